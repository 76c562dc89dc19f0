"""URL expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that do not identify a page.
TRACKING = "^(utm_|ref=|source=|fbclid=)"


def canonical_url(url: Column | str) -> Column:
    """Lower case, no fragment, no tracking parameters, no trailing slash; null stays null."""
    u = F.substring_index(F.trim(F.lower(F.col(url) if isinstance(url, str) else url)), "#", 1)
    path = F.substring_index(u, "?", 1)
    params = F.filter(F.split(F.substring(u, F.length(path) + 2, F.length(u)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(params, "&")
    return F.rtrim(F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query)), F.lit("/"))


def domain(url: Column | str) -> Column:
    """Lower-cased authority without a leading ``www.``; the port stays."""
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.lower(F.regexp_extract(u, "://([^/?#]*)", 1)), r"^www\.", "")
