"""Text expressions: hashes, normal forms, tokens and set similarity (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content or only time.
STOP_WORDS = ["a", "an", "the", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "and", "or", "what", "who", "when", "where", "which", "how", "did", "do", "does", "now", "today", "current", "latest", "right"]


def short_hash(text: Column, digits: int) -> Column:
    """First hex digits of the SHA-256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, digits)


# Parts of a page that change without the page changing, blanked in this order.
VOLATILE = (
    r"\d{4}-\d{2}-\d{2}([t ]\d{2}:\d{2}(:\d{2})?)?", r"\d{1,2}:\d{2}(:\d{2})?", r"\d+ (second|minute|hour|day|week|month|year)s? ago", r"\d+(초|분|시간|일|주|개월|년) 전",
    r"\d[\d,]* (views|shares|comments|reactions|likes)", r"(조회수|댓글|좋아요|공유) ?\d[\d,]*", r"(last )?updated:? .{0,40}", r"copyright .{0,40}", r"session id:? \w+", r"page generated .{0,40}",
)


def normal_text(text: Column) -> Column:
    """Lower case, volatile parts (times, dates, counters) blanked, white space single."""
    s = F.lower(text)
    for pattern in VOLATILE:
        s = F.regexp_replace(s, pattern, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# Elements that hold no text of a page, and common entities.
DROPPED = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg", "button")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and page furniture out with what they hold, tags out, entities read, white space single."""
    s = html
    for pattern in (r"(?s)<!--.*?-->", *(rf"(?is)<{tag}(\s[^<>]*)?>.*?</{tag}\s*>" for tag in DROPPED), r"(?s)</?[a-zA-Z][^<>]*>"):
        s = F.regexp_replace(s, pattern, " ")
    for name, sign in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of Latin letters and digits, or of Hangul."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[가-힣]+"), 0)


def content_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def language(text: Column) -> Column:
    """``ko`` if more than a fifth of the letters are Hangul."""
    hangul, letters = F.length(F.regexp_replace(text, "[^가-힣]", "")), F.length(F.regexp_replace(text, "[^A-Za-z가-힣]", ""))
    return F.when(hangul > 0.2 * letters, "ko").otherwise("en")
