"""Main content of pages by line-block distribution.

Markup is stripped and every line gets a mass: its length if it reads as running text and is not a line that the
host repeats on many pages, else nothing. Masses are summed over sliding windows of lines. Where a window's sum rises
above a threshold the text surges, and where the windows after it hold nothing more it dives; what lies between a
surge and its dive is main text, a page may have several such stretches, and all lines outside of them are
furniture, whatever they say. Data lines that go on before a surge or after a dive and the headline above the first
surge are taken in. An exact check takes out lines between the bounds that the host or many hosts repeat, menus and
lists of links. No list of words decides.

How many pages of its host (and how many hosts) have a line is counted over all texts; texts come with every
number as 0.

Defined results: null and blank texts have no lines here; empty lines belong to neither part; a page without
running text has no main text; repeated texts are decided once; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.pages import DOC
from tidewell.session import cut

SPREAD = 0.005  # share of the hosts from which a line is everybody's
WINDOW, SURGE = 3, 25  # lines in a block; characters of running text (a CJK character counts double) that make a surge

BULLET = re.compile(r"^([•·▪‣▶]|\d{1,2}[.)])\s+")
DATA = re.compile(r"^[-*–]\s+\S.*([:(]|\d)|^\S.*\d[\d,.]*, \S.*\d[\d,.]*$|\t|^\|.*\|$")
END = re.compile(r"[.!?。…](['\"”’)\]]*)$")
TAG = re.compile(r"<[^<>\n]{1,200}>")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")


def line_counts(texts: DataFrame) -> DataFrame:
    """(doc, size, seen): for every line, the share of the host's pages and the number of hosts that have it."""
    lines = texts.select(*DOC, "page", F.xxhash64("host").alias("h"), F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    lines = lines.select(*DOC, "page", "h", "line_no", F.trim("l").alias("l")).where("l <> ''").select(*DOC, "page", "h", "line_no", F.xxhash64("l").alias("line"))
    lines = cut(lines, "lines")
    each = lines.groupBy("h", "line").agg(F.countDistinct("page").alias("pages"))
    once = each.where("pages > 1")
    hosts = each.groupBy("line").agg(F.count("*").alias("hosts")).where("hosts > 1")
    own = texts.groupBy(F.xxhash64("host").alias("h")).agg(F.countDistinct("page").alias("all_pages"))
    often = once.join(own, "h").select("h", "line", F.when(F.col("pages") >= 3, F.col("pages") / F.col("all_pages")).otherwise(0.0).alias("share"), "pages")
    seen = lines.drop("page").join(often, ["h", "line"], "left").join(hosts, "line", "left")
    return seen.groupBy(*DOC).agg(F.collect_list(F.struct(F.col("line_no"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("pages", F.lit(1)).alias("pages"), F.coalesce("hosts", F.lit(1)).alias("hosts"))).alias("seen"))


def _words(s: str) -> int:
    return len(s.split()) + len(CJK.findall(s)) // 4


class Look(NamedTuple):
    """What a line looks like by itself."""

    words: int
    sentence: bool
    data: bool
    bullet: bool
    menu: bool


@lru_cache(maxsize=50_000)
def _look(s: str) -> Look:
    words, bullet = _words(s), bool(BULLET.match(s))
    sentence = bool(END.search(s)) and words >= 4
    return Look(words, sentence, not bullet and bool(DATA.search(s)), bullet, not sentence and len(re.split(r"\s[|>/•·]\s|\s{2,}", s)) >= 3)


def stretches(mass: list[int], bridges: list[bool], window: int, surge: int) -> list[tuple[int, int]]:
    """(surge, dive): first and last line of every stretch of text.

    A window of lines whose masses reach ``surge`` begins a stretch at its first line with some; once ``window`` lines
    in a row hold nothing, the last line with some was the dive. ``bridges`` are lines that count neither way.
    """
    out, k, n = [], 0, len(mass)
    while k < n:
        if not mass[k] or sum(mass[k : k + window]) < surge:
            k += 1
            continue
        last, empty, j = k, 0, k + 1
        while j < n and empty <= window:
            if mass[j]:
                last, empty = j, 0
            elif not bridges[j]:
                empty += 1
            j += 1
        out.append((k, last))
        k = last + 1
    return out


def main_lines(text: str, brand: str, seen: dict[int, tuple[float, int, int]], window: int = WINDOW, surge: int = SURGE, *, spread: int = 3, bounds: bool = True) -> set[int]:
    """Numbers (from 0) of the lines of the main text.

    ``spread``: from so many hosts on, a line that is no sentence is everybody's. Without ``bounds`` the exact check
    alone decides (to test what they do).
    """
    lines = [TAG.sub("", x).replace("\u00a0", " ").strip() for x in text.split("\n")]
    full = [i for i, s in enumerate(lines) if s]
    looks = [_look(lines[i]) for i in full]
    repeated, own = [], []
    for i, look in zip(full, looks):
        share, pages, hosts = seen.get(i, (0.0, 1, 1))
        s = lines[i].casefold()
        own.append(len(brand) > 3 and brand[:3] in s and brand in re.sub(r"[\W_]+", "", s))
        often = pages >= 3 and share >= (0.3 if look.sentence else 0.1) or not look.sentence and hosts >= spread
        repeated.append(own[-1] or not look.data and often)
    out = [r or k.menu or k.bullet and not k.sentence for r, k in zip(repeated, looks)]
    mass = [len(lines[i]) + len(CJK.findall(lines[i])) if k.sentence and not k.bullet and not r else 0 for i, k, r in zip(full, looks, repeated)]
    found = stretches(mass, [k.data for k in looks], window, surge)
    if not found:
        return set()
    keep = {x for a, b in (found if bounds else [(0, len(full) - 1)]) for x in range(a, b + 1) if not out[x]}
    for a, b in found:
        for way in (range(b + 1, len(full)), range(a - 1, -1, -1)):
            for x in way:
                if not out[x]:
                    if not looks[x].data:
                        break
                    keep.add(x)
    above = range(min(keep) - 1, -1, -1) if keep else []
    title = next((x for x in above if not out[x]), None)
    if title is None:  # links elsewhere repeat headlines
        title = next((x for x in above if not (own[x] or looks[x].menu or looks[x].bullet) and looks[x].words >= 4 - 2 * bool(CJK.search(lines[full[x]])) and seen.get(full[x], (0.0, 1, 1))[0] < 0.5), None)
    return {full[x] for x in keep} | ({full[title]} if title is not None else set())


def content_lines(texts: DataFrame) -> DataFrame:
    """(doc, size, line_no, main): every non-empty line of every text, numbered from 1."""
    both = texts.select(*DOC, "host", "text").join(line_counts(texts), DOC)
    spread = max(3, round(SPREAD * texts.select("host").distinct().count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs, sizes, nos, mains = [], [], [], []
            for doc, size, host, text, seen in zip(b.doc, b["size"], b.host, b.text, b.seen):
                brand = re.sub(r"[\W_]+", "", host.split(".")[0].casefold())
                keep = main_lines(text, brand, {x["line_no"]: (x["share"], x["pages"], x["hosts"]) for x in seen}, spread=spread)
                for i, s in enumerate(text.split("\n")):
                    if s.strip():
                        docs.append(doc), sizes.append(size), nos.append(i + 1), mains.append(i in keep)
            yield pd.DataFrame({"doc": docs, "size": sizes, "line_no": nos, "main": mains})

    return both.mapInPandas(run, "doc long, size int, line_no int, main boolean")
