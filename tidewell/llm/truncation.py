"""Text values cut off by field limits or in mid-transfer.

First stage, ``field_limit``: per source, histograms of the lengths in characters and in bytes are tested for spikes,
a length that holds several times as many values as the lengths around it; values at a spike that end neither a
sentence nor a set phrase were cut by the limit.

Second stage, ``mid_transfer``: what breaks off elsewhere has no length in common, so the last segment is looked at: a
remnant (half a character, tag or entity, an opening bracket) or an unfinished sentence is flagged, a heading, list
line, link, sign-off or set phrase is not. What counts as a set phrase or a heading is learned from all texts: a set
phrase stands on its own nearly whenever its first words occur; a heading ends as lines inside other texts end, with
words that more often end lines than go on, or begins as mostly headings do.

Defined results: null, empty and blank texts are never flagged; repeated texts are counted once for learning and
all flagged alike, as are rows that repeat an id; a null source is the source ""; ties between lengths do not matter; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut

# Marks that follow a cut, remnants of one, ends of sentences, links.
MARKS = r"(?i)(?:\s*(?:\.\.\.|…|\[\.\.\.\]|\(more\)|\bread more|\bcontinue reading|더 ?보기|\(계속\)))+\s*$"
REMNANT = r"(?:\x{FFFD}+|<[A-Za-z/!][^<>\n]{0,40}|<|&#?[A-Za-z0-9]{0,7}|[(\[{])\s*$"
TERMINAL = r"[.!?。！？]['\"”’)\]」』]*$"
LINK = r"https?://[\w.-]+(/[\w./?=&%-]*)?$"
FIRST = 8  # beginnings of segments are counted up to so many words; longer set phrases by these and as wholes


def _unmarked(text: Column) -> Column:
    """Without the marks of a cut; the long pattern runs only where the end may be one."""
    return F.when(F.substring(text, -24, 24).rlike(r"(?i)(\.\.\.|…|\)|\]|more|reading|보기)\s*$"), F.regexp_replace(text, MARKS, "")).otherwise(text)


def _skeleton(text: Column) -> Column:
    """Names and numbers masked, spaces single, marks of a cut removed."""
    s = F.regexp_replace(_unmarked(text), r"[A-Z][\p{L}\p{M}'-]*", "N")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[0-9]+([.,:][0-9]+)*", "0"), r"\s+", " "))


def _last(words: Column, k: int) -> Column:
    return F.array_join(F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k), " ")


def _inside(bare: Column, korean: Column) -> list[Column]:
    """Keys of the runs of three words, and of the Korean words, of ``bare``; slices beside one another, so the work stays linear in its words."""
    n = F.greatest(F.size(bare) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(bare, F.lit(1), n), F.slice(bare, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    threes = F.zip_with(pairs, F.slice(bare, F.lit(3), n), lambda a, b: F.xxhash64(F.lit("in"), F.concat(a, F.lit(" "), b)))
    return [threes, F.when(korean, F.transform(F.filter(bare, lambda x: x.rlike(r"[가-힣]")), lambda x: F.xxhash64(F.lit("in"), x))).otherwise(F.expr("cast(array() as array<bigint>)"))]


def length_spikes(docs: DataFrame, *, ratio: float = 3.0, least: int = 6, around: int = 12) -> DataFrame:
    """(source, unit, length, values): lengths that hold ``ratio`` times as many values as the mean of the lengths around them."""
    units = docs.select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "length"))
    hist = units.groupBy("source", "unit", "length").agg(F.count("*").alias("values"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-around, around)
    tested = hist.withColumn("others", (F.sum("values").over(near) - F.col("values")) / (2.0 * around))
    return tested.where((F.col("values") >= least) & (F.col("values") >= ratio * F.greatest(F.col("others"), F.lit(1.0)))).select("source", "unit", "length", "values")


def truncated(documents: DataFrame, *, title: float = 0.5) -> DataFrame:
    """(doc_id, source, cut, stage): every document with some text, whether it was cut off and which stage found it.

    ``title``: the share from which last words count as those of a heading, or first words as those of one.
    """
    text = F.rtrim(F.col("text"), F.lit(" \t\r\n\f\u00a0\u3000"))
    base = documents.select("doc_id", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), F.col("text").alias("whole"), text.alias("t")).where("t <> ''")
    docs = base.select("doc_id", "source", "whole", "t", F.length("whole").alias("chars"), F.octet_length("whole").alias("bytes"), F.struct(F.xxhash64("whole"), F.hash("whole")).alias("h"))

    # All segments of all distinct texts: sentences of lines, the last line apart.
    texts = docs.groupBy("h").agg(F.first("t").alias("t"))
    lines = texts.select("h", F.posexplode(F.split("t", r"\n")).alias("at", "line"), (F.size(F.split("t", r"\n")) - 1).alias("end"))
    segments = lines.select((F.col("at") < F.col("end")).alias("inner"), F.posexplode(F.split("line", r"(?<=[.!?。])\s+")).alias("nth", "seg"))
    words = F.split(_skeleton(F.col("seg")), " ")
    titled = F.col("inner") & (F.col("nth") == 0) & ~F.substring(F.rtrim("seg"), -12, 12).rlike(TERMINAL)  # a line inside a text that ends no sentence
    segments = segments.select((F.col("nth") == 0).alias("alone"), titled.alias("titled"), F.col("seg").rlike(r"[가-힣]").alias("ko"), words.alias("w"))
    followed = F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x: F.rtrim(x, F.lit(",;:")))
    segments = segments.select("alone", "titled", "ko", "w", F.slice("w", 1, FIRST).alias("head"), followed.alias("followed"))
    # One pass for the beginnings of segments and for what their words say before other words.
    no = F.lit(False)
    begun = F.transform(F.expr(f"sequence(1, least(size(w), {FIRST}))"), lambda k: F.struct(F.xxhash64(F.array_join(F.slice("head", F.lit(1), k), " ")).alias("p"), (k == F.size("w")).alias("same"), F.col("alone").alias("alone"), F.col("titled").alias("titled")))
    long = F.when(F.size("w") > FIRST, F.array(F.struct(F.xxhash64(F.array_join("w", " ")).alias("p"), F.lit(True).alias("same"), F.col("alone").alias("alone"), F.col("titled").alias("titled")))).otherwise(F.expr("cast(array() as array<struct<p:bigint,same:boolean,alone:boolean,titled:boolean>>)"))
    inside = [F.transform(runs, lambda e: F.struct(e.alias("p"), no.alias("same"), no.alias("alone"), no.alias("titled"))) for runs in _inside(F.col("followed"), F.col("ko"))]
    # Segments of marks alone say nothing; a filter would be pushed below and split all words again.
    starts = segments.select(F.explode(F.when(F.col("w")[0] != "", F.concat(begun, long, *inside))).alias("s")).select("s.*")
    starts = cut(starts.groupBy("p").agg(F.count("*").alias("starting"), F.sum(F.col("same").cast("int")).alias("same"), F.sum((F.col("same") & F.col("alone")).cast("int")).alias("own_line"), F.sum(F.col("titled").cast("int")).alias("titled")), "starts")
    inner = lines.where("at < end").select("h", F.rtrim("line").alias("line")).where(~F.substring("line", -12, 12).rlike(TERMINAL))
    inner_words = F.split(_skeleton(F.col("line")), " ")
    ends = inner.select(F.explode(F.array(F.xxhash64(_last(inner_words, 3)), F.xxhash64(F.lit("ko"), F.when(_last(inner_words, 1).rlike(r"[가-힣]"), _last(inner_words, 1))))).alias("e"), "h").groupBy("e").agg(F.countDistinct("h").alias("ending"))

    # The last segment of every text, after marks of a cut are taken off.
    bare = F.rtrim(_unmarked(F.col("t")), F.lit(" \t\r\n\f\u00a0\u3000"))
    ending = F.substring_index("t", "\n", -1)
    docs = docs.withColumn("last_line", F.substring_index(bare, "\n", -1))
    tail = F.element_at(F.split("last_line", r"(?<=[.!?。])\s+"), -1)
    tails = docs.select("doc_id", "source", "chars", "bytes", ending.rlike(REMNANT).alias("remnant"), F.col("last_line").rlike(TERMINAL).alias("ended"), tail.alias("tail"), (F.col("last_line") == tail).alias("alone"))
    tails = tails.withColumn("w", F.split(_skeleton(F.col("tail")), " ")).withColumn("n", F.size("w"))
    tails = tails.withColumn("p", F.xxhash64(F.array_join("w", " "))).withColumn("p1", F.when(F.col("n") > 1, F.xxhash64(F.array_join(F.slice("w", 1, F.least(F.col("n") - 1, F.lit(FIRST))), " "))))
    tails = tails.withColumn("e3", F.xxhash64(_last(F.col("w"), 3))).withColumn("e1", F.xxhash64(F.lit("ko"), _last(F.col("w"), 1)))
    tails = tails.withColumn("p3", F.when(F.col("n") > 3, F.xxhash64(F.array_join(F.slice("w", 1, 3), " ")))).withColumn("i3", F.xxhash64(F.lit("in"), _last(F.col("w"), 3))).withColumn("i1", F.xxhash64(F.lit("in"), _last(F.col("w"), 1)))
    open_ = cut(tails.where("remnant or not ended"), "tails")

    judged = open_.join(starts.select("p", "starting", "same", "own_line"), "p", "left").join(starts.select(F.col("p").alias("p1"), F.col("starting").alias("before")), "p1", "left")
    judged = judged.join(ends.select(F.col("e").alias("e3"), F.col("ending").alias("end3")), "e3", "left").join(ends.select(F.col("e").alias("e1"), F.col("ending").alias("end1")), "e1", "left")
    for n in (3, 1):
        judged = judged.join(starts.select(F.col("p").alias(f"i{n}"), F.col("starting").alias(f"inside{n}")), f"i{n}", "left")
    judged = judged.join(starts.select(F.col("p").alias("p3"), (F.col("titled") / F.col("starting")).alias("titles")), "p3", "left")
    spikes = cut(length_spikes(docs.dropDuplicates(["source", "h"])), "spikes")
    at = lambda unit: spikes.where(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}"))
    judged = judged.join(at("chars"), ["source", "chars"], "left").join(at("bytes"), ["source", "bytes"], "left")

    many = F.coalesce("same", F.lit(0))
    # How often the first words occur: those of the phrase itself, or the first FIRST of a longer one.
    starting = F.when(F.col("n") > FIRST, F.col("before")).otherwise(F.col("starting"))
    before = F.when(F.col("n") <= FIRST, F.coalesce("before", F.lit(0))).otherwise(0)
    phrase = F.when(F.col("n") == 1, (many >= 3) & (F.col("own_line") >= 0.25 * many) & (many >= 0.5 * F.col("starting"))).otherwise((many >= 2) & (many >= 0.5 * starting) & (many >= 0.3 * before))
    # Shares, so that the bar stays where it is as texts grow in number: lines that end so among all places that say so, titles among all segments that begin so.
    ending = lambda n: F.coalesce(f"end{n}", F.lit(0)) >= 2
    closes = lambda n: F.col(f"end{n}") >= title * (F.col(f"end{n}") + F.coalesce(f"inside{n}", F.lit(0)))
    latin = ending(3) & (F.col("n") >= 3) & (closes(3) | (F.coalesce("titles", F.lit(0.0)) >= title))
    heading = F.col("alone") & (latin | ending(1) & closes(1) & F.element_at("w", -1).rlike(r"[가-힣]"))
    listed = F.col("alone") & F.col("tail").rlike(r"^(?:[-*•] |\d+[.)] |\|).*\d$|^[-*•] [\p{L} ]+$|^\p{L}+: (?:\S+ ){1,3}[\d,.]*\d$|\|\s*$")
    whole = F.coalesce(phrase, F.lit(False)) | heading | listed | F.col("tail").rlike(LINK)
    spike = F.coalesce("at_chars", "at_bytes", F.lit(False)) & ~F.col("ended")
    stage = F.when(spike & ~F.coalesce(phrase, F.lit(False)), "field_limit").when(F.col("remnant") | ~whole, "mid_transfer")
    decided = judged.select("doc_id", stage.alias("s")).groupBy("doc_id").agg(F.min("s").alias("stage"))
    return docs.select("doc_id", "source").join(decided, "doc_id", "left").select("doc_id", "source", F.col("stage").isNotNull().alias("cut"), "stage")
