"""Template residue and error-page text by positive-unlabelled naive Bayes with expectation-maximisation.

Passages (lines and sentences) are scored, records decided by their passages. Trusted positives are passages of
short records delivered with an error status, on two hosts and in ``usual`` of these records at least, that are not
common elsewhere, and short passages with a fixed error or filler cue or a
placeholder standing alone; all others are unlabelled. Words, word pairs and line ends are features, hashed into
a fixed number of buckets, so that the model has a proven size and may be broadcast. Placeholders inside a
sentence are judged one by one by their neighbouring words, against trusted sentences that write about templates;
a word of such sentences lowers the prior of their slots and decides nothing alone.

Only fitting reads a bounded sample of distinct passages (``sample``); counts per passage and scores cover all.

Defined results: null and blank texts are never found; repeated texts are scored once and decided alike; very
long texts are scored whole; an empty table gives no rows; with no trusted record nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.llm.pages import DOC
from tidewell.session import cut

# How templates write a slot, how fillers begin, words of sentences about templates.
SLOTS = (
    r"\{\{[^{}\n]+\}\}", r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"<%[^%>\n]+%>", r"\{%[^%{}\n]+%\}", r"\[\[[^\[\]\n]+\]\]",
    r"@@[\w.]+@@", r"__[a-zA-Z][\w.]*?__", r"<<[^<>\n]+>>", r"\[INSERT [^\]\n]+\]", r"\[[\w. ]+ here\]", r"\{\d{1,2}\}", r"\{[a-z_.]{2,}\}", r"%[A-Za-z_]{3,}%", r"%\([\w.]+\)s",
)
FILLER = r"^lorem ipsum\b|^sample text\b|\b(goes|comes) here\b|^insert .{1,60} here\b|^todo:|\bcontent placeholder\b|여기에 .{0,40}입력|입력해 주세요\.?$"
# Short passages that are error messages wherever they stand; numbers are 0.
ERRORS = (
    r"^(error )?0\b.{0,4}(not found|forbidden|bad gateway|internal server error|service unavailable|unauthorized|gateway time-?out)|^(page|article|file) (was )?not found|this page (does not|doesn't) exist|^too many requests|^access denied|^request timed out"
    r"|(enable|turn on|allow|requires?) (javascript|scripts|cookies)|javascript is (disabled|off|required)|scripts are (switched|turned) off|verify that you are human|^checking your browser|could not be (found|located)|under maintenance|^<(fault|error)>|^\{.error"
    r"|찾을 수 없습니다|점검 중입니다|접근 권한이 없|로봇이 아님|자바스크립트를 (사용|켜|허용)"
)
ABOUT = r"\b(template|templates|manual|brackets|braces|renderer|syntax|markup|stands for|guide explains)\b|템플릿|괄호|자리표시|중괄호|치환|설명서"

SLOT = r"(?=[{$#<\[@_%])(?:" + "|".join(SLOTS) + ")"  # what begins a slot is looked at first
BUCKETS = 1 << 18


def passages(texts: DataFrame) -> DataFrame:
    """(doc, size, status, host, passage): lines cut at sentence ends; slots become one mark, the host's name another."""
    slots = F.when(F.col("text").rlike(r"[{}\[\]@%<]|__"), F.regexp_replace("text", SLOT, " ⟦⟧ ")).otherwise(F.col("text"))
    label = brand_label(F.col("host"))
    named = (F.length(label) >= 3) & F.translate(F.lower("text"), " -", "").contains(label)
    flat = F.when(named, F.regexp_replace(slots, brand_pattern(F.col("host")), "ⓗ")).otherwise(slots)
    parts = F.split(flat, r"\n|(?<=[.!?。]) +")
    return texts.select(*DOC, "status", "host", F.explode(parts).alias("p")).select(*DOC, "status", "host", F.trim(F.lower(F.regexp_replace("p", r"[\s ]+", " "))).alias("passage")).where("passage <> ''")


def _cued(passage: Column) -> Column:
    """A fixed filler cue, or a fixed error cue in a passage of ten words or less without quotes; the long patterns run on short passages alone."""
    brief = F.length(passage) <= 120
    error = (F.size(F.split(passage, " ")) <= 10) & passage.rlike(ERRORS) & ~passage.rlike("[\"'“”‘’](?!t )")
    return passage.startswith("lorem ipsum ") | brief & (passage.rlike(FILLER) | error)


def brand_label(host: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(host, ".", 1), r"[^\p{L}\p{N}]+", ""))


def brand_pattern(host: Column) -> Column:
    """Matches the host's own name however it is spaced or cased."""
    label = brand_label(host)
    return F.when(F.length(label) < 3, F.lit(r"(?!)")).otherwise(F.concat(F.lit(r"(?i)\b"), F.regexp_replace(label, r"(.)(?=.)", r"$1[ -]?"), F.lit(r"\b")))


def with_features(df: DataFrame, passage: str) -> DataFrame:
    """``df`` with ``features``: hashed words and pairs; words are split once, in a step of their own."""
    words = F.filter(F.split(passage, r"[\s\p{Punct}·•…“”‘’]+"), lambda w: w != "")
    split = df.withColumn("_words", words).withColumn("_ends", F.concat(F.array(F.lit("^")), "_words", F.array(F.lit("$"))))
    pairs = F.zip_with(F.slice("_ends", F.lit(1), F.size("_ends") - 1), F.slice("_ends", F.lit(2), F.size("_ends")), lambda a, b: F.concat(a, F.lit(" "), b))
    return split.withColumn("features", F.transform(F.concat("_words", pairs), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))).drop("_words", "_ends")


class NaiveBayes:
    """Two-class model over hashed features, smoothed towards the whole, fitted by expectation-maximisation.

    ``data``: features array<int>, n (records with the passage), prior (belief that it is positive, before its words).
    """

    def __init__(self, data: DataFrame, *, rounds: int = 4, smooth: float = 0.05, discount: float = 1.0):
        self.weights = np.zeros(BUCKETS)
        started = False
        for _ in range(rounds):
            belief = self.belief(data) if started else F.col("prior")
            held = data.select("features", (F.col("n") * belief).alias("pos"), "n")
            sums = held.select(F.explode("features").alias("f"), "pos", "n").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
            pos, whole = np.zeros(BUCKETS), np.zeros(BUCKETS)
            pos[sums.f.to_numpy(dtype=int)], whole[sums.f.to_numpy(dtype=int)] = sums.pos, sums.n
            neg = np.maximum(whole - pos - discount, 0)
            pos = np.maximum(pos - discount, 0)  # a feature seen once proves nothing
            base = (whole + 0.5) / (whole.sum() + 0.5 * BUCKETS)
            share = lambda x: ((1 - smooth) * x / x.sum() if x.sum() > 0 else 0.0) + smooth * base
            self.weights = np.log(share(pos)) - np.log(share(neg)) if pos.sum() > 0 else np.zeros(BUCKETS)
            started = True

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``llr``, the log-likelihood ratio of its features."""
        kept = df.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32))
        fields = StructType([*df.schema.fields, StructField("llr", DoubleType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sizes = b["features"].map(len).to_numpy()
                flat = np.concatenate([*b["features"], [0]]).astype(int)
                ends = np.concatenate([[0], np.cumsum(kept.value[flat][: sizes.sum()].astype(float))])
                at = np.cumsum(sizes)
                yield b.assign(llr=ends[at] - ends[at - sizes])

        return df.mapInPandas(run, fields)

    def belief(self, data: DataFrame) -> Column:
        kept = data.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32))

        @F.pandas_udf("double")
        def posterior(feats: pd.Series, prior: pd.Series) -> pd.Series:
            p = prior.clip(1e-9, 1 - 1e-9)
            llr = np.array([float(kept.value[np.asarray(x, dtype=int)].sum()) if len(x) else 0.0 for x in feats])
            return pd.Series(1 / (1 + np.exp(-np.clip(llr + np.log(p / (1 - p)).to_numpy(), -50, 50))))

        return posterior("features", "prior")


def _sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen in proportion to ``n`` (common passages always are); ``n`` then stands for all."""
    total = df.agg(F.sum("n")).first()[0] or 1.0
    share = F.least(F.lit(1.0), F.col("n") * (bound / total))
    kept = df.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1_000_000)) < share * 1_000_000)
    return kept.withColumn("n", F.col("n") / share)


def residue_docs(texts: DataFrame, *, trusted_size: int = 500, common: float = 2.0, usual: float = 0.002, prior: float = 0.001, sample: int = 200_000) -> DataFrame:
    """(doc, size) of the texts in which a passage is an error message, a notice, filler or an unfilled slot."""
    trusted = (F.col("status") >= 400) & (F.col("size") <= trusted_size)
    each = cut(passages(texts), "each")
    one = each.groupBy("passage").agg(F.count("*").alias("n"), F.sum(trusted.cast("int")).alias("t"), F.min(F.when(trusted, F.col("host"))).alias("h1"), F.max(F.when(trusted, F.col("host"))).alias("h2"))
    least = max(2.0, usual * texts.where(trusted).count())
    seed = (F.col("t") >= least) & (F.col("h1") != F.col("h2")) & (F.col("n") - F.col("t") <= common * F.col("t")) | _cued(F.col("passage"))
    slot = F.col("passage").contains("⟦⟧")
    known = cut(with_features(one.select("passage", F.xxhash64("passage").alias("pid"), "n", seed.alias("seed"), slot.alias("slot")), "passage"), "passages")

    plain = known.where(~F.col("slot")).select("pid", "features", F.col("n").cast("double"), "seed")
    fit = cut(_sampled(plain.where("seed"), "pid", sample).unionByName(_sampled(plain.where("not seed"), "pid", sample)).select("features", "n", F.when(F.col("seed"), 0.9).otherwise(prior).alias("prior")), "fit")
    bayes = NaiveBayes(fit)
    bad = bayes.score(plain.select("pid", "features")).where(F.col("llr") > float(np.log((1 - prior) / prior))).select("pid")

    # A slot with the two words on either side of it, and whether it stands (nearly) alone or in a sentence about templates.
    around = F.explode(F.regexp_extract_all("passage", F.lit(r"(?:[^\s⟦⟧]+\s+){0,2}⟦⟧(?:\s*[^\s⟦⟧]+){0,2}"), 0))
    words = F.size(F.split("passage", r"\s+"))
    # Such a sentence writes about one slot; a further one in it may well be a left-over.
    many = F.size(F.split("passage", "⟦⟧")) > 2
    about = F.when(many, 0.2).otherwise(0.02)
    near = known.where("slot").select("pid", "n", F.when(F.col("passage").rlike(ABOUT), about).when(words <= 4, 0.98).otherwise(0.9).alias("prior"), around.alias("w"))
    near = cut(with_features(near.select("pid", F.col("n").cast("double"), "prior", "w"), "w").drop("w"), "slots")
    slots = NaiveBayes(_sampled(near, "pid", sample))
    odds = F.log(F.col("prior") / (1 - F.col("prior")))
    unfilled = slots.score(near).where(F.col("llr") + odds > 0).select("pid")
    found = cut(bad.unionByName(unfilled).distinct(), "found")
    return each.select(*DOC, F.xxhash64("passage").alias("pid")).join(found, "pid", "left_semi").select(*DOC).distinct()
