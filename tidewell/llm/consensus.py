"""Consensus of disagreeing annotators by a community confusion model.

Annotators belong to types ("communities") that share confusion matrices; an annotator's own matrix is drawn around
its type's, so one with few labels leans on its type and one with many keeps its own habits. Items have a class and
a level of difficulty. An annotator may echo another: with a probability of its own it repeats that annotator's
label instead of judging, so an echo adds little evidence.

Variational updates alternate between items' posteriors, annotators' matrices (Dirichlet), their types
(Dirichlet-multinomial evidence of their counts), the types' matrices (expected draws, so that prolific annotators
do not swamp a type) and the echoes, until the bound on the evidence stands still. Whom an annotator echoes is
chosen once, after a first fit without echoes: of all annotators with more labels the one with which it agrees most
beyond what the posterior without both labels explains.

Items with the same labels by the same annotators have the same posterior, so items are first collapsed to distinct
label patterns with counts: every round runs over patterns. Patterns and annotators stay distributed; only the
types' matrices and the shares of the states (types x states x classes numbers) pass through the driver.

Defined results: unusable or null labels, null annotators and items whose every label is unusable are left
out; repeated rows count once; of an annotator's labels on one item the earliest usable one counts (null time
last, then label order); nulls inside an item's fields are kept as values; an empty table gives empty results;
equal posteriors go to the class named first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut, drop


def digamma(x):
    """Asymptotic series after six recurrence steps; error below 1e-9 for x > 0."""
    y = x + 6.0
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))


def log_gamma(x):
    """Stirling's series after six recurrence steps; error below 1e-8 for x > 0."""
    y = x + 6.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - sum(np.log(x + i) for i in range(6))


def usable_labels(rows: DataFrame, item: list[str], annotator: str, label: Column, time: Column, classes: list[str]) -> DataFrame:
    """One row per (item, annotator), the item as a struct: ``label`` is the class index of the earliest usable label."""
    clean = F.regexp_replace(F.upper(F.trim(F.regexp_replace(label, r"\s+", " "))), r"[.\s]+$", "")
    index = F.array_position(F.array(*[F.lit(c.upper()) for c in classes]), clean).cast("int") - 1
    flat = rows.select(F.struct(*[F.col(c) for c in item]).alias("item"), F.col(annotator).alias("annotator"), index.alias("label"), F.struct(time.isNull(), time, index).alias("at"))
    return flat.where("label >= 0 and annotator is not null").groupBy("item", "annotator").agg(F.min_by("label", "at").alias("label"))


def _update(k: int, mean: np.ndarray, rho: np.ndarray, shares: np.ndarray, strength: float):
    """Annotators' types and own matrices from their expected counts. ``mean``: type, state, label."""
    m, s, _ = mean.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = strength * mean[None]
        for b in batches:
            n = np.stack([np.asarray(x, dtype=float) for x in b["n"]]).reshape(-1, 1, s, k)
            ev = (log_gamma(around.sum(3)) - log_gamma(around.sum(3) + n.sum(3)) + (log_gamma(around + n) - log_gamma(around)).sum(3)).sum(2)
            r = np.log(rho) + ev
            r = np.exp(r - r.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            draws = r[:, :, None, None] * around * (digamma(around + n) - digamma(around))
            own = np.einsum("am,msk->ask", r, around[0]) + n[:, 0]
            expect = digamma(own) - digamma(own.sum(2, keepdims=True))
            rows = len(b)
            echo = np.where(b["met"] > 0, (b["echoed"] + 0.5) / (b["met"] + 10.0), 0.0) if b["sourced"].any() else np.zeros(rows)
            yield pd.DataFrame({
                "annotator": b["annotator"], "total": b["total"], "echo": echo, "e": list(expect.reshape(rows, -1)), "c": list((own / own.sum(2, keepdims=True)).reshape(rows, -1)),
                "r": list(r), "draws": list(draws.reshape(rows, -1)), "mass": b["mass"], "bound": b["bound"], "lp": [np.log(shares)] * rows,
            })

    return run


OWN = "annotator string, total double, echo double, e array<double>, c array<double>, r array<double>, draws array<double>, mass array<double>, bound double, lp array<double>"


class Consensus:
    """Fits on construction. ``items``: item columns, consensus, confidence, agreement, votes.
    ``annotators``: annotator, type weights, recalls, reliability, whom it echoes and how often.

    ``checks``: annotators that are automatic checks; they inform the verdict like any other, but are never echoed, and agreement and number of labels leave them out.
    """

    def __init__(self, labels: DataFrame, classes: list[str], *, communities: int = 3, levels: int = 2, strength: float = 10.0, rounds: int = 60, tolerance: float = 1e-5, checks: tuple[str, ...] = ()):
        k, m, s = len(classes), communities, len(classes) * levels
        self.k, self.s, self.checks, self.rounds = k, s, list(checks), 0
        spark = labels.sparkSession
        sets = cut(labels.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes")), "sets")
        pid = F.unhex(F.sha2(F.to_json("votes"), 256)).alias("pid")
        patterns = sets.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
        share = [F.expr(f"(size(filter(votes, v -> v.label = {c})) + 0.5D) / (size(votes) + {0.5 * k}D)") for c in range(k)]
        # Patterns whose annotators disagree start out as rather difficult.
        split = 1 - sum((x * x for x in share), F.lit(0.0))
        hard = [1 - split * (levels - 1) / levels if d == 0 else split / levels for d in range(levels)]
        start = F.array(*[share[c] * hard[d] for c in range(k) for d in range(levels)]).alias("q")
        votes = cut(patterns.select(pid, "n", (F.col("n") / F.size("votes")).alias("w"), start, F.explode("votes").alias("v")).select("pid", "n", "w", "q", "v.annotator", "v.label"), "votes")
        one = F.array(*[F.lit(1.0)] * s)
        counted = votes.select("annotator", "label", "n", "w", "q", one.alias("u"), F.lit(False).alias("met"), F.lit(0.0).alias("bound"))
        votes = votes.drop("q").withColumn("heard", F.lit(None).cast("int"))
        state = [(c, d) for c in range(k) for d in range(levels)]
        # Types start as honest, lenient and strict; difficult items start closer to guessing.
        mean = np.zeros((m, s, k))
        for t in range(m):
            for i, (c, d) in enumerate(state):
                row = np.array([0.75 if lab == c else 0.25 / max(1, k - 1) for lab in range(k)])
                row[0] += 0.25 * (t % 3 == 1)
                row[k - 1] += 0.25 * (t % 3 == 2)
                mean[t, i] = (1 - d / levels) * row / row.sum() + d / levels / k
        prior = np.array([[3.0 if lab == c else 1.0 for lab in range(k)] for c, _ in state])
        rho, shares, before, sources, spare = np.full(m, 1.0 / m), np.full(s, 1.0 / s), None, False, []
        totals = [F.sum(F.col(a)[i]).alias(f"{a}{i}") for a, size in (("draws", m * s * k), ("r", m), ("mass", s)) for i in range(size)] + [F.sum("bound").alias("bound")]
        self._build()
        for step in range(rounds):
            self.rounds = step + 1
            own = cut(self._counts(counted, sources).mapInPandas(_update(k, mean, rho, shares, strength), OWN), "annotators")
            sums = own.agg(*totals).first()
            if sums["mass0"] is None:
                post = self._posterior(votes, own)
                break
            mean = np.array([sums[f"draws{i}"] for i in range(m * s * k)]).reshape(m, s, k) + prior
            mean /= mean.sum(2, keepdims=True)
            rho = (np.array([sums[f"r{i}"] for i in range(m)]) + 1.0) / (sum(sums[f"r{i}"] for i in range(m)) + m)
            shares = np.array([sums[f"mass{i}"] for i in range(s)]) + 1.0
            shares /= shares.sum()
            post = self._posterior(votes, own)
            # Echoes are sought as soon as the first fit is roughly settled, before levels of difficulty take their place.
            still = step > 1 and before is not None and abs(sums["bound"] - before) < tolerance * (1 if sources else 100) * abs(sums["bound"])
            before = sums["bound"]
            if still and sources:
                break
            if still or not sources and step == rounds // 2:
                votes, sources, before = self._echoes(votes, own), True, None
                self.sources = votes.where("source is not null").select("annotator", "source").distinct()
                own = own.drop("echo").join(votes.groupBy("annotator").agg(F.max("first_echo").alias("echo")), "annotator")
                post = self._posterior(votes, own)
            counted = post.select(F.explode("who").alias("v"), "n", "w", "q", "bound").select("v.annotator", "v.label", "n", "w", "q", "v.u", "v.met", "bound")
            spare.append(own)
            if len(spare) > 3:  # two rounds back nothing reads it any more
                drop(spark, spare.pop(0))
        self.shares, self.types = shares, mean
        q = F.array(*[sum((F.col("q")[i] for i, (c, _) in enumerate(state) if c == want), F.lit(0.0)) for want in range(k)])
        names = F.array(*[F.lit(c) for c in classes])
        joined = sets.withColumn("pid", pid).join(post.select("pid", q.alias("q")), "pid")
        said = joined.withColumn("best", F.expr("array_position(q, array_max(q))").cast("int") - 1).withColumn("votes", F.filter("votes", lambda v: ~v["annotator"].isin(self.checks)) if checks else F.col("votes"))
        n = F.size("votes")
        same = F.when(n > 0, F.expr("size(filter(votes, v -> v.label = best))") / n)
        pairs = F.expr(" + ".join(f"pow(size(filter(votes, v -> v.label = {c})), 2)" for c in range(k)))
        self.items = said.select("item.*", F.element_at(names, F.col("best") + 1).alias("consensus"), F.array_max("q").alias("confidence"), same.alias("agreement"),
                                 F.when(n > 1, (pairs - n) / (n * (n - 1))).alias("pair_agreement"), n.alias("n_labels"))
        recall = [sum((F.col("c")[i * k + c] * float(shares[i]) for i, (w, _) in enumerate(state) if w == c), F.lit(0.0)) for c in range(k)]
        weight = [float(sum(shares[i] for i, (w, _) in enumerate(state) if w == c)) for c in range(k)]
        told = own.select("annotator", sum(recall, F.lit(0.0)).alias("reliability"), *[(recall[c] / weight[c]).alias(f"recall_{classes[c].lower()}") for c in range(k)],
                          F.col("total").alias("n_labels"), F.col("r").alias("type_weights"), F.col("echo").alias("echo_share"))
        self.annotators = told.join(self.sources, "annotator", "left") if sources else told.withColumn("source", F.lit(None).cast("string"))

    def _build(self) -> None:
        """The expressions of a round, made once; parameters come as columns, so the plan is the same in every round."""
        k, s = self.k, self.s
        cells = [F.sum(F.when(F.col("label") == lab, F.col("n") * F.col("q")[i] * F.col("u")[i]).otherwise(0.0)) for i in range(s) for lab in range(k)]
        mass = [F.sum(F.col("w") * F.col("q")[i]) for i in range(s)]
        echoed = sum((F.col("q")[i] * (1 - F.col("u")[i]) for i in range(s)), F.lit(0.0))
        self._sums = [F.array(*cells).alias("n"), F.array(*mass).alias("mass"), F.sum("n").alias("total"), F.sum(F.col("n") * echoed).alias("echoed"), F.sum(F.col("met").cast("double") * F.col("n")).alias("met"), F.sum(F.col("w") * F.col("bound")).alias("bound")]
        free = F.col("heard").isNull()
        self._p = F.array(*[F.exp(F.element_at("e", F.col("label") + (i * k + 1))) for i in range(s)])
        same = (F.col("label") == F.col("heard")).cast("double")
        self._whole = F.when(free, F.col("p")).otherwise(F.transform("p", lambda x: F.col("echo") * same + (1 - F.col("echo")) * x))
        self._own = F.when(free, F.transform("p", lambda x: F.lit(1.0))).otherwise(F.zip_with("p", "whole", lambda x, y: F.when(y > 0, (1 - F.col("echo")) * x / y).otherwise(F.lit(1.0))))
        log_p = [(F.sum(F.log(F.greatest(F.col("whole")[i], F.lit(1e-300)))) + F.max(F.col("lp")[i])).alias(f"l{i}") for i in range(s)]
        self._scores = [F.collect_list(F.struct("annotator", "label", "u", (~free).alias("met"))).alias("who"), *log_p]
        self._l = F.array(*[F.col(f"l{i}") for i in range(s)]).alias("l")
        top = F.array_max("l")
        z = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        self._q, self._bound = F.transform("l", lambda x: F.exp(x - F.col("bound"))).alias("q"), (top + F.log(z)).alias("bound")

    def _counts(self, counted: DataFrame, sources: bool) -> DataFrame:
        """Per annotator: expected labels of its own per state, echoes, and its part of the states' shares and the bound."""
        return counted.groupBy("annotator").agg(*self._sums).withColumn("sourced", F.lit(sources))

    def _posterior(self, votes: DataFrame, own: DataFrame) -> DataFrame:
        """Per pattern: who said what, the chance that it was no echo, the posterior of each state and the evidence."""
        seen = votes.select("pid", "n", "w", "annotator", "label", "heard").join(own.select("annotator", "e", "lp", "echo"), "annotator")
        seen = seen.withColumn("p", self._p).withColumn("whole", self._whole).withColumn("u", self._own)
        scored = seen.groupBy("pid", "n", "w").agg(*self._scores).withColumn("l", self._l)
        return scored.withColumn("bound", self._bound).select("pid", "n", "w", "who", self._q, "bound", "l")

    def _echoes(self, votes: DataFrame, own: DataFrame) -> DataFrame:
        """``votes`` with ``source``, ``heard`` (the source's label on the same items) and ``first_echo``.

        For every two annotators of a pattern, how often they agree is set against how often they would by the
        posterior without both. Pairs are formed inside a pattern, of at most one label per annotator.
        """
        k, s = self.k, self.s
        held = votes.select("pid", "n", "annotator", "label").join(own.select("annotator", "e", "c", "total"), "annotator").join(self._posterior(votes, own).select("pid", "l"), "pid")
        held = cut(held.select("pid", "n", "annotator", "label", "c", "l", F.struct((-F.col("total")).alias("t"), "annotator").alias("place"), F.array(*[F.element_at("e", F.col("label") + (i * k + 1)) for i in range(s)]).alias("own")), "held")
        x = held.select("pid", "n", *[F.col(c).alias(f"{c}_x") for c in ("annotator", "label", "place", "own", "c")], "l")
        y = held.select("pid", *[F.col(c).alias(f"{c}_y") for c in ("annotator", "label", "place", "own")])
        both = x.join(y, "pid").where("place_y < place_x").where(~F.col("annotator_y").isin(self.checks))
        rest = [F.col("l")[i] - F.col("own_x")[i] for i in range(s)]  # with the source's label, without the annotator's
        top = F.greatest(*rest)
        w = [F.exp(r - top) for r in rest]
        chance = sum((wi * F.element_at("c_x", F.col("label_y") + (i * k + 1)) for i, wi in enumerate(w)), F.lit(0.0)) / sum(w, F.lit(0.0))
        agree = (F.col("label_x") == F.col("label_y")).cast("double")
        sums = both.groupBy("annotator_x", "annotator_y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * agree).alias("agreed"), F.sum(F.col("n") * chance).alias("chance"))
        excess = (F.col("agreed") - F.col("chance")) / (F.col("n") - F.col("chance") + 10.0)
        best = sums.withColumn("x", excess).where("x > 0").groupBy(F.col("annotator_x").alias("annotator")).agg(F.max(F.struct("x", "annotator_y")).alias("b")).select("annotator", F.col("b.annotator_y").alias("source"), F.least("b.x", F.lit(0.9)).alias("first_echo"))
        heard = votes.select("pid", F.col("annotator").alias("source"), F.col("label").alias("heard"))
        return cut(votes.drop("heard").join(best, "annotator", "left").join(heard, ["pid", "source"], "left").select("pid", "n", "w", "annotator", "label", "source", "first_echo", "heard"), "votes")
