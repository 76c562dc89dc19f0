"""Cosine neighbours of a stated query set by blocks of vectors.

Exact search: rows and queries are gathered into blocks; every query block meets every row block once, as a matrix
product inside a task, and only the best ``k`` of each pair of blocks (or counts and the best one) leave it. The query
set is a fixed share of the rows, stated by the caller.

Indexed search: a coarse quantiser, fitted on a bounded sample, gives every row a cell; a query meets the rows of the
cells nearest to it alone, and these are ranked exactly.

Defined results: null vectors and vectors of zero length match nothing; a row is no neighbour of itself; equal
similarities go to the smaller id; similarities are rounded to 6 digits before ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _blocks(vectors: DataFrame, prefix: str, size: int) -> DataFrame:
    n = max(1, vectors.count())
    count = -(-n // size)
    placed = vectors.where("vec is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    rows = F.collect_list(F.struct("id", "vec", label.cast("string").alias("label")))
    return placed.groupBy("block").agg(rows.alias("r")).select(*[F.col(f"r.{c}").alias(f"{prefix}_{n}") for c, n in (("id", "ids"), ("vec", "vecs"), ("label", "labels"))])


def _unit(vecs) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vecs])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _pairs_of_blocks(queries: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """One row per query block and row block; the number of tasks grows with that of the pairs."""
    q, r = _blocks(queries, "q", block), _blocks(rows, "r", block)
    return q.crossJoin(r).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // block)))


def neighbour_counts(queries: DataFrame, rows: DataFrame, *, least: float, prior_only: bool = False, recent: int = 5000, block: int = 2048) -> DataFrame:
    """(query_id, n, best, best_id, n_recent, n_same): how many rows of similarity ``least`` or more a query has, the
    nearest (the smaller id on ties), how many of the rows lie among the ``recent`` ids before it and how many share its ``label``.

    Counts leave a task, not pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, ql, ri, rv, rl in zip(b.q_ids, b.q_vecs, b.q_labels, b.r_ids, b.r_vecs, b.r_labels):
                qi, ri, q, r = np.asarray(qi), np.asarray(ri), _unit(qv), _unit(rv)
                order = np.argsort(ri)
                ri, r, rl = ri[order], r[order], np.asarray(rl, dtype=object)[order]
                same = np.array([[x is not None and x == y for y in rl] for x in ql]) if any(x is not None for x in ql) else np.zeros((len(qi), len(ri)), dtype=bool)
                sim = np.round(q @ r.T, 6)
                ok = (sim >= least) & (qi[:, None] != ri[None, :]) & q.any(1)[:, None] & r.any(1)[None, :]
                if prior_only:
                    ok &= ri[None, :] < qi[:, None]
                masked = np.where(ok, sim, -9.0)
                top = masked.argmax(1)
                some = ok.any(1)
                yield pd.DataFrame({"query_id": qi, "n": ok.sum(1), "best": masked.max(1), "best_id": ri[top], "n_recent": (ok & (ri[None, :] < qi[:, None]) & (ri[None, :] >= qi[:, None] - recent)).sum(1), "n_same": (ok & same).sum(1)})[some]

    part = _pairs_of_blocks(queries, rows, block).mapInPandas(run, "query_id long, n long, best double, best_id long, n_recent long, n_same long")
    best = F.max(F.struct("best", (-F.col("best_id")).alias("i"))).alias("b")
    return part.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_recent", "n_same")], best).select("query_id", "n", "b.best", (-F.col("b.i")).alias("best_id"), "n_recent", "n_same")


class CellIndex:
    """Rows by cells of a coarse quantiser fitted on about ``sample`` of them; every row is indexed."""

    def __init__(self, rows: DataFrame, *, cells: int | None = None, sample: int = 50_000, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        some = rows.where("vec is not null and exists(vec, x -> x <> 0)")
        n = max(1, some.count())
        self.cells = cells or max(1, min(4096, int(n**0.5)))
        held = some.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000)).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        model = KMeans(k=self.cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(held)
        self.centres = _unit([c.tolist() for c in model.clusterCenters()])  # at most 4096 x dimensions
        self.rows = self._placed(some, 1)

    def _placed(self, df: DataFrame, most: int) -> DataFrame:
        """(id, vec, cell) with the ``most`` nearest cells of each row."""
        centres, most = self.centres, min(most, len(self.centres))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sim = _unit(b["vec"]) @ centres.T if len(b) else np.zeros((0, len(centres)))
                near = np.argsort(-sim, axis=1, kind="stable")[:, :most]
                yield b.assign(cell=list(near)).explode("cell").astype({"cell": "int32"})

        return df.select("id", "vec").mapInPandas(run, df.select("id", "vec").schema.add("cell", IntegerType()))

    def search(self, queries: DataFrame, *, k: int = 10, probes: float = 0.75) -> DataFrame:
        """(query_id, id, similarity): the best ``k`` rows among those of the nearest share ``probes`` of the cells."""
        some = queries.where("vec is not null and exists(vec, x -> x <> 0)")
        asked = self._placed(some, max(1, round(probes * self.cells))).select(F.col("id").alias("query_id"), F.col("vec").alias("q"), "cell")
        met = asked.join(self.rows, "cell").where("query_id <> id").select("query_id", "id", "q", "vec")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sim = np.round((_unit(b["q"]) * _unit(b["vec"])).sum(1), 6) if len(b) else np.zeros(0)
                t = pd.DataFrame({"query_id": b.query_id, "id": b.id, "similarity": sim}).sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
                yield t.groupby("query_id").head(k)

        near = met.mapInPandas(run, "query_id long, id long, similarity double")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def neighbours(queries: DataFrame, rows: DataFrame, *, k: int | None = 10, least: float = -1.0, prior_only: bool = False, block: int = 2048) -> DataFrame:
    """(query_id, id, similarity): the ``k`` best (or all) rows of similarity ``least`` or more for each query.

    ``queries`` and ``rows``: id, vec. With ``prior_only`` only rows of a smaller id count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, ri, rv in zip(b.q_ids, b.q_vecs, b.r_ids, b.r_vecs):
                qi, ri, q, r = np.asarray(qi), np.asarray(ri), _unit(qv), _unit(rv)
                sim = np.round(q @ r.T, 6)
                ok = (sim >= least) & (qi[:, None] != ri[None, :]) & q.any(1)[:, None] & r.any(1)[None, :]
                if prior_only:
                    ok &= ri[None, :] < qi[:, None]
                if k is not None and len(ri) > k:
                    order = np.lexsort((np.broadcast_to(ri, sim.shape), -np.where(ok, sim, -9.0)), axis=1)[:, :k]
                    keep = np.zeros_like(ok)
                    np.put_along_axis(keep, order, True, axis=1)
                    ok &= keep
                a, c = np.nonzero(ok)
                yield pd.DataFrame({"query_id": qi[a], "id": ri[c], "similarity": sim[a, c]})

    near = _pairs_of_blocks(queries, rows, block).mapInPandas(run, "query_id long, id long, similarity double")
    if k is None:
        return near
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
