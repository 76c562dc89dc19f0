import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.stats import binomial_upper, mcnemar_exact, wilson
from tidewell.functions.urls import canonical_url, domain
from tidewell.operators.asof import asof_last
from tidewell.operators.running import with_running
from tidewell.operators.similarity import CellIndex, neighbour_counts, neighbours
from tidewell.operators.snapshot_diff import IndexStore, snapshot_changes

DATA = "/root/testdata/sf0.001"


def test_canonical_url(spark):
    cases = {
        "HTTPS://Www.A.Example/X/?utm_source=l&id=3#top": "https://www.a.example/x/?id=3",
        "http://a.test/x/?ref=rail": "http://a.test/x",
        "http://a.test/x?page=2&fbclid=1&source=p&id=9": "http://a.test/x?page=2&id=9",
        "http://a.test/": "http://a.test",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", canonical_url("u").alias("c")).collect()
    assert {r.u: r.c for r in got} == cases
    assert spark.createDataFrame([("http://WWW.a.test:80/x",)], "u string").select(domain("u")).first()[0] == "a.test:80"


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "run string, k string, h string, t double, key string, change string")
    out = snapshot_changes(df, "run", F.col("k"), F.col("h"), F.col("t"), **kw)
    return sorted(tuple(r) for r in out.collect())


def test_snapshot_changes(spark):
    rows = [
        ("r0", "a", "AA", 1.0, "x", "y"), ("r0", "b", "bb", 1.0, "x", "y"), ("r0", "c", None, 1.0, "x", "y"), ("r0", "d", "dd", 5.0, None, None), ("r0", "d", "old", 2.0, None, None), ("r0", None, "zz", 1.0, "x", "y"), ("r0", "", "zz", 1.0, "x", "y"),
        ("r1", "a", "aa", 2.0, "x", "y"), ("r1", "c", "cc", 2.0, "x", "y"), ("r1", "d", "new", None, "x", "y"), ("r1", "d", "dd", float("nan"), "x", "y"), ("r1", "e", "ee", 1.0, "x", "y"), ("r1", "e", "ee", 1.0, "x", "y"),
    ]
    got = changes(spark, rows)
    assert [(r[0], r[1], r[2]) for r in got] == [("r1", "b", "removed"), ("r1", "d", "changed"), ("r1", "e", "added")]
    assert next(r for r in got if r[1] == "d")[3:] == ("dd", "new")
    full = {r[1]: r[2:] for r in changes(spark, rows, old_values=True)}
    assert full["b"] == ("removed", "bb", None, 1.0, None) and full["e"] == ("added", None, "ee", None, 1.0)


def test_snapshot_changes_empty(spark):
    assert changes(spark, []) == [] and changes(spark, [("r0", "a", "h", 1.0, "", "")]) == []


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    ver = [(rng.choice("abc"), float(rng.randrange(40000)), rng.randrange(99)) for _ in range(300)] + [("a", None, 5), (None, 3.0, 5)]
    req = [(i, rng.choice("abcd"), float(rng.randrange(40000))) for i in range(300)] + [(900, None, 1.0), (901, "a", None)]
    v = spark.createDataFrame(ver, "k string, t double, v int")
    r = spark.createDataFrame(req, "id int, k string, t double")
    got = {x.id: (x.v, x.asof_time) for x in asof_last(r, v, key="k", time="t", value="v").collect()}
    for i, k, t in req:
        ok = [(b, c) for a, b, c in ver if a == k and k is not None and t is not None and b is not None and b <= t]
        best = max(ok, default=(None, None))
        assert got[i] == (best[1], best[0])
    assert len(got) == len(req)


def test_index_is_found_again_and_swapped(spark, tmp_path):
    deliver = lambda rows: sorted(tuple(r) for r in IndexStore(spark, f"file://{tmp_path}", "pages", buckets=4).deliver(spark.createDataFrame(rows, "k string, h string, t double"), F.col("k"), F.col("h"), F.col("t"), old_values=True).collect())
    assert deliver([("a", "1", 1.0), ("b", "2", 1.0)]) == [("a", "added", None, "1", None, 1.0), ("b", "added", None, "2", None, 1.0)]
    assert deliver([("a", "9", 2.0), ("a", "8", 1.5), ("c", "3", 2.0)]) == [("a", "changed", "1", "9", 1.0, 2.0), ("b", "removed", "2", None, 1.0, None), ("c", "added", None, "3", None, 2.0)]
    assert sorted(os.listdir(tmp_path / "pages")) == ["v2"]  # the old index is gone
    assert deliver([]) == [("a", "removed", "9", None, 2.0, None), ("c", "removed", "3", None, 2.0, None)]


def test_probe_shuffles_nothing(spark):
    from tidewell.operators.snapshot_diff import HASH, KEY, TIME, probe

    df = spark.createDataFrame([(f"k{i}", str(i), 1.0) for i in range(50)], f"{KEY} string, {HASH} string, {TIME} double")
    for n in ("probe_a", "probe_b"):
        df.write.format("parquet").bucketBy(4, KEY).sortBy(KEY).mode("overwrite").saveAsTable(n)
    try:
        with_plan = probe(spark.table("probe_a"), spark.table("probe_b"))
        assert "Exchange" not in with_plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("drop table probe_a"), spark.sql("drop table probe_b")


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), rng.choice([None, 1, 2, 3])) for i in range(300)]
    got = {r.i: r.s for r in with_running(spark.createDataFrame(rows, "i int, o int, v int"), [F.col("o"), F.col("i")], {"s": F.col("v")}, parts=7).collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v or 0
        assert got[i] == total
    assert with_running(spark.createDataFrame([], "i int"), [F.col("i")], {"s": F.col("i")}).count() == 0


def test_exact_tests(spark):
    cases = [(0, 0), (5, 0), (12, 3), (3, 12), (7, 7), (400, 460), (1, 30)]
    got = spark.createDataFrame(cases, "b int, c int").select("b", "c", mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n = r.b + r.c
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n)
        assert math.isclose(r.p, want, rel_tol=1e-9), (r, want)
    top = spark.createDataFrame([(0, 10), (3, 10), (10, 10)], "k int, n int").select(binomial_upper(F.col("k"), F.col("n"))).collect()
    assert math.isclose(top[0][0], 1 - 0.05**0.1, abs_tol=1e-9) and math.isclose(top[1][0], 0.6066242, abs_tol=1e-6) and top[2][0] == 1.0


def test_index_of_cells_reaches_its_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vecs = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(600)] + [(600, [0.0] * 16), (601, None)]
    df = spark.createDataFrame(vecs, "id long, vec array<float>")
    asked = df.where("id % 20 = 0")
    exact = {(r.query_id, r.id) for r in neighbours(asked, df, k=5).collect()}
    found = {(r.query_id, r.id) for r in CellIndex(df, cells=12).search(asked, k=5, probes=0.25).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    counts = {r.query_id: (r.n, r.best_id) for r in neighbour_counts(asked, df, least=0.5, prior_only=True, block=100).collect()}
    pairs = neighbours(asked, df, k=None, least=0.5, prior_only=True).collect()
    for q in {r.query_id for r in pairs}:
        own = [r for r in pairs if r.query_id == q]
        assert counts[q] == (len(own), min(own, key=lambda r: (-r.similarity, r.id)).id)


def test_neighbours_against_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(200, [0.0] * 8), (201, None)]
    df = spark.createDataFrame(vecs, "id long, vec array<float>")
    got = neighbours(df.where("id % 20 = 0"), df, k=3, block=40).collect()
    m = {i: np.asarray(np.asarray(v, dtype=np.float32), dtype=np.float64) for i, v in vecs if v is not None and any(v)}
    for q in range(0, 150, 20):
        sims = sorted(((-round(float(m[q] @ x / np.linalg.norm(m[q]) / np.linalg.norm(x)), 6), i) for i, x in m.items() if i != q))[:3]
        assert sorted((-r.similarity, r.id) for r in got if r.query_id == q) == sims
    assert {r.query_id for r in got} == set(range(0, 150, 20))


def test_wilson(spark):
    low, high = spark.range(1).select(*wilson(F.lit(5), F.lit(10))).first()
    assert math.isclose(low, 0.2366, abs_tol=1e-3) and math.isclose(high, 0.7634, abs_tol=1e-3)
    assert spark.range(1).select(*wilson(F.lit(0), F.lit(0))).first()[0] is None


def test_salted_join_is_the_plain_join(spark):
    from tidewell.operators.skew import hot_keys, salted_join

    rng = random.Random(6)
    big = spark.createDataFrame([(i, rng.choice(["hot"] * 60 + [f"k{j}" for j in range(400)] + [None])) for i in range(3000)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "k string, v int")
    hot = hot_keys(big, "k", parts=64)
    assert hot == ["hot"]
    for how in ("inner", "left"):
        plain, salted = (sorted(map(str, x.select("i", "k", "v").collect())) for x in (big.join(small, "k", how), salted_join(big, small, "k", hot, F.col("i"), how=how)))
        assert plain == salted
    assert hot_keys(big.limit(0), "k") == [] and salted_join(big, small.limit(0), "k", hot, F.col("i")).count() == 0


def test_text_functions(spark):
    from tidewell.functions.text import normal_text, page_text

    cases = {
        "<html><head><style>p {x}</style></head><body><nav>Home</nav><p>Ralo &amp; <b>Benuti</b></p><script>var a = '<p>';</script></body></html>": "Ralo & Benuti",
        "a < b and c > d": "a < b and c > d", "": "", "<!-- x -->one\n\ntwo": "one two", "5 &lt; 6&nbsp;7": "5 < 6 7",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", page_text(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in got} == cases
    a, b = spark.createDataFrame([("Ralo  mill\n2011-02-03 10:22 12 views",), ("ralo mill 2012-03-04 1,223 views 3 hours ago",)], "t string").select(normal_text(F.col("t"))).collect()
    assert a[0] == b[0] == "ralo mill"


def test_normal_quantile(spark):
    from statistics import NormalDist

    from tidewell.functions.stats import normal_quantile

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 for r in got)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,)], "p double").select(normal_quantile(F.col("p"))).collect()] == [None, None]


def test_logistic_against_numpy(spark):
    from tidewell.plans.texts import logistic

    got = logistic(spark, DATA).first()
    rows = spark.read.parquet(f"{DATA}/url_manifest.parquet").where("changed is not null and rank is not null").select("changed", "rank", "run_id").toPandas()
    rows = rows[rows.run_id != "run_00"]
    x = np.column_stack([np.ones(len(rows)), rows["rank"] / 10.0, np.log1p(rows.run_id.map({"run_01": 1.0, "run_02": 12.0, "run_03": 24.0, "run_04": 168.0}))])
    y, w = rows.changed.astype(float).to_numpy(), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(3), x.T @ (y - p))
    assert np.allclose([got.intercept, got["rank"], got.age], w, atol=1e-4)


def test_files(spark, tmp_path):
    from tidewell.sources.files import read_json_lines, write_once

    (tmp_path / "x.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b"\nnot json\n{"b": "y"}\n')
    schema = spark.createDataFrame([], "a int, b string").schema
    assert {(r.a, r.b) for r in read_json_lines(spark, f"file://{tmp_path}/x.json", schema).collect()} == {(1, "x"), (None, "y")}
    assert read_json_lines(spark, f"file://{tmp_path}/absent", schema).count() == 0
    df = spark.createDataFrame([(1,)], "a int")
    assert write_once(df, f"file://{tmp_path}/w") and not write_once(df.union(df), f"file://{tmp_path}/w")
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 1


def test_shared_folder_must_be_named_on_a_cluster():
    from tidewell.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables absent")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as E
    from tidewell.plans import MODULES
    from verify import plain

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    assert E.entry(spark).columns == ["run_id", "canonical_url", "change"]
    for m in MODULES:
        for name, query in m.QUERIES.items():
            df = query(spark, DATA)
            cols = sorted(df.columns)
            got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
            if name in m.SQL:
                cur = con.execute(m.SQL[name])
                heads = [x[0] for x in cur.description]
                assert sorted(heads) == cols, name
                assert got == sorted(tuple(plain(r[heads.index(c)]) for c in cols) for r in cur.fetchall()), name
