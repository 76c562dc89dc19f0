import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm.boilerplate import content_lines, main_lines, stretches
from tidewell.llm.consensus import Consensus, usable_labels
from tidewell.llm.crosssplit import Speller, cross_split_pairs, distance, ko_stem, letters_of
from tidewell.llm.groups import assign_splits, components, named_entities, record_groups, split_counts, subset_counts
from tidewell.llm.mixing import apportion_shards, mix, sainte_lague
from tidewell.llm.packing import best_fit, pack
from tidewell.llm.pages import distinct_texts, page_rows
from tidewell.llm.pairs import BUCKETS, PER, LanguageModel, _counted, _form, _grams, _is_copy, _word, bare, defects, end_likelihood, plain
from tidewell.llm.residue import residue_docs
from tidewell.llm.tokens import with_tokens
from tidewell.llm.truncation import truncated

NAMES = ["Ralo", "Benuti", "Kosiru", "Todape", "Musera", "Viloka", "Hanepo", "Zurimo"]
PAGE = "row_id long, canonical_url string, extracted_text string, status_code int, page string, passage string"


# --- 2: consensus ---------------------------------------------------------------------------------------------


def votes(spark, rows):
    df = spark.createDataFrame(rows, "q string, judge string, label string, utc string, item string, votes string")
    return usable_labels(df, ["q"], "judge", F.col("label"), F.col("utc"), ["CORRECT", "INCORRECT"])


def test_usable_labels(spark):
    rows = [("a", "j", " Incorrect. ", "2", "", ""), ("a", "j", "UNPARSED", "1", "", ""), ("a", "j", "CORRECT", "3", "", ""), ("a", "j", "CORRECT", None, "", ""), ("a", None, "CORRECT", "1", "", ""), (None, "j", "correct\n", None, "", ""), ("b", "j", None, "1", "", "")]
    got = {(r.item.q, r.annotator, r.label) for r in votes(spark, rows).collect()}
    assert got == {("a", "j", 1), (None, "j", 0)}


def test_consensus_beats_majority_with_bad_judges(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    right = {"g1": 0.92, "g2": 0.9, "n1": 0.5, "n2": 0.5, "bad": 0.15}
    for i in range(400):
        truth[str(i)] = rng.random() < 0.4
        for j, p in right.items():
            if rng.random() < 0.85:
                said = truth[str(i)] if rng.random() < p else not truth[str(i)]
                rows.append((str(i), j, "INCORRECT" if said else "CORRECT", "1", "", ""))
    c = Consensus(votes(spark, rows), ["CORRECT", "INCORRECT"])
    got = {r.q: r.consensus == "INCORRECT" for r in c.items.collect()}
    ours = sum(got[i] == truth[i] for i in got) / len(got)
    by = {i: [r[2] == "INCORRECT" for r in rows if r[0] == i] for i in got}
    majority = sum((2 * sum(v) > len(v)) == truth[i] for i, v in by.items()) / len(got)
    assert ours > majority + 0.03 and ours > 0.85
    rel = {r.annotator: r.reliability for r in c.annotators.collect()}
    assert rel["g1"] > rel["n1"] > rel["bad"]


def test_consensus_of_communities_a_copier_and_annotators_with_few_labels(spark):
    rng = random.Random(37)
    kinds = {"honest": (0.9, 0.9), "lenient": (0.97, 0.55), "inverted": (0.2, 0.25)}
    who = {f"{k}{i}": k for k in kinds for i in range(4)} | {f"few{i}": "honest" if i % 2 else "inverted" for i in range(10)}
    rows, truth = [], {}
    for i in range(600):
        truth[str(i)] = rng.random() < 0.45
        said = {}
        for j, kind in who.items():
            if (rng.random() < 0.35) if not j.startswith("few") else i % 120 == int(j[3:]):
                said[j] = truth[str(i)] == (rng.random() < kinds[kind][truth[str(i)]])
        if "lenient0" in said:  # three that repeat a lenient one
            said |= {f"copier{c}": said["lenient0"] if rng.random() < 0.9 else rng.random() < 0.5 for c in range(3)}
        rows += [(str(i), j, "INCORRECT" if v else "CORRECT", "1", "", "") for j, v in said.items()]
    c = Consensus(votes(spark, rows), ["CORRECT", "INCORRECT"], tolerance=1e-4)
    got = {r.q: r.consensus == "INCORRECT" for r in c.items.collect()}
    ours = sum(got[i] == truth[i] for i in got) / len(got)
    by = {i: [(r[1], r[2] == "INCORRECT") for r in rows if r[0] == i] for i in got}
    majority = sum((2 * sum(v for _, v in vs) > len(vs)) == truth[i] for i, vs in by.items()) / len(got)
    # A model of one coin per annotator, started from the majority.
    belief = {i: (sum(v for _, v in vs) + 0.5) / (len(vs) + 1) for i, vs in by.items()}
    for _ in range(30):
        hit, n = {}, {}
        for i, vs in by.items():
            for j, v in vs:
                n[j] = n.get(j, 2.0) + 1
                hit[j] = hit.get(j, 1.0) + (belief[i] if v else 1 - belief[i])
        for i, vs in by.items():
            odds = 0.45 / 0.55
            for j, v in vs:
                a = min(0.99, max(0.01, hit[j] / n[j]))
                odds *= (a / (1 - a)) ** (1 if v else -1)
            belief[i] = odds / (1 + odds)
    coin = sum((belief[i] > 0.5) == truth[i] for i in got) / len(got)
    assert ours > majority + 0.03 and ours > coin + 0.01 and ours > 0.85
    rel = {r.annotator: r for r in c.annotators.collect()}
    four = ("lenient0", "copier0", "copier1", "copier2")
    assert sum(rel[j].source in four for j in four) == 3  # whoever of the four counts as the source
    # Five labels say little, so such annotators lean on a type; those of one type come out on the same side.
    assert sum(rel[f"few{i}"].reliability for i in range(1, 10, 2)) > sum(rel[f"few{i}"].reliability for i in range(0, 10, 2)) + 0.1


def test_checks_are_no_judges(spark):
    from tidewell.llm.consensus_queries import holds_reference

    cases = [("1,440", "It had 1440 people.", True), ("42", "It had 420 people.", False), ("라로", "대표는 라로였습니다", True), ("Ralo", "by RALO (page 2)", True), ("", "x", False), ("a", None, False)]
    got = spark.createDataFrame([c[:2] for c in cases], "g string, a string").select(holds_reference(F.col("g"), F.col("a"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]
    rows = [(str(i), j, "CORRECT" if (i + n) % 3 else "INCORRECT", "1", "", "") for i in range(30) for n, j in enumerate("abz")]
    c = Consensus(votes(spark, rows), ["CORRECT", "INCORRECT"], checks=("z",))
    assert {r.n_labels for r in c.items.collect()} == {2} and {r.annotator for r in c.annotators.collect()} == {"a", "b", "z"}


def test_consensus_empty(spark):
    c = Consensus(votes(spark, []), ["CORRECT", "INCORRECT"])
    assert c.items.count() == 0 and c.annotators.count() == 0


# --- 3 and 6: pages --------------------------------------------------------------------------------------------


def pages(spark):
    rows, n = [], 0
    rng = random.Random(7)
    for h in range(6):
        for p in range(12):
            body = [f"{rng.choice(NAMES)} repaired the {w} near the {rng.choice(['old', 'new'])} harbour within {rng.randrange(90)} days of the vote." for w in rng.sample(["bridge", "tram", "school", "mill", "canal", "pier"], 4)]
            lines = ["Home | News | Sport | About us", f"{NAMES[p % 8]} opens {p} crossings", *body, "- Ralo: 17", "Read next", "How Benuti sold a canal", f"Host{h}name thanks its readers for staying with the desk.", "Back to top"]
            rows.append((n, f"https://host{h}name.test/{p}", "\n".join(lines), 200, "", ""))
            n += 1
    bad = {}
    for h, k in itertools.product(range(6), range(6)):
        text = "\n".join(["Home | News | Sport | About us", ["404 Not Found", "Request timed out", "Access denied"][k % 3], "The page you asked for could not be found on this server.", "Please try again later."])
        rows.append((n, f"https://host{h}name.test/e{k}", text, [404, 200, 503][k % 3], "", ""))
        bad[n] = True
        n += 1
    for text in ("Ralo opens a mill\nBenuti repaired the {{ thing }} near the old harbour within 4 days of the vote.", "{{ title }}\nRalo repaired the mill near the new harbour."):
        rows.append((n, "https://host1name.test/t" + str(n), text, 200, "", ""))
        bad[n] = True
        n += 1
    for text in (None, "", " \n\t ", "A template writes {{ name }} where the mill value goes, and the renderer swaps it.", "x " * 200_000):
        rows.append((n, None if text is None else "https://host2name.test/k" + str(n), text, None, None, None))
        n += 1
    return spark.createDataFrame(rows, PAGE), bad


def test_residue(spark):
    df, bad = pages(spark)
    rows = page_rows(df)
    found = residue_docs(distinct_texts(rows))
    got = {r.row_id for r in rows.join(found, ["doc", "size"], "left_semi").select("row_id").collect()}
    assert got == set(bad)


def test_slots_of_any_length():
    import re

    from tidewell.llm.residue import SLOT

    for s in ("{{" + "x " * 90 + "}}", "${" + "y" * 90 + "}", "[" + "the text of this long part " * 4 + "here]", "__HEADLINE__", "%(" + "n" * 60 + ")s", "<% " + "z" * 70 + " %>"):
        assert re.fullmatch(SLOT, s), s
    for s in ("50% of 20 %", "a [1] b", "{a}", "x __ y __ z"):
        assert not re.search(SLOT, s), s


def test_residue_in_sentences_about_templates(spark):
    df, bad = pages(spark)
    rows = []
    for i, x in enumerate(itertools.product(NAMES, ["mill", "canal", "pier"])):
        rows.append((1000 + i, f"A template writes {{{{ name }}}} where the {x[1]} value goes, and the renderer swaps it.\n{x[0]} saw it."))
        rows.append((1100 + i, f"{x[0]} repaired the old {{{{ thing }}}} near the {x[1]} within 4 days of the vote."))
    rows += [(1200, "A template writes {{ name }} where __HEADLINE__ mill value goes, and the renderer swaps it."), (1201, "A template writes {{ name }} where the old {{publishDate}} near the mill goes, and the renderer swaps it."), (1202, "Ralo copied a manual of the old {{ place }} near the harbour.")]
    more = spark.createDataFrame([(i, f"https://host{i % 6}name.test/a{i}", t, 200, "", "") for i, t in rows], PAGE)
    all_rows = page_rows(df.unionByName(more))
    got = {r.row_id for r in all_rows.join(residue_docs(distinct_texts(all_rows)), ["doc", "size"], "left_semi").select("row_id").collect()}
    assert got == set(bad) | set(range(1100, 1124)) | {1200, 1201, 1202}


def test_pages_empty(spark):
    texts = distinct_texts(page_rows(spark.createDataFrame([], PAGE)))
    assert residue_docs(texts).count() == 0 and content_lines(texts).count() == 0


def test_main_content(spark):
    df, bad = pages(spark)
    rows = page_rows(df.where(F.col("row_id") < 72))
    lines = rows.join(content_lines(distinct_texts(rows)), ["doc", "size"]).groupBy("row_id").agg(F.collect_set(F.when(F.col("main"), F.col("line_no"))).alias("main"), F.count("*").alias("n")).collect()
    assert len(lines) == 72 and all(sorted(r.main) == [2, 3, 4, 5, 6, 7] and r.n == 11 for r in lines)


def test_surge_and_dive_decide(spark):
    """Furniture that nothing repeats stays out by the bounds alone."""
    body = [f"{n} repaired the mill near the new harbour within nine days." for n in NAMES[:3]]
    links = [f"How {n} sold a canal" for n in NAMES]
    text = "\n".join(["Desk of the day", "Change region", *links[:4], "", "Ralo opens crossings", *body, "- Ralo: 17", "Page generated now", *links[4:], *body[:1], "- Musera: 4", "Back to top"])
    got = main_lines(text, "brand", {})
    assert got == {7, 8, 9, 10, 11, 17, 18}  # two stretches, their data lines and the headline
    assert len(main_lines(text, "brand", {}, bounds=False) - got) >= 8
    assert stretches([0, 30, 0, 0, 40, 0, 0, 0, 0, 50], [False] * 10, 3, 25) == [(1, 4), (9, 9)]
    assert stretches([30, 0, 0, 0, 0, 0, 30], [False, True, True, True, True, False, False], 3, 25) == [(0, 6)]
    assert stretches([], [], 3, 25) == [] and stretches([10, 10, 0], [False] * 3, 3, 25) == []


def test_main_lines_keeps_windows_line_ends_and_finds_nothing_in_menus():
    assert main_lines("Home\r\n\r\nAbout us", "brand", {}) == set()
    assert main_lines("Headline of the day\r\n\r\nThe mill near the harbour was repaired within nine days.\r\nShare this", "brand", {}) == {0, 2}


# --- 4: pairs --------------------------------------------------------------------------------------------------


def test_pair_defects(spark):
    en = ["what was the level of the river in the spring and who kept the register of the town", "the keeper of the archive printed the entry for the whole year", "how many people lived in the town at the end of the year", "the register kept by the town clerk and copied by two later pages had the inhabitants of the year", "seventeen people lived here but the two pages disagree"]
    ko = ["지난해 마을에는 몇 명이 살았나요", "강의 수위는 얼마였나요", "문서에는 값이 적혀 있습니다"]
    labelled = spark.createDataFrame([("en", t) for t in en * 5] + [("ko", t) for t in ko * 5], "lang string, text string")
    cases = [
        ("How many people lived in Ralo in 2010?", "In 2010 Ralo had 17 inhabitants.", None), ("How many people lived in Ralo in 2010?", "17", None), ("Who kept the mill?", "Benuti Kosiru", None),
        ("How many people lived in Ralo in 2010?", None, "empty"), ("How many people lived in Ralo in 2010?", " ​\n", "empty"), ("x", "<p></p>", "empty"),
        ("How many people lived in Ralo in 2010?", "You asked: how many people lived in Ralo in 2010", "copy"), ("How many people lived in Ralo in 2010?", "I'm sorry, but I cannot answer this question.", "refusal"), ("몇 명인가요?", "해당 질문에는 답변드리기 어렵습니다.", "refusal"),
        ("How many people lived in Ralo in 2010?", "The clerk declined to answer earlier queries, but Ralo had 17 inhabitants.", None), ("How many people lived in Ralo in 2010?", "The register kept by the town clerk and copied by two later pages gives (17 for", "truncated"),
        ("How many people lived in Ralo in 2010?", "Two pages disagree, e.g.", "truncated"), ("How many people lived in Ralo in 2010?", "문서에는 17로 적혀 있습니다.", "other_language"), ("How many people lived in Ralo in 2010?", "Laut den Unterlagen lautet der Wert für Ralo 17.", "other_language"),
        (None, "INSUFFICIENT_CONTEXT", "refusal"), (None, "Seventeen people.", None), ("q", "w " * 50_000 + "end.", None),
    ] + [(f"How many people lived in {n} in the year {y}?", f"In the year {y} the town of {n} had 17 inhabitants.", None) for n in NAMES[3:] for y in (2011, 2012)]
    df = spark.createDataFrame([(i, q, a, "old", 1) for i, (q, a, _) in enumerate(cases)] + [(0, cases[0][0], cases[0][1], "old", 1)], "i int, prompt string, response string, defect string, pid int")
    out = defects(df, labelled).collect()
    assert len(out) == len(cases) + 1
    wrong = [(cases[r.i][1], r.defect) for r in out if r.defect != cases[r.i][2]]
    assert not wrong
    assert defects(df.limit(0), labelled.limit(0)).count() == 0


def test_pair_defects_learn_from_all_texts_and_responses(spark):
    rng = random.Random(11)
    common = "the town of had inhabitants in year and river mill was near old who kept register".split()
    rare = ["".join(rng.choice(["ter", "ing", "ver", "ment", "old", "mill", "ers"]) for _ in range(4)) for _ in range(700)]
    rare = sorted(set(rare))[:600]
    labelled = [("en", " ".join(rng.sample(common, 8)) + f" {i}") for i in range(9000)] + [("ko", f"지난해 마을에는 몇 명이 살았나요 {i}") for i in range(200)]
    # Each rare word stands in two familiar responses among many, so a response of rare words is of the same language.
    plain = [f"the old mill near the river was kept in the year {i}." for i in range(14_000)] + [f"the old {w} near the river was kept in {y}." for w in rare for y in (2011, 2012)]
    asked = [" ".join(rare[i : i + 6]) + "." for i in range(0, 600, 6)]
    pairs = spark.createDataFrame([("who kept the register of the old mill", a) for a in plain + asked], "prompt string, response string")
    of = spark.createDataFrame(labelled, "lang string, text string")
    assert [r.response for r in defects(pairs, of).where("defect is not null").collect()] == []
    model = LanguageModel(of)
    assert model.langs == ["en", "ko"]
    grams, texts = Counter(g for _, t in labelled[:9000] for g in _grams(t)), Counter(w for _, t in labelled[:9000] for w in {_word(w) for w in t.split() if w.isalpha()})
    table = np.zeros(BUCKETS)
    for g, n in grams.items():
        table[g] = np.log1p(n * PER / 9000)
    assert np.allclose(model.log_p[0], np.log(0.9 * table / table.sum() + 0.1 / BUCKETS))
    assert set(np.flatnonzero(model.seen[0])) == {w for w, n in texts.items() if n > 9000 / PER}


def test_language_counts_in_partial_sums():
    b = pd.DataFrame({"lang": ["en", "en", "ko"] * 20, "text": ["The old mill, the mill.", "mill of Ralo", "강의 수위는 얼마였나요"] * 20})
    whole = pd.concat(_counted(iter([b])))
    parts = pd.concat(_counted(iter([b[:7], b[7:30], b[30:]]), held=2))
    assert len(parts) > len(whole)
    of = whole.set_index(["lang", "gram"]).n
    assert of.to_dict() == parts.groupby(["lang", "gram"]).n.sum().to_dict()
    assert of["en", -1] == 40 and of["en", BUCKETS + _word("mill")] == 40 and of["en", BUCKETS + _word("old")] == 20 and ("en", BUCKETS + _word("ralo")) not in of


def test_ends_of_responses_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([("how many people lived in Ralo", "the register gives the number of people in the")], "prompt string, response string")
    leaves = defects(df, spark.createDataFrame([("en", "how many people lived in the town")], "lang string, text string"))._jdf.queryExecution().optimizedPlan().collectLeaves()
    paths = [leaf.relation().location().rootPaths().mkString() for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.nodeName().startswith("LogicalRelation")]
    assert sum("/said-" in p for p in paths) == 2  # the runs of words, and the wordings with how responses begin


def test_end_likelihood_against_brute_force(spark):
    rng = random.Random(5)
    said = [(i, rng.random() < 0.6, [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for i in range(300)]
    asked = said[:80]
    ends, goes = Counter(), Counter()
    for _, stopped, e in said:
        for k in (1, 2, 3):
            for i in range(k, len(e) + 1):
                (ends if i == len(e) else goes)[tuple(e[i - k : i])] += stopped if i == len(e) else 1
    want = {}
    for i, _, e in asked:
        p = 0.1
        for k in (1, 2, 3):
            g = tuple(e[-k:]) if k <= len(e) else None
            p = (ends[g] + 2.0 * p) / (ends[g] + goes[g] + 2.0)
        if e:
            want[i] = p
    of = spark.createDataFrame(said, "rid long, stopped boolean, e array<string>")
    got = {r.rid: r.p_end for r in end_likelihood(of, of.where("rid < 80")).collect()}
    assert got == pytest.approx(want)


def test_short_ways_through_pairs_change_nothing():
    threes = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    rng = random.Random(7)
    q = "how many people lived in the old town near the river"
    for _ in range(2000):
        a = "".join(rng.choice("abx ") if rng.random() < rng.choice((0.02, 0.08)) else c for c in q)[: rng.randint(30, 60)]
        x, y = threes(q), threes(" ".join(a.split()))
        asked = len(y) <= len(x) / 0.8 and len(y) >= 0.7 * len(x) and len(x & y) >= max(0.8 * len(y), 0.7 * len(x))
        assert not _is_copy(q, a) or asked
        assert _is_copy(q, a) or not asked or set(a.split()) - set(q.split())
    texts = ["ı can't say", "İ CANNOT say", "We don't know", "It is NOT possible to tell", "No answer can be given", "insufficient context", "I am not able to", "알 수 없습니다", "답변하기 어렵네요", "모르겠어요", "정보가 부족했습니다", "the cable is able", "The mill, dr.", "see no.", "mr.", "ﬁne\u200bly <b>old</b> &amp; caf\u00e9", "n/a", "NULL", "_-_", "Answer: none", "ends here…", "ends here ...", "(as said"]
    assert [_form(None, t)[0] for t in texts] == ["refusal"] * 11 + ["end", "truncated", "truncated", "truncated", "end", "empty", "empty", "empty", "empty", "end", "end", "truncated"]
    assert bare("Ca\u0301fe İ 강의 ﬁ") == "cafe i 강의 fi" and plain("a<b>c</b> &lt;d&gt;\u200b") == "a c   "
    spaces = pd.DataFrame({"lang": "en", "text": ["old\x1cmill\x85of\u2028the\u3000river town", " old \n", "", "12 - don't ﬁne-old Ralo 마을에는"]})
    got = pd.concat(_counted(iter([spaces]))).set_index("gram").n.to_dict()
    want = Counter({-1: 4})
    for t in spaces.text:
        want.update(BUCKETS + b for b in {_word(w) for x in t.split() if not x[:1].isupper() for w in re.findall(r"[^\W\d_]+", x)})
        want.update(g for x in t.split() if not x[:1].isupper() for g in _grams(x))
    assert got == dict(want)

# --- 5: groups ---------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in {n for e in edges if e[0] != e[1] for n in e}}


def test_subset_counts_is_exact():
    rng = random.Random(13)
    for _ in range(40):
        sizes = {rng.randrange(1, 12): rng.randrange(1, 5) for _ in range(4)}
        items = [s for s, m in sizes.items() for _ in range(m)]
        target = rng.randrange(0, sum(items) + 1)
        sums = {0}
        for s in items:
            sums |= {x + s for x in sums}
        taken = subset_counts(sizes, target)
        assert all(taken[s] <= sizes[s] for s in taken)
        assert abs(sum(s * m for s, m in taken.items()) - target) == min(abs(x - target) for x in sums)


def test_groups_and_splits(spark):
    aliases = spark.createDataFrame([("Ralo", "e1", "en"), ("River Ralo", "e1", "en"), ("라로강", "e1", "ko"), ("Benuti", "e2", "en"), ("Kosíru", "e3", "en"), (None, "e4", "en"), ("  ", "e5", "en")], "alias string, entity_id string, lang string")
    recs = [("1", "how long is RALO?"), ("2", "라로강은 얼마나 긴가요"), ("3", "Ralo or Benuti?"), ("4", "Where is Benuti"), ("5", "Kosiru&#63;"), ("6", "Kosirus?"), ("7", None), ("8", ""), ("9", "2011년 라로강의 수위"), ("1", "how long is RALO?"), (None, "Ralo")]
    df = spark.createDataFrame([(*r, "x") for r in recs], "rid string, text string, root string").drop("root")
    named = {(r.rid, r.entity_id) for r in named_entities(df, aliases).collect()}
    assert {("1", "e1"), ("2", "e1"), ("3", "e1"), ("3", "e2"), ("4", "e2"), ("5", "e3"), ("9", "e1")} == {x for x in named if x[0]}
    groups = {r.rid: r.root for r in record_groups(df, aliases).collect()}
    assert groups == {"1": "e1", "2": "e1", "3": "e1", "4": "e1", "9": "e1", "5": "e3", "6": None, "7": None, "8": None}
    assert record_groups(df.limit(0), aliases.limit(0)).count() == 0


def test_splits_meet_targets(spark):
    rows = [(f"r{i}", f"c{i % 7}" if i < 300 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "rid string, root string")
    out = assign_splits(df, [("train", 0.7), ("validation", 0.1), ("heldout", 0.2)]).collect()
    assert {s: sum(r.split == s for r in out) for s in ("train", "validation", "heldout")} == {"train": 700, "validation": 100, "heldout": 200}
    split = {r.rid: r.split for r in out}
    assert all(len({split[r] for r, c in rows if c == f"c{k}"}) == 1 for k in range(7))
    coarse = assign_splits(df, [("train", 0.7), ("validation", 0.1), ("heldout", 0.2)], unit_bits=6).groupBy("split").count().collect()
    assert all(abs(r["count"] / 1000 - {"train": 0.7, "validation": 0.1, "heldout": 0.2}[r.split]) < 0.05 for r in coarse)


@pytest.mark.parametrize("hist", [{1: 10_000_000}, {1: 3_000_000, 3: 3_000_000}, {1: 900_000, 2: 40_000, 17: 3_000, 5_000: 90, 400_000: 2, 3_000_000: 1}, {7: 1_000_003}, {3_000_000: 2, 1_000_000: 3, 999_999: 1}])
def test_splits_of_many_records_meet_their_shares_as_few_do(hist):
    total, rest = sum(s * m for s, m in hist.items()), dict(hist)
    for share, taken in zip((0.1, 0.2), split_counts(hist, [0.1, 0.2, 0.7])):
        assert all(0 <= m <= rest[s] for s, m in taken.items())
        sums = [sum(s * m for s, m in x.items()) for x in (taken, subset_counts(rest, round(total * share)))]
        assert sums[0] == sums[1]
        rest = {s: m - taken.get(s, 0) for s, m in rest.items()}


def test_splits_beyond_the_first_bitset(spark):
    rows = [(f"r{i}", f"c{i // 3}" if i < 1500 else None) for i in range(3000)]
    out = assign_splits(spark.createDataFrame(rows, "rid string, root string"), [("train", 0.7), ("validation", 0.1), ("heldout", 0.2)], unit_bits=8).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 2100, "validation": 300, "heldout": 600}


# --- 7: cross-split pairs ----------------------------------------------------------------------------------------


def test_distance_and_speller():
    assert distance("whta", "what", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2
    s = Speller({"many": 500, "books": 300, "what": 900})
    assert [s.mend(w)[0] for w in ("mnay", "boks", "whta", "Benuti", "2010", "the")] == ["many", "books", "what", "Benuti", "2010", "the"]
    assert Speller({"book": 9, "look": 5}).mend("zook") == ("book", True)
    assert letters_of("안녕하세요. 2011년 7월  라로의 매출은 얼마였습니까 ㅠㅠ") == letters_of("2011년7월 라로의 매출은얼마였나요?")
    assert [ko_stem(w) for w in ("라로의", "매출은", "가수이", "얼마였습니까", "의")] == ["라로", "매출", "가수이", "얼마였", "의"]


def test_cross_split_pairs(spark):
    base = [f"How many books had {n} published by {y}?" for n in NAMES for y in range(2010, 2016)]
    rows = [(f"t{i}", t, True, False) for i, t in enumerate(base)]
    held = [("e0", "hi, how mnay boks had RALO published by 2010 thanks", "t0"), ("e1", "By 2011, how many books had Ralo published?", "t1"), ("e2", base[0], "t0"), ("e3", "How many books had Ralo published by 2099?", None), ("e4", "How many pages had Ralo published by 2010?", None), ("e5", None, None), ("e6", "?!", None)]
    rows += [(r, t, False, True) for r, t, _ in held] + [("e2", base[0], False, True)]
    df = spark.createDataFrame(rows + [("x", base[5], False, False)], "rid string, text string, in_train boolean, in_eval boolean")
    got = sorted(tuple(r) for r in cross_split_pairs(df, common=0.2).collect())
    assert got == sorted((t, r) for r, _, t in held if t)
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_cross_split_pairs_reach_every_order_ending_and_slip(spark):
    """Short and Korean questions against brute force over what the statement allows."""
    rows, want = [], set()
    for n, name in enumerate(NAMES):
        rows.append((f"t{n}", f"Who founded {name}?", True, False))
        for k, text in enumerate((f"{name} founded who", f"who fuonded {name}", f"please, who founded the {name}?")):
            rows.append((f"e{n}{k}", text, False, True))
            want.add((f"t{n}", f"e{n}{k}"))
    for n, name in enumerate(["라로메", "베누티", "코시루", "토다페", "무세라", "비로카"]):
        rows.append((f"k{n}", f"2011년 {name}의 매출은 얼마였나요?", True, False))
        for k, text in enumerate((f"{name}의 매출은 2011년에 얼마였습니까", f"2011년 {name} 매출은 얼마였나요", f"2011년 {name}의 매츨은 얼마였나요?", f"2011년{name}의매출은얼마였나요 감사합니다", f"2012년 {name}의 매출은 얼마였나요?", f"2011년 {name}의 손실은 얼마였나요?")):
            rows.append((f"h{n}{k}", text, False, True))
            if k < 4:
                want.add((f"k{n}", f"h{n}{k}"))
    got = {tuple(r) for r in cross_split_pairs(spark.createDataFrame(rows, "rid string, text string, in_train boolean, in_eval boolean"), common=0.15).collect()}
    assert got == want


# --- 8 and 9: packing and mixing -----------------------------------------------------------------------------------


def test_best_fit():
    rng = random.Random(17)
    sizes = [rng.randrange(1, 101) for _ in range(500)]
    where = best_fit(sizes, 100)
    fills = pd.Series(sizes).groupby(where).sum()
    assert fills.max() <= 100 and len(fills) <= 1.05 * sum(sizes) / 100 + 2


@pytest.mark.parametrize("per_task", [100, 20_000])
def test_pack(spark, per_task):
    rng = random.Random(19)
    items = [(i, rng.randrange(1, 180)) for i in range(700)] + [(900, 0), (901, None), (902, 1000)]
    limits = spark.createDataFrame([("a", 100), ("b", 250), ("none", None)], "packing string, capacity int")
    out = pack(spark.createDataFrame(items, "id long, size int"), limits, per_task=per_task).toPandas()
    for name, cap in (("a", 100), ("b", 250)):
        own = out[out.packing == name]
        fills = own[own.container.notna()].groupby("container")["size"].sum()
        assert fills.max() <= cap and len(fills) <= 1.08 * fills.sum() / cap + 2
        assert own.groupby("id")["size"].sum().to_dict() == {i: s or 0 for i, s in items}
        assert set(own[own.id == 902]["size"]) <= {cap, 1000 % cap or cap}
    if per_task == 100:  # rounds go on up the tree as one task would
        one = pack(spark.createDataFrame(items, "id long, size int"), limits).groupBy("packing").agg(F.countDistinct("container").alias("n")).collect()
        assert all(out[out.packing == r.packing].container.nunique() <= 1.02 * r.n + 1 for r in one)
    assert set(out.packing) == {"a", "b"} and set(out[out.container.isna()].id) == {900, 901}
    assert pack(spark.createDataFrame([], "id long, size int"), limits).count() == 0


def test_sainte_lague():
    assert sainte_lague([53000, 24000, 23000], 7) == [3, 2, 2]
    assert sainte_lague([1.0, 1.0], 5, [1, 9]) == [1, 4] and sainte_lague([0.0], 3) == [0]


def test_mix(spark):
    rng = random.Random(23)
    rows = [(i, rng.choice([" Big", "big", "small", "none", None]), rng.randrange(1, 60)) for i in range(3000)] + [(5000, "big", None), (5001, "big", 0), (None, "big", 5)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.38, 3), ("absent", 0.02, 4)], "source string, target_share double, max_repeats int")
    out = mix(spark.createDataFrame(rows, "id long, source string, tokens int"), targets).toPandas()
    used = (out.tokens * out.uses).groupby(out.source).sum()
    assert len(out) == 3003 and used["none"] == 0 and out[out.source == "big"].uses.max() == 1 and out[out.source == "small"].uses.max() <= 3
    assert abs(used["big"] / used.sum() - 0.6 / 0.98) < 0.01
    assert mix(spark.createDataFrame([], "id long, source string, tokens int"), targets).count() == 0


def test_sainte_lague_is_that_of_the_quotients_one_by_one():
    rng = random.Random(41)
    for _ in range(50):
        weights = [rng.choice([rng.random(), float(rng.randrange(1, 4)), 0.0]) for _ in range(6)]
        caps, seats = [rng.randrange(0, 40) for _ in range(6)], rng.randrange(0, 150)
        held = [0] * 6
        for _ in range(seats):
            open_ = [i for i in range(6) if weights[i] > 0 and held[i] < caps[i]]
            if open_:
                held[max(open_, key=lambda i: (weights[i] / (2 * held[i] + 1), -i))] += 1
        assert sainte_lague(weights, seats, caps) == held


def test_shards_are_apportioned_as_on_one_machine(spark):
    rng = random.Random(43)
    parts = [("a", i, rng.randrange(50, 400), rng.randrange(1, 9)) for i in range(60)] + [("b", i, 100, 3) for i in range(40)]
    df = spark.createDataFrame(parts, "source string, shard long, t long, cap long")
    got = {(r.source, r.shard): int(r.q) for r in apportion_shards(df, {"a": 171, "b": 57}).collect()}
    for name, seats in (("a", 171), ("b", 57)):
        own = [p for p in parts if p[0] == name]
        want = sainte_lague([float(p[2]) for p in own], seats, [p[3] for p in own])
        assert [got[name, p[1]] for p in own] == want


def test_mix_with_more_shards_than_blocks(spark):
    rng = random.Random(47)
    rows = [(i, "big" if i % 4 else "small", rng.randrange(1, 60)) for i in range(20_000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = mix(spark.createDataFrame(rows, "id long, source string, tokens int"), targets, per_shard=40, least_blocks=200, total=200_000).toPandas()
    used = (out.tokens * out.uses).groupby(out.source).sum()
    assert abs(used["big"] / used.sum() - 0.5) < 0.01 and abs(used.sum() / 200_000 - 1) < 0.02


def test_tokens(spark):
    got = with_tokens(spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "text string")).collect()
    assert [r.tokens for r in got][:3] == [2, 0, 0] and got[3].tokens > 1


# --- 10: truncation --------------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(29)
    rows, want = [], {}
    things = ["bridge", "tram", "school", "mill", "canal", "pier"]
    sentence = lambda: f"{rng.choice(NAMES)} repaired the {rng.choice(things)} near the {rng.choice(things)} within {rng.randrange(90)} days."
    for i in range(300):
        text = " ".join(sentence() for _ in range(rng.randrange(2, 6)))
        kind = i % 10
        if kind == 0:
            text, want[i] = text[: len(text) - rng.randrange(12, 30)].rstrip(".") + rng.choice(["", "...", " (more)", "<br"]), True
        elif kind == 1:
            text += "\nthanks in advance"
        elif kind == 2:
            text += "\nSource: https://a.test/x/12"
        elif kind == 3:
            text += f"\n- {rng.choice(NAMES)}: 12"
        rows.append((i, text, [" Forum", "forum", None][i % 3]))
    rows += [(900, None, "forum"), (901, "", "forum"), (902, "  ", None), (903, sentence() * 9000, "forum"), (0, rows[0][1], "forum")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, chars int, cut string")
    got = {r.doc_id for r in truncated(df).where("cut").collect()}
    assert got == set(want)
    assert truncated(df.limit(0)).count() == 0


def test_field_limits_decide_first(spark):
    """Values at a limit end like headings, which are whole elsewhere: the spike alone tells them."""
    rng = random.Random(53)
    word = lambda: "".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(3))
    heading = lambda: f"{word()} {word()} returns to the harbour"
    body = lambda k: " ".join(f"{rng.choice(NAMES)} repaired the mill within {rng.randrange(90)} days." for _ in range(k))
    rows = [(i, (heading() + "\n" if i % 3 == 0 else "") + body(rng.randrange(1, 5)), "free") for i in range(240)]
    tails = [heading() for _ in range(12)]
    same = [(500 + i, body(3)[:99] + ".\n" + t, "limited") for i, t in enumerate(tails)]
    uneven = [(500 + i, body(3)[: 60 + 3 * i] + ".\n" + t, "limited") for i, t in enumerate(tails)]
    found = lambda more: {r.doc_id: r.stage for r in truncated(spark.createDataFrame(rows + more, "doc_id long, text string, source string")).where("cut").collect()}
    assert found(same) == {500 + i: "field_limit" for i in range(12)}
    assert found(uneven) == {}


def test_cut_lines_that_end_as_some_heading_does(spark):
    rng = random.Random(31)
    name = lambda: rng.choice(NAMES)
    rows = []
    for i in range(200):
        first = f"{name()} returns to the {name()} reservoir\n" if i % 10 == 0 else ""
        last = f"Prices at the {name()} reservoir" if i in (3, 4, 5) else f"{name()} returns to the {name()} reservoir" if i in (6, 7) else f"Prices at the {name()} reservoir fell within {i} days."
        rows.append((i, f"{first}{name()} repaired the mill within {i} days.\n{last}", "a"))
    got = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("cut").collect()}
    assert got == {3, 4, 5}
