"""Exact, near, line and substring deduplication against brute force, with nulls, ties, empty tables and clashing names."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tallyferry.llm import exact_dedup, graph, jaccard_join, line_dedup, suffix_dedup  # noqa: E402
from tallyferry.llm.store import stored  # noqa: E402

SCHEMA = "doc_id long, text string"
# columns whose names the operators use themselves
CLASH = ("*", "1 AS _row", "'x' AS set_id", "2.5 AS key", "'l' AS line", "'f' AS _full")


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int, str | None]]:
    """Random texts, near copies of a few, a hot passage in a third, exact copies, empties and a null."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(8)]
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        w = list(rng.choice(bases)) if i % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        text = rng.choice([" ", "\n"]).join(w)
        rows.append((i, f"{text} {passage}" if i % 3 == 0 else text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "x" * 5000)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1200)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_exact(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (4, None), (5, ""), (6, "c"), (6, "c"), (None, "c"), (7, " a b")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASH)
    got = sorted((r._row.doc_id or -1, r._keep_id, r._group_size, r._kept) for r in exact_dedup.duplicate_groups(docs).collect())
    assert got == [
        (-1, 6, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (4, 4, 2, True), (5, 4, 2, False),
        (6, 6, 3, True), (6, 6, 3, True), (7, 7, 1, True),
    ]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 6, 7]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [False, True])
def test_near(spark, monkeypatch, frequent):
    rows = corpus()
    if frequent:  # every shingle counts as frequent, so that only combinations are indexed
        monkeypatch.setattr(jaccard_join, "frequent_buckets", lambda parts, n: jaccard_join.np.full(1 << 11, 255, "uint8"))
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASH)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs).collect()}
    assert got == brute.jaccard(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_near_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_of_each(docs).collect()) == [0, 1, 1, 3]
    assert jaccard_join.similarity_components(docs.limit(0)).count() == 0


def test_near_one_id_at_two_texts(spark):
    near = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(near)), (2, " ".join([*near, "more"])), (2, "a text of its own that nobody else has"), (2, None), (3, " ".join([*near[1:], "x"])), (4, "another")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASH)
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {rows[0], rows[2], rows[3], rows[5]}


def test_blocks_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rows = corpus(7, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs).collect()}
    assert got == brute.jaccard(rows)


def test_sketch_is_small_and_exact():
    rng = jaccard_join.np.random.default_rng(3)
    for counts in (rng.poisson(0.16, 1 << 14), rng.poisson(40, 1 << 14), jaccard_join.np.eye(1, 1 << 14, 7, dtype=int)[0] * (1 << 20)):
        packed = jaccard_join._packed(counts.astype(jaccard_join.np.int32))
        assert (jaccard_join._unpacked(packed) == counts).all()
    assert len(jaccard_join._packed(rng.poisson(0.16, 1 << 14).astype(jaccard_join.np.int32))) < (1 << 14) / 5


def test_near_shuffles_a_text_once_to_find_it(spark):
    """Texts are shuffled by their ids, and once more to where they are compared."""
    docs = spark.createDataFrame([(k, f"a b c d e {k % 3}") for k in range(9)], SCHEMA)
    members = docs.selectExpr("doc_id", "doc_id AS set_id")
    clusters = docs.selectExpr("doc_id AS set_id", "0L AS cluster", "2L AS n")
    for found, most in (
        (jaccard_join._within(clusters, docs, members, 5, 75), 2),
        (jaccard_join._linked(docs.selectExpr("doc_id AS a", "doc_id + 1 AS b"), docs, members, 5, 75), 3),
    ):
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        shuffled = re.findall(r"^\(\d+\) Exchange\s*\nInput \[\d+\]: \[[^\]]*\btext", plan, re.M)
        assert len(shuffled) <= most, plan


def test_keys_of_many_sets_are_not_gathered_in_a_window(spark, monkeypatch):
    """Sets in two clusters that share a key are found by an aggregate and a join back, not by a window over the key."""
    plans = {}

    def kept(df, purpose):
        plans[purpose] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, purpose)

    monkeypatch.setattr(jaccard_join, "stored", kept)
    rows = corpus(8, 12)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs).collect()}
    assert got == brute.jaccard(rows)
    assert "open-groups" in plans and not [p for p, plan in plans.items() if "Window [" in plan]


def test_banded_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 20)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        if abs(len(a) - len(b := "".join(b))) <= 2 and len(b) > 2:
            rows.append((a, b))
    pairs = spark.createDataFrame(rows, "a string, b string").selectExpr("*", "a AS x", "b AS y")
    got = line_dedup.trimmed(pairs, "x", "y", 2).withColumn("d", line_dedup.banded_distance("x", "y", 2)).collect()
    assert all(min(r.d, 3) == min(brute.distance(r.a, r.b), 3) for r in got)


def test_far_lines_are_not_measured(spark, monkeypatch):
    """Lines that share a segment, but differ between their trimmed ends, leave before the distance is taken."""
    rng, measured = random.Random(6), []

    def line(n: int) -> str:
        return "".join(rng.choice("abcdefgé") for _ in range(n))

    def kept(df, purpose):
        out = stored(df, purpose)
        if purpose == "line-middles":
            measured.extend((r.a, r.b) for r in out.where(line_dedup.may_be_near("x", "y", 2)).collect())
        return out

    monkeypatch.setattr(line_dedup, "stored", kept)
    head, near = line(30), line(60)
    texts = [head + line(60) for _ in range(12)] + [near, near[:10] + "x" + near[11:50] + "y" + near[51:], "z" + near]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    want = {(a, b) for a in range(15) for b in range(a) if brute.distance(texts[a], texts[b]) <= 2}
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in line_dedup.near_links(rows).collect()} == want == {(13, 12), (14, 12)}
    assert len(measured) <= 3, measured  # before: the 66 pairs of one head too


def test_probes_meet_the_index(spark):
    """A line within the bound has a probe among the other's index keys, at any place of its edits."""
    rng, rows = random.Random(9), []
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(24, 60)))
        b = list(a)
        for _ in range(2):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "yz"])
        long, short = sorted([a, "".join(b)], key=len, reverse=True)
        if brute.distance(long, short) <= 2 and long != short:
            rows.append((long, short))
    lines = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k long, x string, y string")
    index = lines.select("k", line_dedup.F.explode(line_dedup.index_keys(line_dedup.F.col("y"), 2)).alias("key"))
    probes = line_dedup.probes(lines.selectExpr("k AS line_id", "x AS line"), 2).withColumnRenamed("b", "k")
    assert probes.groupBy("k").count().agg({"count": "max"}).first()[0] <= 12
    assert probes.join(index, ["k", "key"]).select("k").distinct().count() == len(rows) > 50


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """Every shared key counts as hot, and however long keys grow, links are those of brute force."""
    rng, texts = random.Random(12), set()
    for _ in range(12):
        base = [rng.choice("abcdé ") for _ in range(rng.randint(22, 70))]
        for _ in range(9):
            line = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(["", "x", "yz", "aé"])
            texts.add("".join(line))
    # blanks at an end would be lines as well; equal characters give shifted matches
    texts |= {"a" * n for n in range(24, 30)} | {"a" * 12 + "b" + "a" * n for n in range(12, 16)}
    texts = sorted(x for x in texts if len(x) >= 24)
    want = {(b, a) for a in range(len(texts)) for b in range(a) if brute.distance(texts[a], texts[b]) <= 2}
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    monkeypatch.setattr(line_dedup, "HOT", 1)
    for rounds in (1, 4):
        monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
        got = [(r.a, r.b) for r in line_dedup.near_links(rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 50


@pytest.mark.parametrize("hot", [line_dedup.HOT, 1])
def test_short_lines_have_a_bound_of_their_own(spark, monkeypatch, hot):
    """The shorter of two lines gives the bound: two edits from 24 characters on, one from 12, none below."""
    rng, texts = random.Random(14), set()
    for size in [*range(9, 27)] * 2:
        base = [rng.choice("abcdefghé ") for _ in range(size)]
        for _ in range(6):
            line = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(["", "x", "yz"])
            texts.add("".join(line))
    texts = sorted(texts | {"a" * n for n in range(9, 28)})
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    want = set()
    for a in range(len(texts)):
        for b in range(a):
            size = min(len(texts[a]), len(texts[b]))
            if abs(len(texts[a]) - len(texts[b])) <= 2 and brute.distance(texts[a], texts[b]) <= (2 if size >= 24 else 1 if size >= 12 else 0):
                want.add((b, a))
    monkeypatch.setattr(line_dedup, "HOT", hot)
    got = [(r.a, r.b) for r in line_dedup.near_links(rows, short=line_dedup.SHORT).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(len(texts[b]) < 24 for b, _ in want) > 50


@pytest.mark.parametrize("near", [False, True])
def test_hot_keys_are_not_paired_as_they_are(spark, monkeypatch, near):
    """Lines with one beginning, and near copies with other words here and there, make few candidates."""
    rng, made = random.Random(13), {}

    def kept(df, purpose):
        out = stored(df, purpose)
        made[purpose] = out.count()
        return out

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopé") for _ in range(7))

    monkeypatch.setattr(line_dedup, "stored", kept)
    base, texts = [word() for _ in range(30)], []
    for _ in range(90):
        words = list(base)
        for at in rng.sample(range(11, 30), 2) if near else range(11, 30):
            words[at] = word()
        texts.append(" ".join(words))
    texts += [texts[0] + "x", texts[1][:200] + texts[1][201:]]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    links = {(r.a, r.b) for r in line_dedup.near_links(rows).collect()}
    assert links == {(0, 90), (1, 91)}
    assert made["line-pairs"] <= 2 * len(texts), made  # one line has a key of its own that all probe; before: all 4186 pairs
    assert max(made.values()) < 4186, made


def test_lines(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 50))) for _ in range(20)]
    rows: list[tuple[int, str | None]] = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(["", "x", "yz"])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, "short"), (34, "shirt\nshort")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASH)
    got = sorted(tuple(r) for r in line_dedup.line_classes(docs).collect())
    assert got == brute.line_classes(rows, line_dedup.EDITS, line_dedup.MIN_CHARS)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left[34] == "shirt" and left[30] is None and left[32] == "\n\n"
    assert line_dedup.line_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_REGIONS, 1])
def test_repeats(spark, hot):
    rows = [*corpus(11), (100, "ab" * 400), (101, "ab" * 200 + "c")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASH)
    got = {
        r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256)
        for r in suffix_dedup.without_repeats(docs, hot=hot).collect()
    }
    assert got == brute.repeats(rows)


def test_repeats_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(1, text), (2, text[500:1500]), (2, "other"), (None, text[:700]), (3, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 9, r._n_bytes, r._n_removed) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == [(1, 2000, 0), (2, 5, 0), (2, 1000, 1000), (3, 0, 0), (9, 700, 700)]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_repeats_rows_given_twice(spark):
    rng = random.Random(4)
    long, other = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, long), (1, long), (1, long), (2, "short"), (2, "short"), (3, other + long[:150]), (3, other + long[:150]), (None, other), (None, other), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "rand() AS mark")
    got = sorted((r.doc_id or 9, r._n_removed, r._n_spans, r._kept.decode()) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == [
        (1, 0, 0, long), (1, 400, 1, ""), (1, 400, 1, ""), (2, 0, 0, "short"), (2, 0, 0, "short"), (3, 150, 1, other), (3, 550, 1, ""),
        (4, 0, 0, ""), (4, 0, 0, ""), (9, 400, 1, ""), (9, 400, 1, ""),
    ]
