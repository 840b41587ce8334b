"""Merkle manifest, whitening and neighbour search against brute force, with odd rows, empty tables and clashing names."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyferry.llm import merkle, neighbours, whitening


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """Root, and per leaf the hashes beside its path."""
    beside: list[list[str]] = [[] for _ in leaves]
    at, now = list(range(len(leaves))), leaves
    while len(now) > 1:
        runs = [now[i : i + 8] for i in range(0, len(now), 8)]
        for k, i in enumerate(at):
            beside[k] += [x for j, x in enumerate(runs[i // 8]) if j != i % 8]
        at, now = [i // 8 for i in at], [h("".join(r)) for r in runs]
    return now[0], beside


def brute_manifest(rows):
    """{(key, leaf): (subroot, root, proof digest)} of rows (key, tree, text)."""
    def leaf(values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups: dict = {}
    for key, name, text in rows:
        groups.setdefault(name, []).append((key is not None, key or 0, leaf((key, name, text)), key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])])) for g in order}
    root, over = tree([trees[g][1] for g in order])
    return sorted(
        (str(m[3]), m[2], trees[g][1], root, h("".join(trees[g][2][k] + over[i])))
        for i, g in enumerate(order) for k, m in enumerate(trees[g][0])
    )


def documents(seed=1, n=1300):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["de", "de", "de", "fr", "é", None]), "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 9)))) for i in range(n)]
    rows += [(5, "de", "twice"), (5, "de", "twice"), (None, "de", "no key"), (None, None, None), (9000, "only", "x" * 300_000), (9001, "fr", None)]
    rng.shuffle(rows)
    return rows


CLASH = ("*", "1 AS _row", "2 AS place", "'x' AS leaf", "'t' AS tree", "3 AS idx", "4 AS n")


def built(spark, rows):
    df = spark.createDataFrame(rows, "key long, lang string, text string").selectExpr(*CLASH)
    return merkle.manifest(df, "key", "lang", [F.col("key"), F.col("lang"), F.col("text")])


def test_manifest_is_the_brute_force_one(spark):
    rows = documents()
    found = merkle.proofs(built(spark, rows))
    got = found.select("_row.key", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), "_row.text",
                       merkle.folded(F.col("leaf"), F.col("proof")).alias("folded"), merkle.folded(F.sha2("leaf", 256), F.col("proof")).alias("wrong"))
    lines = got.collect()
    assert sorted((str(r.key), r.leaf, r.subroot, r.root, r.p) for r in lines) == brute_manifest(rows)
    assert all(r.folded == r.root != r.wrong for r in lines)
    assert sorted(str(r.text) for r in lines) == sorted(str(t) for _, _, t in rows)


def test_proofs_of_some_leaves_fetch_what_they_lack(spark):
    rows = documents(2)
    found = built(spark, rows)
    some = found.leaves.where("_row.key % 97 = 3 OR _row.key BETWEEN 600 AND 610")
    got = merkle.proofs(found, some).select("_row.key", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p")).collect()
    wanted = {r.leaf for r in some.collect()}
    assert sorted((str(r.key), r.leaf, r.subroot, r.root, r.p) for r in got) == [x for x in brute_manifest(rows) if x[1] in wanted]
    assert 0 < len(got) < len(rows)


def test_missing_nodes_are_the_least_set():
    assert merkle.missing_nodes([0], 1) == [] and merkle.missing_nodes(range(8), 8) == []
    assert sorted(merkle.missing_nodes([3], 9)) == [(0, i) for i in (0, 1, 2, 4, 5, 6, 7)] + [(1, 1)]
    assert merkle.missing_nodes(range(64), 65) == [(2, 1)]  # a run of one is derived only by those who hold it
    assert sorted(merkle.missing_nodes([0, 8], 16)) == [(0, i) for i in (*range(1, 8), *range(9, 16))]


@pytest.mark.parametrize("rows", [[(1, "a", "x")], [(1, None, None)], [(i, "a", "t") for i in range(9)], [(1, "a", "x"), (2, "b", "y")]])
def test_small_manifests(spark, rows):
    got = merkle.proofs(built(spark, rows)).select("_row.key", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"))
    assert sorted((str(r.key), *r[1:]) for r in got.collect()) == brute_manifest(rows)


def test_empty_manifest(spark):
    df = spark.createDataFrame([], "key long, lang string, text string")
    found = merkle.manifest(df, "key", "lang", [F.col("text")])
    assert found.leaves.count() == found.nodes.count() == merkle.proofs(found).count() == 0


# -- whitening ----------------------------------------------------------------------------------------


def vectors(seed=3, n=400, d=12):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).round(4)


def brute_whitened(v: np.ndarray, k=8):
    x = np.floor(1024 * v) + 100_000
    z = x - x.astype("i8").sum(axis=0) / len(x)
    e, u = np.linalg.eigh(z.T @ z / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    xi = x.astype("i8")
    return z @ u / np.sqrt(e), e / np.trace(z.T @ z / len(x)), ((len(x) * xi - xi.sum(axis=0)) ** 2).sum(axis=1)


def test_whitening_with_odd_rows(spark):
    v = vectors()
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None] + [0.0] * 10, [nan] + [0.0] * 11, [inf] + [0.0] * 11, [-inf] + [0.0] * 11, [1e300] + [0.0] * 11, [1.0], [1.0, 2.0]]
    rows = [(i, x) for i, x in enumerate([*v.tolist(), *v[:3].tolist()])] + [(1000 + i, x) for i, x in enumerate(odd)] + [(None, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").repartition(5).selectExpr("*", "1 AS _row", "2 AS _vector", "3 AS at")
    model = whitening.fit(df, "e")
    want, explained, deviation = brute_whitened(np.vstack([v, v[:3], v[5:6]]))
    got = {r._row.vec_id: (r._whitened, r._deviation) for r in whitening.whitened(df, "e", model).collect()}
    assert got.keys() == {*range(403), None} and model.n == 404
    assert whitening.identity_error(df, "e", model) < 1e-9
    np.testing.assert_allclose(model.values / model.trace, explained, rtol=1e-10)
    signs = np.sign(np.array(got[0][0]) * want[0])
    for k, i in enumerate([*range(403), None]):
        np.testing.assert_allclose(np.array(got[i][0]) * signs, want[k], atol=1e-9)
        assert got[i][1] == deviation[k]


def test_whitening_without_rank(spark):
    flat = spark.createDataFrame([(i, [float(i), float(2 * i), 7.0]) for i in range(6)], "vec_id long, e array<float>")
    model = whitening.fit(flat, "e")
    assert len(model.values) == 1 and whitening.identity_error(flat, "e", model) < 1e-9
    for rows in (flat.limit(1), flat.limit(0), flat.where("vec_id < 0"), flat.selectExpr("vec_id", "array(1.0D, 2.0D) AS e")):
        model = whitening.fit(rows, "e")
        assert len(model.values) == 0 and all(r._whitened == [] for r in whitening.whitened(rows, "e", model).collect())
        assert whitening.identity_error(rows, "e", model) == 0.0


def test_factors():
    v = np.cov(vectors(4, 50, 9).T)
    factor = whitening.pivoted_cholesky(v)
    np.testing.assert_allclose(factor @ factor.T, v, rtol=1e-12, atol=1e-12 * np.abs(v).max())
    turned = whitening.orthogonal_columns(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-13 * np.diag(gram).max()
    np.testing.assert_allclose(np.sort(np.diag(gram)), np.linalg.eigvalsh(v), rtol=1e-9)
    assert whitening.pivoted_cholesky(np.outer([1.0, 2, 3], [1.0, 2, 3])).shape == (3, 1)


# -- neighbours ---------------------------------------------------------------------------------------


def brute_nearest(rows, is_query, k):
    """{query id: [(score, id)]} over rows that take part, as the operator states it."""
    from collections import Counter

    good = sorted({(i, tuple(x)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)})
    size = max(Counter(len(x) for _, x in good).items(), key=lambda c: (c[1], c[0]))[0] if good else 0
    good = [(i, x) for i, x in good if len(x) == size]
    out = []
    for i, q in good:
        if is_query(i):
            found = sorted((-float(sum(np.multiply(q, x))), j) for j, x in good if (j, x) != (i, q))
            out.append((i, [(round(-s, 9), j) for s, j in found[:k]]))
    return sorted(out)


def searched(spark, rows, k, query="id % 5 = 0"):
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3).selectExpr("*", "1 AS class", "2 AS id", "3 AS vector", "4 AS score")
    got: dict = {}
    for r in neighbours.nearest(df, "vec_id", "v", F.expr(query), k).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.id))
        assert r.rank == len(got[r.query_id])
    return sorted(got.items())


def test_neighbours_in_one_list_are_exact_with_odd_rows_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [int(c) for c in rng.integers(-2, 3, 4)]) for i in range(120)]  # few different vectors: many ties
    rows += [(200 + i, [1, 1, 0, 0]) for i in range(80)]
    rows = [(i, [float(c) for c in x]) for i, x in rows]
    rows += [(300, None), (305, []), (310, [0.0] * 4), (315, [nan, 1.0, 1.0, 1.0]), (320, [inf, 0.0, 0.0, 0.0]), (325, [1.0, None, 1.0, 1.0]), (330, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [rows[0], rows[205]]
    assert searched(spark, rows, 7) == brute_nearest(rows, lambda i: i % 5 == 0, 7)


def test_neighbours_few_and_none(spark):
    rows = [(5, [1.0, 0.0]), (10, [0.5, 0.5]), (11, [-1.0, 0.0])]
    assert searched(spark, rows, 20) == brute_nearest(rows, lambda i: i % 5 == 0, 20)
    assert searched(spark, rows[:1], 20) == searched(spark, [(5, [0.0])], 20) == searched(spark, rows, 20, "id < 0") == []


@pytest.mark.parametrize("pieces", [False, True])
def test_neighbours_over_many_lists(spark, monkeypatch, pieces):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    if pieces:
        monkeypatch.setattr(neighbours, "PIECE_ROWS", 300)
        monkeypatch.setattr(neighbours, "RUN_QUERIES", 60)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 2500)] + 0.6 * rng.normal(size=(2500, 16))
    x *= rng.uniform(0.5, 2, (2500, 1))  # largest inner products are not the nearest vectors
    rows = [(i, v) for i, v in enumerate(x.round(3).tolist())]
    got, want = searched(spark, rows, 20), brute_nearest(rows, lambda i: i % 5 == 0, 20)
    assert [i for i, _ in got] == [i for i, _ in want] and all(len(a) == 20 for _, a in got)
    hits = sum(len({j for _, j in a} & {j for _, j in b}) for (_, a), (_, b) in zip(got, want))
    assert hits >= 0.9 * sum(len(b) for _, b in want)
    for i, answer in got:
        assert all(abs(s - float(np.dot(rows[i][1], rows[j][1]))) < 1e-8 for s, j in answer) and answer == sorted(answer, key=lambda a: (-a[0], a[1]))


def test_lists_are_balanced_and_all_can_be_found():
    x = np.random.default_rng(7).normal(size=(3000, 8))
    model = neighbours.fitted(x, float(np.linalg.norm(x, axis=1).max()), 64)
    sizes = np.bincount(neighbours.nearest_of(model.lifted(x), model.centroids), minlength=len(model.centroids))
    assert sizes.max() <= 4 * 3000 / 64
    far = model.within(model.lifted(x[:200]), 1e9)
    assert np.isfinite(far).all()  # the graph is connected
    near = model.within(model.lifted(x[:200]), 0.1)
    exact = np.linalg.norm(model.lifted(x[:200])[:, None] - model.centroids, axis=2)
    assert (near.argmin(axis=1) == exact.argmin(axis=1)).mean() > 0.97
