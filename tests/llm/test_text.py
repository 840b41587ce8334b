"""Token counts, pieces, scans and classifiers: exact round trips, brute force and held-out accuracy."""

from __future__ import annotations

import math
import random
import sys
import tracemalloc
import weakref
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tallyferry.llm import decontamination, licenses, piece_sampling, quality, queries, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "a", "<|endoftext|> it's é é Σ 漢字 😀 ▁ \x00\x1c", "x" * 40_000, "don't stop " * 5000]


def odd_docs(spark):
    return spark.createDataFrame([*enumerate(ODD), (1, ""), (None, "a b")], SCHEMA).selectExpr("*", "1 AS key", "'x' AS words")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary(token_counts.MODEL)
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd_docs(spark), path, chunk=1000).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r._n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r._n_bytes == len((r.text or "").encode()) and r._over_limit == (r._n_tokens > 2048)
    assert token_counts.token_counts(odd_docs(spark).limit(0), path).count() == 0


def test_spliced_chunks():
    from tokenizers import Tokenizer

    path, rng = queries.vocabulary(token_counts.MODEL), random.Random(1)
    library, encoder = Tokenizer.from_file(path), token_counts.WordEncoder(path)
    parts = ["a", "the", " ", "  ", "\n", "é", "é", "Σ", "'s", "don't", "12", "<|endoftext|>", "漢字", " ", "!!", "A" * 30]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        due = library.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((40, 8), (100, 30)):
            assert [t for _, _, ids in token_counts.spliced(encoder, text, chunk, overlap) for t in ids] == due


def test_chunks_are_encoded_and_wide_enough():
    """Chunks get the library's own tokens and offsets, and an overlap whose tokens differ is widened until they agree."""
    path, rng, asked = queries.vocabulary(token_counts.MODEL), random.Random(2), []

    class LateEncoder(token_counts.WordEncoder):
        def encode(self, text, begin, end):
            asked.append((begin, end))
            got = super().encode(text, begin, end)
            if begin:  # what stands near the left cut is wrong
                got.ids = [0 if s < 90 else token for (s, _), token in zip(got.offsets, got.ids, strict=True)]
            return got

    encoder = LateEncoder(path)
    text = " ".join(rng.choice(["some", "don't", "漢字", "of", "unbelievably", "12"]) for _ in range(700))
    due = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    parts = list(token_counts.spliced(encoder, text, 400, 20))
    assert [t for _, _, ids in parts for t in ids] == due and not encoder.kept
    assert [s for s, _, _ in parts] == [0, *[e for _, e, _ in parts[:-1]]] and parts[-1][1] == len(text) and len(parts) > 5
    assert max(e - b for b, e in asked) <= 400 + 160


def test_pieces_decode_and_repeat(spark):
    path = queries.vocabulary(piece_sampling.MODEL)
    first = {(r.doc_id, r.text): r for r in piece_sampling.sampled_pieces(odd_docs(spark), path).collect()}
    again = {(r.doc_id, r.text): r for r in piece_sampling.sampled_pieces(odd_docs(spark).repartition(5), path).collect()}
    assert all(r._lossless and again[k]._pieces == r._pieces and len(r._pieces) == r._n_pieces for k, r in first.items())
    other = {(r.doc_id, r.text): r for r in piece_sampling.sampled_pieces(odd_docs(spark), path, seed=1).collect()}
    assert any(other[k]._pieces != r._pieces for k, r in first.items())
    assert piece_sampling.sampled_pieces(odd_docs(spark).limit(0), path).count() == 0


def test_pieces_follow_the_lattice():
    trie = piece_sampling.load(queries.vocabulary(piece_sampling.MODEL))
    number = {trie.text[i]: i for i in range(3 + 256, len(trie.text))}

    def segmentations(rest: bytes):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in number:
                for more in segmentations(rest[k:]):
                    yield (number[rest[:k]], *more)

    n = 20_000
    got = Counter(tuple(x.tolist()) for x in piece_sampling.encode_group(trie, ["that"] * n, np.arange(n)))
    weight = {s: math.prod(trie.weight[i] for i in s) for s in segmentations(b" that")}
    assert set(got) <= set(weight)
    assert max(abs(got[s] / n - w / sum(weight.values())) for s, w in weight.items()) < 0.01


def test_resident_parts_change_nothing():
    trie, rng = piece_sampling.load(queries.vocabulary(piece_sampling.MODEL)), random.Random(4)
    texts = [[" ".join(rng.choice(["ab", "cde", "é!", "the"]) for _ in range(20)) for _ in range(5)] for _ in range(6)]
    encoder = piece_sampling.Encoder(trie, after=2)
    for group in texts:
        kept = [x.tolist() for x in encoder.encode(group, np.arange(5))]
        assert kept == [x.tolist() for x in piece_sampling.encode_group(trie, group, np.arange(5))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 11, 14])))) for k in range(12)]
    items += [(90, None), (91, ""), (92, items[0][1].upper())]
    rows: list[tuple[int, str | None]] = []
    for i in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
        rows.append((i, f"{text}, {rng.choice(items)[1]}. {text}" if i % 2 else text))
    rows += [(50, None), (51, ""), (52, "end " + items[2][1]), (53, items[3][1][:-1])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS item_id", "2 AS spans")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.matches(docs, benchmark, block_bytes=block_bytes).withColumn("hit", decontamination.n_hit()).collect()
    due = brute.decontaminated(rows, items)
    for r in found:
        assert (r._n_words, r.hit, len(r._items), bool(r._spans)) == (*due[r.doc_id][:3], due[r.doc_id][4]), r
    kept = decontamination.decontaminated(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, d in due.items() if not d[4])
    assert kept.columns == docs.columns
    assert decontamination.decontaminated(docs, benchmark.limit(0)).count() == len(rows)
    assert decontamination.matches(docs.limit(0), benchmark).count() == 0


def test_benchmark_reaches_the_driver_in_blocks(spark, monkeypatch):
    """Copies of a text are one text with many ids, an id list has a bound too, and blocks are not held together."""
    rng, made, alive = random.Random(5), [], []
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(12)) for _ in range(30)]
    items = [*enumerate(texts), *((k, texts[0]) for k in range(100, 400)), (400, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {texts[0]} {texts[1]} y"), (2, "x")], SCHEMA)
    blocks = decontamination.benchmark_blocks

    def watched(*args):
        for block in blocks(*args):
            made.append(sum(len(i) + 1 for ids in block.ids for i in ids) + len(block.word) * 3)
            alive.append(weakref.ref(block))
            yield block
            del block
            assert sum(ref() is not None for ref in alive) <= 1

    monkeypatch.setattr(decontamination, "benchmark_blocks", watched)
    found = {r.doc_id: r._items for r in decontamination.matches(docs, benchmark, block_bytes=800).collect()}
    assert found == {1: sorted(map(str, [0, 1, *range(100, 400)])), 2: []}
    assert max(made) <= 800 and len(made) > 3, made  # before: 300 copies of a text in one block


def test_shards_stay_small():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(400)]
    items = decontamination.Items.of([([str(k)], text[:300]) for k, text in enumerate(texts[:20])])
    column, n = decontamination.pa.array(texts), len(texts)
    spans, hits, longest = [np.zeros((0, 2), np.int64)] * n, [set() for _ in texts], [0] * n
    tracemalloc.start()
    counts = decontamination._step(items, decontamination.WINDOW, column, spans, hits, longest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(counts) == {2000} and [k for k in range(n) if str(k) in hits[k]] == list(range(20))
    assert peak < 60 << 20, peak  # before: shards of 4 MB


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "see the mit  license, the MIT license"), (3, None), (4, ""),
        (5, "Licensed under the Apache License, Version 2.0."), (6, "licensed under CC BY-NC 4.0"),
        (7, "licensed under the terms of the GNU General Public License, version 3"), (8, "licensed under the Apache thing"),
        (9, "a license of mit"),
        (10, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met:"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS label")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [m.label for m in got[1]._matches] == ["mit-notice"] and got[1]._score == 1
    assert [b.word for b in got[2]._base] == [2, 5] and got[2]._score == 0.5
    assert [m.label for m in got[5]._matches] == ["apache-2.0"] and [b.label for b in got[5]._base] == ["apache"]
    assert [m.label for m in got[6]._matches] == ["cc-by-nc-4.0"] and [m.label for m in got[7]._matches] == ["gpl-3.0"]
    assert [m.label for m in got[10]._matches] == ["bsd-text"]
    assert all(not got[k]._base and not got[k]._matches and got[k]._score == 0 for k in (3, 4, 8, 9))
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_automaton_regions():
    automaton = licenses.Automaton.compiled("x", "use [[of it]] by {{2}} is free")
    for text, end in (("use of it by a b is free", 8), ("use by is free now", 4), ("use of by x is free", None), ("use by a b c is free", None)):
        assert automaton.match(text.split(), 0) == end
    with pytest.raises(ValueError):
        licenses.Automaton.compiled("x", "[[all optional]]")


def labelled(spark, n: int = 900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 60))]
        if bad:
            w = [rng.choice(["vile", "GROSS!!", x]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "abc def"), (0, rows[0][1])]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS label", "'f' AS fold"), spark.createDataFrame(
        [*labels, (n + 5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.mark.parametrize(("module", "target", "threshold"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifiers(spark, module, target, threshold):
    from pyspark.sql import functions as F

    from tallyferry.llm.labels import fold

    docs, labels = labelled(spark)
    got = module.scored(docs, labels).withColumn("held_out", fold(F.col("doc_id")) == 0).collect()
    assert len(got) == 904 and all(0 <= r._score <= 1 for r in got)
    held = [(r._score >= threshold) == (r.doc_id % 4 == 0 if target == "toxic" else r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(held) >= 0.97 * len(held)
    assert {r._score for r in module.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert module.scored(docs.limit(0), labels).count() == 0


def brute_ratios(docs, known, strengths, strong=1.0):
    """Log-likelihood ratios and strong parts of all docs (id, text), with plain counters and none left out."""
    pairs = {i: list(zip([None, *w], w)) for i, w in ((i, brute.words(t)) for i, t in docs)}
    n = [Counter(p for i in pairs if known.get(i) == c for p in pairs[i]) for c in (0, 1)]
    shared = Counter(b for _, b in {*n[0], *n[1]})
    before = [Counter(b for _, b in n[c]) for c in (0, 1)]
    behind = [Counter() for _ in n]
    for c in (0, 1):
        for (a, _), k in n[c].items():
            behind[c][a] += k

    def discount(counts):
        ones, twos = (sum(k == x for k in counts.values()) for x in (1, 2))
        return ones / max(ones + 2 * twos, 1)

    lower, upper = [discount(x) for x in before], [discount(x) for x in n]
    total = [sum(x.values()) for x in before]
    kept = [{w: max(k - lower[c], 0) / total[c] for w, k in before[c].items()} for c in (0, 1)]
    less = [{p: k - upper[c] if k > 1 else 0 for p, k in n[c].items()} for c in (0, 1)]
    taken = [Counter() for _ in n]
    for c in (0, 1):
        for (a, _), x in less[c].items():
            taken[c][a] += x

    def score(a, b):
        base = (shared[b] + 1) / (sum(shared.values()) + len(shared) + 1)
        p = [(kept[c].get(b, 0) + (strengths[0] + 1 - sum(kept[c].values())) * base) / (1 + strengths[0]) for c in (0, 1)]
        weight = [behind[c][a] + strengths[1] * sum(n[c].values()) for c in (0, 1)]
        both = [(1 - taken[c][a] / weight[c]) * p[c] + less[c].get((a, b), 0) / weight[c] for c in (0, 1)]
        whole, alone = (math.log(x[1]) - math.log(x[0]) for x in (both, p))
        seen = max(n[0][a, b], n[1][a, b]) > 1
        return whole, max((whole if seen else alone) - strong, 0)

    return {i: [sum(score(*p)[k] for p in own) / max(len(own), 1) for k in (0, 1)] for i, own in pairs.items()}


@pytest.mark.parametrize("cached", [0, 40])
def test_toxicity_counts_have_no_cap(spark, monkeypatch, cached):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, "never seen"), (62, "w1 w2 " * 3000)]
    known = {i: int(i % 3 == 0) for i in range(45)}
    docs = spark.createDataFrame([*rows, rows[50], rows[50]], SCHEMA)
    model = toxicity.count(docs, spark.createDataFrame(list(known.items()), "doc_id long, label int"))
    chosen = list(range(len(toxicity.CANDIDATES)))
    ids = docs.select(toxicity.row_key(docs).alias("row"), "doc_id").distinct()
    for ask in (chosen, [1]):
        got = toxicity.ratios(docs, model, ask, cached).join(ids, "row").collect()
        assert len(got) == len(rows)
        for j, k in enumerate(ask):
            want = brute_ratios(rows, known, toxicity.CANDIDATES[k])
            assert all(abs(r[f"{kind}_{j}"] - want[r.doc_id][at]) < 1e-9 for r in got for at, kind in enumerate(("all", "strong")))
    assert model.entries.where(~F.col("word")).count() > 10


def test_toxicity_keeps_and_drops(spark):
    """Rows under the threshold stay as they are, columns of any name and repeated rows included; all others go."""
    docs, labels = labelled(spark)
    docs = docs.selectExpr("*", "'a' AS row", "'b' AS score", "'c' AS _row", "'d' AS _may", "'e' AS _slot", "'f' AS key")
    got = toxicity.scored(docs, labels)
    assert got.columns == [*docs.columns, "_score"]
    want = sorted((str(tuple(r)[:-1]) for r in got.collect() if r._score < toxicity.THRESHOLD))
    left = toxicity.accepted(docs, labels)
    assert left.columns == docs.columns and sorted(str(tuple(r)) for r in left.collect()) == want
    assert 0.6 * 904 < len(want) < 0.85 * 904
    assert toxicity.accepted(docs.limit(0), labels).count() == 0 and toxicity.accepted(docs, labels.limit(0)).count() == 904


def test_lattices_of_many_parts_stay_small(monkeypatch):
    """Tables of nodes by size are held for a slice of the parts; paths are those of one lattice of all."""
    import tracemalloc

    import public_tokenizers

    rng = random.Random(11)
    trie = piece_sampling.load(public_tokenizers.path(piece_sampling.MODEL))
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 12))) for _ in range(60_000)]
    text = " ".join([*words, "internationalization " * 3])
    tracemalloc.start()
    try:
        got = piece_sampling.encode_group(trie, [text], np.arange(1))[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert piece_sampling.decode(trie, got) == text.encode()
    assert peak < 100e6, peak
    few = " ".join(words[:300])
    whole = piece_sampling.encode_group(trie, [few], np.arange(1))[0].tolist()
    monkeypatch.setattr(piece_sampling, "SLICE_CHARS", 50)
    assert piece_sampling.encode_group(trie, [few], np.arange(1))[0].tolist() == whole


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_cache_is_sent_small(n):
    """The broadcast cache finds the same after it is sent, and is sent in less than its arrays hold."""
    import pickle

    rng = np.random.default_rng(n)
    keys = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    terms = np.stack([np.round(rng.normal(size=n), 3), rng.normal(size=n).clip(0), np.zeros(n)], 1)
    bits = np.zeros((1 << toxicity.LOG2_BITS) // 64, np.uint64)
    slot = keys & np.uint64((1 << toxicity.LOG2_BITS) - 1)
    np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    cache = toxicity.Cache(keys, terms, bits)
    sent = pickle.dumps(cache)
    again, asked = pickle.loads(sent), np.concatenate([keys, rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    for x, y in zip(cache.find(asked), again.find(asked), strict=True):
        assert x.tolist() == y.tolist()
    assert again.terms.shape == terms.shape and (again.terms == terms).all()
    assert len(sent) < 0.2 * sum(x.nbytes for x in (cache.keys, cache.terms, cache.bits, cache.begin))


def test_frequent_entries_stay_packed_on_the_driver(spark):
    """What is broadcast reaches the driver packed by tasks; the driver never holds the entries as arrays."""
    import tracemalloc

    n, columns = 300_000, ["s", "b0", "b1", "t0", "t1", "x0", "x1", "y0", "y1"]
    entries = spark.range(0, n, 1, 4).selectExpr(
        "xxhash64(id) AS key", "id % 50 AS n", "id % 3 = 0 AS word", "2 + id % 5 AS n0", "id % 4 AS n1", *[f"id % {7 + k} AS {c}" for k, c in enumerate(columns)]
    )
    bits = np.full((1 << toxicity.LOG2_BITS) // 64, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model = toxicity.Model(entries, n, n, [n, n], [n, n], [0.5, 0.5], [0.5, 0.5], [0.5, 0.5], bits)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], SCHEMA)
    toxicity.ratios(docs, model, [1], 10).count()
    tracemalloc.start()
    try:
        got = toxicity.ratios(docs, model, [1], n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6, peak
    want = toxicity.ratios(docs, model, [1], 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
