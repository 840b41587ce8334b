"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models of the same vocabulary, one of toxic and one of ordinary documents. Each backs off from its bigrams to its
own continuation counts (the number of different words before a word), and from there to the continuation counts both
classes share. Discounts come from counts of counts, n1 / (n1 + 2 * n2), and a bigram that a class has seen once goes to the
backoff as a whole; continuation counts are discounted alike, ones included. As the classes differ much in size, the backoff
also gets a strength in proportion to the class (the concentration of a Pitman-Yor process, whose predictions Kneser-Ney's
are without it), so an expression rare in both speaks for neither. The difference of the log-likelihoods, divided by the
number of words, and the part of it that words with a difference of more than STRONG make, become a probability by a logistic
fit on one fold that the counts leave out; the strengths are those of CANDIDATES that fit this fold best. Every candidate is
of order 2.

Counts cover all words and bigrams of all labelled rows outside the held-out and the tuning fold, and stay Spark tables
of any size, known by 64-bit hashes. Texts without a label train nothing and are only scored. Only the fit of the three
weights sees at most labels.MAX_LABELLED rows. A document's sums are sums over entries of one table: each word as itself and
as the word before another, and a correction for each bigram that a class has seen twice. The most frequent entries, and a
bitmap of all keys, are broadcast with a fixed size: what is frequent, or certainly in no table, is scored where documents
are read. All else is counted per document and joined with the table, so results do not depend on these sizes.

Null and empty texts have no words and get the probability of no difference. Repeated rows are all kept and get equal scores;
if labelled, each counts. Rows without an id train nothing. An empty table gives an empty result. Columns of the caller are
kept whatever their names are, but for `_score`, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import BASE, Words, mixed, pieces
from tallyferry.llm.labels import MAX_LABELLED, learnable, to_learn_from
from tallyferry.llm.store import shuffles_removed, stored, without

CACHED = 1 << 20
CACHED_TUNING = 1 << 16
LOG2_BITS = 26
BROADCAST_LABELS = 1_000_000  # of at most 32 bytes each; more are joined without a hint
TUNE_FOLD = 4
THRESHOLD = 0.5
STRONG = 1.0  # in nats
CANDIDATES = ((0.1, 0.1), (0.1, 1.0), (1.0, 1.0))  # strengths of words and bigrams, in shares of a class
RIDGE = 1e-3
_START = np.uint64(0x5EED5EED5EED5EED)  # the word before a text
_PACKED = 1 << 16  # entries that a task packs at a time for a broadcast
_HELD = 1 << 19  # bigrams that a task holds before it sends them on


def bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the hash of the word before it, and of both."""
    before = np.empty(len(words.hash), np.uint64)
    before[1:] = words.hash[:-1]
    before[words.first[:-1][words.count > 0]] = _START
    return before, mixed(before * BASE + words.hash)


def _before(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The words before: `bigrams` turned back."""
    x = keys ^ (keys >> np.uint64(31)) ^ (keys >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return (x - second) * np.uint64(pow(int(BASE), -1, 1 << 64))


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of the rows of values by them."""
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    rows = np.concatenate(values)
    return own, np.stack([np.bincount(inverse, rows[:, k], len(own)) for k in range(rows.shape[1])], 1).astype(np.int64)


def _batch(names: list[str], *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


_OF_WORD = ["s", "b0", "b1", "w0", "w1", "l0", "l1"]
_FIRST = ["t0", "t1", "x0", "x1", "y0", "y1"]
_SECOND = ["s", "b0", "b1"]


def _counts(rows: DataFrame) -> DataFrame:
    """Bigrams of rows (label, text) that a class has twice or more, as (key, first, second, n0, n1: occurrences in either
    class); and over all bigrams partial sums by word, with key null: s different words before it, b0, b1 the same in
    either class, w0, w1 its occurrences, l0, l1 how many of them end a text (of the word before a text: as many below zero
    as there are texts with words).

    Bigrams are dealt out by their second word and an eighth of their hashes, so that most words are summed in one place and
    a frequent word in eight."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "second", "n0", "n1"]
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        ended: list[np.ndarray] = []

        def held() -> pa.RecordBatch:
            key, n = _summed(keys, [v[:, :2] for v in values])
            # the second word of a bigram is the same wherever it stands
            second = np.empty(len(key), np.int64)
            for k, v in zip(keys, values, strict=True):
                second[np.searchsorted(key, k)] = v[:, 2]
            keys.clear()
            values.clear()
            return _batch(names, key.view(np.int64), second, n[:, 0], n[:, 1])

        for batch in batches:
            label = batch.column(0).to_numpy()
            for at, to, data, bounds in pieces(batch.column(1)):
                words = Words(data, bounds)
                own, where, inverse = np.unique(bigrams(words)[1], return_index=True, return_inverse=True)
                of = label[at:to][words.owner()]
                n = [np.bincount(inverse, of == c, len(own)).astype(np.int64) for c in (0, 1)]
                keys.append(own)
                values.append(np.stack([*n, words.hash[where].view(np.int64)], 1))
                whole = words.count > 0
                by_class = np.stack([label[at:to][whole] == c for c in (0, 1)], 1).astype(np.int64)
                ends += [words.hash[words.first[1:][whole] - 1], np.full(1, _START)]
                ended += [by_class, -by_class.sum(0, keepdims=True)]
                if sum(map(len, ends)) > _HELD:
                    word, n_ends = _summed(ends, ended)
                    ends[:], ended[:] = [word], [n_ends]
                if sum(map(len, keys)) > _HELD:
                    yield held()
        if keys:
            yield held()
        if ends:
            word, n_ends = _summed(ends, ended)
            yield _batch(names, pa.nulls(len(word), pa.int64()), word.view(np.int64), n_ends[:, 0], n_ends[:, 1])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "second", "n0", "n1", *_OF_WORD]
        words: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def of_words() -> pa.RecordBatch:
            word, v = words[0], values[0]
            none = pa.nulls(len(word), pa.int64())
            words.clear()
            return _batch(names, none, none, word, none, none, *values.pop().T) if len(v) else _batch(names, *[pa.nulls(0, pa.int64())] * len(names))

        for batch in batches:
            alone = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            key, second, n0, n1 = (batch.column(k).fill_null(0).to_numpy() for k in range(4))
            first = _before(key.view(np.uint64), second.view(np.uint64)).view(np.int64)
            kept = np.flatnonzero(((n0 > 1) | (n1 > 1)) & ~alone)
            if len(kept):
                none = [pa.nulls(len(kept), pa.int64())] * len(_OF_WORD)
                yield _batch(names, *(x[kept] for x in (key, first, second, n0, n1)), *none)
            words.append(second)
            values.append(np.where(alone, [*[np.zeros_like(n0)] * 5, n0, n1], [np.ones_like(n0), n0 > 0, n1 > 0, n0, n1, *[np.zeros_like(n0)] * 2]).T)
            if sum(map(len, words)) > _HELD:
                word, v = _summed(words, values)
                words[:], values[:] = [word], [v]
                if len(word) > _HELD // 2:
                    yield of_words()
        if words:
            word, v = _summed(words, values)
            words[:], values[:] = [word], [v]
            yield of_words()

    found = rows.select("label", "text").mapInArrow(read, "key long, second long, n0 long, n1 long")
    # tasks have added up what they met, so nothing more is added before the shuffle
    found = found.withColumn("part", F.coalesce(F.pmod("key", F.lit(8)), F.lit(0))).repartition("second", "part")
    found = found.groupBy("key", "second", "part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).drop("part")
    return found.mapInArrow(fold, ", ".join(f"{c} long" for c in ("key", "first", "second", "n0", "n1", *_OF_WORD)))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (.., n) with at least the least n that at most `most` rows reach; no rows are gathered for it."""
    reached, least = 0, 1 << 62
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("c")).collect(), key=lambda r: -r.n):
        if reached + r.c > most:
            break
        reached, least = reached + r.c, r.n
    return counts.where(F.col("n") >= least)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2**LOG2_BITS bits, those of all keys modulo that number set; at most 2**LOG2_BITS / 64 rows are gathered."""
    slot = F.pmod("key", F.lit(1 << LOG2_BITS))
    got = (
        keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits"))
    )
    with shuffles_removed(keys.sparkSession):
        got = got.select("word", "bits").toArrow()
    out = np.zeros((1 << LOG2_BITS) // 64, np.int64)
    for batch in got.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


@dataclass
class Model:
    """entries: key, n (occurrences), word (whether a word or a bigram), and the counts that `terms` makes scores of.

    size, mass: different words and bigrams of both classes; by class (ordinary, toxic) tokens, total of continuation
    counts, share of it left to the backoff, and discounts of continuation counts and bigrams. bits: bitmap of all keys."""

    entries: DataFrame
    size: int
    mass: int
    tokens: list[int]
    total: list[int]
    rest: list[float]
    lower: list[float]
    upper: list[float]
    bits: np.ndarray

    def _word(self, k: int, c: int, s: Column, b: Column) -> Column:
        """Probability of a word by its continuation counts."""
        strength = CANDIDATES[k][0]
        base = (s + 1) / float(self.mass + self.size)
        own = F.greatest(b - self.lower[c], F.lit(0.0)) / float(self.total[c])
        return (own + (strength + self.rest[c]) * base) / (1 + strength)

    def unseen(self, k: int) -> float:
        strength = CANDIDATES[k][0]
        return float(np.log(strength + self.rest[1]) - np.log(strength + self.rest[0]))

    def terms(self, k: int) -> list[Column]:
        """What an entry adds to a document's difference and its strong part for each time it stands there, and to the
        difference for each word that it stands before."""
        p = [self._word(k, c, F.col("s"), F.col(f"b{c}")) for c in (0, 1)]
        weight = [F.col(f"t{c}") + CANDIDATES[k][1] * self.tokens[c] for c in (0, 1)]
        left = [1 - (F.col(f"x{c}") - self.upper[c] * F.col(f"y{c}")) / weight[c] for c in (0, 1)]
        both = [left[c] * p[c] + F.when(F.col(f"n{c}") > 1, F.col(f"n{c}") - self.upper[c]).otherwise(0.0) / weight[c] for c in (0, 1)]
        word, behind, pair = (F.log(x[1]) - F.log(x[0]) for x in (p, left, both))
        strong, none = [F.greatest(x - STRONG, F.lit(0.0)) for x in (word, pair)], F.lit(0.0)
        return [
            F.when(F.col("word"), word).otherwise(pair - word - behind),
            F.when(F.col("word"), strong[0]).otherwise(strong[1] - strong[0]),
            F.when(F.col("word"), behind).otherwise(none),
        ]


def _discount(ones: int, twos: int) -> float:
    return ones / max(ones + 2 * twos, 1)


def count(docs: DataFrame, known: DataFrame) -> Model:
    """Counts of the texts of `docs` that `known` (doc_id, label) has, by class."""
    labels = known.select("doc_id", "label")
    if labels.count() <= BROADCAST_LABELS:  # else Spark chooses, and texts may be shuffled
        labels = F.broadcast(labels)
    rows = docs.select("doc_id", "text").join(labels, "doc_id").select(F.col("label").cast("long").alias("label"), "text")
    found = stored(_counts(rows), "bigrams")
    pairs = found.where("key IS NOT NULL").select("key", "first", "second", "n0", "n1")
    begun = pairs.groupBy(F.col("first").alias("key")).agg(
        *[F.sum(F.when(F.col(f"n{c}") > 1, F.col(f"n{c}")).otherwise(0)).alias(f"x{c}") for c in (0, 1)],
        *[F.count(F.when(F.col(f"n{c}") > 1, 1)).alias(f"y{c}") for c in (0, 1)],
    )
    words = found.where("key IS NULL").groupBy(F.col("second").alias("key")).agg(*[F.sum(c).alias(c) for c in _OF_WORD])
    words = stored(
        words.join(begun, "key", "left").na.fill(0)
        .select("key", *_SECOND, *[(F.col(f"w{c}") - F.col(f"l{c}")).alias(f"t{c}") for c in (0, 1)], *_FIRST[2:], "w0", "w1"),
        "words",
    )

    def of(value: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    def number(test: str) -> Column:
        return F.count(F.when(F.expr(test), 1))

    one = words.agg(
        number("s > 0").alias("size"), of("s").alias("mass"),
        *[x for c in (0, 1) for x in (of(f"b{c}").alias(f"b{c}"), of(f"t{c}").alias(f"t{c}"), of(f"y{c}").alias(f"y{c}"),
          number(f"b{c} > 0").alias(f"k{c}"), number(f"b{c} = 1").alias(f"one{c}"), number(f"b{c} = 2").alias(f"two{c}"))],
    ).first()
    two = pairs.agg(*[number(f"n{c} = 2").alias(f"two{c}") for c in (0, 1)]).first()
    total = [max(one[f"b{c}"], 1) for c in (0, 1)]
    lower = [_discount(one[f"one{c}"], one[f"two{c}"]) for c in (0, 1)]
    upper = [_discount(one[f"b{c}"] - one[f"y{c}"], two[f"two{c}"]) for c in (0, 1)]
    rest = [1 - (one[f"b{c}"] - lower[c] * one[f"k{c}"]) / total[c] for c in (0, 1)]
    columns = ["n0", "n1", *_SECOND, *_FIRST]
    zero = F.lit(0).cast("long")
    alone = words.select(
        "key", F.greatest(F.col("w0") + F.col("w1"), F.col("t0") + F.col("t1")).alias("n"), F.lit(True).alias("word"),
        zero.alias("n0"), zero.alias("n1"), *_SECOND, *_FIRST,
    )
    joined = (
        pairs.join(words.select(F.col("key").alias("first"), *_FIRST), "first")
        .join(words.select(F.col("key").alias("second"), *_SECOND), "second")
        .select("key", (F.col("n0") + F.col("n1")).alias("n"), F.lit(False).alias("word"), *columns)
    )
    entries = stored(alone.unionByName(joined), "entries")
    return Model(entries, one["size"] + 1, one["mass"], [max(one[f"t{c}"], 1) for c in (0, 1)], total, rest, lower, upper, _bitmap(entries))


def _packed(x: np.ndarray) -> bytes:
    """Compressed numbers of 8 bytes: all their first bytes, all their second bytes and so on, as first bytes are much alike."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(sent: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(sent), np.uint8).reshape(8, -1).T).ravel().view(kind)


class Cache:
    """Terms of the frequent keys (sorted), three columns a candidate, and the bitmap of all keys.

    As keys are hashes, their first bits tell about where a key is; the last entry stands for none."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray, bits: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.terms, self.bits = terms, bits
        keys = self.keys[:-1]
        self.shift = np.uint64(64 - max(len(keys).bit_length(), 1))
        self.begin = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes]], columns: int, bits: bytes) -> Cache:
        """From packed parts (keys, terms by column), each of any keys."""
        keys = np.concatenate([np.empty(0, np.uint64), *[_unpacked(k, np.uint64) for k, _ in parts]])
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        keys = keys[order]
        terms, at = np.empty((len(keys), columns)), 0
        for _, sent in parts:
            part = _unpacked(sent, np.float64).reshape(columns, -1).T
            terms[place[at : at + len(part)]] = part
            at += len(part)
        return cls(keys, terms, _unpacked(bits, np.uint64))

    def __reduce__(self) -> tuple:
        """Compressed, without what follows from the keys: every executor writes a broadcast to its disk."""
        columns = self.terms.shape[1]
        return Cache.of, ([(_packed(self.keys[:-1]), _packed(self.terms.T))], columns, _packed(self.bits))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `terms`; whether they are the keys'; whether the key may be in the table only."""
        slot = keys & np.uint64((1 << LOG2_BITS) - 1)
        there = (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        at = np.zeros(len(keys), np.int64)
        known = np.zeros(len(keys), bool)
        due = np.flatnonzero(there)
        wanted = keys[due]
        place = self.begin[(wanted >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.keys[place] < wanted)
        while len(low):
            place[low] += 1
            low = low[self.keys[place[low]] < wanted[low]]
        at[due] = place
        known[due] = (self.keys[place] == wanted) & (place < len(self.keys) - 1)
        return at, known, there & ~known


@dataclass
class Gathered:
    """A cache as it is sent, in parts that tasks have packed; a task that reads the broadcast gets the cache itself.

    The driver holds the packed parts only, not the arrays."""

    parts: list[tuple[bytes, bytes]]
    columns: int
    bits: bytes

    def __reduce__(self) -> tuple:
        return Cache.of, (self.parts, self.columns, self.bits)


def _gathered(entries: DataFrame, terms: list[Column], bits: np.ndarray) -> Gathered:
    """The terms of all entries, which are few enough for a broadcast."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            keys, *rest = (np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for batch in held]) for i in range(held[0].num_columns))
            held.clear()
            order = np.argsort(keys.view(np.uint64))
            sent = [_packed(keys[order]), _packed(np.stack([x[order] for x in rest]))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in sent], names=["keys", "terms"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _PACKED:
                yield packed()
        if held:
            yield packed()

    got = entries.select("key", *terms).mapInArrow(task, "keys binary, terms binary").toArrow()
    parts = [(k.as_py(), x.as_py()) for batch in got.to_batches() for k, x in zip(*batch.columns, strict=True)]
    return Gathered(parts, len(terms), _packed(bits))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def ratios(docs: DataFrame, model: Model, chosen: list[int], most: int) -> DataFrame:
    """One row per different (doc_id, text) of `docs`: row, its hash, and for the chosen candidate at place j all_j, toxic minus
    ordinary log-likelihood a word, and strong_j, the part of it above STRONG of each word; both 0 without words. A word's
    part is that of its bigram if a class has it twice, else that of its continuation counts."""
    named = [t.alias(f"{kind}_{j}") for j, k in enumerate(chosen) for t, kind in zip(model.terms(k), ("a", "h", "f"), strict=True)]
    cache = docs.sparkSession.sparkContext.broadcast(_gathered(_frequent(model.entries, most), named, model.bits))
    unseen = [model.unseen(k) for k in chosen]
    extra = [max(u - STRONG, 0.0) for u in unseen]
    sums = [f"{kind}_{j}" for j in range(len(chosen)) for kind in ("all", "strong")]
    names = ["row", "key", "n", "m", *sums]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cache.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, to, data, bounds in pieces(batch.column(1)):
                words = Words(data, bounds)
                owner = words.owner()
                before, pairs = bigrams(words)
                local = np.zeros((to - at, len(sums)))
                due: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # owner, key, n, m
                # a word is found once, for itself and as the one before the next
                single = held.find(np.append(words.hash, _START))
                last = np.empty(len(before), np.int64)
                last[1:] = np.arange(len(before) - 1)
                last[before == _START] = len(before)
                for kind, key in enumerate((words.hash, before, pairs)):
                    where, known, unsure = held.find(pairs) if kind == 2 else [x[:-1] if kind == 0 else x[last] for x in single]
                    absent = ~known & ~unsure
                    for j in range(len(chosen)):
                        for part in (0, 1):
                            column = 3 * j + (2 if kind == 1 else part)
                            if kind == 1 and part:
                                continue
                            local[:, 2 * j + part] += np.bincount(owner[known], held.terms[where[known], column], to - at)
                            if kind == 0:
                                local[:, 2 * j + part] += np.bincount(owner[absent], minlength=to - at) * (extra if part else unseen)[j]
                    due.append((owner[unsure], key[unsure], int(kind != 1), (0, 1, -1)[kind]))
                none = pa.nulls(to - at, pa.int64())
                yield _batch(names, ids[at:to], ids[at:to], words.count.astype(np.int64), none, *local.T)
                for group in (due[:2], due[2:]):
                    whose, key = (np.concatenate([g[i] for g in group]) for i in (0, 1))
                    if len(key):
                        n, m = (np.concatenate([np.full(len(g[0]), g[i], np.int64) for g in group]) for i in (2, 3))
                        order = np.lexsort((key, whose))
                        whose, key = whose[order], key[order]
                        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])]))
                        n, m = np.add.reduceat(n[order], head), np.add.reduceat(m[order], head)
                        no = [pa.nulls(len(head), pa.float64())] * len(sums)
                        yield _batch(names, ids[at:to][whose[head]], key[head].view(np.int64), n, np.maximum(m, -1), *no)

    # a document's own line has m null and its row hash as a key, which only spreads these lines
    found = docs.select(row_key(docs).alias("row"), "text").mapInArrow(task, ", ".join(["row long, key long, n long, m long", *[f"{c} double" for c in sums]]))
    found = found.join(model.entries.select("key", *named), "key", "left")
    own, word, parts = F.col("m").isNull(), F.col("m") >= 0, []
    for j in range(len(chosen)):
        a, h = (F.coalesce(F.col(f"{x}_{j}"), F.when(word, F.lit(none)).otherwise(0.0)) for x, none in (("a", unseen[j]), ("h", extra[j])))
        parts += [F.col("n") * a + F.greatest("m", F.lit(0)) * F.coalesce(F.col(f"f_{j}"), F.lit(0.0)), F.col("n") * h]
    whole = found.select("row", F.when(own, F.col("n")).otherwise(0).alias("n"), *[F.when(own, F.col(c)).otherwise(x).alias(c) for x, c in zip(parts, sums, strict=True)])
    # a row given twice adds to sums and numbers of words alike
    return whole.groupBy("row").agg(*[(F.sum(c) / F.greatest(F.sum("n"), F.lit(1))).alias(c) for c in sums])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a logistic fit by Newton's steps with a slight ridge, and its mean loss."""
    spread = np.append(np.where(x.std(0) > 0, x.std(0), 1), 1)
    z = np.append(x, np.ones((len(x), 1)), 1) / spread
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), z.T @ (p - y) + RIDGE * w)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-12))
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w / spread, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """(row, score) per different (doc_id, text) of `docs`: `row_key` and the probability of label 1, from the text alone.

    If the labels to learn from are all alike, every score is that label, and 0 if there are none; if only those of the
    tuning fold are, the difference is taken as it is. At most `most` labelled rows take part in the logistic fit; counts
    take all.
    """
    docs = docs.select("doc_id", "text")
    known = stored(learnable(labels, target), "labelled")
    seen = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return docs.select(row_key(docs).alias("row")).distinct().withColumn("score", F.lit(float(1 in seen)))
    model = count(docs, known.where(F.col("fold") != TUNE_FOLD))
    every = list(range(len(CANDIDATES)))
    tune = to_learn_from(labels, target, most).where(F.col("fold") == TUNE_FOLD).select("doc_id", "label")
    tuning = docs.join(F.broadcast(tune), "doc_id").select("doc_id", "text", "label")
    marks = tuning.select(row_key(tuning).alias("row"), "label").distinct()
    tuned = stored(ratios(tuning, model, every, CACHED_TUNING).join(marks, "row"), "tuned").toArrow()  # of at most `most` rows
    y = tuned["label"].to_numpy().astype(float)
    best, weights = 0, np.array([1.0, 0.0, np.log(seen[1] / seen[0])])
    if len(set(y.tolist())) == 2:
        fits = [logistic(np.stack([tuned[f"all_{k}"].to_numpy(), tuned[f"strong_{k}"].to_numpy()], 1), y) for k in every]
        best = min(every, key=lambda k: fits[k][1])
        weights = fits[best][0]
    total = F.col("all_0") * float(weights[0]) + F.col("strong_0") * float(weights[1]) + float(weights[2])
    return ratios(docs, model, [best], CACHED).select("row", (1 / (1 + F.exp(-total))).alias("score"))


def scored(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """All columns of `docs` and _score; see `scores`."""
    docs = docs.drop("_score")
    found = scores(docs, labels, target, most)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(docs).alias("row"))
    return wrapped.join(found, "row").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("score").alias("_score"))


def accepted(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs` that score less than THRESHOLD. Only rows whose hash may be that of a rejected one are shuffled."""
    rejected = stored(scores(docs, labels, target, most).where(F.col("score") >= THRESHOLD).select("row"), "rejected")
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(docs).alias("row"))
    return without(wrapped, "row", rejected).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
