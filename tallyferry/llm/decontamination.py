"""Benchmark decontamination over suffix arrays of the training texts.

Every task turns runs of its documents into shards: the words as numbers of the benchmark's vocabulary, and their
suffixes sorted by rank doubling. All suffixes of the benchmark items are looked up at once by binary search; the
range of suffixes that begin with an item's window gives every place where it stands, and extending those gives the
longest verbatim match. Words outside the benchmark's vocabulary, and the end of a document, match nothing.

The benchmark is the stated query set: its different texts, each with the ids of its items, travel in blocks of about
BLOCK_BYTES, one broadcast each, and the documents pass through one step per block without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import Words, pieces
from tallyferry.llm.store import stored

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20  # of text; a worker sorts its suffixes in about 40 times as much
_PARTS = 16  # of a block, by whose sizes blocks are made up


@dataclass
class Items:
    """A block of benchmark texts: their words as numbers from 1, one text after the other, and the ids of the items of each."""

    ids: list[list[str]]
    vocabulary: np.ndarray
    word: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[list[str], str]]) -> Items:
        words = [Words(d, b) for _, _, d, b in pieces(pa.array([t for _, t in rows], pa.string()), 1 << 62)]
        hashes = words[0].hash if words else np.empty(0, np.uint64)
        vocabulary, word = np.unique(hashes, return_inverse=True)
        first = words[0].first if words else np.zeros(1, np.int64)
        return cls([ids for ids, _ in rows], vocabulary, word + 1, first)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: the item, the place of its first word, its length (an item of fewer words is one)."""
        count = np.diff(self.first)
        number = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
        item = np.repeat(np.arange(len(count)), number)
        at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        return item, self.first[item] + at, np.minimum(count, size)[item]


class Shard:
    """Sorted suffixes of a text of numbers; 0 matches nothing, and no suffix that begins with it is held."""

    def __init__(self, text: np.ndarray, longest: int) -> None:
        self.text = text
        self.held = np.flatnonzero(text)
        rank = text.astype(np.int64)
        known = 1
        while known < longest and len(self.held):
            behind = np.zeros(len(text), np.int64)
            behind[:-known] = rank[known:]
            key = rank[self.held] * (int(rank.max()) + 1) + behind[self.held]
            values, order = np.unique(key, return_inverse=True)
            rank[self.held] = order + 1
            known *= 2
            if len(values) == len(self.held):
                break
        self.suffixes = self.held[np.argsort(rank[self.held], kind="stable")]

    def _compare(self, at: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sign of suffix minus query over the first `length` words of each."""
        sign = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(int(length.max()) if len(length) else 0):
            open_ = open_[length[open_] > k]
            place = at[open_] + k
            own = np.where(place < len(self.text), self.text[np.minimum(place, len(self.text) - 1)], 0)
            sign[open_] = np.sign(own - query[start[open_] + k])
            open_ = open_[sign[open_] == 0]
            if not len(open_):
                break
        return sign

    def ranges(self, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted suffixes, those that begin with query[start : start + length], for all starts at once."""
        found = []
        for right in (False, True):
            low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.suffixes))
            while (due := np.flatnonzero(low < high)).size:
                middle = (low[due] + high[due]) // 2
                sign = self._compare(self.suffixes[middle], query, start[due], length[due])
                below = sign <= 0 if right else sign < 0
                low[due] = np.where(below, middle + 1, low[due])
                high[due] = np.where(below, high[due], middle)
            found.append(low)
        return found[0], found[1]

    def extended(self, at: np.ndarray, query: np.ndarray, start: np.ndarray, room: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many words match verbatim from each place, of at most `room`, given that `length` do."""
        size = length.copy()
        open_ = np.arange(len(at))
        while len(open_):
            open_ = open_[size[open_] < room[open_]]
            place = at[open_] + size[open_]
            own = np.where(place < len(self.text), self.text[np.minimum(place, len(self.text) - 1)], 0)
            open_ = open_[own == query[start[open_] + size[open_]]]
            size[open_] += 1
        return size


def _step(items: Items, window: int, column: pa.Array, spans: list, hit_items: list, longest: list) -> np.ndarray:
    """Adds one block's matches of each text to spans, hit_items and longest; returns the numbers of words."""
    item, start, length = items.windows(window)
    end_of_item = items.first[item + 1]
    most = int(length.max()) if len(length) else 0
    counts = np.zeros(len(column), np.int64)
    for at, to, data, bounds in pieces(column, SHARD_BYTES):
        words = Words(data, bounds)
        counts[at:to] = words.count
        if not most:
            continue
        # a 0 behind every document keeps matches inside it
        text = np.zeros(len(words.hash) + to - at, np.int64)
        owner = words.owner()
        text[np.arange(len(owner)) + owner] = items.numbers(words.hash)
        shard = Shard(text, most)
        low, high = shard.ranges(items.word, start, length)
        which = np.repeat(np.arange(len(low)), high - low)
        if not len(which):
            continue
        place = shard.suffixes[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]]
        begin = words.first[:-1] + np.arange(to - at)  # of each document in the shard's text
        doc = np.searchsorted(begin, place, "right") - 1
        size = shard.extended(place, items.word, start[which], (end_of_item - start)[which], length[which])
        order = np.lexsort((place, doc))
        cut = np.flatnonzero(np.diff(doc[order])) + 1
        for part in np.split(order, cut):
            k = int(doc[part[0]])
            inside = place[part] - begin[k]
            spans[at + k] = merged(np.concatenate([np.stack([inside, inside + length[which[part]]], 1), spans[at + k]]))
            hit_items[at + k] = hit_items[at + k].union(*[items.ids[x] for x in np.unique(item[which[part]])])
            longest[at + k] = max(longest[at + k], int(size[part].max()))
    return counts


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching [begin, end) rows as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    heads = np.flatnonzero(new)
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], 1)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The different texts and their ids in blocks of about `block_bytes`; one block at a time reaches the driver. One
    without items, if there are none.

    Texts are dealt to parts by hash, and neighbouring parts make a block. A text with more ids than fill a block stands in
    several, with some of its ids each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text IS NOT NULL")
    bytes_of_ids = F.sum(F.octet_length("id") + 1)
    by_text = items.groupBy("text").agg(bytes_of_ids.alias("n")).select("n", F.octet_length("text").alias("size"))
    total, most = by_text.agg(F.coalesce(F.sum(F.col("n") + F.col("size")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shares, parts = max(1, -(-2 * most // block_bytes)), _PARTS * max(1, -(-total // block_bytes))
    texts = stored(
        items.groupBy("text", F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")).agg(F.collect_set("id").alias("ids"), bytes_of_ids.alias("n"))
        .select(F.pmod(F.xxhash64("text", "share"), F.lit(parts)).alias("part"), "text", "ids", (F.col("n") + F.octet_length("text")).alias("size")),
        "benchmark",
    )
    sizes = sorted((r.part, r.size) for r in texts.groupBy("part").agg(F.sum("size").alias("size")).collect())
    if not sizes:
        yield Items.of([])
    while sizes:
        n, held = 0, 0
        while n < len(sizes) and (not n or held + sizes[n][1] <= block_bytes):
            held += sizes[n][1]
            n += 1
        rows = texts.where(F.col("part").between(sizes[0][0], sizes[n - 1][0])).select("ids", "text").collect()
        yield Items.of([(r.ids, r.text) for r in rows])
        sizes = sizes[n:]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of `docs`, and: _n_words, _spans (array of [begin, end) word places hit, merged), _items (sorted ids
    of items with a window in the text), _longest (words of the longest verbatim match of an item's part).

    A null text has no words; so has an item of null text. Items without an id count as the empty string.
    """
    extra = "_n_words long, _spans array<array<long>>, _items array<string>, _longest long"
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumns({
        "_n_words": F.lit(None).cast("long"), "_spans": F.lit(None).cast("array<array<long>>"),
        "_items": F.lit(None).cast("array<string>"), "_longest": F.lit(None).cast("long"),
    })
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64()]

    for block in benchmark_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                before = [batch.column(names.index(c)).to_pylist() for c in ("_spans", "_items", "_longest")]
                spans = [np.array(x or [], np.int64).reshape(-1, 2) for x in before[0]]
                items, longest = [set(x or ()) for x in before[1]], [x or 0 for x in before[2]]
                counts = _step(shared.value, window, batch.column(names.index("text")), spans, items, longest)
                made = [counts, [x.tolist() for x in spans], [sorted(x) for x in items], longest]
                arrays = [pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 4], *arrays], names=names)

        out = out.mapInArrow(task, f"{own}, {extra}")
    return out


def n_hit() -> Column:
    return F.expr("aggregate(_spans, 0L, (n, s) -> n + s[1] - s[0])")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark stands, with their own columns."""
    return matches(docs, benchmark, window).where("size(_spans) = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
