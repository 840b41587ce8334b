"""Removal of repeated byte strings of at least WINDOW bytes across documents, by hash-compared suffix sorting.

Every window of WINDOW bytes chooses one of its GRAM-byte substrings by hash (the last of the least), so equal windows
choose equal grams at equal offsets, and only windows of one gram need be compared. An occurrence of a chosen gram
answers for the run of windows that chose it, its region, at most WINDOW - GRAM + 1 windows.

1. Where documents are read, prefix polynomial hashes give grams and regions. Of equal regions (two independent 64-bit
   hashes agree) in a batch only the earliest goes on; the others are repeats.
2. Dealt and sorted by gram, later copies of a region are repeats as a whole. A region that is the first of its kind, but
   shares its gram with another, is at the border of a repeat, and only some of its windows may occur earlier.
3. The bytes of those regions are dealt by gram, and all their windows are suffix-sorted: a bottom-up mergesort compares
   two suffixes by binary search for their common extension over prefix hashes. Neighbours that agree over WINDOW bytes are
   verified byte by byte; all but the earliest are repeats.
4. Repeated windows of a document are merged into spans, and their bytes removed.

A gram with many different regions is dealt window by window on from HOT_REGIONS, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import BASE, BYTE_VALUE, flat, mixed, powers
from tallyferry.llm.store import marked, stored

WINDOW = 100
GRAM = 32
HOT_REGIONS = 20_000
PIECE = 4 << 20  # a longer document is worked on in pieces that overlap by a window
SORT_BYTES = 2 << 20
_SECOND = mixed(BYTE_VALUE + np.uint64(1)) | np.uint64(1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    while len(_inverse) < n:
        _inverse = np.concatenate([_inverse, _inverse * (_inverse[-1:] * _INVERSE)])
    return _inverse[:n]


def prefix_hashes(data: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """P with P[j] - P[i] = sum of value[data[k]] * BASE**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers(len(data)), out=out[1:])
    return out


def regions(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the chosen grams of one text: gram hash, region hash, first and last window, place of the gram."""
    n = len(data)
    if n < window:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    inverse = inverse_powers(n + 1)
    one, two = prefix_hashes(data), prefix_hashes(data, _SECOND)
    grams = mixed((one[gram:] - one[:-gram]) * inverse[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | (low - place)  # the last place is the least of equal grams
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: n - window + 1], least[span - width : span - width + n - window + 1])
    chosen = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:] - 1, len(chosen) - 1)
    at = chosen[first]
    body = (two[last + window] - two[first]) * inverse[first]
    region = mixed(body ^ mixed(((at - first) * 1000 + (last - first)).astype(np.uint64)))
    return grams[at], region, first, last, at


def _spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[begin, end) of each doc, overlapping and touching ones as one."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    head = np.concatenate([[True], doc[1:] != doc[:-1]])
    lift = (np.cumsum(head) - 1) * (int(end.max()) + 1)  # each doc's ends above those of the one before
    reach = np.maximum.accumulate(end + lift)
    new = head | np.concatenate([[True], begin[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], begin[at], (reach - lift)[np.append(at[1:], len(doc)) - 1]


_ROWS = "gram long, region long, doc long, begin long, shape long"
_NAMES = ["gram", "region", "doc", "begin", "shape"]


def _batch(columns: list[np.ndarray], names: list[str], masks: dict[int, np.ndarray] | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(c).view(np.int64), mask=(masks or {}).get(k)) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Regions (shape = 256 * offset of the gram + number of windows - 1), and repeats in a batch (region null; shape =
    end of the span; gram only deals them out)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, bounds = flat(batch.column(1))
            parts: list[tuple[np.ndarray, ...]] = []
            for k in range(len(ids)):
                text, at = data[bounds[k] : bounds[k + 1]], 0
                while len(text) - at >= window:
                    g, r, first, last, chosen = regions(text[at : at + PIECE], window, gram)
                    parts.append((g, r, np.full(len(g), ids[k]), first + at, (chosen - first) * 256 + (last - first)))
                    at += PIECE - window + 1
            if not parts:
                continue
            g, r, doc, begin, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((begin, doc, r, g))
            again = np.zeros(len(g), bool)
            again[order[1:]] = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
            new = ~again
            yield _batch([g[new], r[new], doc[new], begin[new], shape[new]], _NAMES)
            d, b, e = _spans(doc[again], begin[again], begin[again] + (shape[again] & 255) + window)
            if len(d):
                yield _batch([mixed(d.view(np.uint64) + b.view(np.uint64)), d, d, b, e], _NAMES, {1: np.ones(len(d), bool)})

    return docs.select("_ord", "text").mapInArrow(task, _ROWS)


def _borders(candidates: DataFrame, window: int) -> DataFrame:
    """Repeats as (gram null, doc, begin, end in shape), and regions at a border with their gram and shape."""
    dealt = candidates.repartition("gram").sortWithinPartitions("gram", "region", "doc", "begin")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        names = ["gram", "doc", "begin", "shape"]

        def out(kind: int, doc: np.ndarray, begin: np.ndarray, shape: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
            return _batch([gram, doc, begin, shape], names, {0: np.full(len(doc), kind == 0)})

        for batch in _ended(batches):
            if batch is None:
                rows, closing = held, True
            else:
                ready = batch.column(1).is_null().to_numpy(zero_copy_only=False)
                whole = [batch.column(k).fill_null(0).to_numpy() for k in range(5)]
                if ready.any():
                    yield out(0, whole[2][ready], whole[3][ready], whole[4][ready], whole[0][ready])
                rows, closing = [np.concatenate([h, c[~ready]]) for h, c in zip(held, whole, strict=True)], False
            gram, region, doc, begin, shape = rows
            if not len(gram):
                continue
            again = np.zeros(len(gram), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (region[1:] == region[:-1])
            d, b, e = _spans(doc[again], begin[again], begin[again] + (shape[again] & 255) + window)
            if len(d):
                yield out(0, d, b, e, d)
            rows = [c[~again] for c in rows]
            gram = rows[0]
            cut = len(gram) if closing else int(np.searchsorted(gram, gram[-1]))
            held = [c[cut:] for c in rows]
            gram, _, doc, begin, shape = (c[:cut] for c in rows)
            beside = np.zeros(len(gram), bool)
            beside[1:] = gram[1:] == gram[:-1]
            beside[:-1] |= beside[1:]
            if beside.any():
                yield out(1, doc[beside], begin[beside], shape[beside], gram[beside])

    return dealt.mapInArrow(task, "gram long, doc long, begin long, shape long")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


class Suffixes:
    """Windows of a block of bytes, compared by their prefix hashes."""

    def __init__(self, data: np.ndarray, window: int) -> None:
        self.data, self.window = data, window
        self.prefix, self.scale = prefix_hashes(data), inverse_powers(len(data) + 1)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of the windows at p and q, by binary search over prefix hashes."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.window)
        base_p, base_q, scale_p, scale_q = self.prefix[p], self.prefix[q], self.scale[p], self.scale[q]
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (self.prefix[p + middle] - base_p) * scale_p == (self.prefix[q + middle] - base_q) * scale_q
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, p: np.ndarray, q: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        size = self.common(p, q)
        whole = size == self.window
        at = np.minimum(size, self.window - 1)
        return np.where(whole, or_equal, self.data[p + at] < self.data[q + at])

    def sort(self, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Order of the windows by group, then by bytes: a bottom-up mergesort inside the groups, all at once."""
        order = np.argsort(group, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        size = np.diff(np.append(head, len(order)))
        start, most = np.repeat(head, size), np.repeat(size, size)
        rank = np.arange(len(order)) - start
        width = 1
        while len(size) and width < size.max():
            due = np.flatnonzero(most > width)
            run = rank[due] // width
            left = run % 2 == 0
            other = np.minimum((run + np.where(left, 1, -1)) * width, most[due])
            end = np.minimum(other + width, most[due])
            mine = place[order[due]]
            low, high = other.copy(), end.copy()
            while (going := np.flatnonzero(low < high)).size:
                middle = (low[going] + high[going]) // 2
                theirs = place[order[start[due[going]] + middle]]
                # how many of the other run come before: of equal ones, those of the left run
                before = self.less(theirs, mine[going], ~left[going])
                low[going] = np.where(before, middle + 1, low[going])
                high[going] = np.where(before, high[going], middle)
            to = start[due] + np.where(left, run, run - 1) * width + (rank[due] - run * width) + (low - other)
            merged = order.copy()
            merged[to] = order[due]
            order = merged
            width *= 2
        return order


def _repeated(suffixes: Suffixes, group: np.ndarray, place: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of their group that starts earlier."""
    order = suffixes.sort(group, place)
    one, two = order[:-1], order[1:]
    beside = np.flatnonzero(group[one] == group[two])
    same = np.zeros(len(order), bool)
    near = beside[suffixes.common(place[one[beside]], place[two[beside]]) == suffixes.window]
    span = np.arange(suffixes.window)
    for k in range(0, len(near), 1 << 16):  # collisions of hashes are told apart by the bytes
        part = near[k : k + (1 << 16)]
        equal = (suffixes.data[place[one[part]][:, None] + span] == suffixes.data[place[two[part]][:, None] + span]).all(1)
        same[part[equal] + 1] = True
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(~same)
    ranked = np.lexsort((begin, doc, run))
    out = np.zeros(len(order), bool)
    out[ranked[1:]] = run[ranked][1:] == run[ranked][:-1]
    return out


def _border_repeats(borders: DataFrame, docs: DataFrame, window: int, hot: int) -> DataFrame:
    """Repeats (doc, begin, end) among the windows of the border regions (gram, doc, begin, shape)."""
    crowded = borders.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("gram", F.lit(True).alias("crowded"))
    by_doc = (
        borders.join(crowded, "gram", "left")
        .groupBy("doc").agg(F.collect_list(F.struct("gram", "begin", "shape", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("own"))
    )
    texts = marked(docs, "_may", F.xxhash64("_ord"), by_doc.select(F.xxhash64("doc"))).where("_may").select("_ord", "text")
    rows = texts.join(by_doc, texts["_ord"] == by_doc["doc"]).select("doc", "text", "own.gram", "own.begin", "own.shape", "own.crowded")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "begin", "shape", "body"]
        for batch in batches:
            data, bounds = flat(batch.column(1))
            keys, docs_, begins, shapes, bodies, held = [], [], [], [], [], 0
            for k, doc in enumerate(batch.column(0).to_pylist()):
                text = data[bounds[k] : bounds[k + 1]].tobytes()
                for g, b, s, crowd in zip(*(batch.column(c)[k].as_py() for c in (2, 3, 4, 5)), strict=True):
                    last = b + (s & 255)
                    for x, y in ((x, x) for x in range(b, last + 1)) if crowd else ((b, last),):
                        body = text[x : y + window]
                        if crowd:  # equal windows have the same bytes, so these may deal them out
                            word = int.from_bytes(sha256(body).digest()[:8], "little", signed=True)
                            keys.append(word)
                            shapes.append(0)
                        else:
                            keys.append(g)
                            shapes.append(s)
                        docs_.append(doc)
                        begins.append(x)
                        bodies.append(body)
                        held += len(body)
                if held > 4 * SORT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs_, pa.int64()), pa.array(begins, pa.int64()), pa.array(shapes, pa.int64()), pa.array(bodies, pa.binary())], names=names)
                    keys, docs_, begins, shapes, bodies, held = [], [], [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs_, pa.int64()), pa.array(begins, pa.int64()), pa.array(shapes, pa.int64()), pa.array(bodies, pa.binary())], names=names)

    dealt = rows.mapInArrow(cut, "key long, doc long, begin long, shape long, body binary").repartition("key").sortWithinPartitions("key")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(rows: pa.Table) -> pa.RecordBatch:
            key, doc, begin, shape = (rows.column(k).to_numpy() for k in range(4))
            body = rows.column(4).combine_chunks()
            body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
            offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            at = offsets[:-1] - offsets[0]
            n = (shape & 255) + 1
            row = np.repeat(np.arange(len(key)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            # equal windows have their gram at the same offset
            _, group = np.unique(np.stack([key[row], (shape >> 8)[row] - step]), axis=1, return_inverse=True)
            start = begin[row] + step
            again = _repeated(Suffixes(data, window), group.reshape(-1), at[row] + step, doc[row], start)
            return _batch(list(_spans(doc[row][again], start[again], start[again] + window)), ["doc", "begin", "end"])

        for batch in _ended(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.nbytes for b in held) < SORT_BYTES:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column(0).to_numpy()
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            held = rows.slice(whole).to_batches()
            if whole:
                yield closed(rows.slice(0, whole))

    return dealt.mapInArrow(sort, "doc long, begin long, end long")


def _in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """_ord, a number that is unique and rises with doc_id, and the columns of `docs`; and later copies of these rows, if any.

    That is doc_id itself if it is an integer, without nulls or repeats. Otherwise rows are numbered in the order of
    doc_id, nulls last, then of a hash of their text. Of rows that repeat in both, one has the number and the others are its
    later copies.
    """
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
        if ids[0] == ids[1]:
            return docs.withColumn("_ord", F.col("doc_id").cast("long")), None
    keyed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))
    numbered = (
        keyed.groupBy("doc_id", "_hash").agg(F.count("*").alias("c")).orderBy(F.asc_nulls_last("doc_id"), "_hash")
        .rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], x[1]))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = stored(docs.sparkSession.createDataFrame(numbered, f"_id {kind}, _h long, _copies long, _ord long"), "order")
    joined = keyed.join(numbers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))).drop("_hash", "_id", "_h")
    once = joined.where("_copies = 1").drop("_copies")
    # written, so that every reader sees the same copy as the first
    copies = stored(joined.where("_copies > 1").drop("_copies").withColumn("_at", F.monotonically_increasing_id()), "copies")
    if copies.isEmpty():
        return once, None
    first = copies.groupBy("_ord").agg(F.min("_at").alias("_at")).select("_at")
    return once.unionByName(copies.join(first, "_at", "left_semi").drop("_at")), copies.join(first, "_at", "left_anti").drop("_at", "_ord")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_REGIONS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The documents with _ord, later copies of the same rows (they repeat as a whole), and (doc, begin, end) of repeated
    bytes; a document's spans may overlap."""
    docs, copies = _in_order(docs)
    found = stored(_borders(_candidates(docs, window, gram), window), "regions")
    whole = found.where("gram IS NULL").select("doc", "begin", F.col("shape").alias("end"))
    partial = _border_repeats(found.where("gram IS NOT NULL"), docs, window, hot)
    return docs, copies, stored(whole.unionByName(partial), "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_REGIONS) -> DataFrame:
    """The columns of `docs`, _n_bytes, _n_removed, _n_spans, _kept (the bytes that stay) and _kept_sha256.

    Every byte that a repeated string of `window` bytes covers goes, unless the string starts there first: in the order
    of documents, then of places. Null counts as empty. Matches never cross documents. A row given again with the same
    doc_id and text is a later document.
    """
    columns = [f"`{c}`" for c in docs.columns]
    ordered, copies, spans = repeated_spans(docs, window, gram, hot)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    seen = marked(ordered, "_may", F.xxhash64("_ord"), spans.select(F.xxhash64("doc")))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    clean = seen.where("NOT _may").select(
        *columns, F.octet_length(text).cast("long").alias("_n_bytes"), F.lit(0).cast("long").alias("_n_removed"),
        F.lit(0).cast("long").alias("_n_spans"), text.alias("_kept"), F.sha2(text, 256).alias("_kept_sha256"),
    )
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("own"))
    rows = seen.where("_may").join(by_doc, seen["_ord"] == by_doc["doc"], "left").select(
        *columns, F.col("own.begin").alias("_begin"), F.col("own.end").alias("_end")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, bounds = flat(batch.column(names.index("text")))
            begins, ends = batch.column(names.index("_begin")), batch.column(names.index("_end"))
            sizes, removed, runs, kept, digests = [], [], [], [], []
            for k in range(batch.num_rows):
                whole = data[bounds[k] : bounds[k + 1]]
                b, e = (np.array(c[k].as_py() or [], np.int64) for c in (begins, ends))
                _, b, e = _spans(np.zeros(len(b), np.int64), b, e)
                stays = np.ones(len(whole), bool)
                for x, y in zip(b, e, strict=True):
                    stays[x:y] = False
                left = whole[stays].tobytes()
                sizes.append(len(whole))
                removed.append(len(whole) - len(left))
                runs.append(len(b))
                kept.append(left)
                digests.append(sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names) - 2], *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=[*names[:-2], "_n_bytes", "_n_removed", "_n_spans", "_kept", "_kept_sha256"],
            )

    cut = rows.mapInArrow(task, f"{own}, _n_bytes long, _n_removed long, _n_spans long, _kept binary, _kept_sha256 string")
    out = clean.unionByName(cut)
    if copies is None:
        return out
    size, gone = F.octet_length(text).cast("long"), F.octet_length(text) >= window
    left = F.when(gone, F.lit(b"")).otherwise(text)
    return out.unionByName(
        copies.select(
            *columns, size.alias("_n_bytes"), F.when(gone, size).otherwise(0).alias("_n_removed"), gone.cast("long").alias("_n_spans"),
            left.alias("_kept"), F.sha2(left, 256).alias("_kept_sha256"),
        )
    )
