"""Exact n-gram Jaccard self-join by token-combination prefixes (after pkwise, Wang et al., 2016).

Tokens are word shingles. A fixed-size sketch of shingle counts over all documents splits them in two classes: rare
ones, indexed alone, and frequent ones, indexed in combinations of two. In the order (class, hash) a set of n shingles
that may miss at most m = n - ceil(t n) of them takes its first tokens until they cannot all be missed: c rare tokens
count c, c frequent tokens of one pool count c - 1. Two sets over the threshold then share a rare token or a pair of
frequent tokens of one pool. Pools cut the frequent tokens by hash, finer for larger sets, so that pairs stay few; as
partners differ in size by at most 1 / t, a set is indexed in the pools of its own size band and of the next lower one.

Equal sets are one node. The sketch bounds the count of every rare shingle by its bucket, so groups of rare tokens
are small by construction; its width follows the number of shingles. No group is expanded into pairs: every set points
to the partner that shares most keys with it, which makes clusters; all sets of a cluster are compared over an inverted
index, in blocks of bounded size; then what shares a key across two clusters, and is in different components still, is
compared pair by pair. Only links that join two components are ever returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import SOLID, Words, mixed, pieces
from tallyferry.llm.graph import components
from tallyferry.llm.store import stored, wanted_only, without

WORDS = 5
PERCENT = 75
SKETCH_BUCKETS = 1 << 24  # at most; a sketch of fewer shingles is folded to about SKETCH_LOAD a bucket
SKETCH_LOAD = 8
BLOCK_SHINGLES = 1 << 20  # a block of a cluster has about so many; a task holds two
_CHUNK = 1 << 14
_POOL_TOKENS = 4  # frequent tokens a pool of the prefix holds, about
_NO_SET = "doc_id {t}, n_shingles long, set_id long, chunk int, counts binary"


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, bounds of each row in them)."""
    for at, to, data, bounds in pieces(column):
        value, owner = Words(data, bounds, SOLID).grams(n)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield at, value, np.searchsorted(owner, np.arange(to - at + 1))


def _set_id(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An order-free 64-bit digest of each row's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values))])
    size = np.diff(bounds).astype(np.uint64)
    return mixed((total[bounds[1:]] - total[bounds[:-1]]) ^ mixed(size)).view(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bit planes, compressed: most are 0 or 1, so that all planes but the first are nearly empty."""
    return zlib.compress(b"".join(np.packbits(counts >> k & 1).tobytes() for k in range(int(counts.max()).bit_length())), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, _CHUNK // 8)
    out = np.zeros(_CHUNK, np.int64)
    for k, plane in enumerate(planes):
        out += np.unpackbits(plane).astype(np.int64) << k
    return out


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """Per document: id, number of distinct shingles, digest of the set (null if empty); and parts of the sketch."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_BUCKETS, np.int32)
        schema = None
        for batch in batches:
            ids = batch.column(0)
            sizes, digests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for at, values, bounds in _sets(batch.column(1), n):
                np.add.at(sketch, (values & np.uint64(SKETCH_BUCKETS - 1)).astype(np.int64), 1)
                sizes[at : at + len(bounds) - 1] = np.diff(bounds)
                digests[at : at + len(bounds) - 1] = _set_id(values, bounds)
            schema = pa.schema([("doc_id", ids.type), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(digests, mask=sizes == 0), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())],
                schema=schema,
            )
        parts = [(k, sketch[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(SKETCH_BUCKETS // _CHUNK)]
        parts = [(k, _packed(x)) for k, x in parts if x.any()]
        if schema is not None and parts:
            none = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, schema.field(0).type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()),
                 pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())],
                schema=schema,
            )

    return docs.select("doc_id", "text").mapInArrow(task, _NO_SET.format(t=id_type))


def frequent_buckets(parts: DataFrame, shingles: int) -> np.ndarray:
    """Packed bits of the buckets of frequent shingles: three deviations of an even spread, and five, above the mean.

    Chunks of all tasks are added up by Spark; only the bits reach the driver, 2 MB at most.
    """
    width = _CHUNK
    while width < SKETCH_BUCKETS and shingles > SKETCH_LOAD * width:
        width *= 2
    mean = shingles / width
    limit = mean + 3 * math.sqrt(mean) + 5

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + _unpacked(x.as_py())
        bits = [np.packbits(x > limit).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    folded = parts.select(F.expr(f"chunk % {width // _CHUNK}").alias("chunk"), "counts")
    out = np.zeros(width // 8, np.uint8)
    for row in stored(folded.repartition("chunk").mapInArrow(task, "chunk int, bits binary"), "frequent").collect():
        out[row.chunk * _CHUNK // 8 : (row.chunk + 1) * _CHUNK // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _signatures(values: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set's prefixes, and per key: 4 if of rare tokens, 2 if due as the smaller set, 1 as the larger.

    The smaller set of a pair shares at least 2t / (1 + t) of its tokens, the larger at least t, so the prefix that is
    due as the smaller is the shorter one.
    """
    n = len(values)
    as_larger = n - -(-percent * n // 100) + 1
    as_smaller = n - -(-2 * percent * n // (100 + percent)) + 1
    rare, common = values[~frequent], values[frequent]
    take = rare[:as_larger]
    keys, roles = [take], [np.where(np.arange(len(take)) < as_smaller, 7, 5)]
    if len(take) < as_larger:
        band = _band(n, percent)
        for pools_of, role in ((band, 3 if len(take) < as_smaller else 1), (band - 1, 1)):
            pairs = _pairs(common, as_larger - len(take), _pools(pools_of, percent))
            keys.append(mixed(pairs + np.uint64(pools_of % 997)))
            roles.append(np.full(len(pairs), role))
    return np.concatenate(keys), np.concatenate(roles)


def _band(n: int, percent: int) -> int:
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def _pools(band: int, percent: int) -> int:
    """How many pools sets of a size band use: for about _POOL_TOKENS prefix tokens each."""
    n = (100 / percent) ** max(band, 0)
    return max(1, int(n * (100 - percent) / 100 * 4 / 3 / _POOL_TOKENS))


def _pairs(common: np.ndarray, left: int, pools: int) -> np.ndarray:
    """Pairs of frequent tokens of one pool, of the shortest prefix whose pools count `left` in sum of c - 1.

    A set has enough for that: it has far more tokens than pools. Only a set of one shingle has not, and that one
    links with nothing but its equals, which are one node.
    """
    pool = (mixed(common) % np.uint64(pools)).astype(np.int64)
    order = np.argsort(pool, kind="stable")
    again = np.zeros(len(common), np.int64)
    again[order[1:]] = pool[order[1:]] == pool[order[:-1]]
    end = int(np.searchsorted(np.cumsum(again), left)) + 1
    order = order[order < end]
    token, pool = common[order], pool[order]
    out = [common[:0]]
    for step in range(1, len(token)):
        same = pool[step:] == pool[:-step]
        if not same.any():
            break
        one, two = token[:-step][same], token[step:][same]
        out.append(mixed(np.minimum(one, two)) * np.uint64(3) + np.maximum(one, two))
    return np.concatenate(out)


def _keys(docs: DataFrame, frequent_bits: np.ndarray, n: int, percent: int) -> DataFrame:
    """(sig, set_id, info) of every distinct set, equal sets of an Arrow batch once; info = 8 * size + role."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_bits)  # SKETCH_BUCKETS bits at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_common = np.unpackbits(common.value).view(bool)
        for batch in batches:
            seen: set[int] = set()
            for _, values, bounds in _sets(batch.column(0), n):
                digests, sigs, infos, owners = _set_id(values, bounds), [], [], []
                frequent = is_common[(values & np.uint64(len(is_common) - 1)).astype(np.int64)]
                for i in np.flatnonzero(np.diff(bounds)):
                    if (digest := int(digests[i])) in seen:
                        continue
                    seen.add(digest)
                    own = slice(bounds[i], bounds[i + 1])
                    sig, role = _signatures(values[own], frequent[own], percent)
                    sigs.append(sig)
                    infos.append(role + 8 * int(bounds[i + 1] - bounds[i]))
                    owners.append(np.full(len(sig), digest))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).view(np.int64)) for x in (sigs, owners, infos)],
                        names=["sig", "set_id", "info"],
                    )

    return docs.select("text").mapInArrow(task, "sig long, set_id long, info long")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys that may belong to several sets.

    Groups of rare keys, whose size the sketch bounds, meet in one task; those of one set end here, and the others get
    their least set as pivot. Keys of frequent tokens are dealt by their set too, and pass once each, without a pivot.
    """
    frequent_salt = F.when(F.col("info").bitwiseAND(4) == 0, F.pmod("set_id", F.lit(64))).otherwise(-1)
    dealt = keys.repartition("sig", frequent_salt).sortWithinPartitions("sig", "set_id", F.desc("info"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in _with_end(batches):
            last = batch is None
            rows = held if last else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            sig, owner, info = rows
            if not len(sig):
                continue
            cut = len(sig) if last else int(np.searchsorted(sig, sig[-1]))
            held = [x[cut:] for x in rows]
            sig, owner, info = sig[:cut], owner[:cut], info[:cut]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
            sig, owner, info = sig[new], owner[new], info[new]
            beside = np.zeros(len(sig), bool)
            beside[1:] = sig[1:] == sig[:-1]
            beside[:-1] |= beside[1:]
            go = beside | (info & 4 == 0)
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            least = np.flatnonzero(head)[np.cumsum(head) - 1]  # the group's first row has its least set
            whole = info & 4 == 0
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x[go]) for x in (sig, owner, info)],
                 *[pa.array(x[go], mask=whole[go]) for x in (owner[least], info[least] >> 3)]],
                names=["sig", "set_id", "info", "pivot", "pivot_n"],
            )

    return dealt.mapInArrow(task, "sig long, set_id long, info long, pivot long, pivot_n long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _owners(ends: DataFrame, members: DataFrame) -> DataFrame:
    """(set_id, doc_id) of one document for each set of `ends`. Ids are joined to all else first, so that a text is
    shuffled once to be found, and not again by its set."""
    return members.join(ends, "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))


def _own_sets(texts: pa.Array, ids: np.ndarray, n: int) -> list[np.ndarray | None]:
    """The set of each text; None if it isn't the one of that id (a repeated doc_id with another text)."""
    out: list[np.ndarray | None] = []
    for at, values, bounds in _sets(texts, n):
        right = _set_id(values, bounds) == ids[at : at + len(bounds) - 1]
        out += [values[x:y] if r else None for x, y, r in zip(bounds[:-1], bounds[1:], right, strict=True)]
    return out


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _joined(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets that make their components, found over an inverted index of their shingles."""
    if len(sets) == 2:
        return [(0, 1)] if _similar(*sets, percent) else []
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    posting = owner[np.argsort(token, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    at = np.concatenate([[0], np.cumsum(size)])
    label, out = np.arange(len(sets)), []
    for k in range(len(sets)):
        own = token[at[k] : at[k + 1]]
        common = np.bincount(np.concatenate([posting[start[t] : start[t + 1]] for t in own]), minlength=len(sets))
        hits = np.flatnonzero(100 * common >= percent * (size + size[k] - common))
        for other in hits.tolist():
            if label[other] != label[k]:
                out.append((k, other))
                label[label == label[other]] = label[k]
    return out


def _within(clusters: DataFrame, docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) inside clusters (set_id, cluster, n), each set compared with all of its cluster.

    A cluster of more than a block is dealt in blocks by hash, and every two blocks meet in one task.
    """
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.count("*").alias("c")).where("c > 1")
    dealt = (
        clusters.join(blocks, "cluster")
        .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("set_id", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))
    )
    owned = dealt.join(_owners(dealt.select("set_id").distinct(), members), "set_id")
    rows = (
        wanted_only(docs, "doc_id", owned.select("doc_id")).join(owned, "doc_id")
        .repartition("unit").sortWithinPartitions("unit", "set_id").select("unit", "set_id", "text")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, ids = None, [], []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(sets) > 1:
                links.extend((ids[x], ids[y]) for x, y in _joined(sets, percent))

        for batch in batches:
            units, owners = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for u, s, x in zip(units, owners.tolist(), _own_sets(batch.column(2), owners, n), strict=True):
                if u != unit:
                    close()
                    unit, sets, ids = u, [], []
                if x is not None and (not ids or ids[-1] != s):
                    sets.append(x)
                    ids.append(s)
        close()
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(task, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of sets, those over the threshold."""
    owners = stored(_owners(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), members), "owners")
    texts = wanted_only(docs, "doc_id", owners.select("doc_id"))
    named = pairs.select("a", "b")
    for end in ("a", "b"):
        named = named.join(owners.select(F.col("set_id").alias(end), F.col("doc_id").alias(f"doc_{end}")), end)
    for end in ("a", "b"):
        named = named.join(texts.select(F.col("doc_id").alias(f"doc_{end}"), F.col("text").alias(f"text_{end}")), f"doc_{end}")
    both = named.select("a", "b", "text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column(0), part.column(1)
                sets = zip(_own_sets(part.column(2), a.to_numpy(), n), _own_sets(part.column(3), b.to_numpy(), n), strict=True)
                keep = pa.array([x is not None and y is not None and _similar(x, y, percent) for x, y in sets], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return both.mapInArrow(task, "a long, b long")


def similarity_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see `set_components`."""
    return set_components(docs, n, percent).drop("set_id")


def set_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the row's shingles), component_id of every row.

    A null text, or one without words, has no shingles and is linked with nothing; so is a row whose id is null
    (its component_id is null). Repeated rows give a row each. Of `docs` only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    both = stored(shingle_sets(docs, n), "shingle-sets")
    sets = both.where("chunk IS NULL").select("doc_id", "n_shingles", "set_id")
    members = sets.where("doc_id IS NOT NULL AND set_id IS NOT NULL").select("doc_id", "set_id")
    shingles = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    frequent = frequent_buckets(both.where("chunk IS NOT NULL").select("chunk", "counts"), shingles)

    keys = stored(_shared(_keys(docs.where("doc_id IS NOT NULL"), frequent, n, percent)), "shared-keys")
    keys = keys.withColumns({"n": F.shiftright("info", 3), "role": F.col("info").bitwiseAND(3)})

    # each set with the partner it shares most keys with
    open_keys = keys.where("pivot IS NULL").select("sig", "set_id", "n")
    pivots = open_keys.groupBy("sig").agg(F.min(F.struct("set_id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    votes = (
        keys.where("pivot IS NOT NULL").select("set_id", "n", "pivot", "pivot_n")
        .unionByName(open_keys.join(pivots, "sig").select("set_id", "n", F.col("p.set_id").alias("pivot"), F.col("p.n").alias("pivot_n")))
        .where("set_id <> pivot").where(_fits("n", "pivot_n", percent))
        .groupBy("set_id", "pivot").agg(F.count("*").alias("c"))
    )
    stars = votes.groupBy("set_id").agg(F.max(F.struct("c", "pivot")).alias("m")).select(F.col("set_id").alias("a"), F.col("m.pivot").alias("b"))
    sizes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("n_shingles").alias("n"))
    clusters = stored(
        components(stars, "a", "b").select(F.col("node").alias("set_id"), F.col("component").alias("cluster")).join(sizes, "set_id"),
        "clusters",
    )
    inside = stored(_within(clusters, docs, members, n, percent), "links")

    # what shares a key, but neither cluster nor component
    placed = clusters.select("set_id", "cluster").join(
        components(inside, "a", "b").withColumnRenamed("node", "set_id"), "set_id", "full"
    )
    placed_keys = stored(
        keys.select("sig", "set_id", "n", "role").join(placed, "set_id", "left")
        .withColumns({"cluster": F.coalesce("cluster", "set_id"), "component": F.coalesce("component", "set_id")}),
        "placed-keys",
    )
    # a plain aggregate, joined back: however many sets have a key, they are never gathered in one task
    ends = placed_keys.groupBy("sig").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("sig")
    ends = stored(ends, "open-sigs")
    open_groups = stored(wanted_only(placed_keys, "sig", ends).join(ends, "sig", "left_semi"), "open-groups")
    fits = f"({_fits('x.n', 'y.n', percent)})"
    roles = "IF(x.n < y.n OR (x.n = y.n AND x.set_id < y.set_id), (x.role & 2) > 0 AND (y.role & 1) > 0, (y.role & 2) > 0 AND (x.role & 1) > 0)"
    more = (
        open_groups.alias("x")
        .join(open_groups.alias("y"), F.expr(f"x.sig = y.sig AND x.cluster < y.cluster AND x.component <> y.component AND {fits} AND {roles}"))
        .select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    )
    across = _linked(stored(more, "pairs"), docs, members, n, percent)
    found = components(stored(inside.unionByName(across), "links"), "a", "b")

    # the smallest id of each component
    owned = members.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    least = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = owned.select("set_id", "component").distinct().join(least, "component").select("set_id", "component_id")
    return sets.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", "set_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _fits(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _with_set(docs: DataFrame, n: int) -> DataFrame:
    """All columns of `docs` and _set, the digest of the row's shingles; null without shingles."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, values, bounds in _sets(batch.column(batch.schema.names.index("text")), n):
                sizes[at : at + len(bounds) - 1] = np.diff(bounds)
                digests[at : at + len(bounds) - 1] = _set_id(values, bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, mask=sizes == 0)], names=[*batch.schema.names, "_set"])

    return docs.mapInArrow(task, f"{own}, _set long")


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is the smallest of their component, with their own columns; null ids stay.

    Where an id stands at several texts, each is judged by its own component.
    """
    verdicts = stored(
        set_components(docs, n, percent).where("doc_id IS NOT NULL").select("doc_id", "set_id", (F.col("component_id") != F.col("doc_id")).alias("gone")),
        "verdicts",
    )
    by_id = verdicts.groupBy("doc_id").agg(F.max("gone").alias("some"), F.min("gone").alias("all"))
    some = stored(by_id.where("some"), "dropped")
    left, split = without(docs, "doc_id", some), some.where("NOT all").select("doc_id")
    if split.isEmpty():
        return left
    apart = _with_set(wanted_only(docs, "doc_id", split).join(split, "doc_id", "left_semi").select(docs.columns), n)
    gone = verdicts.where("gone").select("doc_id", F.col("set_id").alias("_set")).join(split, "doc_id", "left_semi").distinct()
    return left.unionByName(apart.join(gone, ["doc_id", "_set"], "left_anti").select(docs.columns))
