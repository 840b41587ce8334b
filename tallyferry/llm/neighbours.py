"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

* Equal vectors are one class, known by its smallest id; a class keeps its k + 1 smallest ids, more can never be answered.
* Lists are fitted on a bounded sample of classes (about `SAMPLE`): the sample is halved across its widest direction until
  a part has the wanted share, the parts' means are improved by a few rounds of means, and parts that grew to twice their
  share are halved again. Neighbouring lists have neighbouring numbers.
* Every class goes to its nearest list and, near a border, to up to `REPLICAS` lists in all: those whose distance is at most
  `BORDER` more. A query looks into all lists whose distance is at most `REACH` more than that of its nearest.
* Lists are found over an in-memory graph of centroids, by following links from the nearest ones seen so far.
* Sixteen neighbouring lists make a shard; shards are cut into pieces of bounded size by the hash of the class, and queries
  into runs of bounded size, so no task holds a whole hot list. Every class of a chosen list is scored, in double precision;
  a shard's k + 1 best per query are shuffled and merged.

Inner products of any vectors become distances by one more entry, sqrt(M^2 - |x|^2), with M the largest norm; a query gets
norm M and 0 there.

Odd rows: vectors that are null, empty, zero, or hold a null or non-finite entry take no part, nor do vectors without an id or
of another length than the most common (the longest of equally common). Rows given twice are one row. An id at two vectors
is two rows, each with answers of its own. An empty table has no answers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyferry.llm.store import stored

SAMPLE = 20_000
LIST_ROWS = 256
SAMPLES_A_LIST = 4
REPLICAS = 4
BORDER, REACH = 0.05, 0.15
LINKS, BEAM = 24, 24
SHARD_LISTS = 16
PIECE_ROWS, RUN_QUERIES = 1 << 14, 1 << 12
HASH_RANGE = 1 << 30


@dataclass(frozen=True)
class Lists:
    """Centroids in neighbouring order, links between near ones, and the norm that queries are given."""

    centroids: np.ndarray
    links: np.ndarray
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = self.norm**2 - (x**2).sum(axis=1, keepdims=True)
        return np.hstack([x, np.sqrt(np.maximum(rest, 0))])

    def aimed(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x * (self.norm / np.sqrt((x**2).sum(axis=1, keepdims=True))), np.zeros((len(x), 1))])

    def within(self, points: np.ndarray, more: float) -> np.ndarray:
        """Distances of points to lists, infinite for lists not found or more than 1 + `more` times as far as the nearest."""
        count, squares = len(self.centroids), (self.centroids**2).sum(axis=1)
        far = np.full((len(points), count), np.inf)
        open_ = np.zeros(far.shape, bool)  # seen, links not yet followed
        done = np.zeros(far.shape, bool)

        def see(rows: np.ndarray, lists: np.ndarray) -> None:
            x, c = points[rows], self.centroids[lists]
            far[rows, lists] = np.sqrt(np.maximum((x**2).sum(axis=1) + squares[lists] - 2 * np.einsum("ij,ij->i", x, c), 0))
            open_[rows, lists] = True

        entries = np.unique(np.linspace(0, count - 1, min(count, 16)).astype(int))
        see(np.repeat(np.arange(len(points)), len(entries)), np.tile(entries, len(points)))
        beam = min(BEAM, count) - 1
        while True:
            bound = np.maximum((1 + more) * far.min(axis=1), np.partition(far, beam, axis=1)[:, beam])
            rows, lists = np.nonzero(open_ & (far <= bound[:, None]))
            if not len(rows):
                break
            open_[rows, lists], done[rows, lists] = False, True
            next_rows, next_lists = np.repeat(rows, self.links.shape[1]), self.links[lists].ravel()
            new = np.zeros(far.shape, bool)
            new[next_rows, next_lists] = True
            see(*np.nonzero(new & ~done & ~open_))
        return np.where(far <= (1 + more) * far.min(axis=1)[:, None], far, np.inf)


def halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two equal parts of some rows of x, on both sides of the median along their widest direction."""
    centred = x[rows] - x[rows].mean(axis=0)
    way = centred[0] + 1e-9
    for _ in range(6):
        way = centred.T @ (centred @ way)
        way /= max(np.linalg.norm(way), 1e-300)
    order = np.argsort(centred @ way, kind="stable")
    return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]


def nearest_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (centroids**2).sum(axis=1)
    return np.concatenate([(squares - 2 * part @ centroids.T).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 4096))])


def fitted(sample: np.ndarray, norm: float, lists: int) -> Lists:
    """Balanced lists over sampled vectors."""
    x = Lists(sample[:0], sample[:0], norm).lifted(sample)
    share = len(x) / lists
    todo, parts = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= max(share, 1):
            parts.append(rows)
        else:
            left, right = halves(x, rows)
            todo += [right, left]
    for _ in range(4):
        centroids = np.stack([x[rows].mean(axis=0) for rows in parts])
        own = nearest_of(x, centroids)
        by_list = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(parts)))[:-1])
        parts = []
        for rows in by_list:
            if len(rows) > 2 * share:
                parts += halves(x, rows)
            elif len(rows):
                parts.append(rows)
    centroids = np.stack([x[rows].mean(axis=0) for rows in parts])
    count = len(centroids)
    squares, near = (centroids**2).sum(axis=1), []
    for part in np.array_split(centroids, -(-count // 1024)):
        far = squares - 2 * part @ centroids.T
        kept = min(LINKS, count)
        near.append(np.argpartition(far, kept - 1, axis=1)[:, :kept])
    ring = (np.arange(count) + 1) % count  # every list can be reached from every other
    return Lists(centroids, np.hstack([np.vstack(near), ring[:, None]]), norm)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1)


def placed(rows: DataFrame, model: Lists, queries: bool) -> DataFrame:
    """`rows` (with `vector`) once per shard they go to, with `lists`, the chosen lists of that shard."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                x = matrix(batch.column(batch.schema.get_field_index("vector")))
                if queries:
                    row, chosen = np.nonzero(np.isfinite(model.within(model.aimed(x), REACH)))
                else:
                    far = model.within(model.lifted(x), BORDER)
                    most = min(REPLICAS, far.shape[1])
                    best = np.sort(np.argpartition(far, most - 1, axis=1)[:, :most], axis=1)
                    row, at = np.nonzero(np.isfinite(np.take_along_axis(far, best, axis=1)))
                    chosen = best[row, at]
                shard = chosen // SHARD_LISTS
                # rows are sorted by (row, list), so a shard's lists stand together
                first = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])[0] if len(row) else row
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype("i4")), pa.array(chosen.astype("i4")))
                out = batch.take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(shard[first].astype("i4")), lists], [*batch.schema.names, "shard", "lists"]
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(place, f"{schema}, shard int, lists array<int>")


def best_of(k: int):
    """Per query of a shard's run, the k + 1 best (class, id) of a shard's piece."""

    def scan(members: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if members.num_rows and asked.num_rows:
            x = matrix(members["vector"].combine_chunks())
            q = matrix(asked["vector"].combine_chunks())
            owner, ids = members["class"].to_numpy(), members["ids"].to_pylist()
            names = asked["class"].to_numpy()

            def by_list(table: pa.Table) -> dict[int, np.ndarray]:
                lists = table["lists"].combine_chunks()
                rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                flat = lists.flatten().to_numpy()
                order = np.argsort(flat, kind="stable")
                found, starts = np.unique(flat[order], return_index=True)
                return dict(zip(found.tolist(), np.split(rows[order], starts[1:])))

            here, wanted = by_list(members), by_list(asked)
            kept: dict[int, list[np.ndarray]] = {}
            for number, rows in here.items():
                takers = wanted.get(number, ())
                for run in range(0, len(takers), 512):
                    some = takers[run : run + 512]
                    scores = q[some] @ x[rows].T
                    most = min(k + 1, len(rows))
                    # ties at the border are all kept: the smaller id may be among them
                    least = np.partition(scores, len(rows) - most, axis=1)[:, len(rows) - most]
                    for at, row in enumerate(some.tolist()):
                        kept.setdefault(row, []).append(rows[scores[at] >= least[at] - 1e-9 * abs(least[at])])
            for row, found in kept.items():
                at = np.unique(np.concatenate(found))
                # one fixed way of adding up, so that equal products come out equal wherever they are computed
                scores = (x[at] * q[row]).sum(axis=1)
                order = np.lexsort((owner[at], -scores))[: k + 1]
                flat = sorted((-s, i, owner[m]) for s, m in zip(scores[order].tolist(), at[order].tolist()) for i in ids[m])
                out += [(names[row], c, i, -s) for s, i, c in flat[: k + 1]]
        asker, member, ids, scores = zip(*out) if out else ((), (), (), ())
        return pa.table({
            "asker": pa.array(asker, pa.int64()), "member": pa.array(member, pa.int64()), "id": pa.array(ids, pa.int64()),
            "score": pa.array(scores, pa.float64()),
        })

    return scan


def valid(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vector) of the rows that take part, the length aside."""
    found = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("vector")).where("id IS NOT NULL")
    bad = "exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return found.where(f"size(vector) > 0 AND NOT {bad} AND exists(vector, x -> x <> 0)")


def nearest(rows: DataFrame, key: str, column: str, queries: Column, k: int = 20) -> DataFrame:
    """The k nearest found of every row where `queries` (over `id`) holds: query_id, rank, id, score."""
    spark = rows.sparkSession
    answer = "query_id long, rank int, id long, score double"
    given = valid(rows, key, column)
    norm = F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + double(x) * double(x)))")
    sizes = given.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    shape = sizes.orderBy(F.desc("n"), F.desc("size")).head()
    if shape is None:
        return spark.createDataFrame([], answer)
    given = given.where(F.size("vector") == shape["size"])
    # The limit on row numbers is applied before the shuffle too, so a hot vector brings k + 1 rows a task.
    among_equal = Window.partitionBy("vector").orderBy("id")
    few = given.distinct().withColumn("nth", F.row_number().over(among_equal)).where(F.col("nth") <= k + 1)
    classes = stored(
        few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
            F.xxhash64("vector").alias("hash"), F.col("ids")[0].alias("class"), "ids", "vector"
        ),
        "neighbour-classes",
    )
    count = classes.count()
    sample = classes.where(F.pmod("hash", F.lit(HASH_RANGE)) < HASH_RANGE * min(1.0, SAMPLE / count)).orderBy("hash", "class")
    points = np.array([r.vector for r in sample.select("vector").collect()] or [classes.head().vector], dtype="f8")
    lists = max(1, min(count // LIST_ROWS, len(points) // SAMPLES_A_LIST))
    model = fitted(points, shape["norm"], lists)

    asking = stored(given.where(queries).distinct().join(classes.select("vector", "class"), "vector").select("id", "class"), "neighbour-queries")
    askers = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "vector")
    members = stored(placed(classes.select("class", "ids", "vector"), model, queries=False), "neighbour-lists")
    asked = stored(placed(askers, model, queries=True), "neighbour-probes")

    # at most one line per shard, of which there are at most SAMPLE / SAMPLES_A_LIST / SHARD_LISTS
    def cut(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    cuts = F.broadcast(cut(members, PIECE_ROWS, "pieces").join(cut(asked, RUN_QUERIES, "runs"), "shard"))
    piece, run = (F.pmod(F.xxhash64("class"), F.col(c)).cast("int") for c in ("pieces", "runs"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = members.join(cuts, "shard").withColumn("piece", piece).withColumn("run", every("runs")).drop("pieces", "runs")
    right = asked.join(cuts, "shard").withColumn("run", run).withColumn("piece", every("pieces")).drop("pieces", "runs")
    by = ("shard", "piece", "run")
    scores = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best_of(k), "asker long, member long, id long, score double")

    # an answer stands in every list it was replicated to
    merged = scores.repartition("asker").dropDuplicates(["asker", "member", "id"])
    in_order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    top = merged.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= k + 1)
    answers = top.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "member", "score"))).alias("found"))
    own = F.filter("found", lambda f: ~((f["id"] == F.col("query_id")) & (f["member"] == F.col("class"))))
    return (
        asking.withColumnRenamed("id", "query_id").join(answers.withColumnRenamed("asker", "class"), "class")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "f.id", "f.score")
    )
