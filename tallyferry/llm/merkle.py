"""Merkle manifest of a dataset: one hash tree a group, one tree over the groups' roots, and proofs for many rows at once.

A tree has `ARITY` children a node; the last node of a level may have fewer. Nodes are known by (tree, level, idx), leaves
are level 0. Leaves get their places from range partitions (`numbering`), so no group is ever sorted in one task; nodes
are hashed in blocks of 512 neighbours, three levels a round.

Proofs of many rows share most of their nodes. Leaves are dealt into parts of up to 512 neighbours; each part finds the
least set of nodes it can neither hold nor derive (`missing_nodes`), the sets of all parts are fetched by one join, and
each part derives the nodes between and writes out the proofs of its leaves.

Odd rows: rows given twice are two leaves, one after the other. Rows with the same key are in the order of their leaf
hashes. A null key comes first, a null group is a group of its own and the first. An empty table has no leaf and no root.
Columns of the caller are kept in one struct `_row`, so their names never clash; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyferry.llm.store import stored
from tallyferry.operators.numbering import number_by_key

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
ROUND_LEVELS = 3
BLOCK_BITS = ARITY_BITS * ROUND_LEVELS
# askers of nodes near a root are dealt over so many copies of each
SALTS = 32
# so many trees, a short line each, are broadcast to the leaves; more are copied to SALTS parts of a shuffle
FEW_TREES = 10_000
# trees are named "" (null group) or "=" and the group's value; this one stands over their roots
OVER = "*"
NODES = "tree string, level int, idx long, hash string, n long"


@dataclass(frozen=True)
class Manifest:
    """`leaves`: _row, tree, idx, n (leaves of the tree), leaf, subroot, at, width (place and number of trees), root.

    `nodes`: tree, level, idx, hash, n (nodes of that level) of every inner node; those of tree `OVER` include its leaves.
    """

    leaves: DataFrame
    nodes: DataFrame


def leaf_hash(*values: Column) -> Column:
    """H over all values in order: `-` for null, else the length in UTF-8 bytes, a colon and the value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in (v.cast("string") for v in values)
    ]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(children: Iterable[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels(n: int) -> int:
    """How many levels of inner nodes stand over n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def missing_nodes(held: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The least set of (level, idx) that, with the held leaves of a tree of n leaves, gives every proof of them."""
    now, found, level = set(held), [], 0
    while n > 1:
        runs = {i >> ARITY_BITS for i in now}
        found += [(level, i) for r in runs for i in range(r << ARITY_BITS, min((r + 1) << ARITY_BITS, n)) if i not in now]
        now, n, level = runs, -(-n // ARITY), level + 1
    return found


def climbing(base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The next `ROUND_LEVELS` levels over a block of neighbours on level `base`."""

    def climb(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        tree, left = block.tree.iloc[0], int(block.n.iloc[0])
        here, out = list(zip(block.idx, block.hash)), []
        for level in range(base + 1, base + ROUND_LEVELS + 1):
            if left <= 1:
                break
            left = -(-left // ARITY)
            first = here[0][0] >> ARITY_BITS
            here = [(first + k // ARITY, hashed(h for _, h in here[k : k + ARITY])) for k in range(0, len(here), ARITY)]
            out += [(tree, level, i, h, left) for i, h in here]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "hash", "n"])

    return climb


def inner_nodes(leaves: DataFrame) -> DataFrame:
    """All inner nodes over rows (tree, idx, n, hash): `ROUND_LEVELS` levels a round, each in blocks of 512 neighbours."""
    now = leaves.select("tree", "idx", "n", "hash")
    made = leaves.sparkSession.createDataFrame([], NODES)
    for base in range(0, levels(leaves.agg(F.max("n")).head()[0] or 0), ROUND_LEVELS):
        blocks = now.where("n > 1").groupBy("tree", F.shiftright("idx", BLOCK_BITS).alias("block"))
        here = stored(blocks.applyInPandas(climbing(base), NODES), "merkle-nodes")
        made = made.unionByName(here)
        now = here.where(F.col("level") == base + ROUND_LEVELS)
    return made


def of_tree(leaves: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    """Leaves with the line of their tree. One tree may hold most leaves, so leaves never meet by tree alone."""
    if width <= FEW_TREES:
        return leaves.join(F.broadcast(trees), "tree")
    salted = leaves.withColumn("salt", F.pmod(F.xxhash64("leaf", "tree"), F.lit(SALTS)).cast("int"))
    copied = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied, ["tree", "salt"]).drop("salt")


def manifest(rows: DataFrame, key: str, tree: str, fields: list[Column], carry: dict[str, Column] | None = None) -> Manifest:
    """The trees of `rows`, one per value of `tree`, with leaves over `fields` ascending by `key`.

    `carry` has more columns to keep in `_row` beside key and tree (None: all columns of `rows`). Only what is kept and one
    hash a row is shuffled; for texts, carry something smaller.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns] if carry is None else [
        F.col(f"`{key}`"), F.col(f"`{tree}`"), *[c.alias(name) for name, c in carry.items()]
    ]
    leaves = rows.select(
        F.struct(*kept).alias("_row"), F.col(f"`{key}`").alias("key"),
        # null is the least tree; "=" keeps the bytewise order of the others
        F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("")).alias("tree"),
        leaf_hash(*fields).alias("leaf"), F.monotonically_increasing_id().alias("spread"),
    )
    # hashed once: dealing into ranges looks at its input twice
    leaves = stored(leaves, "merkle-hashes")
    placed = number_by_key(leaves, ["tree", "key", "leaf", "spread"], "place", lambda df: stored(df, "merkle-leaves"))
    trees = placed.groupBy("tree").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ranked = number_by_key(trees, "tree", "at", lambda df: stored(df, "merkle-trees"))
    width = ranked.count()
    placed = of_tree(placed, ranked, width).select("_row", "tree", (F.col("place") - F.col("first")).alias("idx"), "n", "leaf")
    inner = inner_nodes(placed.withColumnRenamed("leaf", "hash"))
    tops = inner.where("n = 1").select("tree", F.col("hash").alias("subroot")).unionByName(
        placed.where("n = 1").select("tree", F.col("leaf").alias("subroot"))
    )
    subroots = stored(
        ranked.join(tops, "tree").select("tree", (F.col("at") - 1).alias("at"), F.lit(width).cast("long").alias("width"), "subroot"),
        "merkle-subroots",
    )
    leaves_over = subroots.select(
        F.lit(OVER).alias("tree"), F.lit(0).alias("level"), F.col("at").alias("idx"), F.col("subroot").alias("hash"), F.col("width").alias("n")
    )
    over = leaves_over.unionByName(inner_nodes(leaves_over))
    top = over.where("n = 1").head()
    done = of_tree(placed, subroots, width).withColumn("root", F.lit(top.hash if top else None).cast("string"))
    return Manifest(stored(done, "merkle-manifest"), inner.unionByName(over))


def proofs(found: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """`wanted` leaves (rows of `found.leaves`; None: all) with `proof`: per level, from leaf to root, the hashes that stand
    before and after the node in its run, each joined to one text."""
    leaves = (found.leaves if wanted is None else wanted).withColumn("part", F.shiftright("idx", BLOCK_BITS))
    parts = leaves.groupBy("tree", "part").agg(
        F.collect_list("idx").alias("held"), *[F.first(c).alias(c) for c in ("n", "at", "width")]
    )

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree, part, held, n, at, width in batch.itertuples(index=False):
                out += [(tree, part, tree, level, i) for level, i in missing_nodes(map(int, held), n)]
                out += [(tree, part, OVER, level, i) for level, i in missing_nodes([at], width)]
            yield pd.DataFrame(out, columns=["tree", "part", "of", "level", "idx"])

    asked = parts.mapInPandas(needed, "tree string, part long, of string, level int, idx long")
    nodes = found.nodes.select(F.col("tree").alias("of"), "level", "idx", "hash").unionByName(
        found.leaves.select(F.col("tree").alias("of"), F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"))
    )
    # The nodes next to a root are wanted by every part.
    shared = (F.col("idx") < 1 << BLOCK_BITS) & ((F.col("level") > 0) | (F.col("of") == OVER))
    salt = F.pmod(F.xxhash64("tree", "part"), F.lit(SALTS)).cast("int")
    asked = asked.withColumn("salt", F.when(shared, salt).otherwise(0))
    nodes = nodes.withColumn("salt", F.explode(F.when(shared, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    fetched = asked.join(nodes, ["of", "level", "idx", "salt"]).select("tree", "part", "of", "level", "idx", "hash")
    columns = ["_row", "tree", "idx", "n", "leaf", "subroot", "at", "width", "root"]

    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        (tree, n, at, width, subroot), *_ = zip(*(mine[c].to_pylist()[:1] for c in ("tree", "n", "at", "width", "subroot")))
        places = mine["idx"].to_pylist()
        known = {(of, level, i): h for of, level, i, h in zip(*(others[c].to_pylist() for c in ("of", "level", "idx", "hash")))}
        known |= {(tree, 0, i): h for i, h in zip(places, mine["leaf"].to_pylist())} | {(OVER, 0, at): subroot}
        for of, now, left in ((tree, set(places), n), (OVER, {at}, width)):
            for level in range(levels(left)):
                now = {i >> ARITY_BITS for i in now}
                for i in now:
                    run = range(i << ARITY_BITS, min((i + 1) << ARITY_BITS, left))
                    known[of, level + 1, i] = hashed(known[of, level, k] for k in run)
                left = -(-left // ARITY)

        @cache
        def step(of: str, level: int, i: int, left: int) -> dict[str, str]:
            run = i >> ARITY_BITS << ARITY_BITS
            return {
                "before": "".join(known[of, level, k] for k in range(run, i)),
                "after": "".join(known[of, level, k] for k in range(i + 1, min(run + ARITY, left))),
            }

        def path(i: int) -> list[dict[str, str]]:
            steps = []
            for of, now, left in ((tree, i, n), (OVER, at, width)):
                for level in range(levels(left)):
                    steps.append(step(of, level, now, left))
                    now, left = now >> ARITY_BITS, -(-left // ARITY)
            return steps

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return mine.select(columns).append_column("proof", pa.array([path(i) for i in places], kind))

    schema = T.StructType([*[leaves.schema[c] for c in columns]]).add("proof", T.ArrayType(T.StructType().add("before", "string").add("after", "string")))
    return leaves.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give: compare it with the root one trusts."""
    return F.aggregate(
        proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]).cast("binary"), 256)
    )


def proof_digest(proof: Column) -> Column:
    """H over all hashes of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)
