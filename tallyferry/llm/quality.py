"""Quality classifier: a sparse ensemble of rules over text statistics (after RuleFit, Friedman and Popescu, 2008).

Trees of a random forest give the rules: each path from a root to a node is a conjunction of bounds on statistics. A
logistic regression with a lasso penalty weighs the rules, and those with a weight become one Spark column expression.
Only that expression scores documents. Learned from labels.MAX_LABELLED rows at most, none of them held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.arrays import BASE, BYTE_VALUE, SOLID, Words, mixed, pieces
from tallyferry.llm.labels import MAX_LABELLED, to_learn_from
from tallyferry.llm.store import stored

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "symbols", "stops", "exclaims", "wide",
    "distinct_words", "top_word", "lines", "line_bytes", "repeated_lines", "words_with_symbols",
)
TREES, DEPTH, LASSO = 24, 3, 0.002
THRESHOLD = 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    size = np.diff(bounds).astype(float)
    words = Words(data, bounds, SOLID)
    count, owner = words.count.astype(float), words.owner()
    some, any_word = np.maximum(size, 1), np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    n = len(bounds) - 1
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[data] | (data == 0x21))])
    # distinct words, and the share of the most frequent one
    order = np.lexsort((words.hash, owner))
    h, o = words.hash[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    # lines, by the hash of their bytes
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    lines, repeated, line_owner = np.zeros(n), np.zeros(n), np.searchsorted(bounds, starts, "right") - 1
    if len(starts):
        within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        value = BYTE_VALUE[data] * mixed(within.astype(np.uint64) * BASE)
        line = np.add.reduceat(value, starts)
        order = np.lexsort((line, line_owner))
        l, o2 = line[order], line_owner[order]
        again = np.zeros(len(l), bool)
        again[1:] = (l[1:] == l[:-1]) & (o2[1:] == o2[:-1])
        lines, repeated = np.bincount(line_owner, minlength=n).astype(float), np.bincount(o2[again], minlength=n).astype(float)
    letters = _per_text(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A), bounds)
    return np.stack([
        np.log1p(size), np.log1p(count), np.bincount(owner, length, n) / any_word, np.bincount(owner, length > 20, n) / any_word,
        _per_text((data >= 0x41) & (data <= 0x5A), bounds) / np.maximum(letters, 1),
        _per_text((data >= 0x30) & (data <= 0x39), bounds) / some, _per_text(_SYMBOL[data], bounds) / some,
        _per_text(_STOP[data], bounds) / any_word, _per_text(data == 0x21, bounds) / any_word, _per_text(data >= 0x80, bounds) / some,
        np.bincount(o[new], minlength=n) / any_word, top / any_word, lines, size / np.maximum(lines, 1), repeated / np.maximum(lines, 1),
        np.bincount(owner, (odd[words.end] - odd[words.start]) > 0, n) / any_word,
    ], 1)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `docs` but the text, and _s_<name> for each of STATISTICS."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"_s_{s} double" for s in STATISTICS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            got = [_statistics(data, bounds) for _, _, data, bounds in pieces(batch.column(names.index(text_col)))]
            table = np.concatenate(got) if got else np.empty((0, len(STATISTICS)))
            arrays = [batch.column(k) for k, name in enumerate(names) if name != text_col]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))]],
                names=[n for n in names if n != text_col] + [f"_s_{s}" for s in STATISTICS],
            )

    return docs.mapInArrow(task, schema)


Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound) of each condition, all of which must hold


def paths(node, so_far: Rule = ()) -> list[Rule]:
    """The rules of a fitted tree: the conditions that lead to each of its nodes but the root."""
    if not node.subtreeDepth():
        return []
    name, bound = STATISTICS[node.split().featureIndex()], node.split().threshold()
    out = []
    for sign, child in (("<=", node.leftChild()), (">", node.rightChild())):
        rule = tightened((*so_far, (name, sign, bound)))
        out += [rule, *paths(child, rule)]
    return out


def tightened(rule: Rule) -> Rule:
    """One bound per statistic and side, in a fixed order."""
    best: dict[tuple[str, str], float] = {}
    for name, sign, bound in rule:
        held = best.get((name, sign), bound)
        best[name, sign] = min(held, bound) if sign == "<=" else max(held, bound)
    return tuple((name, sign, bound) for (name, sign), bound in sorted(best.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        value = F.col(f"_s_{name}")
        out = out & (value <= bound if sign == "<=" else value > bound)
    return out


def fit(known: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> tuple[dict[Rule, float], float]:
    """Weights of the rules that the lasso keeps, and the intercept, from rows with statistics and `label`."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[f"_s_{s}" for s in STATISTICS], outputCol="features").transform(known)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5).fit(rows.select("label", "features"))
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._java_obj.rootNode())})
    if not rules:
        share = known.agg(F.avg("label")).first()[0]
        return {}, math.log(share / (1 - share))
    named = known.select("label", *[condition(rule).cast("double").alias(f"r{k}") for k, rule in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(named)
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(held.select("label", "features"))
    weights = model.coefficients.toArray()
    return {rule: float(w) for rule, w in zip(rules, weights, strict=True) if w}, float(model.intercept)


def compiled(weights: dict[Rule, float], intercept: float) -> Column:
    """The probability of label 1 as one column expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in weights.items():
        total = total + F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """The columns of `docs` but the text, and _score, the probability of label 1, from the text alone.

    An empty or null text has statistics of 0 and is scored like any other. If the labels to learn from are all alike,
    every score is that label, and 0 if there are none (of documents that are here).
    """
    known = stored(to_learn_from(labels, target, most), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "label")), "doc_id")
    learned = stored(with_statistics(rows).orderBy("doc_id"), "statistics")
    seen = {r.label for r in learned.select("label").distinct().collect()}
    if len(seen) < 2:
        return docs.drop("text").withColumn("_score", F.lit(float(1 in seen)))
    weights, intercept = fit(learned)
    return with_statistics(docs).withColumn("_score", compiled(weights, intercept)).drop(*[f"_s_{s}" for s in STATISTICS])
