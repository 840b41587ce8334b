"""Line deduplication by a segment-partition edit join (after Pass-Join, Li et al., 2011), in DataFrame functions only.

Lines within `edits` edit operations of each other are linked; linked lines, and lines linked with those, are one class,
of which the first occurrence stays. Equal lines are one node, known by a 64-bit hash.

A line is split into edits + 1 segments, which an index holds with the line's length and the segment's number. Of two
lines within the bound, one segment of the shorter stands unchanged in the longer, shifted by no more than the edits
around it allow; so a line probes, for each length from its own down to `edits` less, only the substrings that a segment
can have moved to. Candidates are verified by the banded bit-parallel distance of Hyyro (2003): 2 * edits + 1 bits hold
the band of one column, and each character of the other line advances them by a few operations.

A key of more than HOT lines, such as a beginning that many lines share, is not paired as it is. What a line leaves open on
either side of the segment is split again in the same way, by the number of edits that may stand there, and the parts make
longer keys; a key that this does not make much smaller holds near copies. Of these, lines are paired whose characters,
counted by class, differ by no more than the edits can make them differ. Neither step loses a pair within the bound.

Two edits may make any short line another. Lines shorter than `min_chars` are compared exactly only, or, with `short` =
(chars, fewer), from that many characters on by so many edits: each bound is a grade with an index and probes of its own, and
two lines are held to that of the shorter one. Blank lines are no lines. Null texts have none. A null doc_id comes last in the order of occurrences; rows that repeat doc_id and
text stay or go together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.graph import components
from tallyferry.llm.store import marked, stored

EDITS = 2
MIN_CHARS = 24
SHORT = (12, 1)  # characters and edits of lines below MIN_CHARS
HOT = 16  # lines of a key that are paired with all lines that probe it
ROUNDS = 4  # how often the key of a hot group may grow
CLASSES = 16  # of characters, whose numbers tell near copies apart
_LONGEST_POWER = 20  # common ends are measured in steps from 2**20 characters down; longer ones are trimmed by less


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line, line_id of every line that is not blank."""
    return (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(r"\S"))
        .withColumn("line_id", F.xxhash64("line"))
    )


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Begin (from 1) and length of segment i of `parts`; the last ones are longer by a character where needed."""
    size, more = F.floor(length / parts).cast("int"), length % parts
    short = parts - more
    return size * i + F.greatest(F.lit(0), i - short) + 1, size + F.when(F.lit(i) >= short, 1).otherwise(0)


Grades = list[tuple[int, int, int | None]]  # edits, and the lengths of the lines that are indexed and probed with them


def grades_of(edits: int, min_chars: int, short: tuple[int, int] | None) -> Grades:
    """A line of `min_chars` or little more may be linked with a shorter one, so it is of the lower grade as well."""
    return [(edits, min_chars, None), *([(short[1], short[0], min_chars - 1 + short[1])] if short else [])]


def _of_grades(line: Column, grades: Grades, arrays: list[Column]) -> Column:
    """One array, of those of the line's grades."""
    own = F.length(line)
    due = [own >= low if high is None else own.between(low, high) for _, low, high in grades]
    return F.concat(*[F.when(test, x).otherwise(F.array()) for test, x in zip(due, arrays, strict=True)])


def _key(length: Column, i: int, text: Column) -> Column:
    return F.xxhash64(length, F.lit(i), text)


def index_keys(line: Column, edits: int, grade: int = 0) -> Column:
    own = F.length(line)
    keys = []
    for i in range(edits + 1):
        begin, size = segment(own, i, edits + 1)
        keys.append(_key(own, i + _APART * grade, F.substring(line, begin, size)))
    return F.array(*keys)


def _indexed(line: str, grades: Grades) -> Column:
    """All index keys of a line."""
    return _of_grades(F.col(line), grades, [index_keys(F.col(line), edits, g) for g, (edits, _, _) in enumerate(grades)])


_APART = 100  # keeps the keys of grades apart
_LEVEL_KEY = f"xxhash64(n, i + {_APART} * grade, substring(line, at, size))"


def _places(lines: DataFrame, grades: Grades) -> DataFrame:
    """line_id, line, own: its length, and where a segment i of a line of n characters, n at most own, is looked for: `size`
    characters from `at` on, shifted by `move`; `grade` and its `edits`.

    The places to look at are rows first, and one short expression makes their keys: an array of all keys' expressions is
    too much code for the JVM to compile.
    """
    places = [
        F.array(*[
            F.struct(F.lit(grade).alias("grade"), F.lit(edits).alias("edits"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(move).alias("move"))
            for less in range(edits + 1)
            for i in range(edits + 1)
            for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
        ])
        for grade, (edits, _, _) in enumerate(grades)
    ]
    kept = ("line_id", "line", "own", "grade", "edits", "i", "move")
    return (
        lines.select("line_id", "line", F.length("line").alias("own"), F.inline(_of_grades(F.col("line"), grades, places)))
        .selectExpr(*kept, "own - less AS n", "CAST((own - less) DIV (edits + 1) AS INT) AS size", "edits + 1 - (own - less) % (edits + 1) AS short")
        .selectExpr(*kept, "n", "size * i + greatest(0, i - short) + 1 + move AS at", "size + IF(i >= short, 1, 0) AS size")
        .where("at >= 1 AND at + size <= own + 1")
    )


def probes(lines: DataFrame, edits: int, grades: Grades | None = None) -> DataFrame:
    """(b, key): the keys under which a line of at most this length, within the bound, is found."""
    return _places(lines, grades or [(edits, 0, None)]).selectExpr("line_id AS b", f"{_LEVEL_KEY} AS key")


def _open(left: tuple[str, str, str, str], right: tuple[str, str, str, str]) -> str:
    """What is left to compare: intervals (at, size) of a line, n characters in the shorter one, that hold `budget` edits."""
    both = ", ".join(f"named_struct('at', {at}, 'size', {size}, 'n', {n}, 'budget', {budget})" for at, size, n, budget in (left, right))
    return f"filter(array({both}), x -> x.budget > 0 AND x.n > x.budget)"


def opened(lines: DataFrame, grades: Grades) -> DataFrame:
    """(line_id, key, same, open) for all probes; those with `same` are the line's index keys."""
    left, right = ("1", "at - 1", "at - 1 - move", "i"), ("at + size", "own + 1 - at - size", "n + 1 - at + move - size", "edits - i")
    return _places(lines, grades).selectExpr("line_id", f"{_LEVEL_KEY} AS key", "own = n AND move = 0 AS same", f"{_open(left, right)} AS open")


def narrowed(rows: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(line_id, parent, key, same, open): `rows` of `opened` with longer keys, the old ones as parent.

    The first open interval is split into one part more than it may hold edits. One part j stands unchanged, with at most j
    edits before it and the others behind, so its shift has the same bounds as that of a segment.
    """
    steps = ", ".join(
        f"named_struct('budget', {budget}, 'j', {j}, 'move', {move})"
        for budget in range(1, edits + 1) for j in range(budget + 1) for move in range(-j, j + 1)
    )
    left, right = ("p.at", "from - p.at", "from - p.at - move", "j"), ("from + part", "p.at + p.size - from - part", "p.n + p.at + move - from - part", "budget - j")
    return (
        rows.where("size(open) > 0").join(lines.select("line_id", "line"), "line_id")
        .selectExpr("line_id", "line", "key AS parent", "same", "open[0] AS p", "slice(open, 2, size(open)) AS later", f"inline(array({steps}))")
        .where("p.budget = budget AND abs(p.size - p.n - move) <= budget - j")
        .selectExpr("*", "CAST(p.n DIV (budget + 1) AS INT) AS whole", "budget + 1 - p.n % (budget + 1) AS short")
        .selectExpr("*", "p.at + whole * j + greatest(0, j - short) + move AS from", "whole + IF(j >= short, 1, 0) AS part")
        .where("from >= p.at AND from + part <= p.at + p.size")
        .selectExpr(
            "line_id", "parent", "xxhash64(parent, j, substring(line, from, part)) AS key", "same AND move = 0 AS same",
            f"concat(later, {_open(left, right)}) AS open",
        )
    )


def alike(rows: DataFrame, bags: DataFrame, edits: int) -> DataFrame:
    """(a, b): different lines of one key, one of them its index line, whose bags may be within `edits` edits."""
    x = rows.where("same").join(bags, "line_id").selectExpr("key", "line_id AS a", "bag AS x")
    y = rows.join(bags, "line_id").selectExpr("key", "line_id AS b", "bag AS y")
    apart = " + ".join(f"abs(x.c{k} - y.c{k})" for k in range(CLASSES))
    return x.join(y, "key").where(f"a <> b AND {apart} <= {2 * edits}").select("a", "b")


def hot_pairs(rows: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): candidates among `rows` of `opened`, all of hot keys. An edit changes the numbers of two classes by one."""
    codes = "transform(filter(split(line, ''), c -> c <> ''), c -> ascii(c))"
    counted = ", ".join(f"'c{k}', size(filter(codes, c -> c % {CLASSES} = {k}))" for k in range(CLASSES))
    bags = stored(lines.selectExpr("line_id", f"{codes} AS codes").selectExpr("line_id", f"named_struct({counted}) AS bag"), "line-bags")
    found, number = [], [F.count_if("same").alias("n"), F.count("*").alias("p")]
    for _ in range(ROUNDS):
        longer = stored(narrowed(rows, lines, edits), "line-longer-keys")
        met = stored(
            longer.groupBy("parent", "key").agg(*number, F.min("line_id").alias("least"), F.max("line_id").alias("most"))
            .where("n > 0 AND least <> most"), "line-key-sizes",
        )
        smaller = (
            rows.where("size(open) > 0").groupBy("key").agg(*number)
            .join(met.groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("n") * F.col("p")).alias("after")), "key", "left")
            .where("2 * coalesce(after, 0) <= n * p").select("key")
        )
        smaller = stored(smaller, "line-keys-narrowed")
        found.append(alike(rows.join(smaller, "key", "left_anti"), bags, edits))
        kept = met.join(smaller.withColumnRenamed("key", "parent"), "parent", "left_semi").select("key", "n")
        rows = stored(longer.drop("parent").join(kept, "key"), "line-hot-keys")
        found.append(alike(rows.where(f"n <= {HOT}"), bags, edits))
        rows = rows.where(f"n > {HOT}").drop("n")
        if rows.isEmpty():
            break
    else:
        found.append(alike(rows, bags, edits))
    return reduce(DataFrame.unionByName, found)


def _common(a: str, b: str, room: str, from_end: bool) -> str:
    """Length of the common beginning or end, at most `room`, in halving steps."""
    x, y = (f"substring({s}, length({s}) - n - p + 1, p)" if from_end else f"substring({s}, n + 1, p)" for s in (a, b))
    steps = ", ".join(str(1 << power) for power in range(_LONGEST_POWER, -1, -1))
    return f"aggregate(array({steps}), 0, (n, p) -> IF(n + p <= {room} AND {x} = {y}, n + p, n))"


def trimmed(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Cuts common ends off both columns, leaving edits + 1 characters of either; the distance stays the same."""
    room = f"least(length({a}), length({b})) - {edits + 1}"
    head = pairs.withColumn("_n", F.expr(_common(a, b, room, False)))
    cut = head.withColumns({s: F.expr(f"substring({s}, _n + 1)") for s in (a, b)})
    tail = cut.withColumn("_n", F.expr(_common(a, b, room, True)))
    return tail.withColumns({s: F.expr(f"left({s}, length({s}) - _n)") for s in (a, b)}).drop("_n")


def may_be_near(a: str, b: str, edits: int) -> Column:
    """False only for trimmed columns that are farther than `edits` apart.

    Where nothing common is left at either end, one edit is at the first and one at the last character; with no more than
    two, all between stands unchanged in the other. What the trimming had to leave is too short to tell.
    """
    if edits > 2:
        return F.lit(True)
    return F.expr(f"least(length({a}), length({b})) <= {edits + 1} OR contains({b}, substring({a}, 2, length({a}) - 2))")


def banded_distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of columns a and b if it is at most `edits`, else some larger number; lengths differ by at most
    `edits`, and `a` has more than `edits` characters.

    Bit i of the band stands for character j - edits + i of `a` beside character j of `b`. The distance is followed down
    the band's last diagonal to the end of `a`, and from there along its last row.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (2 * edits)
    chars = f"filter(split({a}, ''), c -> c <> '')"
    other = f"filter(split({b}, ''), c -> c <> '')"
    # for each character of b, the bits of the band whose characters of a match it
    match = " + ".join(f"IF(coalesce(get(p, j - {edits - i}) = c, false), {1 << i}L, 0L)" for i in range(width))
    bits = f"element_at(transform(array({chars}), p -> transform({other}, (c, j) -> {match})), 1)"
    # one column of the band: d zero diagonal steps, hp and hn horizontal steps up and down
    d = f"(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask}L)"
    hp, hn = f"((s.vn | ~({d} | s.vp)) & {mask}L)", f"(s.vp & {d})"
    moved = (
        f"IF(s.j < s.m - {edits}, IF(({d} & {top}L) = 0, 1, 0), "
        f"CAST((shiftright({hp}, s.m - 1 - s.j + {edits}) & 1) - (shiftright({hn}, s.m - 1 - s.j + {edits}) & 1) AS INT))"
    )
    step = (
        f"named_struct('m', s.m, 'j', s.j + 1, 'vp', ({hn} | ~(shiftright({d}, 1) | {hp})) & {mask}L, "
        f"'vn', shiftright({d}, 1) & {hp}, 'dist', s.dist + {moved})"
    )
    start = f"named_struct('m', length({a}), 'j', 0, 'vp', {((1 << (edits + 1)) - 1) << edits}L, 'vn', 0L, 'dist', {edits})"
    return F.expr(f"aggregate({bits}, {start}, (s, x) -> {step}, s -> s.dist)")


def candidates(met: DataFrame, texts: DataFrame, grades: Grades) -> DataFrame:
    """(a, b) out of `met`: keys with n, the number of their index lines, a, the least of these, and b, a line that probes it.

    The index lines of a key probe it as well, so all of them are among b."""

    def lines_of_keys(test: str) -> DataFrame:
        return texts.join(met.where(test).select(F.col("b").alias("line_id")).distinct(), "line_id", "left_semi")

    some = lines_of_keys(f"n BETWEEN 2 AND {HOT}").select(F.col("line_id").alias("a"), F.explode(_indexed("line", grades)).alias("key"))
    pairs = met.where("n = 1").select("a", "b").unionByName(
        met.where(f"n BETWEEN 2 AND {HOT}").select("key", "b").join(some, "key").where("a <> b").select("a", "b")
    )
    hot = met.where(f"n > {HOT}").select("key")
    if hot.isEmpty():
        return pairs
    lines = stored(lines_of_keys(f"n > {HOT}"), "line-hot-texts")
    rows = stored(opened(lines, grades).join(hot.distinct(), "key", "left_semi"), "line-hot-keys")
    return pairs.unionByName(hot_pairs(rows, lines, max(edits for edits, _, _ in grades)))


def near_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): line_id of every two different lines of at least `min_chars` characters within `edits` edits; with `short` =
    (chars, fewer) also of those whose shorter one has at least `chars` characters within `fewer` edits, no more than `edits`."""
    grades = grades_of(edits, min_chars, short)
    long_lines = lines.where(F.length("line") >= min(low for _, low, _ in grades)).select("line_id", "line")
    again = long_lines.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1").select("line_id")
    seen = marked(long_lines, "_again", F.col("line_id"), stored(again, "repeated-ids"))
    once = seen.where("NOT _again").select("line_id", "line")
    repeated = stored(seen.where("_again").groupBy("line_id").agg(F.min("line").alias("line")), "repeated-lines")
    distinct = once.unionByName(repeated)

    index = distinct.select(F.col("line_id").alias("a"), F.explode(_indexed("line", grades)).alias("key"))
    keys = index.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("a"))
    # one row per probe at most, however many lines a key has
    met = stored(probes(distinct, edits, grades).join(keys, "key").where("n > 1 OR a <> b").select("key", "n", "a", "b"), "line-keys")
    ends = met.select(F.col("a").alias("line_id")).union(met.select("b")).distinct()
    texts = stored(marked(distinct, "_may", F.col("line_id"), ends).where("_may").drop("_may").join(ends, "line_id", "left_semi"), "line-texts")
    pairs = stored(
        candidates(met, texts, grades).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs"
    )
    # pairs are short rows, few files hold many of them: they are dealt to all cores before they get their texts
    both = (
        pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "a", "b")
        .join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a")
        .join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b")
    )
    # written, so that the filter is not pushed below the trimming, which would repeat it at every step
    bound = F.when(F.least(F.length("x"), F.length("y")) >= min_chars, edits).otherwise(short[1] if short else edits)
    middle = stored(trimmed(both.withColumn("bound", bound), "x", "y", edits), "line-middles")
    return middle.where(may_be_near("x", "y", edits)).where(banded_distance("x", "y", edits) <= F.col("bound")).select("a", "b")


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS,
    short: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, class_doc and class_line (the first occurrence of its class),
    n_links (different lines within the bound), kept."""
    lines = lines_of(docs, id_col, text_col)
    links = stored(near_links(lines, edits, min_chars, short), "line-links")
    degree = (
        links.select(F.col("a").alias("line_id")).unionByName(links.select(F.col("b").alias("line_id")))
        .groupBy("line_id").agg(F.count("*").alias("n_links"))
    )
    classes = components(links, "a", "b").withColumnRenamed("node", "line_id").join(degree, "line_id")
    placed = (
        lines.select("doc_id", "line_no", "line_id").join(classes, "line_id", "left")
        .select("doc_id", "line_no", F.coalesce("component", "line_id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    first = placed.groupBy("class").agg(F.min(order).alias("first"))
    return placed.join(first, "class").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc"),
        F.col("first.line_no").cast("long").alias("class_line"), "n_links",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS,
    short: tuple[int, int] | None = None,
) -> DataFrame:
    """The documents without the lines that do not stay; blank lines and the order of lines are kept.

    The ids of the lines to leave out travel by document, so a document's list is no longer than the document. Rows that
    share a doc_id lose the lines that fall in any of them.
    """
    gone = (
        line_classes(docs, id_col, text_col, edits, min_chars, short).where("NOT kept AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    )
    left = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> NOT array_contains(coalesce(_gone, array()), CAST(i AS LONG))), '\\n')")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_id"), "left").withColumn(text_col, left).select(*[F.col(f"`{c}`") for c in docs.columns])
