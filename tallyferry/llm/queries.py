"""The registered queries: each operator with production parameters over its whole table, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyferry.llm import decontamination, exact_dedup, jaccard_join, licenses, line_dedup, merkle, neighbours, piece_sampling, quality, suffix_dedup, token_counts, toxicity, whitening
from tallyferry.llm.labels import fold
from tallyferry.llm.store import importable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register(
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
               FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256)
    )
    return exact_dedup.duplicate_groups(docs).select(
        "_row.doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"), "_row.text_sha256",
    )


@register()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


@register()
def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_sampling.sampled_pieces(docs, vocabulary(piece_sampling.MODEL), with_pieces=False).select(
        "doc_id", F.col("_n_pieces").alias("n_pieces"), F.col("_pieces_sha256").alias("pieces_sha256"),
        F.col("_lossless").alias("lossless"),
    )


@register()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@register(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
    wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
             FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p
                   FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    places AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, p, n, item_id FROM places JOIN wins USING (n, g)),
    words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
              FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", F.col("_n_words").alias("n_words"), decontamination.n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


@register()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary(token_counts.MODEL)).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), F.col("_over_limit").alias("over_limit")
    )


@register()
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base, more = F.col("_base.label"), F.col("_matches.label")
    return licenses.license_scan(docs).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.word").alias("first_word"), F.array_max("_base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.col("_score").alias("score"), F.col("_matches").alias("matches"),
    )


@register()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@register()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"),
        F.col("_kept_sha256").alias("kept_sha256"),
    )


@register()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), short=line_dedup.SHORT)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAF_SQL = "sha256(concat({}))".format(", ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
))


@register(
    f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, {_LEAF_SQL.replace("{text}", "text")} AS leaf,
             {_LEAF_SQL.replace("{text}", f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other,
             -- crc32, bit by bit
             xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                   lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::UBIGINT),
                 lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))),
               4294967295::UBIGINT) AS crc
      FROM documents),
    l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
                 count(*) OVER (PARTITION BY lang) AS n FROM d),
    low(tree, level, idx, h, n) AS (
      SELECT tree, 0, idx, leaf, n FROM l
      UNION ALL
      SELECT tree, max(level) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), max((n + 7) // 8) FROM low WHERE n > 1 GROUP BY tree, idx // 8),
    sub AS (SELECT tree, max(h) AS subroot, count(*) OVER () AS width FROM low WHERE n = 1 GROUP BY tree),
    high(level, idx, h, n) AS (
      SELECT 0, tree - 1, subroot, width FROM sub
      UNION ALL
      SELECT max(level) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), max((n + 7) // 8) FROM high WHERE n > 1 GROUP BY idx // 8),
    start AS (SELECT doc_id, tree, idx, n, CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS h FROM l),
    fold_low(doc_id, tree, level, idx, h, n, proof) AS (
      SELECT doc_id, tree, 0, idx, h, n, '' FROM start
      UNION ALL
      SELECT f.doc_id, f.tree, max(f.level) + 1, max(f.idx // 8),
             sha256(string_agg(CASE WHEN o.idx = f.idx THEN f.h ELSE o.h END, '' ORDER BY o.idx)), max((f.n + 7) // 8),
             max(f.proof) || coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx <> f.idx), '')
      FROM fold_low f JOIN low o ON o.tree = f.tree AND o.level = f.level AND o.idx // 8 = f.idx // 8 WHERE f.n > 1 GROUP BY f.doc_id, f.tree),
    fold_high(doc_id, level, idx, h, n, proof) AS (
      SELECT doc_id, 0, tree - 1, h, width, proof FROM fold_low JOIN sub USING (tree) WHERE n = 1
      UNION ALL
      SELECT f.doc_id, max(f.level) + 1, max(f.idx // 8),
             sha256(string_agg(CASE WHEN o.idx = f.idx THEN f.h ELSE o.h END, '' ORDER BY o.idx)), max((f.n + 7) // 8),
             max(f.proof) || coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx <> f.idx), '')
      FROM fold_high f JOIN high o ON o.level = f.level AND o.idx // 8 = f.idx // 8 WHERE f.n > 1 GROUP BY f.doc_id)
    SELECT l.doc_id, l.leaf, sub.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
    FROM l JOIN sub USING (tree) JOIN fold_high f ON f.doc_id = l.doc_id AND f.n = 1 CROSS JOIN (SELECT h FROM high WHERE n = 1) r
    """
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    tampered = F.when(chosen, merkle.leaf_hash(*fields, F.translate("text", _UPPER, _LOWER)))
    found = merkle.manifest(docs, "doc_id", "lang", [*fields, F.col("text")], {"tampered": tampered})
    return merkle.proofs(found).select(
        "_row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(F.coalesce("_row.tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, "embedding")
    error = whitening.identity_error(vectors, "embedding", model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return whitening.whitened(vectors, "embedding", model).select(
        "_row.vec_id", F.posexplode("_whitened").alias("at", "whitened"), F.col("_deviation").alias("deviation")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


@register()
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")
