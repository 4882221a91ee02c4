"""The registered queries of this folder: thin, over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, containment, content_sort, extraction, hard_negatives, language, licenses, minhash_forest
from . import packing, periodic_runs, secrets, suffix_sort, token_counts, toxicity


def held_out(key: str, parts: int, rest: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == rest


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.rows(common.read(spark, folder, "documents"))
    looked = licenses.read(documents)
    found = licenses.scan(documents, licenses.fit(documents, looked), looked).filter("confirmed")
    each = found.groupBy("id", "family").agg(
        F.max("probability").alias("probability"),
        F.max("similarity").alias("similarity"),
        F.countDistinct("paragraph").alias("paragraphs"),
    )
    best = F.max(F.struct("similarity", "probability", "family"))
    named = each.groupBy("id").agg(
        best.alias("best"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.sum("paragraphs").alias("n_paragraphs"),
    )
    ids = documents.select("id").join(named, "id", "left")
    return ids.select(
        F.col("id").alias("doc_id"),
        F.coalesce("best.family", F.lit(licenses.UNKNOWN)).alias("family"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.col("best.probability").alias("probability"),
        F.col("best.similarity").alias("similarity"),
    )


def op2_suffix_sort(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_sort.cleaned(common.rows(common.read(spark, folder, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    table = common.rows(common.read(spark, folder, "documents"), "doc_id", "text", "lang")
    fitted = language.fit(table.filter(~F.coalesce(held_out("id", 3, 1), F.lit(False))))
    found = language.predict(table, fitted, spans=False)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out("id", 3, 1), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "n_spans",
    )


def op4_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.read(spark, folder, "pages").select(F.col("page_id").cast("long").alias("id"), "url", "html")
    found = extraction.extract(pages)
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_forest.near_duplicates(common.rows(common.read(spark, folder, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


def op6_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    found = content_sort.duplicates(common.rows(common.read(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.rows(common.read(spark, folder, "documents"))
    labels = common.read(spark, folder, "labels").select(F.col("doc_id").cast("long").alias("id"), "toxic")
    found = toxicity.score(documents, toxicity.fit(documents, labels.filter(~held_out("id", 5, 0))))
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out("id", 5, 0), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def packed(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    found = packing.sequences(
        common.rows(documents),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return found.withColumnRenamed("id", "doc_id")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(common.read(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(common.rows(common.read(spark, folder, "documents")))

    def count(kind: str):
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
    )


def op10_containment(spark: SparkSession, folder: str) -> DataFrame:
    items = common.rows(common.read(spark, folder, "benchmark"), "item_id")
    found = containment.contained(common.rows(common.read(spark, folder, "documents")), items)
    return found.select(
        "item_id",
        F.col("id").alias("doc_id"),
        "n_shared",
        "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = common.rows(common.read(spark, folder, "documents"))
    found = token_counts.counts(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def repeat_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents with the end replaced by repetitions of its beginning."""
    mixed, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or mixed % 10 or not n:
        return words
    first = mixed // 10 % n
    period = 1 + (n - first) // (3 + mixed // 10 % 8)
    return words[:first] + [words[first + i % period] for i in range(n - first)]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.rows(common.read(spark, folder, "documents"))
    found = periodic_runs.find(documents, prepare=repeat_tail)

    def longer(best, run):
        # Runs come by start and period, so the first of equal exponents stays.
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    none = F.lit(None).cast(periodic_runs.RUN)
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, longer)).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = common.read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_suffix_sort": op2_suffix_sort,
    "op3_language": op3_language,
    "op4_extraction": op4_extraction,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_content_sort": op6_content_sort,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_containment": op10_containment,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

# Distinct five-word shingles, or the whole sequence of a shorter text, of a table (key, text).
SHINGLES = r"""
    SELECT DISTINCT key, CASE WHEN n < 5 THEN array_to_string(words, ' ')
        ELSE array_to_string(words[pos:pos + 4], ' ') END AS shingle
    FROM (
        SELECT key, words, len(words) AS n, unnest(range(1, greatest(len(words) - 3, 2))) AS pos
        FROM (
            SELECT key, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM ({table})
        ) WHERE len(words) > 0
    )
"""

# SQL for the queries that it can express.
SQL = {
    "op5_minhash_forest": f"""
        WITH RECURSIVE grams AS MATERIALIZED ({SHINGLES.format(table="SELECT doc_id AS key, text FROM documents")}),
        sizes AS MATERIALIZED (SELECT key, count(*) AS n FROM grams GROUP BY key),
        links AS MATERIALIZED (
            SELECT a.key AS a, b.key AS b FROM grams a JOIN grams b ON a.shingle = b.shingle AND a.key <> b.key
            JOIN sizes x ON x.key = a.key JOIN sizes y ON y.key = b.key
            GROUP BY a.key, b.key, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        found AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
               doc_id <= coalesce(b, doc_id) AS kept
        FROM documents LEFT JOIN sizes ON sizes.key = doc_id LEFT JOIN found ON found.a = doc_id
    """,
    "op10_containment": f"""
        WITH grams AS MATERIALIZED ({SHINGLES.format(table="SELECT doc_id AS key, text FROM documents")}),
        items AS MATERIALIZED ({SHINGLES.format(table="SELECT item_id AS key, text FROM benchmark")}),
        sizes AS (SELECT key, count(*) AS n_item FROM items GROUP BY key)
        SELECT i.key AS item_id, g.key AS doc_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM items i JOIN grams g ON g.shingle = i.shingle JOIN sizes s ON s.key = i.key
        GROUP BY i.key, g.key, n_item HAVING 100 * count(*) >= 75 * n_item
    """,
    "op6_content_sort": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        ), shown AS (SELECT doc_id, sha256(body) AS text_sha256 FROM texts)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM shown WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op13_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS MATERIALIZED (
            SELECT a.vec_id AS anchor, r.vec_id AS other, a.label = r.label AS same,
                   list_dot_product(a.vector, r.vector)::BIGINT AS score
            FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
        ), positives AS (
            SELECT anchor, other, score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
        )
        SELECT p.anchor AS anchor_id, p.other AS positive_id,
               (row_number() OVER best)::INTEGER AS rank, n.other AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
             AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        WINDOW best AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other)
        QUALIFY row_number() OVER best <= 3
    """,
}
