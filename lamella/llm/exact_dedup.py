"""Exact deduplication by skew-safe combining (DataFrame operations only).

1. Copies inside one input partition meet in the map-side aggregate.
2. The partial groups of a digest are merged per salt, so that a text with very
   many copies is spread over ``salts`` tasks.
3. The winners of the salts are combined globally.

Each of these aggregates is keyed by (digest, whole text): rows are combined
only if their full contents are equal, whatever their digests say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import read

SALTS = 16
_KEY = ["_sha", "_len", "_xx"]


def _content_key(text):
    """Digest, length and an independent hash: names the text in narrow joins."""
    return [
        F.sha2(text, 256).alias("_sha"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(text).alias("_xx"),
    ]


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``_sha, _len, _xx, keep_id`` (largest id) and ``group_size``.

    Null texts count as empty. A null id is smaller than any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = df.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
    )
    salted = tagged.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return merged.select(*_content_key(F.col("_text")), "keep_id", "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. Null texts equal empty ones.
    Rows that repeat both id and text are one document written twice and carry the
    same marks; texts whose ids are all null are all kept (no id to prefer). An
    empty table gives an empty result; other columns of ``df`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), *_content_key(text))
    repeated = copy_groups(df, id_col, text_col, salts).filter("group_size > 1")
    return rows.join(repeated, _KEY, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of ``df`` for each distinct text, with all its columns.

    It is the row with the largest id; of several such rows (a row written twice, or equal
    texts without ids), the one whose whole row has the largest hash. Columns of any name
    are kept as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(whole.alias("_row"), F.col(id_col).alias("_id"), *_content_key(text))
    repeated = copy_groups(df, id_col, text_col, salts).filter("group_size > 1")
    kept = rows.join(repeated, _KEY, "left").filter("group_size IS NULL OR _id <=> keep_id").select("_row", "_id", *_KEY)
    # Ids that repeat a text, found without the texts; there are none where ids are unique.
    twice = rows.select("_id", *_KEY).groupBy("_id", *_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        again = twice.select(F.col("_id").alias("_i"), *[F.col(k).alias(f"{k}2") for k in _KEY])
        same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_sha2")) & (F.col("_len") == F.col("_len2")) & (F.col("_xx") == F.col("_xx2"))
        one = kept.join(again, same, "left_semi").groupBy(*_KEY).agg(F.max_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        kept = kept.join(again, same, "left_anti").select("_row").union(one.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def op8(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8}
ORACLE = {
    "op8_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
