"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

A window of ``window`` consecutive words of a benchmark item (a shorter item is one window) occurs in a
document only if all of its shingles do. So each window is represented by its prefix, the one shingle
that is rarest among the documents; that suffices where containment has to be complete.

1. The shingles of the windows are counted over all documents; a window with a shingle that no document
   has is left out.
2. Documents' shingles join the prefix shingles. The window's start follows from the two places; it must
   lie inside the text (positional bound), and so must its length.
3. The window's words are compared with the document's words at that place.

Windows with equal words are one window of several items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm._shared import durable, read

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 200_000  # windows or shingles that are sent to all tasks; more are joined by a shuffle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["id", "tag", "octets"]  # a document: its id, the hash and the length of its text


def _words(text):
    """Lower-cased words: digits, letters and everything beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tag"), F.octet_length(text).alias("octets"), _words(text).alias("w"))


def _shingle(words: str, at, size: int):
    """Hash of ``size`` words from the place ``at`` (from 0)."""
    return F.xxhash64(F.lit(size), *[F.col(words)[at + k] for k in range(size)])


def _shingles(df: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """Place and hash of every shingle of the words ``w``, of the sizes given."""
    # The outer form with its own check of nulls: else the filter inferred for it splits each text a second time.
    starts = F.when(F.size("w") >= min(sizes), F.sequence(F.lit(0), F.size("w") - min(sizes)))
    placed = df.select(*columns, "w", F.size("w").alias("n"), F.explode_outer(starts).alias("at")).filter("at IS NOT NULL")
    if len(sizes) == 1:
        return placed.select(*columns, "w", "n", "at", _shingle("w", F.col("at"), sizes[0]).alias("token"))
    each = F.array_compact(F.array(*[F.when(F.col("at") + k <= F.col("n"), _shingle("w", F.col("at"), k)) for k in sizes]))
    return placed.select(*columns, "w", "n", "at", F.explode(each).alias("token"))


def _windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, words`` of every window; items without words have none."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), _words(F.col(f"`{text_col}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.filter("size(w) > 0").select("item", "w", F.explode(starts).alias("s")).select("item", F.expr(f"slice(w, s, {window})").alias("words"))


def _prefixes(windows: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """``token, offset, words``: the rarest shingle of each window all of whose shingles some document has."""
    tokens = _of_window(windows, shingle).join(counts, "token", "left")
    whole = tokens.groupBy("words").agg(F.count(F.lit(1)).alias("own"), F.count("count").alias("known"), F.min(F.struct("count", "offset", "token")).alias("rarest"))
    return whole.filter("own = known").select("rarest.token", "rarest.offset", "words")


def _of_window(windows: DataFrame, shingle: int) -> DataFrame:
    """``words, offset, token`` of every shingle of every window."""
    parts = []
    for k in range(1, shingle + 1):  # windows of fewer words are one shingle
        own = windows.filter(F.size("words") == k if k < shingle else F.size("words") >= k)
        placed = own.select("words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("offset"))
        parts.append(placed.select("words", "offset", _shingle("words", F.col("offset"), k).alias("token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def occurrences(
    documents: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``id, tag, octets, start, words``: every place (from 0) where a document has the words of a window."""
    windows = windows.select("words").distinct()
    own = durable(_of_window(windows, shingle).select(F.least(F.size("words"), F.lit(shingle)).alias("size"), "token").distinct())
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most ``shingle`` of them
    docs = _texts(documents, id_col, text_col)
    if not sizes:
        return docs.limit(0).select(*_KEY, F.lit(0).alias("start"), "w").withColumnRenamed("w", "words")

    wanted = own.select("token").distinct()
    known = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    counts = _shingles(docs, sizes).select("token").join(known, "token", "left_semi").groupBy("token").count()
    prefixes = durable(_prefixes(windows, counts, shingle))

    here = _shingles(docs, sizes, *_KEY)
    start, length = F.col("at") - F.col("offset"), F.size("words")
    bounds = (start >= 0) & (start + length <= F.col("n"))
    if prefixes.count() <= broadcast_rows:
        met = here.join(F.broadcast(prefixes), "token").filter(bounds)
        met = met.filter(F.slice("w", start + 1, length) == F.col("words"))
    else:  # the words around a shingle travel with it
        longest = windows.agg(F.max(F.size("words"))).first()[0]
        reach = max(longest - shingle, 0)
        low = F.greatest(F.col("at") - reach, F.lit(0))
        around = here.select(*_KEY, "at", "n", "token", low.alias("low"), F.slice("w", low + 1, F.lit(2 * reach + max(sizes))).alias("around"))
        met = around.join(prefixes, "token").filter(bounds)
        met = met.filter(F.slice("around", start - F.col("low") + 1, length) == F.col("words"))
    return met.select(*_KEY, start.alias("start"), "words")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    A word is hit where it lies in an occurrence of a window of the benchmark; ``items`` are the ids, as
    strings in their order, of the items with such windows. Null and empty texts have no words and no
    hits; null and empty items have no window. Items without an id mark words, but are not listed; an id
    that has several texts is listed once. Rows without an id and repeated rows are marked like others: a
    document is its id and text. An empty table of documents gives an empty result, an empty benchmark no
    hits. Columns other than those named are not read, so their names do not matter.
    """
    windows = durable(_windows(benchmark, item_id_col, item_text_col, window))
    found = durable(occurrences(documents, windows, id_col, text_col, shingle, broadcast_rows).distinct())
    # Words are counted once: of each occurrence those beyond the furthest end before it.
    spans = found.groupBy(*_KEY, "start").agg((F.col("start") + F.max(F.size("words"))).alias("end"))
    before = Window.partitionBy(*_KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("until", F.max("end").over(before))
    hit = fresh.groupBy(*_KEY).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "until"), F.lit(0))).alias("n_hit"))
    owners = windows.filter("item IS NOT NULL").distinct()
    named = found.select(*_KEY, "words").distinct().join(owners, "words").select(*_KEY, "item").distinct()
    items = named.groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    marks = _beside(hit, items, "items")
    rows = _texts(documents, id_col, text_col).select(*_KEY, F.size("w").cast("long").alias("n_words"))
    out = _beside(rows, marks, "n_hit", "items")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _beside(left: DataFrame, right: DataFrame, *values: str) -> DataFrame:
    """``left`` with the values of the same document; ids may be null."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in _KEY], *values)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")) & (F.col("octets") == F.col("_octets"))
    return left.join(other, same, "left").drop(*[f"_{k}" for k in _KEY])


def op12(spark, sf_dir):
    marked = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op12_decontamination": op12}
ORACLE = {
    "op12_decontamination": r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
    b AS (
      SELECT CAST(item_id AS VARCHAR) AS item,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
    v AS (
      SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    z AS (SELECT DISTINCT size FROM v),
    o AS (
      SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS s
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, z WHERE len(w) >= size)),
    m AS (SELECT r, i, o.size, item FROM o JOIN v ON v.size = o.size AND v.s = o.s),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
    k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""
}
