"""Best-fit packing of documents into fixed-length training sequences.

Pieces of full length fill a bin alone. The rest is packed best-fit decreasing in
groups of about ``GROUP_ROWS`` pieces, dealt by id hash: bins are kept in order of
their residual space, and each carries bitmaps of the sources and duplicate clusters
it holds. The search starts at the tightest bin with room and goes on to the next
larger residual until a bin is compatible: it must not hold a piece of the same
cluster, nor already hold ``PER_SOURCE`` pieces of the same source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import durable, read
from lamella.llm.mixing import n_words

CAPACITY = 2048
GROUP_ROWS = 4096
PER_SOURCE = 4


def best_fit(pieces, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, start inside the bin) of each piece (size, source, cluster), taken in the given order.

    Bitmaps are integers: bit c of ``clusters[b]`` says that bin b holds cluster c, and
    bit s of ``sources[b][p]`` that it holds more than p pieces of source s. Clusters
    that occur once cannot conflict and get no bit.
    """
    count = Counter(c for _, _, c in pieces)
    bit = {c: i for i, c in enumerate(c for c, n in count.items() if n > 1)}
    source_bit: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    clusters: list[int] = []
    sources: list[list[int]] = []
    out = []
    for size, source, cluster in pieces:
        own = 1 << bit[cluster] if cluster in bit else 0
        s = 1 << source_bit.setdefault(source, len(source_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (clusters[order[at][1]] & own or sources[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        out.append((b, capacity - residual))
        clusters[b] |= own
        for p in range(per_source):
            if not sources[b][p] & s:
                sources[b][p] |= s
                break
        if residual > size:
            insort(order, (residual - size, b))
    return out


_PIECE = "doc_id long, copy int, piece long, first_word long, n_words long, bin_id string, bin_start long"


def _pack_group(table: pa.Table) -> pa.Table:
    """Arrow keeps the ids as they are: 64-bit and null."""
    order = pc.sort_indices(table, [("n_words", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("cluster", "ascending")], null_placement="at_start")
    table = table.take(order)
    placed = best_fit(list(zip(*(table.column(c).to_pylist() for c in ("n_words", "source", "cluster")))))
    group = table.column("group")[0].as_py() if table.num_rows else 0
    bins = [pa.array([f"g{group}-{b}" for b, _ in placed], pa.string()), pa.array([start for _, start in placed], pa.int64())]
    columns = ["doc_id", "copy", "piece", "first_word", "n_words"]
    return pa.table([*(table.column(c) for c in columns), *bins], names=[*columns, "bin_id", "bin_start"])


def packing(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", cluster=None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, copy, piece, first_word, n_words, bin_id, bin_start``.

    Sizes are words; longer texts are cut into pieces of ``capacity`` words and a
    rest, so every word of every text is in one bin. ``cluster`` names the column of
    duplicate clusters; by default equal texts are one cluster. Null texts and texts
    without words need no space and have no row. The null source is a source of its
    own; rows without an id are packed like others. Rows repeated in full are counted
    once and numbered by ``copy``, so a document repeated very often is still dealt over
    all groups; rows that repeat an id with another text are documents of their own. An empty table gives an empty
    result; extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text) if cluster is None else F.xxhash64(F.col(cluster))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), mark.alias("cluster"), n_words(text).alias("size")
    ).filter("size > 0")
    counted = durable(rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n")))
    sized = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    groups = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // GROUP_ROWS))
    full = sized.filter(f"size >= {capacity}").withColumn("piece", F.explode(F.expr(f"sequence(0L, size div {capacity} - 1)")))
    alone = full.select(
        "doc_id", "copy", F.col("piece").cast("long").alias("piece"), (F.col("piece") * capacity).cast("long").alias("first_word"),
        F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("source", "cluster")), "copy", "piece").alias("bin_id"),
        F.lit(0).cast("long").alias("bin_start"),
    )
    rest = sized.filter(f"size % {capacity} > 0").select(
        "doc_id", "copy", F.expr(f"size div {capacity}").alias("piece"), F.expr(f"size - size % {capacity}").alias("first_word"),
        F.expr(f"size % {capacity}").alias("n_words"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "copy", "cluster"), F.lit(groups)).cast("int").alias("group"),
    )
    return alone.unionByName(rest.groupBy("group").applyInArrow(_pack_group, _PIECE))


def op2(spark, sf_dir):
    return packing(read(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2}
ORACLE = {}
