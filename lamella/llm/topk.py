"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of all vectors are cut into ``LISTS`` slices, and each slice is a list of
its own: it holds the partial scores that its components give and knows nothing of the
others. The score of a vector is the sum of its partial scores.

1. Every list gives, for each query, its ``FIRST`` * k best entries. Their whole scores are
   resolved, and the k-th best of them is a safe cutoff: the true k-th score is no lower.
2. The cutoff goes out with the queries. A vector at or above it must reach
   ``cutoff / LISTS`` in some list, so each list gives the entries that do. They are summed by
   query and vector: where all lists gave one, the score is whole; otherwise each
   missing part is under the threshold, which bounds the score from above.
3. Entries with a missing part whose bound still reaches the cutoff are resolved exactly: the
   list that did not give the part is asked for it. Then the k best of each query are ranked.

Equal vectors have equal scores, so they are searched once: a class of equal vectors is
a candidate for all its rows, and of those only the k + 1 smallest ids can be results (one may be
the query's own). Equal queries are asked once, for k + 1 rows. This keeps very common vectors
from filling the lists with ties, and drops nothing.

A list is cut into blocks of about ``BLOCK_ROWS`` vectors and the queries into blocks of
``QUERY_ROWS``. Blocks are dealt to at most ``SLABS`` slabs of a list, and up to ``GATHERED`` blocks of
queries go together to every slab. Such a place is one partition: its queries come first and are held, its
blocks of vectors follow one by one. So queries are copied ``SLABS`` times however many vectors there are,
no list or query set has to fit in one place, and no copies are broadcast or pass through the driver.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, durable, read

LISTS = 2
QUERY_ROWS = 512
BLOCK_ROWS = 2048
SLABS = 32
GATHERED = 32
SCALE = 256
FIRST = 8
NARROW = 2.0**60  # up to this bound of all products, partial scores are longs, beyond it decimals
END = 10**37  # decimal partial scores are held at its ends: sums of LISTS of them fit a decimal

_NARROW, _WIDE = "long", "decimal(38,0)"


def integer_vectors(df: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``vec_id, comps``: floor(256 * x) of every component; vectors that are null or hold null or non-finite ones are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("comps"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond NARROW are Python's whole numbers, held at plus and minus END."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:  # every sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < NARROW:
        return a @ b.T
    return _held(a.astype(object) @ b.astype(object).T)


def _held(parts: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(parts, END), -END)


def _column(parts: np.ndarray, kind: str) -> pa.Array:
    if kind == _NARROW:
        return pa.array(parts.astype(np.int64))
    return pa.array([Decimal(int(p)) for p in parts], pa.decimal128(38))


def _slices(dim: int) -> list[tuple[int, int]]:
    return [(dim * i // LISTS, dim * (i + 1) // LISTS) for i in range(LISTS)]


def _pack(batches):
    """Each batch of (key, block, comps) as rows (dim, list, block, piece, ids, body): one a slice of the vectors of one dimension and block."""
    for batch in batches:
        ids, block, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        sizes = np.array([len(c) for c in comps], np.int64)
        flat, ends = comps.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)
        out = [[] for _ in range(6)]
        for dim, b in sorted(set(zip(sizes.tolist(), block.tolist()))):
            own = np.flatnonzero((sizes == dim) & (block == b))
            body = np.stack([flat[ends[i] - dim : ends[i]] for i in own]).reshape(len(own), dim)
            for k, (lo, hi) in enumerate(_slices(dim)):
                for column, value in zip(out, (dim, k, b, int(ids[own[0]]), ids[own].astype(np.int64).tobytes(), np.ascontiguousarray(body[:, lo:hi]).tobytes())):
                    column.append(value)
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["dim", "list", "block", "piece", "ids", "body"])


def _blocks(vectors: DataFrame, rows: int, n: int) -> DataFrame:
    """``dim, list, block, piece, ids, body`` of (key, comps): vectors dealt into blocks of about ``rows`` by key, packed in pieces (named by their first key)."""
    parts = max(1, -(-n // rows))
    dealt = vectors.select("key", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("block"), "comps").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(_pack, "dim int, list int, block long, piece long, ids binary, body binary")


def _places(blocks: int, qblocks: int) -> tuple[int, int]:
    """Slabs of a list, and sets of query blocks that go together."""
    return min(blocks, SLABS), -(-qblocks // GATHERED)


def _dealt(vectors: DataFrame, queries: DataFrame, blocks: int, qblocks: int, asked: DataFrame | None = None) -> DataFrame:
    """Every slab of each list beside every set of query blocks of the same slice, one partition each: queries (block -1) first, then each
    block's vectors and what it is asked for (``list, query, cls``)."""
    slabs, sets = _places(blocks, qblocks)
    place = lambda block, qblock: ((F.col("list") * slabs + block % slabs) * sets + qblock).cast("int").alias("place")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = vectors.withColumn("set", each(sets)).select(place(F.col("block"), F.col("set")), "block", F.lit(0).alias("kind"), "dim", "piece", "ids", "body")
    held = queries.withColumn("slab", each(slabs)).select(place(F.col("slab"), F.floor(F.col("block") / GATHERED)), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), "dim", "piece", "ids", "body", *(["cuts"] if "cuts" in queries.columns else []))
    out = out.unionByName(held, allowMissingColumns=True)
    if asked is not None:
        at = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))  # noqa: E731  as the blocks were dealt
        wanted = asked.select(place(at("cls", blocks), F.floor(at("query", qblocks) / GATHERED)), at("cls", blocks).alias("block"), F.lit(1).alias("kind"), "query", "cls")
        out = out.unionByName(wanted, allowMissingColumns=True)
    return out.repartitionById(LISTS * slabs * sets, "place").sortWithinPartitions("place", "block", "kind", "dim", "piece")


def _met(batches, places):
    """The rows of dealt partitions in turn: (list, place, queries, vectors, asked).

    ``queries`` are the place's, pieces of (keys, vectors, cutoffs) by dimension, ``vectors`` the block's, pieces of (keys, vectors) by
    dimension; ``asked`` is None where the last of these pieces is new, else the entries asked for.
    """
    here, block, queries, vectors = None, None, {}, {}
    for batch in batches:
        place, blocks, kind = (batch.column(c).to_numpy() for c in ("place", "block", "kind"))
        cuts = batch.column("cuts") if "cuts" in batch.schema.names else None
        starts = np.flatnonzero(np.r_[True, (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (blocks[1:] != blocks[:-1]) | (place[1:] != place[:-1])]) if len(place) else []
        for lo, hi in zip(starts, [*starts[1:], len(place)]):  # a piece, or all that a block is asked for
            if here != place[lo]:
                here, block, queries = int(place[lo]), None, {}
            if block != blocks[lo]:
                block, vectors = blocks[lo], {}
            if kind[lo]:
                yield here // places, here, queries, vectors, (batch.column("query")[lo:hi].to_numpy(), batch.column("cls")[lo:hi].to_numpy())
                continue
            dim, keys = batch.column("dim")[lo].as_py(), np.frombuffer(batch.column("ids")[lo].as_py(), np.int64)
            body = np.frombuffer(batch.column("body")[lo].as_py(), np.int64)
            body = body.reshape(len(keys), len(body) // len(keys))  # nought wide for an empty slice
            if block < 0:
                queries.setdefault(dim, []).append((keys, body, None if cuts is None or not cuts[lo].is_valid else _cuts(cuts[lo])))
            else:
                vectors.setdefault(dim, []).append((keys, body))
                yield here // places, here, queries, {dim: vectors[dim]}, None


def _cuts(cut) -> np.ndarray:
    """Cutoffs of the queries of a block: packed longs, or a list of decimals."""
    if isinstance(cut, pa.ListScalar):
        return np.array([int(c) for c in cut.as_py()], object)
    return np.frombuffer(cut.as_py(), np.int64)


def _entries(k, q, v, p, kind):
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(np.full(len(q), k, np.int32)), _column(p, kind)], ["query", "cls", "list", "part"])


class _Best:
    """The k best entries so far of each query of a piece."""

    def __init__(self, queries: np.ndarray, k: int, kind: str):
        self.queries, self.k, self.kind = queries, k, kind
        self.least = np.full(len(queries), -2 * END, object) if kind == _WIDE else np.full(len(queries), np.iinfo(np.int64).min)
        self.held, self.kept = [], None
        self.waiting = 0

    def add(self, v: np.ndarray, p: np.ndarray) -> None:
        p = p.astype(object) if self.kind == _WIDE else p
        least = self.least
        if len(v) > self.k and self.kept is None:
            least = np.partition(p, -self.k, axis=1)[:, -self.k] - 1
        rows, columns = np.nonzero((p > least[:, None]).astype(bool))
        self.held.append((rows, v[columns], p[rows, columns]))
        self.waiting += len(rows)
        if self.kept is None or self.waiting > 2 * self.k * len(self.queries):
            self.cut()

    def cut(self) -> None:
        rows, cls, parts = (np.concatenate(c) for c in zip(*([self.kept] if self.kept else []), *self.held))
        order = np.lexsort((cls, -parts, rows))
        rows, cls, parts = rows[order], cls[order], parts[order]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.least[rows[at == self.k - 1]] = parts[at == self.k - 1]
        best = at < self.k
        self.kept, self.held, self.waiting = (rows[best], cls[best], parts[best]), [], 0


def _first_lists(k, kind, places):
    """The k best entries of every slab of a list."""

    def told(name, best):
        for pool in best.values():
            if pool.held:
                pool.cut()
            rows, cls, parts = pool.kept
            yield _entries(name, pool.queries[rows], cls, parts, kind)

    def run(batches):
        at, best = None, {}
        for name, here, queries, vectors, _ in _met(batches, places):
            if at is not None and at[1] != here:
                yield from told(at[0], best)
                best = {}
            at = name, here
            for dim, pieces in vectors.items():
                v, x = pieces[-1]
                for i, (q, y, _) in enumerate(queries.get(dim, ())):
                    best.setdefault((dim, i), _Best(q, k, kind)).add(v, _product(y, x))
        if at is not None:
            yield from told(at[0], best)

    return run


def _second_lists(kind, places):
    """The entries of a list that reach the uniform threshold."""

    def run(batches):
        for name, _, queries, vectors, _ in _met(batches, places):
            for dim, pieces in vectors.items():
                v, x = pieces[-1]
                for q, y, cut in queries.get(dim, ()):
                    p = _product(y, x)
                    rows, columns = np.nonzero((p >= _threshold(cut)[:, None]).astype(bool))
                    yield _entries(name, q[rows], v[columns], p[rows, columns], kind)

    return run


def _threshold(cut):
    """The least whole partial score that is at least cutoff / LISTS."""
    return -(-cut // LISTS)


def _with_cuts(blocks: DataFrame, cutoffs: DataFrame, kind: str) -> DataFrame:
    """Query blocks with the cutoffs of their queries (the least number where there are none) in the order of ``ids``."""
    least = F.lit(-(2**62) if kind == _NARROW else Decimal(-END * LISTS)).cast(kind)
    ids = blocks.filter("list = 0").select("dim", "piece", "ids")
    each = ids.mapInArrow(_unpacked, "dim int, piece long, at int, key long").join(cutoffs, "key", "left")
    told = each.groupBy("dim", "piece").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("cutoff", least).alias("c")))).alias("cuts"))
    packed = told.select("dim", "piece", F.transform("cuts", lambda c: c["c"]).alias("cuts"))
    if kind == _NARROW:
        packed = packed.mapInArrow(_packed, "dim int, piece long, cuts binary")
    return blocks.join(packed.hint("merge"), ["dim", "piece"])  # bodies are far longer than on disk, by which the planner would broadcast them


def _unpacked(batches):
    for batch in batches:
        keys = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
        n = np.array([len(k) for k in keys], np.int64)
        rows = np.repeat(np.arange(len(keys)), n)
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in n)]).astype(np.int32)
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(at), pa.array(key)], ["dim", "piece", "at", "key"])


def _packed(batches):
    for batch in batches:
        cuts = [np.array(x.as_py(), np.int64).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.binary())], ["dim", "piece", "cuts"])


def _answer(kind, places):
    """(query, cls, part) of the entries that a list is asked for."""

    def run(batches):
        sorted_q, sorted_v, at_q, at_v = {}, {}, None, None
        for _, _, queries, vectors, asked in _met(batches, places):
            if asked is None:
                continue
            if at_q is not queries:
                at_q, sorted_q = queries, {dim: _by_key(pieces) for dim, pieces in queries.items()}
            if at_v is not vectors:
                at_v, sorted_v = vectors, {dim: _by_key(pieces) for dim, pieces in vectors.items()}
            for dim in sorted_v.keys() & sorted_q.keys():
                (q, y), (v, x) = sorted_q[dim], sorted_v[dim]
                (of_q, has_q), (of_v, has_v) = _found(q, asked[0]), _found(v, asked[1])
                held = np.flatnonzero(has_q & has_v)
                for part in np.array_split(held, max(1, len(held) * x.shape[1] // 4_000_000)):  # bounded temporary arrays
                    yield pa.RecordBatch.from_arrays([pa.array(asked[0][part]), pa.array(asked[1][part]), _column(_rowwise(y[of_q[part]], x[of_v[part]]), kind)], ["query", "cls", "part"])

    return run


def _by_key(pieces) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pieces in their order, and the vectors."""
    keys = np.concatenate([p[0] for p in pieces])
    order = np.argsort(keys)
    return keys[order], np.concatenate([p[1] for p in pieces])[order]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _rowwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact and held as in ``_product``."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < NARROW:
        return (a * b).sum(axis=1, dtype=np.int64)
    return _held(np.array([int(t) for t in (a.astype(object) * b.astype(object)).sum(axis=1)], object))


def _whole(entries: DataFrame, lists: DataFrame, query_blocks: DataFrame, blocks: int, qblocks: int, kind: str) -> DataFrame:
    """``query, cls, score`` of (query, cls, known, missing): the lists are asked for the missing parts, block by block."""
    asked = entries.select("query", "cls", F.explode("missing").alias("list"))
    parts = _dealt(lists, query_blocks, blocks, qblocks, asked).mapInArrow(_answer(kind, math.prod(_places(blocks, qblocks))), f"query long, cls long, part {kind}")
    known = entries.select("query", "cls", F.col("known").alias("part"))
    return known.union(parts).groupBy("query", "cls").agg(F.sum("part").alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """Of each query the k best classes by (score, key)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    return scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")


def _bound(vectors: DataFrame, queries: DataFrame) -> float:
    """No sum of products of a vector and a query is larger."""
    size = lambda df: df.agg(F.max(F.array_max(F.transform("comps", lambda c: F.abs(c.cast("double"))))), F.max(F.size("comps"))).first()
    (a, dim), (b, _) = size(vectors), size(queries)
    return float(a or 0) * float(b or 0) * (dim or 0)


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """``key, comps, ids``: one row for each distinct vector, keyed by its smallest id, with the k smallest ids of its rows."""
    order = Window.partitionBy("comps").orderBy("vec_id")
    few = vectors.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)  # cut in each partition before the shuffle
    return few.groupBy("comps").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("key"), "comps", "ids")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best vectors of each query, ties to the smaller id.

    ``vectors`` and ``queries`` have ``vec_id, comps`` without nulls; a query never finds its
    own id. Vectors of other dimensions than the query's are not compared. Of rows that
    repeat an id with different vectors the largest vector counts. Scores are exact whatever
    their size and rank so; those beyond a long are told as its ends. (Sums over a slice beyond
    10^37 are held there.) Queries without any candidate have no rows, as has an empty table;
    extra columns are not read.
    """
    bounded_batches(vectors.sparkSession)
    one = lambda df: df.groupBy("vec_id").agg(F.max("comps").alias("comps"))
    # Ties go to smaller ids: of a class and a query, only the k + 1 smallest ids can be among k results.
    classes = durable(_classes(one(vectors), k + 1))
    asked = durable(one(queries))
    distinct = durable(asked.groupBy("comps").agg(F.min("vec_id").alias("key")).select("key", "comps"))
    n, m = classes.count(), distinct.count()
    blocks, qblocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))
    kind = _NARROW if _bound(classes, distinct) < NARROW else _WIDE
    entry = f"query long, cls long, list int, part {kind}"
    lists = durable(_blocks(classes.select("key", "comps"), BLOCK_ROWS, n))
    query_blocks = durable(_blocks(distinct, QUERY_ROWS, m))

    deep = FIRST * (k + 1)
    places = math.prod(_places(blocks, qblocks))
    first = _dealt(lists, query_blocks, blocks, qblocks).mapInArrow(_first_lists(deep, kind, places), entry)
    order = Window.partitionBy("query", "list").orderBy(F.desc("part"), "cls")
    first = durable(first.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= deep).select("query", "cls").distinct())
    every = F.array(*[F.lit(i) for i in range(LISTS)])
    resolved = _whole(first.select("query", "cls", F.lit(0).cast(kind).alias("known"), every.alias("missing")), lists, query_blocks, blocks, qblocks, kind)
    cutoffs = resolved.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).filter(F.col("at") == k + 1)
    cutoffs = durable(cutoffs.select(F.col("query").alias("key"), F.col("score").alias("cutoff")))

    told = durable(_with_cuts(query_blocks, cutoffs, kind))
    second = _dealt(lists, told, blocks, qblocks).mapInArrow(_second_lists(kind, places), entry)
    given = second.groupBy("query", "cls").agg(F.sum("part").alias("known"), F.bit_or(F.expr("shiftleft(1, list)")).alias("given"))
    absent = F.filter(every, lambda i: F.col("given").bitwiseAND(F.pow(F.lit(2), i).cast("int")) == 0)
    summed = durable(given.select("query", "cls", "known", absent.alias("missing")))
    whole = summed.filter("size(missing) = 0").select("query", "cls", F.col("known").alias("score"))
    cut = cutoffs.select(F.col("key").alias("query"), "cutoff")
    under = F.expr(f"cutoff div {LISTS} + if(cutoff % {LISTS} > 0, 1, 0) - 1")  # the most that a missing part can be
    open_ = summed.filter("size(missing) > 0")
    if kind == _NARROW:
        open_ = open_.join(cut, "query", "left").filter(F.col("cutoff").isNull() | (F.col("known") + F.size("missing") * under >= F.col("cutoff")))
    scored = whole.union(_whole(open_.select("query", "cls", "known", "missing"), lists, query_blocks, blocks, qblocks, kind))

    best = durable(_best(scored, k + 1))
    members = best.join(classes.select(F.col("key").alias("cls"), F.explode("ids").alias("vec_id")), "cls").select("query", "vec_id", "score")
    named = asked.join(distinct.withColumnRenamed("key", "query").hint("merge"), "comps").select(F.col("vec_id").alias("query_id"), "query")
    found = named.join(members, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    told_score = F.least(F.greatest("score", F.lit(-(2**63))), F.lit(2**63 - 1)).cast("long")
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", told_score.alias("score"))


def op4(spark, sf_dir):
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


QUERIES = {"op4_exact_topk": op4}
ORACLE = {
    "op4_exact_topk": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS s
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, CAST(s AS BIGINT) AS score FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
}
