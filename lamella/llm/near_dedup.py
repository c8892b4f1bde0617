"""MinHash near-deduplication by a signature-coordinate inverted join.

Every document with words becomes its set of 5-word shingles and a signature of
``COORDS`` minhash values. Rows with equal sets are one node. Nodes are posted under each
(coordinate, value) of the first ``POSTED`` coordinates. Two nodes are candidates if at
least ``MEET`` of those and ``MATCHES`` of all coordinates collide. At similarity 0.75 a
pair has fewer collisions with probability of about 2e-6 each, and less for closer pairs.

* Prefix merging: nodes that share fewer than ``MATCHES`` of all coordinates with anyone
  have no partner at all. With postings ordered by rising list length, a candidate pair
  must meet within the first ``s - MEET + 1`` of a node's ``s`` shared and posted
  coordinates.
* Skip merging: the longest lists (common passages) come last in that order and are
  skipped. Lists are not expanded into all pairs: first each list is compared with its
  leader and what is linked is contracted. Only pairs from different components that are left are then compared:
  those of short lists in a join, those of long ones in blocks inside the tasks, where
  the largest component of a list meets the others but not itself. Both read the same
  lists, so the length of a list decides how its pairs are compared and not which.

Every link is confirmed on the full shingle sets before it counts, and so is the equality
of the rows of a node.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._components import components
from lamella.llm._shared import bounded_batches, durable, read
from lamella.llm._words import mix, word_hashes

SHINGLE = 5
THRESHOLD = 75  # percent
COORDS = 48
MATCHES = 22
POSTED = 12
MEET = 2
SHORT = 64  # up to this length, a list's pairs are joined
BLOCK_ROWS = 1024  # of longer lists, so many rows or shingles are compared at a time
BLOCK_VALUES = 1_000_000

_rng = np.random.RandomState(7)
_MULTIPLY = _rng.randint(0, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 1 << 62, COORDS, dtype=np.uint64)
_PLACE = _rng.randint(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    n = len(words)
    windows = np.zeros(0, np.uint64)
    if n >= SHINGLE:
        windows = words[: n - SHINGLE + 1] * _PLACE[0]
        for j in range(1, SHINGLE):
            windows = windows + words[j : n - SHINGLE + 1 + j] * _PLACE[j]
        windows = mix(windows)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= SHINGLE:
            out.append(np.unique(windows[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            few = (words[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo)
            out.append(mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minima per non-empty set; the low 6 bits name the coordinate."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), COORDS), np.uint64)
    if full:
        every = np.concatenate(full)
        starts = np.cumsum([0, *(len(s) for s in full[:-1])])
        for k in range(COORDS):
            low = np.minimum.reduceat(every * _MULTIPLY[k] + _ADD[k], starts)
            out[:, k] = (mix(low) & ~np.uint64(63)) | np.uint64(k)
    return out


def _node(s: np.ndarray, seed: int) -> np.uint64:
    """Digest of a set: two sums over its values and its size."""
    with np.errstate(over="ignore"):
        other = mix(s ^ np.uint64(0xA5A5A5A5 + seed)).sum(dtype=np.uint64)
        return mix(mix(np.array([other], np.uint64)) + s.sum(dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(len(s)))[0]


def _sign(seed):
    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            for first, end, words, offsets in word_hashes(batch.column(2)):
                sets = _shingles(words, offsets)
                sizes = np.array([len(s) for s in sets], np.int64)
                signed = _signatures(sets).view(np.int64)
                nodes = np.array([_node(s, seed) for s in sets], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, COORDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids[first:end], tags[first:end], pa.array(nodes), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed.ravel()))],
                    ["id", "tag", "node", "n", "sig"],
                )

    return run


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``id, tag`` (hash of the text), ``node`` (digest of the set), ``n`` (its size) and ``sig`` of every row."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sign(seed), "id long, tag long, node long, n long, sig array<bigint>")


def _full_sets(seed):
    def run(batches):
        for batch in batches:
            for _, _, words, offsets in word_hashes(batch.column(1)):
                sets = [s for s in _shingles(words, offsets) if len(s)]
                nodes = np.array([_node(s, seed) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "body"])

    return run


def _confirm(batches):
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            linked[i] = 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(linked)), batch.column(1).filter(pa.array(linked))], ["a", "b"])


def _colliding(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes can reach the threshold and whose signatures collide often enough."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)"
    return pairs.join(left, "a").join(right, "b").filter(sized).filter(F.size(F.array_intersect("sa", "sb")) >= MATCHES).select("a", "b")


def _links(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = bodies.select(F.col("id").alias("a"), F.col("body").alias("ba"))
    right = bodies.select(F.col("id").alias("b"), F.col("body").alias("bb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ba", "bb").mapInArrow(_confirm, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def postings(reps: DataFrame) -> DataFrame:
    """``token, id, n``: the prefix of each node's shared coordinates, shortest lists first."""
    every = reps.select("id", "n", F.explode("sig").alias("token"))
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    own = every.join(shared, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("length", "token"))).alias("own"))
    held = own.filter(F.size("own") >= MATCHES).select("id", "n", F.filter("own", lambda x: x["token"].bitwiseAND(F.lit(63)) < POSTED).alias("own"))
    prefix = held.filter(F.size("own") >= MEET).select("id", "n", F.slice("own", 1, F.size("own") - MEET + 1).alias("own"))
    return prefix.select(F.explode("own.token").alias("token"), "id", "n")


def _led(posted: DataFrame) -> DataFrame:
    """Pairs of each list's members with its smallest id."""
    first = posted.groupBy("token").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("length")).filter("length > 1").select("token", "b")
    return posted.join(first, "token").filter("id <> b").select(F.col("id").alias("a"), "b")


def _shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two groups of sorted sets, by slices of their common values."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)

    def membership(sets, values):
        m = np.zeros((len(sets), len(values)), np.float32)
        for i, s in enumerate(sets):
            own = s[np.searchsorted(s, values[0]) : np.searchsorted(s, values[-1], side="right")]
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            m[i, at[values[at] == own]] = 1
        return m

    for at in range(0, len(common), 4096):
        values = common[at : at + 4096]
        out += np.rint(membership(left, values) @ membership(right, values).T).astype(np.int64)
    return out


def _compare_block(key, table):
    """Confirmed links between two blocks of one list that join different components (a spanning set of them)."""
    token, low, high = (k.as_py() for k in key)
    coordinate = token & 63
    block, ids, root, n, posted = (table.column(c).to_numpy() for c in ("block", "id", "root", "n", "posted"))
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDS)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    matches = np.zeros((len(left), len(right)), np.int16)
    first = np.full(matches.shape, COORDS, np.int16)
    for k in reversed(range(COORDS)):
        same = sig[left, k][:, None] == sig[right, k][None, :]
        matches += same
        own, other = posted[left] >> k & 1 == 1, posted[right] >> k & 1 == 1
        first[same & own[:, None] & other[None, :]] = k
    # A pair that meets in several lists is compared in that of the first common coordinate only.
    wanted = (matches >= MATCHES) & (first == coordinate) & (root[left][:, None] != root[right][None, :])
    if low == high:
        wanted &= ids[left][:, None] < ids[right][None, :]
    a, b = [], []
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if len(rows):
        body = table.column("body")
        left, right = left[rows], right[columns]
        shared = _shared_sizes([np.frombuffer(body[int(i)].as_buffer(), np.uint64) for i in left], [np.frombuffer(body[int(i)].as_buffer(), np.uint64) for i in right])
        union = n[left][:, None] + n[right][None, :] - shared
        parent: dict[int, int] = {}

        def top(r):
            while parent.setdefault(r, r) != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        for i, j in zip(*np.nonzero((100 * shared >= THRESHOLD * union) & wanted[np.ix_(rows, columns)])):
            x, y = left[i], right[j]
            p, q = top(int(root[x])), top(int(root[y]))
            if p != q:
                parent[p] = q
                a.append(ids[x]), b.append(ids[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed(posted: DataFrame) -> DataFrame:
    """Lists that hold several components: ``token, length, main`` (the largest component's root)."""
    parts = posted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("part"))
    lists = parts.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.sum("part").alias("length"), F.max_by("root", F.struct("part", "root")).alias("main"))
    return lists.filter("roots > 1").drop("roots")


def _dealt(listed: DataFrame) -> DataFrame:
    """Rows (token, low, high, block, id) of the pairs of blocks to compare.

    Rows of a list's largest component lie in blocks 0 to m - 1, the others in m to m + o - 1.
    Blocks of the others meet all blocks, so a large component costs its length once for
    each block of the others and is never compared with itself.
    """
    own = F.when(F.col("root") == F.col("main"), "m").otherwise("o")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_VALUES))
    sided = listed.withColumn("side", own)
    counts = sided.groupBy("token").pivot("side", ["m", "o"]).agg(size.cast("int"))
    placed = sided.join(counts, "token")
    spread = F.pmod(F.xxhash64("id"), F.when(F.col("side") == "m", F.col("m")).otherwise(F.col("o"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("side") == "m", spread).otherwise(F.col("m") + spread))
    others = F.when(F.col("side") == "m", F.sequence(F.col("m"), F.col("m") + F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") + F.col("o") - 1))
    met = placed.withColumn("other", F.explode(others))
    return met.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "root", "n")


def _rest(posted: DataFrame, reps: DataFrame, bodies: DataFrame, tested: DataFrame) -> DataFrame:
    """Links between nodes of different components that meet in a list."""
    met = posted.join(_mixed(posted), "token")
    short = met.filter(f"length <= {SHORT}")
    other = short.select("token", F.col("id").alias("b"), F.col("root").alias("rb"))
    few = short.select("token", F.col("id").alias("a"), "root").join(other, "token").filter("a < b AND root <> rb").select("a", "b").distinct()
    few = _links(durable(_colliding(few.join(tested, ["a", "b"], "left_anti"), reps)), bodies)

    hot = durable(met.filter(f"length > {SHORT}").select("token", "id", "root", "main", "n"))
    if hot.isEmpty():
        return few
    # What a node brings is put together once, and then meets its places in the blocks.
    lists = hot.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 AS int))")).alias("posted"))
    nodes = lists.join(reps.select("id", "sig"), "id").join(bodies, "id")
    filled = _dealt(hot).join(nodes, "id")
    return few.union(filled.groupBy("token", "low", "high").applyInArrow(_compare_block, "a long, b long"))


def _nodes(df: DataFrame, id_col: str, text_col: str):
    """All rows with their node, the nodes to compare and the full sets, equal rows confirmed.

    Should different sets have one digest, the digests are drawn anew.
    """
    for seed in count():
        signed = durable(signatures(df, id_col, text_col, seed))
        full = signed.filter("n > 0")
        reps = durable(full.select(F.col("node").alias("id"), "n", "sig").dropDuplicates(["id"]))
        posted = durable(postings(reps))
        lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1").select("token")
        repeated = full.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node")
        wanted = posted.join(lists, "token", "left_semi").select(F.col("id").alias("node")).union(repeated).distinct()
        asked = full.filter("id IS NOT NULL").join(wanted, "node", "left_semi").select("id").distinct()
        texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        texts = texts.join(asked, "id", "left_semi").union(texts.filter("id IS NULL"))
        bodies = durable(texts.mapInArrow(_full_sets(seed), "id long, body binary").distinct())
        if bodies.groupBy("id").count().filter("count > 1").isEmpty():
            return signed, reps, posted, bodies


def _groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, tag, node, n; marks: node, root, first) where marks has the nodes that hold or meet several rows.

    ``first`` is the group's row that stays: the smallest id, of rows that repeat it the
    smallest tag; rows without an id come last.
    """
    signed, reps, posted, bodies = _nodes(df, id_col, text_col)
    now = posted.withColumn("root", F.col("id"))
    tested = durable(_colliding(_ordered(_led(now)), reps))
    links = durable(_links(tested, bodies))
    roots = components(links)
    now = durable(posted.join(roots, "id", "left").select("token", "id", "n", F.coalesce("root", "id").alias("root")))
    found = durable(_rest(now, reps, bodies, tested))
    if not found.isEmpty():
        roots = components(links.union(found))
    rows = signed.select("id", "tag", "node", "n")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tag")
    each = rows.filter("n > 0").groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    linked = durable(each.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = linked.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1").drop("rows")
    return rows, durable(linked.select("node", "root").join(groups, "root"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links. Rows without words or
    text (nulls, empty texts) have no shingles and are linked with nothing. Rows with
    equal sets are linked; repeated rows carry the same marks, and rows that repeat an id
    with another text are linked by their texts like others. Rows without an id are
    linked too; they are kept only where their whole group has no id, and the component
    is null there. An empty table gives an empty result; extra columns are not read.
    """
    rows, marks = _groups(df, id_col, text_col)
    out = rows.join(marks.select("node", F.lit(True).alias("grouped"), F.col("first.id").alias("least")), "node", "left")
    component = F.when(F.col("grouped") & (F.col("n") > 0), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which each group of near copies keeps exactly one, with all its columns.

    It is the row with the smallest id, of rows that repeat it the one whose text has the
    smallest hash, of equal ones the one whose whole row has the largest hash. Rows without
    words stay. Columns of any name are kept as they are.
    """
    rows, marks = _groups(df, id_col, text_col)
    grouped = rows.filter("n > 0").join(marks, "node")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tag") == F.col("first.tag"))
    dropped = grouped.filter(~stays).select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    again = durable(grouped.filter(stays).groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).count().filter("count > 1").drop("count"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    tagged = df.select(whole.alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text_col).alias("_t"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag"))
    kept = tagged.join(dropped, same, "left_anti")
    if not again.isEmpty():  # the row that stays is written several times
        one = kept.join(again, same, "left_semi").groupBy("_i", "_t").agg(F.max_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        kept = kept.join(again, same, "left_anti").select("_row").union(one.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def op7(spark, sf_dir):
    return near_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash_near_dedup": op7}
# All pairs that share a shingle, and all that links reach.
ORACLE = {
    "op7_minhash_near_dedup": r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN both_ways ON a = id),
    c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
