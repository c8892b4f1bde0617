"""Phrase collocations counted by vertical partitioning of suffixes.

Texts are split into pieces and words; the suffixes of every piece, cut off at ``DEPTH`` words, are the
leaves of a suffix tree per language. Words are 64-bit hashes, checked to be different for different
words of a language.

1. Words are counted. A phrase that occurs often has only frequent words.
2. Pairs of frequent words are counted by the hash of the pair. A suffix ends where its next pair is
   rare: what it loses belongs to no frequent phrase. Hashes that meet by chance only keep a suffix longer.
3. Suffixes are partitioned by their prefix. Those with one first word form part of a group of about
   ``budget`` leaves; a prefix with more than that is extended by its next word, so that no hot word fills
   a group. Prefixes over the budget are fewer than all pairs divided by it.
4. Each group sorts its leaves, which is its subtree, and reads the count of each node from the totals of
   the leaves below. Nodes shorter than their group's prefix lie in several groups and are summed.

The sets of frequent words and pairs and of large prefixes are filters in bitmaps sized by their counts.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, durable, read
from lamella.llm._words import SEGMENT, buffers, mix, power_table

DEPTH = 4
LEAST = 30
TOP = 2000
BUDGET = 1_000_000  # leaves of a group
LEAVES = 1_000_000  # rows a task puts together at a time
GROUPS = 65_536  # of a level at most: beyond, the budget grows with the corpus
FILTER_BITS = 1 << 29  # 64 MB at most; a fuller filter lets more through to the counting, it loses nothing
BITS_PER_KEY = 16
BLOCK_BITS = 1 << 16

_ENDS = np.zeros(256, bool)
_ENDS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True  # . , ; : ! ? and line ends
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LONG = 64  # longer words are hashed by digest
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _Words:
    """Words of whole rows: hash, row, whether a piece begins there, and the bytes they come from."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, seed: int):
        self.raw, n = raw, len(raw)
        letters = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed))
        parts, at, carried = [], 0, True
        while at < n:
            stop = self._cut(at, n)
            part = raw[at:stop]
            gap = _GAPS[part]
            first, last = ~gap, ~gap
            inner = offsets[(offsets > at) & (offsets < stop)] - at
            fresh = np.zeros(len(part), bool)
            fresh[inner] = True
            first[1:] &= gap[:-1] | fresh[1:]
            last[:-1] &= gap[1:] | fresh[1:]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            breaks = np.append(0, np.cumsum(_ENDS[part] | fresh))
            up, down = power_table(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(letters[part] * up, out=total[1:])
            key = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[2])
            for k in np.flatnonzero(end - start > _LONG):
                digest = hashlib.blake2b(part[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
                key[k] = int.from_bytes(digest, "little")
            # A break counts up to the word's first byte: a row that begins there is a break as well.
            seen = np.append(0, breaks[start + 1])
            begins = seen[1:] > seen[:-1]
            if len(start):
                begins[0] |= carried
                carried = breaks[-1] > seen[-1]
            else:
                carried |= breaks[-1] > 0
            if len(inner) == 0 or inner[-1] < len(part):
                carried |= bool(np.any(offsets == stop))
            parts.append((key, start + at, end + at, begins))
            at = stop
        none = np.zeros(0, np.int64)
        self.key, self.start, self.end, self.begins = (np.concatenate(c) for c in zip(*parts)) if parts else (none.astype(np.uint64), none, none, none.astype(bool))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1

    def _cut(self, at: int, n: int) -> int:
        """End of the part that begins at ``at``: after a gap, near SEGMENT bytes on."""
        if n - at <= SEGMENT:
            return n
        gaps = np.flatnonzero(_GAPS[self.raw[at : at + SEGMENT]])
        if len(gaps):
            return at + int(gaps[-1]) + 1
        for begin in range(at + SEGMENT, n, SEGMENT):  # one very long word
            gaps = np.flatnonzero(_GAPS[self.raw[begin : min(begin + SEGMENT, n)]])
            if len(gaps):
                return begin + int(gaps[0]) + 1
        return n


def _segments(batch, seed):
    """(language code of each word, languages, words) of about SEGMENT bytes of whole rows at a time."""
    raw, offsets = buffers(batch.column(1))
    raw = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    coded = batch.column(0).dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1), rows)
        words = _Words(raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], seed)
        if len(words.key):
            yield code[row:end][words.row], names, words
        row = end


def _tongue(names: list[str]) -> np.ndarray:
    """Hash of each language's name."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, its number)."""
    _, first, number = np.unique(keys, return_index=True, return_counts=True)
    return first, number


def _vocabulary(seed):
    def run(batches):
        for batch in batches:
            for code, names, w in _segments(batch, seed):
                first, number = _counted(mix(w.key ^ _tongue(names)[code]))
                text = w.raw.tobytes()
                spelled = pa.array([text[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())], pa.binary()).cast(pa.string())
                lang = pa.array(names).take(pa.array(code[first]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(w.key[first].view(np.int64)), spelled, pa.array(number)], ["lang", "h", "word", "n"])

    return run


class _Filter:
    """A bitmap of 64-bit keys, made in blocks by tasks and held by every task."""

    def __init__(self, keys: DataFrame, number: int):
        self.bits = min(FILTER_BITS, max(BLOCK_BITS, 1 << (BITS_PER_KEY * number).bit_length()))
        bit = keys.select(F.col("key").bitwiseAND(F.lit(self.bits - 1)).alias("bit")).distinct()
        blocks = bit.groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).applyInArrow(_block, "block long, bits binary")
        out = np.zeros(max(self.bits, BLOCK_BITS) // 8, np.uint8)
        for r in blocks.toLocalIterator():
            out[r["block"] * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(out.tobytes())

    def passes(self, keys: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.shared.value, np.uint8)
        at = keys & np.uint64(self.bits - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _block(key, table):
    flags = np.zeros(BLOCK_BITS, np.uint8)
    flags[table.column("bit").to_numpy() % BLOCK_BITS] = 1
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def _prefix_key(tongue: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Key of a phrase of a language."""
    out = tongue
    for k, w in enumerate(words):
        out = mix(out * _ODD[0] + w * _ODD[k % 4] + np.uint64(k + 1))
    return out


def _pairs(w: _Words, tongue: np.ndarray, frequent: _Filter) -> tuple[np.ndarray, np.ndarray]:
    """(places where a pair of frequent words of one piece begins, the pairs' keys)."""
    often = frequent.passes(_prefix_key(tongue, [w.key]))
    at = np.flatnonzero(often[:-1] & often[1:] & ~w.begins[1:])
    return at, _prefix_key(tongue[at], [w.key[at], w.key[at + 1]])


def _pair_counts(seed, frequent):
    def run(batches):
        for batch in batches:
            for code, names, w in _segments(batch, seed):
                _, keys = _pairs(w, _tongue(names)[code], frequent)
                first, number = _counted(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(number)], ["key", "n"])

    return run


_PLACES = ["h1", "h2", "h3", "h4"]
_LEAF = "lang string, h1 long, h2 long, h3 long, h4 long, depth int, held int, part long, n long"


def _suffixes(w: _Words, tongue: np.ndarray, frequent: _Filter, paired: _Filter):
    """(places where a frequent pair begins, depth up to the next rare pair, words from there on)."""
    at, keys = _pairs(w, tongue, frequent)
    linked = np.zeros(len(w.key) + DEPTH, bool)
    linked[at[paired.passes(keys)]] = True
    start = np.flatnonzero(linked)
    depth = np.full(len(start), 2)
    for k in range(1, DEPTH - 1):
        depth += (depth == k + 1) & linked[start + k]
    padded = np.append(w.key, np.zeros(DEPTH, np.uint64))
    return start, depth, [np.where(depth > k, padded[start + k], np.uint64(0)) for k in range(DEPTH)]


class _Leaves:
    """Leaves of one task, equal ones put together before they leave it."""

    def __init__(self, large: _Filter, groups: int):
        self.large, self.groups, self.names, self.parts, self.rows = large, groups, [], [], 0

    def add(self, names, code, depth, words):
        for x in names:
            if x not in self.names:
                self.names.append(x)
        code = np.array([self.names.index(x) for x in names])[code]
        leaf = _prefix_key(_tongue(self.names)[code], [*words, depth.astype(np.uint64)])
        _, first, number = np.unique(leaf, return_index=True, return_counts=True)
        self.parts.append([leaf[first], number, code[first], depth[first], *[x[first] for x in words]])
        self.rows += len(first)

    def batch(self):
        """All leaves so far with their group and the length of the prefix that chose it."""
        leaf, number, code, depth, *words = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.rows = [], 0
        _, first, place = np.unique(leaf, return_index=True, return_inverse=True)
        number = np.bincount(place, weights=number).astype(np.int64)
        code, depth, words = code[first], depth[first], [x[first] for x in words]
        tongue = _tongue(self.names)[code]
        one, two, all_words = (_prefix_key(tongue, words[:k]) for k in (1, 2, DEPTH))
        over, far_over = self.large.passes(one), self.large.passes(two)
        held = np.where(over, np.where(far_over, DEPTH, 2), 1)
        part = mix(np.where(over, np.where(far_over, all_words, two), one)) % np.uint64(self.groups)
        lang = pa.array(self.names, pa.string()).take(pa.array(code))
        columns = [lang, *[pa.array(x.view(np.int64)) for x in words], pa.array(depth.astype(np.int32)), pa.array(held.astype(np.int32)), pa.array(part.view(np.int64)), pa.array(number)]
        return pa.RecordBatch.from_arrays(columns, ["lang", *_PLACES, "depth", "held", "part", "n"])


def _leaves(seed, frequent, paired, large, groups):
    """Suffixes from each frequent pair on, cut at rare pairs."""

    def run(batches):
        own = _Leaves(large, groups)
        for batch in batches:
            for code, names, w in _segments(batch, seed):
                start, depth, words = _suffixes(w, _tongue(names)[code], frequent, paired)
                own.add(names, code[start], depth, words)
                if own.rows >= LEAVES:
                    yield own.batch()
        if own.rows:
            yield own.batch()

    return run


def _subtrees(least):
    """Nodes of a group's subtrees with the totals of their leaves.

    The node of a phrase shorter than the prefix that chose its group has leaves in other
    groups, too; it is part of a sum and stays, whatever its total.
    """

    def run(key, table):
        coded = table.column("lang").combine_chunks().dictionary_encode()
        lang = coded.indices.to_numpy()
        words = [table.column(c).to_numpy() for c in _PLACES]
        depth, held, n = (table.column(c).to_numpy() for c in ("depth", "held", "n"))
        order = np.lexsort([*words[::-1], lang])
        lang, depth, held, n, words = lang[order], depth[order], held[order], n[order], [x[order] for x in words]
        out = []
        changed = np.append(True, (lang[1:] != lang[:-1]) | (words[0][1:] != words[0][:-1]))
        for k in range(1, DEPTH):
            changed[1:] |= words[k][1:] != words[k][:-1]
            first = np.flatnonzero(changed)
            total = np.add.reduceat(n, first)
            node = (depth[first] > k) & ((total >= least) | (held[first] > k + 1))  # less deep: a shorter phrase
            first, total = first[node], total[node]
            out.append([lang[first], *[np.where(j <= k, words[j][first], 0) for j in range(DEPTH)], np.full(len(first), k + 1, np.int32), total])
        lang, *words, depth, n = (np.concatenate(c) for c in zip(*out))
        names = ["lang", *_PLACES, "depth", "n"]
        return pa.table([coded.dictionary.take(pa.array(lang)), *[pa.array(x) for x in words], pa.array(depth), pa.array(n)], names=names)

    return run


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words: ``lang, h, word, n`` of all words; phrases: ``lang, h1 .. h4, depth, n`` of those of 2 to 4 words that occur ``least`` times).

    Null languages are ``und``, null texts empty. ``h1`` to ``h4`` name the words by ``h``; places beyond the depth are 0.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    for seed in count():  # drawn anew should two words of a language have one hash
        words = rows.mapInArrow(_vocabulary(seed), "lang string, h long, word string, n long")
        words = durable(words.groupBy("lang", "h", "word").agg(F.sum("n").alias("n")))
        if words.groupBy("lang", "h").count().filter("count > 1").isEmpty():
            break
    often = words.filter(F.col("n") >= least)
    named = often.select("lang", "h").mapInArrow(_word_keys, "key long")
    frequent = _Filter(named, often.count())

    pairs = rows.mapInArrow(_pair_counts(seed, frequent), "key long, n long")
    pairs = durable(pairs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    number, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    paired = _Filter(pairs, number)

    budget = max(budget, total // GROUPS)
    groups = max(1, -(-total // budget))
    heads = often.filter(F.col("n") > budget).select("lang", "h").mapInArrow(_word_keys, "key long").union(pairs.filter(F.col("n") > budget).select("key"))
    heads = durable(heads)
    large = _Filter(heads, heads.count())

    leaves = rows.mapInArrow(_leaves(seed, frequent, paired, large, groups), _LEAF).repartition("part")
    leaves = leaves.groupBy("lang", *_PLACES, "depth", "held", "part").agg(F.sum("n").alias("n"))
    nodes = leaves.groupBy("part").applyInArrow(_subtrees(least), "lang string, h1 long, h2 long, h3 long, h4 long, depth int, n long")
    nodes = nodes.groupBy("lang", *_PLACES, "depth").agg(F.sum("n").alias("n"))
    return words, durable(nodes.filter(F.col("n") >= least))


def _word_keys(batches):
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        tongue = _tongue(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
        keys = _prefix_key(tongue, [batch.column(1).to_numpy().view(np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _key(*places):
    """The phrase of these places, filled up with zeros."""
    return [F.col(p) if p else F.lit(0).cast("long") for p in [*places, *[None] * (DEPTH - len(places))]]


def _cuts(phrases: DataFrame) -> DataFrame:
    """``lang, h1 .. h4, depth, a, k`` and the two parts ``left`` and ``right`` of every cut."""
    cuts = []
    for d in range(2, DEPTH + 1):
        own = _PLACES[:d]
        for k in range(1, d):
            left, right = F.array(*_key(*own[:k])), F.array(*_key(*own[k:]))
            cuts.append(F.when(F.col("depth") == d, F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))))
    return phrases.select("lang", *_PLACES, "depth", F.col("n").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("lang", *_PLACES, "depth", "a", "c.*")


def _inner(phrases: DataFrame) -> DataFrame:
    """``lang, h1 .. h4, longer``: every shorter phrase inside each phrase, with the longer one's count."""
    parts = []
    for d in range(3, DEPTH + 1):
        for size in range(2, d):
            for at in range(d - size + 1):
                parts.append(F.when(F.col("depth") == d, F.array(*_key(*_PLACES[at : at + size]))))
    inner = phrases.select("lang", F.col("n").alias("longer"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return inner.select("lang", *[F.col("p")[k].alias(p) for k, p in enumerate(_PLACES)], "longer")


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, budget: int = BUDGET
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of 2 to 4 words that occur a >= ``least`` times inside pieces (between punctuation and line
    ends). Of the cuts into a first part that occurs l and a rest that occurs r times, the one with
    the lowest floor(2000000 a / (l + r)) counts, of equal ones the first. A phrase goes if a longer one
    that has it inside occurs at least 80 % as often. Order: score, a (both descending), phrase by bytes. Null languages are ``und``;
    null and empty texts have no words; rows without any id and repeated rows count like others. An empty
    table gives an empty result; columns other than the two named are not read.
    """
    words, phrases = phrase_counts(df, lang_col, text_col, least, budget)
    long = lambda c: F.col(c).cast("decimal(38,0)")
    inside = _inner(phrases).groupBy("lang", *_PLACES).agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["lang", *_PLACES], "left").filter(F.col("longer").isNull() | (100 * long("longer") < 80 * long("n"))).drop("longer")

    single = words.filter(F.col("n") >= least).select("lang", F.array(F.col("h"), *[F.lit(0).cast("long")] * (DEPTH - 1)).alias("p"), "n")
    known = single.union(phrases.select("lang", F.array(*_PLACES).alias("p"), "n"))
    cuts = _cuts(kept).join(known.withColumnsRenamed({"p": "left", "n": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"p": "right", "n": "r"}), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr("(2000000 * cast(a AS decimal(38,0))) div (cast(l AS decimal(38,0)) + r)"))
    best = scored.groupBy("lang", *_PLACES, "depth", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    # What reaches the score of the last place, ties included, is spelled out and put in order.
    reached = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"))
    near = durable(best.withColumn("place", F.rank().over(reached)).filter(F.col("place") <= top))
    named = near.select("lang", *_PLACES, F.posexplode(F.slice(F.array(*_PLACES), 1, F.col("depth"))).alias("at", "h"))
    spelled = named.join(words.select("lang", "h", "word"), ["lang", "h"]).groupBy("lang", *_PLACES)
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, ["lang", *_PLACES]).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13}
ORACLE = {
    "op13_collocations": r"""
    WITH p AS (
      SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda w: w <> '') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
    g AS (
      SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size)
      GROUP BY ALL),
    c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE size > 1 AND f >= 30),
    x AS (
      SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS k) WHERE k < size) GROUP BY ALL),
    s AS (
      SELECT c.lang, c.phrase, a, k, u.f AS l, v.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (u.f + v.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
      JOIN g u ON u.lang = c.lang AND u.phrase = array_to_string(w[1 : k], ' ')
      JOIN g v ON v.lang = c.lang AND v.phrase = array_to_string(w[k + 1 :], ' ')),
    b AS (
      SELECT s.* FROM s LEFT JOIN x ON x.lang = s.lang AND x.phrase = s.phrase
      WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
      QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, k) = 1),
    t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM b JOIN t USING (lang) QUALIFY rank <= 2000"""
}
