"""Line deduplication: repeated chunks of lines, and every repeated passage of words.

A document's lines are cut into chunks where a rolling hash over the last ``WINDOW``
line hashes is divisible by ``DIVISOR``. The cuts depend only on nearby lines, so a
passage that several documents share gets the same inner chunks wherever it stands.
A chunk of several lines and at least ``MIN_WORDS`` words that occurs more than once in
the corpus is removed everywhere but in its first place. Occurrences are grouped by
digest and by the chunk's whole bytes, so only equal bytes count as a repetition.

A row is known by its id and the hash of its text: rows that repeat both are one document,
rows that repeat an id with another text are documents of their own.

Besides, each run of ``PASSAGE`` words that occurs more than once is removed but for its
first place, wherever lines and chunks begin. Every such run is found: the least hash among
its runs of ``ANCHOR`` words depends on its words alone, so equal runs have equal anchors.
Anchors and chunks that occur twice set bits of a filter sized by their number. The runs around one
anchor are a segment; segments that pass the filter (some by chance) are grouped whole by
128 hash bits of their words, and all but the first go. Where an anchor has several segments,
the runs of the first of each are grouped one by one, as they can be equal in part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, durable, read
from lamella.llm._words import EXACT, line_hashes, mix, power_table, word_hashes

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
MIN_WORDS = 10
PASSAGE = 50
ANCHOR = 25
BITS_PER_KEY = 128  # one bit a key is set, so about one other key in so many passes by chance
MOST_BITS = 1 << 30  # 128 MB; beyond, the filter gets fuller and lets more through to the grouping, it loses nothing
BLOCK_BITS = 1 << 16

_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the rolling hash, one a line of the window
_WORD = re.compile(r"[^ \t\n\v\f\r]+")  # words as in _words


def _chunk_lines(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, end line) of the chunks of whole rows; ``before`` are the lines before each row."""
    starts = before[:-1]
    rolled = np.zeros(len(hashes), np.uint64)
    last = hashes
    for k in range(WINDOW):  # the line k places back, 0 before the row's first line
        rolled = rolled + last * np.uint64(_PLACES[k])
        last = np.append(np.uint64(0), last[:-1])
        last[starts] = 0
    cut = mix(rolled) % np.uint64(DIVISOR) == 0
    cut[before[1:] - 1] = True
    end = np.flatnonzero(cut) + 1
    return np.append(0, end[:-1]), end


class _Chunks:
    """The chunks of whole rows: row, place in the row, byte span, lines, words and key of each."""

    def __init__(self, hashes, begins, ends, words, before):
        self.first, self.end = _chunk_lines(hashes, before)
        self.row = np.searchsorted(before, self.first, side="right") - 1
        self.before = np.searchsorted(self.row, np.arange(len(before)))
        self.place = np.arange(len(self.row)) - self.before[self.row]
        self.begins, self.ends = begins[self.first], ends[self.end - 1]
        self.lines = self.end - self.first
        total = np.append(0, np.cumsum(words))
        self.words = total[self.end] - total[self.first]
        self.removable = (self.lines >= MIN_LINES) & (self.words >= MIN_WORDS)
        self.key = _hash(hashes, self.first, self.end)

    def distinct(self) -> np.ndarray:
        """Removable chunks, of equal keys in one row the first."""
        own = np.flatnonzero(self.removable)
        order = own[np.lexsort((own, self.key[own], self.row[own]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.key[order][1:] != self.key[order][:-1]) | (self.row[order][1:] != self.row[order][:-1])
        return np.sort(order[fresh])

    def repeats(self, distinct: np.ndarray) -> np.ndarray:
        """Whether a row has equal removable chunks."""
        rows = len(self.before) - 1
        return np.bincount(self.row[self.removable], minlength=rows) > np.bincount(self.row[distinct], minlength=rows)


def _chunked(column: pa.Array):
    """(first row, end row, bytes, lines before each row, chunks) over a text column."""
    for first, end, raw, hashes, begins, ends, words, before in line_hashes(column):
        yield first, end, raw, before, _Chunks(hashes, begins, ends, words, before)


def chunks(text: str) -> list[list[str]]:
    """The lines of a text, cut by content."""
    lines = text.split("\n")
    return [lines[a:b] for _, _, _, _, c in _chunked(pa.array([text])) for a, b in zip(c.first, c.end)]


def _hash(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span."""
    up, down = power_table(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def _lanes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _hash(words, begin, end), _hash(mix(words ^ np.uint64(0x5851F42D4C957F2D)), begin, end)


def _segments(words: np.ndarray, offsets: np.ndarray):
    """(anchor hash, row, first passage's place in the row, first passage, number of passages) of the segments of whole rows."""
    if len(words) < PASSAGE:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    begin = np.arange(len(words) - ANCHOR + 1)
    runs = _hash(words, begin, begin + ANCHOR)
    at, size, width = begin, 1, PASSAGE - ANCHOR + 1
    while size < width:  # place of the leftmost least hash of each passage
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at, size = np.where(runs[right] < runs[left], right, left), size + step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[: len(at)] == row[PASSAGE - 1 :])
    at = at[starts]
    fresh = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    starts, number = starts[fresh], np.diff(np.append(fresh, len(at)))
    return runs[at[fresh]], row[starts], starts - offsets[row[starts]], starts, number


def _units(batches):
    """Keys of all anchors and removable chunks, a chunk once a row."""
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for _, _, _, _, c in _chunked(batch.column(0)):
            found.append(c.key[c.distinct()])
        for _, _, words, offsets in word_hashes(batch.column(0), EXACT):
            found.append(_segments(words, offsets)[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])


def _packed(batches):
    """(block, bits) of a partition's blocks of the filter."""
    bits = [b.column(0).to_numpy() for b in batches if b.num_rows]
    if bits:
        bits = np.unique(np.concatenate(bits))
        blocks, first = np.unique(bits // BLOCK_BITS, return_index=True)
        for block, part in zip(blocks, np.split(bits, first[1:])):
            flags = np.zeros(BLOCK_BITS, np.uint8)
            flags[part % BLOCK_BITS] = 1
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])


def _filter(keys: DataFrame):
    """A broadcast filter of the keys, BITS_PER_KEY for each and MOST_BITS in all."""
    keys = durable(keys.select("key"))
    size = min(MOST_BITS, max(BLOCK_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    bit = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("bit"))
    blocks = bit.repartition(F.expr(f"bit div {BLOCK_BITS}")).mapInArrow(_packed, "block long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _passing(shared):
    """The keys that pass the filter, as an expression: only they go to Python, the texts beside them do not."""

    @F.arrow_udf("boolean")
    def passing(keys: pa.Array) -> pa.Array:
        return pa.array(_passes(np.frombuffer(shared.value, np.uint8), keys.to_numpy().view(np.uint64)))

    return passing


def _tags(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix(mix(rows.view(np.uint64)) + places.view(np.uint64))


_FOUND = "doc_id long, row long, place long, body string, anchor long, n long, a long, b long, tag long"


def _emit(shared):
    """What passes the filter: (doc_id, row, place, body) of chunks, (doc_id, row, place, anchor, n, a, b, tag) of segments; (doc_id, row, -1) of rows with a removable chunk twice."""

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        names = ["doc_id", "row", "place", "body", "anchor", "n", "a", "b", "tag"]
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, raw, _, c in _chunked(batch.column(2)):
                use = c.distinct()
                twice = first + np.flatnonzero(c.repeats(use))
                use = use[_passes(bits, c.key[use])]
                if len(twice):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[twice]), pa.array(rows[twice]), pa.array(np.full(len(twice), -1)), pa.nulls(len(twice), pa.string()), *[pa.nulls(len(twice), pa.int64())] * 5], names)
                if len(use):
                    at = first + c.row[use]
                    bodies = pa.array([raw[a:b].tobytes() for a, b in zip(c.begins[use], c.ends[use])], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rows[at]), pa.array(c.place[use]), bodies, *[pa.nulls(len(use), pa.int64())] * 5], names)
            for first, _, words, offsets in word_hashes(batch.column(2), EXACT):
                anchor, row, place, start, n = _segments(words, offsets)
                use = _passes(bits, anchor)
                anchor, row, place, start, n = (x[use] for x in (anchor, row, place, start, n))
                if len(row):
                    a, b = _lanes(words, start, start + n + PASSAGE - 1)
                    own = rows[first + row]
                    columns = [anchor.view(np.int64), n, a.view(np.int64), b.view(np.int64), _tags(own, place).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + row]), pa.array(own), pa.array(place), pa.nulls(len(row), pa.string()), *map(pa.array, columns)], names)

    return run


def _emit_passages(shared):
    """(doc_id, row, place, a, b) of the single passages of the segments whose tags pass the filter."""

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, words, offsets in word_hashes(batch.column(2), EXACT):
                _, row, place, start, n = _segments(words, offsets)
                use = _passes(bits, _tags(rows[first + row], place))
                row, place, start, n = (x[use] for x in (row, place, start, n))
                if len(row):
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    begin = np.repeat(start, n) + step
                    a, b = _lanes(words, begin, begin + PASSAGE)
                    columns = [np.repeat(ids[first + row], n), np.repeat(rows[first + row], n), np.repeat(place, n) + step, a.view(np.int64), b.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "row", "place", "a", "b"])

    return run


def _inside(text: str) -> list[tuple[int, int]]:
    """Spans of words of one text that repeat an earlier passage of it."""
    out = []
    for _, _, words, _ in word_hashes(pa.array([text]), EXACT):
        first = {}
        begins = np.arange(max(0, len(words) - PASSAGE + 1))
        for at, key in enumerate(zip(*(x.tolist() for x in _lanes(words, begins, begins + PASSAGE)))):
            if (begin := first.setdefault(key, at)) < at:
                out.append((max(at, begin + PASSAGE), at + PASSAGE))
    return out


def _without(line: str, words: list[tuple[int, int]], gone: bytearray) -> str:
    """The line without its marked words and the blanks after them."""
    out, at = [], 0
    for k, (begin, end) in enumerate(words):
        if gone[k]:
            out.append(line[at:begin])
            at = words[k + 1][0] if k + 1 < len(words) else end
    return "".join([*out, line[at:]])


def _cleaned(text: str, spans: list[list[str]], drops: list[tuple[int, int]], named: bool) -> tuple[int, str]:
    """(lines gone whole, text) without the chunks and words at the given places and without repetitions inside the text."""
    drop, gaps = {begin for begin, end in drops if end is None}, [d for d in drops if d[1] is not None]
    if not named:
        gaps = _inside(text)
    marked = bytearray(len(text) // 2 + 2) if gaps else None
    for begin, end in gaps:
        marked[begin:end] = b"\1" * (end - begin)
    seen, kept, removed, word = set(), [], 0, 0
    for place, (chunk, removable) in enumerate(spans):
        repeated = False
        if removable:
            body = "\n".join(chunk)
            repeated = body in seen
            seen.add(body)
        if marked is None:
            if repeated or place in drop:
                removed += len(chunk)
            else:
                kept.extend(chunk)
            continue
        for line in chunk:
            words = [m.span() for m in _WORD.finditer(line)]
            flags = marked[word : word + len(words)]
            inner = not words and word and marked[word - 1] and marked[word]
            word += len(words)
            if repeated or place in drop or inner or (words and all(flags)):
                removed += 1
            else:
                kept.append(_without(line, words, flags) if any(flags) else line)
    return removed, "\n".join(kept)


def _clean(batches):
    """``doc_id, n_lines, n_removed, text`` of (doc_id, text, drops); only rows with something to remove are taken apart."""
    for batch in batches:
        ids, texts, drops = batch.column(0), batch.column(1), batch.column(2)
        asked = drops.is_valid().to_numpy(zero_copy_only=False)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        n, gone, out = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for first, end, _, before, c in _chunked(texts):
            n[first:end] = np.diff(before)
            for i in np.flatnonzero(c.repeats(c.distinct()) | asked[first:end] | ~named[first:end]):
                text, row = texts[first + i].as_py() or "", range(c.before[i], c.before[i + 1])
                lines = text.split("\n")
                spans = [(lines[c.first[k] - before[i] : c.end[k] - before[i]], c.removable[k]) for k in row]
                places = [(d["begin"], d["end"]) for d in drops[first + i].as_py() or ()]
                gone[first + i], out[first + i] = _cleaned(text, spans, places, named[first + i])
        text = pc.coalesce(pa.array(out, pa.string()), texts.cast(pa.string()), pa.scalar(""))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(gone), text], ["doc_id", "n_lines", "n_removed", "text"])


def _after_first(places: DataFrame, firsts: DataFrame, key: list[str], n) -> DataFrame:
    """(doc_id, row, begin, end): words of the ``n`` passages at each place but the first; what overlaps the first stays."""
    other = places.join(firsts, key).filter("row <> f.row OR place <> f.place")
    begin = F.when(F.col("row") == F.col("f.row"), F.greatest("place", F.col("f.place") + n + PASSAGE - 1)).otherwise(F.col("place"))
    return other.select("row", begin.alias("begin"), (F.col("place") + n + PASSAGE - 1).alias("end"))


def line_dedup(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, text`` with repeated chunks and passages removed.

    The first place of a chunk or passage is the one in the document with the smallest id
    (of rows that repeat it, the one with the smallest hash), there the topmost.
    ``n_removed`` counts lines that are gone whole; of other lines the words of a passage
    are cut out. Null texts count as empty (one empty line). Rows without an id take no
    part and come back whole, but for repetitions inside them. Rows that repeat an id and
    text are one document; with another text they are documents of their own. An empty
    table gives an empty result; extra columns are not read.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    repeated = named.select("text").mapInArrow(_units, "key long").groupBy("key").count().filter("count > 1")
    found = durable(named.mapInArrow(_emit(_filter(repeated)), _FOUND))

    # Chunks: grouped by digest and whole bytes; a copy in any row but the first goes.
    placed = found.filter("body IS NOT NULL").select("doc_id", "row", "place", "body")
    key = [F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("size"), F.xxhash64("body").alias("xx")]
    whose = F.struct("doc_id", "row")
    groups = placed.groupBy(F.unhex(F.sha2("body", 256)).alias("digest"), "body").agg(F.min(whose).alias("first"), F.max(whose).alias("last"))
    repeated = groups.filter("first <> last").select(*key, F.col("first.row").alias("first"))
    hits = placed.select("row", "place", *key).join(repeated, ["sha", "size", "xx"]).filter("row <> first")
    hits = hits.select("row", F.col("place").alias("begin"), F.lit(None).cast("long").alias("end"))

    segments = found.filter("anchor IS NOT NULL").select("doc_id", "row", "place", "anchor", "n", "a", "b", "tag")
    kinds = durable(segments.groupBy("anchor", "n", "a", "b").agg(F.min(F.struct("doc_id", "row", "place", "tag")).alias("f"), F.count(F.lit(1)).alias("times")))
    again = _after_first(segments, kinds.filter("times > 1").drop("times"), ["anchor", "n", "a", "b"], F.col("n"))

    several = kinds.groupBy("anchor").count().filter("count > 1")
    partly = kinds.join(several, "anchor").select(F.explode(F.array("f.tag", "f.row")).alias("key"))
    parted = _filter(partly)
    passages = durable(named.filter(_passing(parted)("row")).mapInArrow(_emit_passages(parted), "doc_id long, row long, place long, a long, b long"))
    firsts = passages.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row", "place")).alias("f"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    again = again.union(_after_first(passages, firsts, ["a", "b"], F.lit(1)))

    drops = durable(hits.union(again).groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("drops")))
    # Only rows with something to drop, or that repeat a chunk of their own, or without an id are taken to Python (and a few by chance);
    # those with something to drop are shuffled to meet it. All others stay as they are.
    touched = _passing(_filter(drops.select(F.col("row").alias("key")).union(found.filter("place < 0").select("row"))))
    asked = F.col("doc_id").isNull() | touched("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    apart = rows.filter(~asked).select("doc_id", (feeds + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), text.alias("text"))
    met = rows.filter(asked).join(drops, "row", "left").select("doc_id", "text", "drops")
    return apart.union(met.mapInArrow(_clean, "doc_id long, n_lines long, n_removed long, text string"))


def op10(spark, sf_dir):
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op10_line_dedup": op10}
ORACLE = {}
