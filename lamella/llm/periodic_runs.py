"""Runs of periodic words (maximal repetitions), found with a suffix automaton and link-cut access.

The words of a text are appended to a suffix automaton; its suffix links form a tree whose path
from the root to a prefix's state holds the suffixes of that prefix. A link-cut tree over it keeps
one colour, the last end position, on each preferred path. Access to the state of the prefix that
ends at ``i`` walks up the segments of earlier colours and recolours them: a segment of colour
``e`` whose longest string has ``len`` words says that the words up to ``i`` and up to ``e`` agree
over exactly ``len`` words. Where the distance ``i - e`` is at most ``len``, a square ends at
``i``. The segments hold last occurrences only, so the square's root is primitive; a run of period
``q`` shows its square at every end from its first ``2 q`` words on, each time with the run's true
start, and the last such end is the run's end. Accesses cost O(log n) steps on the average.

Only stretches that may hold a run go through the automaton. A run of at least ``2 q`` and
``LEAST`` words is covered by sequences of ``LEAST // 2`` words that occur twice in it, so a text is
first split, by sorted hashes of such sequences, into the stretches that repeated ones cover. No
run, nor the word before or after it that would extend it, is lost or cut by that.

Every text is its own unit of work: rows are not shuffled. Memory grows with the longest
repetitive stretch of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, read
from lamella.llm._words import EXACT, mix, word_hashes

LEAST = 12

_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest length, suffix link of each state, state of each prefix); state 0 is the empty string."""
    length, link, following = [0], [-1], [{}]
    states = []
    last = 0
    for word in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at >= 0:
            target = following[at][word]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = len(length)
                length.append(length[at] + 1)
                link.append(link[target])
                following.append(following[target].copy())
                while at >= 0 and following[at].get(word) == target:
                    following[at][word] = clone
                    at = link[at]
                link[target] = link[state] = clone
        states.append(state)
        last = state
    return length, link, states


class _Segments:
    """Link-cut tree over the suffix links: each preferred path is a splay tree, whose root knows the path's colour."""

    def __init__(self, link: list[int]):
        self.parent = link[:]  # of a splay tree's root: the node above the path
        self.left = [-1] * len(link)
        self.right = [-1] * len(link)
        self.colour = [-1] * len(link)  # last end position, -1 before the first

    def _splay(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        top = x
        while (up := parent[top]) >= 0 and (left[up] == top or right[up] == top):
            top = up
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while True:
            p = parent[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = parent[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x, parent, left, right)
            self._rotate(x, parent, left, right)

    @staticmethod
    def _rotate(x, parent, left, right):
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            parent[inner] = p
        parent[p] = x
        parent[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``state``; its segments as (deepest state, earlier colour)."""
        colour, right = self.colour, self.right
        met = []
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            if right[x] >= 0:  # what lies deeper keeps its colour on a path of its own
                colour[right[x]] = colour[x]
            met.append((x, colour[x]))
            right[x] = below
            below, x = x, self.parent[x]
        self._splay(state)
        colour[state] = end
        return met


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least twice their smallest period, by start and period."""
    length, link, states = _automaton(words)
    segments = _Segments(link)
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(states):
        for deepest, e in segments.access(state, i):
            if e >= 0 and i - e <= length[deepest]:
                found[e - length[deepest] + 1, i - e] = i
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def _repeated(words: np.ndarray, unit: np.ndarray, width: int) -> np.ndarray:
    """Whether each word is covered by a sequence of ``width`` words that its unit has twice."""
    out = np.zeros(len(words), bool)
    if len(words) < width:
        return out
    n = len(words) - width + 1
    keys = np.zeros(n, np.uint64)
    for k in range(width):
        keys = mix(keys + words[k : n + k])
    inside = unit[:n] == unit[width - 1 :]
    keys = mix(keys + mix(unit[:n].astype(np.uint64)))
    ordered = np.sort(keys[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        starts = np.flatnonzero((twice[at] == keys) & inside)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        out = np.cumsum(edge[:-1]) > 0
    return out


def _stretches(words: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that may hold a run of ``least`` words; they lie inside rows."""
    place = np.arange(len(words))
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    while len(place):
        kept = _repeated(words[place], unit, max(least // 2, 1))
        # A repetition of another stretch is none inside this one: look again while that removes a tenth.
        done = 10 * kept.sum() > 9 * len(place)
        place, unit = place[kept], unit[kept]
        if len(place):
            fresh = np.append(True, (place[1:] != place[:-1] + 1) | (unit[1:] != unit[:-1]))
            unit = np.cumsum(fresh)
        if done:
            break
    if not len(place):
        return []
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    return list(zip(place[first].tolist(), (place[np.append(first[1:], len(place)) - 1] + 1).tolist()))


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text without those that lie in a run after its first period."""
    words = text.split()  # at the six ASCII spaces
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


def _find(least: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for first, end, words, offsets in word_hashes(batch.column(1), EXACT):
                found: list[list] = [[] for _ in range(first, end)]
                for lo, hi in _stretches(words, offsets, least):
                    row = int(np.searchsorted(offsets, lo, side="right")) - 1
                    shift = lo - int(offsets[row])
                    codes = np.unique(words[lo:hi], return_inverse=True)[1].tolist()
                    found[row] += [(start + shift, length, period) for start, length, period in runs_of(codes) if length >= least]
                kept = [_collapsed(texts[first + k].as_py() or b"", runs) for k, runs in enumerate(found)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                parts = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: ``id, n_words, runs, collapsed``.

    ``runs`` are all maximal stretches of consecutive words with smallest period q (words q apart are
    identical) of at least ``least`` and 2 q words, as (start, length, period), words numbered from 0,
    ordered by start and period. ``collapsed`` is the text's words, joined by one space, without those
    that some run holds after its first q words. Words are separated by ASCII space, tab and line ends and
    compared by 64-bit hashes; case counts. Null and empty texts have no words, no runs and an empty
    collapsed text. Rows without an id and repeated rows are treated like others; an empty table gives an
    empty result; columns other than the two named are not read, so their names do not matter.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find(least), f"id {kind}, n_words long, runs {_RUNS}, collapsed string")


def with_periods(df: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, chosen by id, repeat a part of theirs to the end.

    With h the CRC-32 of the decimal id and g = h div 10, those with h % 10 = 0 have, from word a = g % n on,
    the original words a to a + p - 1 over and over, p = 1 + (n - a) div (3 + g % 8). Null ids are left alone.
    """
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    plain = df.select("doc_id", "text", h.alias("h"))
    # One array a row: words once, then slices of it, so that no expression looks up single words.
    chosen = plain.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    chosen = chosen.withColumn("a", F.expr("if(n > 0, cast(g % n AS int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int)))), 1, n), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir):
    found = periodic_runs(with_periods(read(spark, sf_dir, "documents")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start, -r.period, r AS run))).run")
    out = found.select("id", "runs", "collapsed", longest.alias("run"), listed.alias("listed"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"run.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * run.length div run.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11}
ORACLE: dict[str, str] = {}  # periods of every length have no bounded SQL form; tests compare with brute force
