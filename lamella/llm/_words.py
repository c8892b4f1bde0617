"""Words and lines of Arrow text columns as 64-bit hashes, computed with numpy over the UTF-8 bytes.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR; A-Z are
lower-cased. Equal words have equal hashes; different ones collide with
probability near 2^-64. Texts are taken in segments cut between words, so that the
temporary arrays stay within a few megabytes whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EXACT = np.arange(256, dtype=np.uint8)  # for word_hashes: case counts
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hash_segment(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = power_table(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((letters[raw].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    words = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(words), np.searchsorted(start, offsets)


def _cut(raw: np.ndarray, at: int, stop: int) -> int:
    """End of the segment that begins at ``at``: between words, near SEGMENT bytes on."""
    if stop - at <= SEGMENT:
        return stop
    spaces = np.flatnonzero(_SPACE[raw[at : at + SEGMENT]])
    if len(spaces):
        return at + int(spaces[-1]) + 1
    for begin in range(at + SEGMENT, stop, SEGMENT):  # one very long word
        spaces = np.flatnonzero(_SPACE[raw[begin : min(begin + SEGMENT, stop)]])
        if len(spaces):
            return begin + int(spaces[0]) + 1
    return stop


def word_hashes(column: pa.Array, letters: np.ndarray = _LOWER):
    """Yield (first row, end row, word hashes, word offsets by row) over a text column."""
    raw, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1)
        end = min(end, rows)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= SEGMENT:
            yield (row, end, *_hash_segment(raw[lo:hi], offsets[row : end + 1] - lo, letters))
        else:  # a single long text
            parts = []
            while lo < hi:
                cut = _cut(raw, lo, hi)
                parts.append(_hash_segment(raw[lo:cut], np.array([0, cut - lo]), letters)[0])
                lo = cut
            words = np.concatenate(parts)
            yield row, end, words, np.array([0, len(words)])
        row = end


def _line_segment(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end, words, lines before each row) of the lines of whole rows; a row has a line more than line feeds."""
    n = len(raw)
    feeds = np.flatnonzero(raw == 10)
    ends = np.concatenate([feeds, offsets[1:]])
    # A row ends before a line feed at the same place, which belongs to the next row.
    order = np.argsort(np.concatenate([2 * feeds + 1, 2 * offsets[1:]]), kind="stable")
    end = ends[order]
    closes = order >= len(feeds)
    begin = np.empty(len(end), np.int64)
    begin[0] = 0
    begin[1:] = np.where(closes[:-1], end[:-1], end[:-1] + 1)
    before = np.append(0, np.flatnonzero(closes) + 1)
    up, down = power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    space = _SPACE[raw]
    starts = np.zeros(n + 1, np.int64)
    if n:
        first = ~space
        first[1:] &= space[:-1]
        first[offsets[(offsets > 0) & (offsets < n)]] = ~space[offsets[(offsets > 0) & (offsets < n)]]
        np.cumsum(first, out=starts[1:])
    return hashes, begin, end, starts[end] - starts[begin], before


def line_hashes(column: pa.Array):
    """Yield (first row, end row, bytes, line hashes, begins, ends, words, lines before each row) over a text column.

    Begins and ends are places in the bytes, which hold the rows of the segment. A single long
    text is hashed by parts of whole lines.
    """
    raw, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1)
        end = min(end, rows)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= SEGMENT:
            yield (row, end, raw[lo:hi], *_line_segment(raw[lo:hi], offsets[row : end + 1] - lo))
        else:  # a single long text
            parts, at = [], lo
            while at < hi:
                stop = at + SEGMENT
                feeds = np.flatnonzero(raw[at:stop] == 10)
                while stop < hi and not len(feeds):  # one very long line
                    at_next = stop
                    stop += SEGMENT
                    feeds = np.flatnonzero(raw[at_next:stop] == 10) + (at_next - at)
                stop = hi if stop >= hi else at + int(feeds[-1]) + 1
                h, begin, line_end, words, _ = _line_segment(raw[at:stop], np.array([0, stop - at]))
                last = len(h) - (stop < hi)  # the empty line after the last feed goes on in the next part
                parts.append([h[:last], begin[:last] + (at - lo), line_end[:last] + (at - lo), words[:last]])
                at = stop
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield row, end, raw[lo:hi], *columns, np.array([0, len(columns[0])])
        row = end
