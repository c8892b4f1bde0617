import hashlib
import random
import re

import pyarrow as pa

from lamella.llm import _words
from lamella.llm.license_scan import KNOWN, license_scan
from lamella.llm.line_dedup import _chunked, chunks, line_dedup

SCHEMA = "doc_id long, text string, digest string, place int"


def table(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], SCHEMA)


def test_licenses_are_found_after_normalising(spark):
    docs = [
        (1, "licensed UNDER the apache license version 2.0"), (2, "Prose here.\nReleased under the M.I.T. Licence\n"), (3, "Released under the MIT Licence!\nReleased under the MIT License."),
        (4, "Copyright 2020 Someone\n" + next(t for k, t in KNOWN if k == "MIT" and len(t) > 500)), (5, "No licence at all"), (6, None), (7, ""), (8, "x" * 200_000),
        (9, "All rights reserved."), (10, "This work is licensed under the GNU General Public License, version 3, or not"),
    ]
    got = {r.doc_id: (r.licenses, r.n_units, r.whole_text) for r in license_scan(table(spark, docs)).collect()}
    assert got == {1: ("Apache-2.0", 1, True), 3: ("MIT", 2, False), 4: ("MIT", 1, True)}
    assert license_scan(table(spark, [])).count() == 0


# Constants of the chunk rule, restated.
BASE, LENGTH, NOW, BEFORE, ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def spread(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


def own_chunks(text):
    """The chunk rule in plain Python: a cut where the rolled hash of a line and the one before it is divisible by 3."""
    out, part, last = [], [], 0
    for line in text.split("\n"):
        raw = line.encode()
        h = spread((sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(raw)) + len(raw) * LENGTH) & ALL)
        part.append(line)
        if spread((h * NOW + last * BEFORE) & ALL) % 3 == 0:
            out.append(part)
            part = []
        last = h
    return [*out, part] if part else out


def removable(chunk):
    return len(chunk) >= 2 and len(re.findall(r"[^ \t\n\v\f\r]+", "\n".join(chunk))) >= 10


def brute(docs):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for c in own_chunks(t or ""):
            if removable(c):
                first.setdefault("\n".join(c), i)
    out = {}
    for i, t in docs:
        seen, kept = set(), []
        for c in own_chunks(t or ""):
            body = "\n".join(c)
            if removable(c) and (body in seen or (i is not None and first[body] != i)):
                seen.add(body)
                continue
            seen.add(body)
            kept += c
        out[i] = "\n".join(kept)
    return out


def test_chunks_equal_the_plain_rule():
    rng = random.Random(4)
    texts = ["", "\n", "\n\nx", "one", "é\n\n ü\n"] + ["\n".join("".join(rng.choices("ab é", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    assert [chunks(t) for t in texts] == [own_chunks(t) for t in texts]
    together = [len(c.row) for _, _, _, _, c in _chunked(pa.array([*texts, None]))]
    assert sum(together) == sum(len(own_chunks(t)) for t in [*texts, ""])


def test_long_texts_are_chunked_by_parts(monkeypatch):
    text = "\n".join(f"line {k} " + "x" * (k * 7 % 90) for k in range(400))
    whole = chunks(text)
    monkeypatch.setattr(_words, "SEGMENT", 64)
    assert chunks(text) == whole and sum(whole, []) == text.split("\n")


def test_a_row_loses_only_what_repeats(spark):
    """An id written with two texts: what only the second text holds stays."""
    p = "\n".join(f"passage line {k} with a few more words in it" for k in range(12))
    q = "\n".join(f"other lines {k} that occur nowhere else at all" for k in range(12))
    got = sorted((r.doc_id, r.text) for r in line_dedup(table(spark, [(1, p), (2, p), (2, q), (2, q)])).collect())
    assert got[0] == (1, p) and got[2:] == [(2, q), (2, q)] and len(got[1][1]) < len(p) / 2


def test_repeated_chunks_go_everywhere_but_first(spark):
    """Against brute force; passages are under 50 words, so that only the chunk rule applies."""
    passages = ["\n".join(f"{name} passage line {k} of six" for k in range(7)) for name in ("shared", "common", "other")]
    docs = [(i, f"own start {i} words\n" + f"line {i}\n" * 2 + passages[i % 3] + f"\nend{i} own") for i in range(9)]
    docs += [(20, None), (21, ""), (22, "\n\n\n"), (23, "one line only, and a long one at that with many words"), (24, passages[0] + f"\n{'z ' * 3}\n" + passages[0]), (25, "w" * 200_000), (None, passages[1])]
    got = {r.doc_id: r.text for r in line_dedup(table(spark, docs)).collect()}
    assert got == brute(docs)
    assert sum(len(t or "") for _, t in docs) - sum(map(len, got.values())) > 300
    assert line_dedup(table(spark, [])).count() == 0


def test_cuts_resist_shifts():
    lines = [f"line {k}" for k in range(200)]
    one, two = chunks("\n".join(lines)), chunks("\n".join(["new first line", *lines]))
    assert len({tuple(c) for c in one} & {tuple(c) for c in two}) >= len(one) - 3
    assert sum(one, []) == lines
    assert hashlib.md5("\n".join(sum(two, [])).encode()).hexdigest() == hashlib.md5("\n".join(["new first line", *lines]).encode()).hexdigest()
