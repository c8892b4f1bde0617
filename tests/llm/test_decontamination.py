import random
import re

import pytest

from lamella.llm import decontamination as dc

DOCS = "doc_id long, text string, lang string, id string, w long, words string, token long"
ITEMS = "item_id long, text string, item string, words long"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_force(docs, items, window=10):
    """Every place of every document against every window."""
    out = []
    for i, text in docs:
        own = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            theirs = words(item_text)
            size = min(window, len(theirs))
            for s in range(len(theirs) - size + 1) if size else []:
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == theirs[s : s + size]:
                        hit |= set(range(p, p + size))
                        found |= {str(item)} - {"None"}
        out.append((i, len(own), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", "x", 1, "y", 2) for i, t in docs], DOCS)
    return d, spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)


def result(spark, docs, items, **options):
    return sorted(((r[0], r[1], r[2], r[3], list(r[4]), r[5]) for r in dc.contamination(*tables(spark, docs, items), **options).collect()), key=str)


def corpus():
    """Items that share passages, some short; documents with whole windows, windows but one word, overlaps and repeats."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÉé9") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    shared = text(14)
    bodies = [text(rng.randrange(11, 30)) for _ in range(8)] + [shared, text(5) + shared + text(3), text(10), text(9), ["rare-word"], ["two", "words"], ["q"] * 13]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(b)) for k, b in enumerate(bodies)] + [(3, "another text under the same id of eleven words or more"), (None, " ".join(shared[:12])), (90, None), (91, " .;"), (92, "")]
    docs = []
    for k in range(60):
        parts = text(rng.randrange(0, 12))
        for _ in range(rng.randrange(4)):
            b = rng.choice(bodies)
            lo = rng.randrange(len(b))
            piece = b[lo : lo + rng.randrange(8, 16)] if rng.random() < 0.8 else b
            if rng.random() < 0.2:
                piece = [*piece[:4], "changed", *piece[5:]]
            parts += [w.upper() if rng.random() < 0.3 and "é" not in w else w for w in piece] + text(rng.randrange(4))
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (None, " ".join(shared)), (None, None), (5, docs[5][1]), (5, "the same id with another text"), (103, "q " * 40), (104, "Two, words RARE word")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"shingle": 3}, {"window": 4, "broadcast_rows": 0}])
def test_equals_brute_force(spark, options):
    docs, items = corpus()
    assert result(spark, docs, items, **options) == brute_force(docs, items, options.get("window", 10))


def test_empty_tables(spark):
    docs, items = corpus()
    assert result(spark, [], items) == []
    for none in ([], [(1, None), (2, "--")]):
        assert result(spark, docs[:3], none) == brute_force(docs[:3], none)


def test_long_text_with_every_item(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(300)]
    text = " filler ".join(t for _, t in items) * 20
    row = dc.contamination(*tables(spark, [(1, text)], items)).first()
    assert (row.n_items, row.n_hit) == (300, 300 * 12 * 20 - 19 * 2)  # where the text repeats, the last word of one copy runs into the next


def test_no_python_workers(spark, tmp_path):
    docs, items = corpus()
    d, b = tables(spark, docs, items)
    d.write.parquet(f"{tmp_path}/documents.parquet"), b.write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = dc.op12(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
