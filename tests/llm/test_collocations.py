import random
import re
from collections import Counter, defaultdict

import pytest

from lamella.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n long, h long, phrase string, part string"


def brute_force(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        chosen = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        found = []
        for p, a in chosen.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(k, t, lang, 1, 2, "x", "y") for k, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["one", "Two", "drei", "à", "été", "l'eau", "x-y", "É", "a" * 70, "a" * 69 + "b"]
    fixed = [rng.choices(words, k=4) for _ in range(5)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(12)):
            parts += rng.choice(fixed) if rng.random() < 0.4 else rng.choices(words, weights=[20, 9, 5, 4, 3, 2, 2, 1, 1, 1], k=rng.randrange(1, 4))
            parts.append(rng.choice(["", "", "", ".", ",\n", "! ", ";", "\r", "\v", "\t", "\x1f", "?:"]))
        rows.append((rng.choice([" ", "\t", "  "]).join(parts), rng.choice(["en", "en", "de", "und", None])))
    return rows + [(None, "en"), ("", "fr"), (" .. ", None), ("alone", "fr")] + [rows[0]] * 3


@pytest.mark.parametrize("options", [{"least": 3}, {"least": 30}, {"least": 2, "budget": 4}, {"least": 3, "top": 5}, {"least": 1, "budget": 20}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    assert result(spark, rows, **options) == brute_force(rows, options["least"], options.get("top", 2000))


def test_full_filters(spark, monkeypatch):
    """Filters so full that they pass most keys give the same."""
    monkeypatch.setattr(co, "FILTER_BITS", 1 << 3)
    rows = corpus(9)
    assert result(spark, rows, least=3) == brute_force(rows, 3)


def words_by_rule(text):
    return [(w.lower().encode(), k == 0) for piece in re.split(r"[.,;:!?\x0A-\x0D]", text) for k, w in enumerate(re.findall(r"[^\x20\x09]+", piece))]


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 1 << 20])
def test_words_of_long_texts(monkeypatch, segment):
    import numpy as np

    monkeypatch.setattr(co, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(200):
        texts = ["".join(rng.choice("ab .,\n\t") for _ in range(rng.randrange(25))) for _ in range(3)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        w = co._Words(raw, np.cumsum([0, *map(len, texts)]), 0)
        got = [(raw[a:b].tobytes(), bool(x)) for a, b, x in zip(w.start, w.end, w.begins)]
        assert got == [x for t in texts for x in words_by_rule(t)]
        assert w.row.tolist() == [k for k, t in enumerate(texts) for _ in words_by_rule(t)]
        assert len(set(zip((raw[a:b].tobytes() for a, b in zip(w.start, w.end)), w.key.tolist()))) == len(set(w.key.tolist()))


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", str(rng.randrange(10**6))]) for _ in range(400_000))
    assert result(spark, [(text, "en")], top=100) == brute_force([(text, "en")], 30, 100)
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("", "en")]) == []
