import hashlib
import random
import re
import zlib

import pytest

from lamella.llm import periodic_runs as pr


def brute_force(words, least=12):
    """Runs by trying every period: stretches of equal words q apart, of which the smallest period of each stretch counts."""
    n, spans = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                spans.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in spans.items())


def rewritten(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def expected(i, text):
    words = rewritten(i, text)
    runs = brute_force(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = [rng.randrange(rng.choice([1, 2, 2, 3])) for _ in range(rng.randrange(60))]
        assert pr.runs_of(words) == brute_force(words, 2)


def texts(rng):
    """Periodic parts inside random words, nested and overlapping ones, lines that repeat far apart, single words."""
    word = lambda k: "".join(rng.choice("abcdéf") for _ in range(k))
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(6)):
            root = [word(2) for _ in range(rng.randrange(1, 9))]
            kind = rng.randrange(4)
            if kind == 0:
                parts += root * rng.randrange(2, 7) + root[: rng.randrange(len(root))]
            elif kind == 1:
                parts += (root * 3 + [word(4)]) * rng.randrange(2, 4)
            elif kind == 2:
                parts += ["The", "same", "six", "words", "again", "here", word(5)]
            else:
                parts += [word(6) for _ in range(rng.randrange(30))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    return out


def query(spark, tmp_path, rows, schema="doc_id long, text string, lang string, id string, runs long"):
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], schema).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return pr.op11(spark, path)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    rows += [(100 + k, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 80)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a"), (1004, "a " * 11), (1005, "a " * 12), (1006, "A a " * 12), (None, "x y " * 9), (None, None)]
    chosen = [k for k in range(2000, 2400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows += list(zip(chosen, [None, "", "one", "one two", *texts(rng)]))
    rows += [(7, rows[7][1])]  # a row written twice
    got = sorted(map(tuple, query(spark, tmp_path, rows).collect()), key=str)
    assert got == sorted([(i, *expected(i, t)) for i, t in rows], key=str)


def test_long_text_and_empty_table(spark, tmp_path):
    rng = random.Random(1)
    root = [str(rng.randrange(10**9)) for _ in range(20_000)]
    text = " ".join(root * 3 + [str(rng.randrange(10**9)) for _ in range(150_000)] + ["z"] * 30_000)
    found = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in found.runs] == [(0, 60_000, 20_000), (210_000, 30_000, 1)] and found.n_words == 240_000
    assert len(found.collapsed.split()) == 20_000 + 150_000 + 1
    assert query(spark, tmp_path, []).count() == 0
