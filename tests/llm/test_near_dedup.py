import random
import re
from collections import Counter, defaultdict

import numpy as np

from lamella.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, n long, sig string"


def brute_force(docs):
    """Shingle count and component of every document by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    shared = Counter((a, b) for own in lists.values() for a in own for b in own if a < b)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "extra") for i, t in docs], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(df).collect()}


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def corpus():
    """A large group of near copies of all degrees, common passages, short and empty texts, exact copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    seed = [word() for _ in range(150)]
    passage = " ".join(word() for _ in range(40))
    docs = [(i, edited(rng, seed, rng.choice([0.0, 0.01, 0.02, 0.04, 0.07]))) for i in range(120)]
    docs += [(1000 + i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(60)]
    docs += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three four five")]
    docs += [(3000 + i, "the very same text of seven words") for i in range(20)]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    assert result(spark, docs) == brute_force(docs)


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHORT", 2)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    docs = corpus()
    assert result(spark, docs) == brute_force(docs)


def test_empty_table_and_null_ids(spark):
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    same, alone = "a b c d e f", "u v w x y z"
    df = spark.createDataFrame([(None, same, 1, ""), (4, same, 1, ""), (4, same, 1, ""), (None, alone, 1, ""), (None, alone, 1, ""), (None, None, 1, "")], SCHEMA)
    rows = sorted(nd.near_dedup(df).collect(), key=lambda r: (r.doc_id or 0, r.component_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(None, None, True)] * 3 + [(None, 4, False), (4, 4, True), (4, 4, True)]


CLASHING = "doc_id long, text string, n long, sig string, _dropped long, _row int, id long, first string"


def test_kept_rows_are_one_a_group_with_all_columns(spark):
    """A stage keeps one row of each group: of rows written twice, of ids repeated with other texts, of rows without ids."""
    base = [f"w{k}" for k in range(40)]
    near, other = " ".join(base), " ".join([*base[:39], "else"])
    docs = [(5, near), (5, near), (5, other), (7, other), (None, near), (None, "p q r s t u"), (None, "p q r s t u"), (9, None), (9, ""), (None, ""), (8, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "s", 2, 3, 4, "f") for i, t in docs], CLASHING)
    kept = nd.drop_near_copies(df)
    assert kept.columns == df.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [r[1] for r in rows if r[0] == 5] in ([near], [other])
    assert [r for r in rows if r[0] != 5] == sorted([(None, "p q r s t u"), (9, None), (9, ""), (None, ""), (8, "w " * 30_000)], key=str)
    assert nd.drop_near_copies(df.limit(0)).count() == 0


def test_an_id_repeated_with_other_texts_links_by_its_texts(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in nd.near_dedup(spark.createDataFrame([(3, one, 1, ""), (3, two, 1, ""), (6, two, 1, ""), (2, one, 1, "")], SCHEMA)).collect())
    assert got == [(2, 2, 26), (3, 2, 26), (3, 3, 26), (6, 3, 26)]


def test_equal_digests_of_different_sets_are_drawn_anew(spark, monkeypatch):
    node = nd._node
    monkeypatch.setattr(nd, "_node", lambda s, seed: np.uint64(1) if seed == 0 else node(s, seed))
    docs = [(i, " ".join(f"{i}x{k}" for k in range(20))) for i in range(4)] + [(9, " ".join(f"2x{k}" for k in range(20)))]
    assert result(spark, docs) == brute_force(docs)


def test_most_pairs_at_the_threshold_are_found(spark):
    """Recall on pairs just over the threshold, against brute force."""
    rng = random.Random(11)
    docs = []
    for i in range(150):
        words = [f"{rng.randrange(10**6)}" for _ in range(120)]
        docs += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:104], *(f"z{rng.randrange(10**6)}" for _ in range(16))]))]
    want = brute_force(docs)
    linked = sum(c != i for i, (_, c) in want.items())
    assert linked >= 100 and result(spark, docs) == want
