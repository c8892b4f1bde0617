import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from lamella.llm import mixing as mx
from lamella.llm.mixing import CAP, mix, mixing
from lamella.llm.packing import PER_SOURCE, best_fit, packing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def corpus():
    rng = random.Random(5)
    docs = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 5, 20, 60, 200]))), f"s{min(rng.randrange(9), 5)}") for i in range(400)]
    return docs + [(1000, None, "s0"), (1001, "", None), (1002, "\t one\vtwo ", None), (1003, "a b c " * 3000, "s1"), (1004, "a b c " * 3000, "s1"), (7, "again seven", "s2")]


def table(spark, docs):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in docs], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """Targets by the contract, in fractions: weights 1, 2, 3 by code point, null last; stopped at 3 times the size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(k % 3 + 1) for k, s in enumerate(order)}
    stopped, rest, out = set(), Fraction(sum(sizes.values())), {}
    while True:
        unit = rest / (sum(weight[s] for s in order if s not in stopped) or 1)
        over = {s for s in order if s not in stopped and weight[s] * unit > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in order if s not in stopped}
        stopped |= over
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        rest -= sum(out[s] for s in over)


def test_targets_equal_plain_fractions(spark):
    for sizes in ({"a": 1000, "b": 10, None: 20}, {"B": 5, "a": 7, "é": 9, "z": 4000, None: 3, "ab": 0}, {f"s{k:03d}": (k * 37) % 101 + 1 for k in range(300)}):
        df = spark.createDataFrame(list(sizes.items()), "_source string, words long")
        got = {r["_source"]: r.target for r in mx.targets(df).collect()}
        assert got.keys() == sizes.keys() and all(math.isclose(got[s], float(t), rel_tol=1e-12, abs_tol=1e-9) for s, t in shares(sizes).items())


def check_mix(rows, docs):
    """Sizes, targets and copies against plain counting; returns words taken by source."""
    sizes, taken = Counter(), Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    expected = shares(sizes)
    source = {(i, words(t)): s for i, t, s in docs}
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(i), words(t)) for i, t, _ in docs)
    for r in rows:
        s = source[(r.doc_id, r["size"])]
        assert 0 <= r.taken <= CAP * r["size"] and r.taken == r.copies * r["size"]
        assert r.target == pytest.approx(float(expected[s])) and r.source_size == sizes[s]
        taken[s] += r.taken
    return taken, {s: float(t) for s, t in expected.items()}


def test_mix_meets_its_targets(spark):
    docs = corpus()
    rows = mixing(table(spark, docs)).collect()
    taken, expected = check_mix(rows, docs)
    for s, target in expected.items():
        # Copies are whole: a source with very long documents can miss by half the longest.
        longest = max(words(t) for _, t, x in docs if x == s)
        assert abs(taken[s] - target) <= max(0.02 * target, longest / 2 if longest > 0.1 * target else 12), (s, taken[s], target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing(table(spark, docs).repartition(7)).collect()))


def test_rates_are_exponential_tilts_that_meet_the_targets(spark):
    """The rates meet the token constraint of every source, and log rates are a source's term plus a class's."""
    docs = [d for d in corpus() if words(d[1]) and d[0] < 900 and d[0] != 7]
    rows = mixing(table(spark, docs)).collect()
    source = {i: s for i, _, s in docs}
    words_at, log_rate = Counter(), {}
    for r in rows:
        words_at[source[r.doc_id]] += r.rate * r["size"]
        if r.rate < CAP - 1e-9:
            log_rate[source[r.doc_id], r["size"].bit_length()] = math.log(r.rate)
    for s, target in {source[r.doc_id]: r.target for r in rows}.items():
        assert math.isclose(words_at[s], target, rel_tol=1e-5)
    for (s, c), x in log_rate.items():
        for (t, d), y in log_rate.items():
            if (s, d) in log_rate and (t, c) in log_rate:
                assert math.isclose(x - log_rate[s, d], log_rate[t, c] - y, abs_tol=1e-6)


def test_without_convergence_the_closed_form_is_taken(spark, monkeypatch):
    monkeypatch.setattr(mx, "ITERATIONS", 0)
    docs = [d for d in corpus() if words(d[1]) and d[0] < 900 and d[0] != 7]
    for r in mixing(table(spark, docs)).collect():
        assert math.isclose(r.rate, min(r.target / r.source_size, CAP), rel_tol=1e-9)


def test_many_sources(spark):
    docs = [(i, "w " * (i % 9 + 1), f"s{i % 700}") for i in range(2800)]
    taken, expected = check_mix(mixing(table(spark, docs)).collect(), docs)
    assert abs(sum(taken.values()) - sum(expected.values())) < 0.05 * sum(expected.values())


def test_mix_repeats_rows_and_keeps_clashing_columns(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, s, 9.0, 8, 7.0, 6.0, 5, 4, "x") for i, t, s in docs], "doc_id long, text string, source string, _size double, _bin int, target double, rate double, whole int, cut int, _row string")
    copies = Counter()
    for r in mixing(df).collect():
        copies[r.doc_id] += r.copies
    out = mix(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == +copies
    assert {tuple(r)[3:] for r in rows} == {(9.0, 8, 7.0, 6.0, 5, 4, "x")}


def test_mixing_empty_tables(spark):
    assert mixing(table(spark, [])).count() == 0 and mix(table(spark, [])).count() == 0
    assert [r.taken for r in mixing(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def naive(pieces, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(capacity - sum(p[0] for p in b), k) for k, b in enumerate(bins)]
        fits = [x for x in sorted(fits) if x[0] >= size and all(p[2] != cluster for p in bins[x[1]]) and sum(p[1] == source for p in bins[x[1]]) < per_source]
        if fits:
            k = fits[0][1]
        else:
            bins.append([])
            k = len(bins) - 1
        bins[k].append((size, source, cluster))
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_the_naive_search(seed):
    rng = random.Random(seed)
    pieces = sorted(((rng.randint(1, 100), rng.choice("aaab"), rng.randrange(30)) for _ in range(200)), reverse=True)
    assert [b for b, _ in best_fit(pieces, 100, 2)] == naive(pieces, 100, 2)


def test_packing_holds_every_word_and_keeps_its_rules(spark):
    docs = corpus() + [(7, "again seven", "s2")]
    out = packing(table(spark, docs)).collect()
    assert sum(r.n_words for r in out) == sum(words(t) for _, t, _ in docs)
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    text = {}
    for i, t, s in docs:
        text.setdefault((i, words(t)), (t, s))
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        assert own[-1].bin_start + own[-1].n_words <= 2048
        assert all(a.bin_start + a.n_words == b.bin_start for a, b in zip(own, own[1:]))
        ids = [r.doc_id for r in own]
        assert len(set(ids)) == len(ids)
    assert {r.doc_id for r in out} == {i for i, t, _ in docs if words(t)}


def test_packing_keeps_ids_and_limits(spark):
    """64-bit ids beside a null one come back unchanged; no bin holds two equal texts or more than PER_SOURCE pieces of a source."""
    big = [(2**60 + k, f"w{k} " * (50 + k), "s0") for k in range(40)] + [(None, "w a b", "s1"), (None, "w a b", None)]
    big += [(k, "the same text again", f"s{k % 7}") for k in range(30)] + [(99, "v " * 5000, "s2")]
    out = packing(table(spark, big)).collect()
    assert {r.doc_id for r in out} == {i for i, _, _ in big}
    text = {}
    for i, t, s in big:
        text.setdefault((i, len(t.split()) if i != 99 else None), (t, s))
    bins = defaultdict(list)
    for r in out:
        if r.doc_id is not None and r.doc_id != 99:
            bins[r.bin_id].append(text[(r.doc_id, r.n_words)])
    for own in bins.values():
        assert len({t for t, _ in own}) == len(own)
        assert max(Counter(s for _, s in own).values()) <= PER_SOURCE


def test_packing_empty_table(spark):
    assert packing(table(spark, [])).count() == 0
