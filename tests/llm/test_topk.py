import math
import random

from lamella.llm import topk
from lamella.llm.topk import integer_vectors, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def score(a, b):
    """Whole numbers without bounds."""
    return sum(x * y for x, y in zip(a, b))


def brute(rows, k, every):
    vectors = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors[i] = max(vectors.get(i, []), [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in e])
    out = set()
    for q, a in vectors.items():
        if q % every == 0:
            scored = sorted((-score(a, b), v) for v, b in vectors.items() if v != q and len(a) == len(b))
            out |= {(q, n + 1, v, max(-(2**63), min(2**63 - 1, -s))) for n, (s, v) in enumerate(scored[:k])}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    eighth = lambda: rng.randrange(-128, 128) / 128  # exact in float
    rows = [(i, [eighth() for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(40)] + [(500 + i, [0.5] * 7 + [0.375]) for i in range(40)]  # a very common vector, and near it
    rows += [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (None, [0.0] * 8), (610, [1.0, 2.0]), (620, [2.0, 1.0]), (10, rows[10][1])]
    df = spark.createDataFrame([(i, e, "clash") for i, e in rows], SCHEMA).repartition(6)
    v = integer_vectors(df)
    got = {tuple(r) for r in top_k(v, v.filter("vec_id % 10 = 0"), 5).collect()}
    assert got == brute(rows, 5, 10)


def run(spark, rows, k, every):
    v = integer_vectors(spark.createDataFrame([(i, e, "clash") for i, e in rows], SCHEMA.replace("float", "double")).repartition(4))
    return {tuple(r) for r in top_k(v, v.filter(f"vec_id % {every} = 0"), k).collect()}


def test_blocks_ties_and_negative_scores(spark, monkeypatch):
    """Many blocks of vectors and queries, ties everywhere, only negative scores, other dimensions."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(3)]) for i in range(200)]
    rows += [(300 + i, [-1.0 - i, 2.0]) for i in range(30)] + [(400 + 4 * i, [float((-1) ** i)]) for i in range(6)] + [(500, []), (504, [])]
    assert run(spark, rows, 3, 4) == brute(rows, 3, 4)


def test_scores_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [-1e12, 1.0]), (4, [1e300, -1e300]), (6, [1.0, 1.0]), (8, [3e7, 3e7])]
    got = run(spark, rows, 5, 2)
    assert got == brute(rows, 5, 2) and (0, 1, 1, 2**63 - 1) in got


def test_scores_near_the_ends_of_a_long_are_exact(spark):
    """Slices whose sums pass 2^61, whole scores just inside and outside a long, and large parts that cancel."""
    rng = random.Random(5)
    rows = [(0, [2.0**23, 0.0]), (1, [2.0**23, 0.0]), (2, [0.75 * 2.0**23, 0.0]), (3, [0.9 * 2.0**23, 0.0]), (5, [0.0, 1.0]), (7, [-(2.0**23), 3.0])]
    assert run(spark, rows, 5, 10) == brute(rows, 5, 10)
    wide = [(i, [rng.choice([-1, 1]) * rng.uniform(0.5, 1) * 2.0 ** rng.choice([20, 23, 24, 40]) for _ in range(6)]) for i in range(120)]
    wide += [(200, [2.0**40, -(2.0**40), 1.0, 2.0**40, -(2.0**40), 1.0]), (201, [2.0**40] * 6), (210, [2.0**40, 2.0**40, 2.0, 2.0**40, 2.0**40, 3.0]), (211, [-(2.0**40)] * 6)]
    assert run(spark, wide, 5, 10) == brute(wide, 5, 10)


def test_an_id_repeated_with_other_vectors_counts_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 3.0]), (1, [1.0, 1.0]), (1, [2.0, -9.0]), (2, [1.0, 1.0])]
    assert run(spark, rows, 5, 2) == brute(rows, 5, 2)


def test_few_candidates_and_empty_tables(spark):
    v = integer_vectors(spark.createDataFrame([(0, [1.0], ""), (1, [-1.0], "")], SCHEMA))
    assert [tuple(r) for r in top_k(v, v.filter("vec_id = 0")).collect()] == [(0, 1, 1, -65536)]
    none = integer_vectors(spark.createDataFrame([], SCHEMA))
    assert top_k(none, none).count() == 0


def nodes(plan, under=()):
    """(name, names above it) of every node of a physical plan."""
    name = plan.nodeName()
    yield name, under
    below = plan.children()
    for child in [plan.initialPlan()] if name == "AdaptiveSparkPlan" else [below.apply(i) for i in range(below.size())]:
        yield from nodes(child, (*under, name))


def test_queries_are_copied_to_slabs_and_never_broadcast(spark, monkeypatch):
    """However many blocks there are: copies of queries for each of them went through the driver, 2 GB of them at 600,000 vectors."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 128)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk, "SLABS", 3, raising=False)
    monkeypatch.setattr(topk, "GATHERED", 2, raising=False)
    plans, durable = [], topk.durable
    monkeypatch.setattr(topk, "durable", lambda df: plans.append(list(nodes(df._jdf.queryExecution().executedPlan()))) or durable(df))
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-128, 128) / 128 for _ in range(8)]) for i in range(1500)] + [(2000 + i, [rng.randrange(-4, 4) / 4.0]) for i in range(60)]
    assert run(spark, rows, 3, 30) == brute(rows, 3, 30)
    assert any(name == "Generate" for plan in plans for name, _ in plan)
    assert not [under for plan in plans for name, under in plan if name == "Generate" and "BroadcastExchange" in under]
