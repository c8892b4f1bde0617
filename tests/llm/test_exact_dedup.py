import hashlib

from lamella.llm.exact_dedup import drop_exact_copies, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _sha string, group_size int"


def rows(docs):
    return [(i, t, "clash", "x", 0) for i, t in docs]


def expected(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in docs:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    docs = [(i, f"text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (102, "é" * 5000), (103, "é" * 5000), (104, " "), (None, "text 1"), (5, "text 5")]
    df = spark.createDataFrame(rows(docs), SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in exact_dedup(df, salts=3).collect()), key=str)
    assert got == expected(docs)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_rows_have_all_columns(spark):
    df = spark.createDataFrame(rows([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")]), SCHEMA)
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]


def test_one_row_a_text_stays(spark):
    """Rows written twice and equal texts without ids leave one row each."""
    docs = [(3, "a", "x", "", 1), (3, "a", "x", "", 1), (3, "a", "y", "", 1), (None, "b", "x", "", 1), (None, "b", "x", "", 2), (None, None, "", "", 1), (None, "", "", "", 1), (4, "c", "", "", 0)]
    kept = drop_exact_copies(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert sorted((r.text or "") for r in kept.collect()) == ["", "a", "b", "c"]
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 1, 3)], "doc_id long, text string, _row int, keep_id int")
    assert [tuple(r) for r in drop_exact_copies(clash).collect()] == [(2, "a", 1, 3)]


def test_plan_is_native(spark):
    df = spark.createDataFrame(rows([(1, "a")]), SCHEMA)
    for out in (exact_dedup(df), drop_exact_copies(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    plan = exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
