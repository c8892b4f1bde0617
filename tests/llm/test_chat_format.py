from lamella.llm.chat_format import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, pos int, h1 string"


def table(spark, turns):
    return spark.createDataFrame([(*t, 9, "clash") for t in turns], SCHEMA)


def conversation(i, texts, start=0):
    return [(i, start + k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def brute(turns):
    talks = {}
    for c, turn, role, text in turns:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    bodies = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in talks.items()}
    keep = {}
    for c in sorted(bodies):
        if not any(len(b) > len(bodies[c]) and b[: len(bodies[c])] == bodies[c] for b in bodies.values()):
            keep.setdefault(bodies[c], []).append(c)
    return {min(own): (len(b), len(own), "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in b)) for b, own in keep.items()}


def test_snapshots_copies_nulls_and_ties(spark):
    long = [f"turn {k}" for k in range(6)]
    turns = conversation(1, long[:2]) + conversation(2, long[:4]) + conversation(3, long) + conversation(4, long) + conversation(5, [*long[:3], "other"])
    turns += [(6, 0, None, None), (7, None, "user", "x"), (7, 1, "assistant", None), (None, 0, "user", "nobody"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, 1, "user", "a")]
    turns += conversation(9, ["has <|im_end|> inside", "y" * 50_000], start=5)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_format(table(spark, turns)).collect()}
    assert got == brute(turns)


def test_empty_table(spark):
    assert chat_format(table(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = chat_format(table(spark, conversation(1, ["a"])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
