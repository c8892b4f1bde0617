"""op10 against an independent search for repeated passages."""

import random

from lamella.llm import line_dedup


def passages(texts):
    """All runs of 50 words that occur more than once in (id, text) pairs."""
    seen, again = set(), set()
    for _, text in texts:
        words = text.split()
        for k in range(len(words) - 49):
            run = tuple(words[k : k + 50])
            (again if run in seen else seen).add(run)
    return again


def cleaned(spark, texts):
    out = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    return {r["doc_id"]: r for r in out}


def test_no_passage_of_fifty_words_stays_twice(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    one_line, two_lines, inner = fresh(60), fresh(30) + "\n" + fresh(40), fresh(55)
    texts = [
        (1, f"{fresh(5)}\n{one_line}\n{fresh(7)}\n{two_lines}\n{fresh(9)}"),
        (2, f"{one_line}\n{fresh(8)} {inner} {fresh(6)}"),
        (3, f"{fresh(3)}\n{two_lines}\n{fresh(4)} {inner}\n{fresh(5)}"),
        (4, fresh(200)),
    ]
    assert passages(texts)
    got = cleaned(spark, texts)
    assert not passages([(i, r["text"]) for i, r in got.items()])
    assert got[1]["text"] == texts[0][1] and got[4]["text"] == texts[3][1]  # first places and unshared text stay
    assert got[2]["text"] == texts[1][1].split("\n")[1] and got[2]["n_removed"] == 1
    lines = texts[2][1].split("\n")
    assert got[3]["text"] == "\n".join([lines[0], " ".join(lines[3].split()[:4]) + " ", lines[4]])


def test_repetition_inside_a_text_keeps_its_first_place(spark):
    got = cleaned(spark, [(1, "same " * 120), (2, "Same " * 49)])
    assert len(got[1]["text"].split()) == 50 and got[2]["text"] == "Same " * 49
    words = " ".join(f"v{k}" for k in range(70))
    out = line_dedup.line_dedup(spark.createDataFrame([(None, f"{words}\n{words}\nend")], "doc_id long, text string")).collect()
    assert out[0]["text"] == f"{words}\nend"


def test_only_rows_with_something_to_drop_go_to_python(spark):
    """One pass takes rows apart, those that were asked for; a row that repeats but its own chunk, or has no id, is among them."""
    rng = random.Random(4)
    own = lambda n: "\n".join(f"line {rng.randrange(10**9)} of a passage of six" for _ in range(n))
    chunk = own(8)
    texts = [(1, f"{chunk}\nmiddle\n{chunk}"), (2, "free\n\ntext\n"), (3, None), (4, ""), (None, f"{own(3)}\nend")]
    df = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: r for r in df.collect()}
    assert {i: r["n_lines"] for i, r in got.items()} == {1: 17, 2: 4, 3: 1, 4: 1, None: 4}
    assert got[1]["n_removed"] > 0 and {i for i, r in got.items() if r["n_removed"]} == {1}
    assert [got[i]["text"] for i in (2, 3, 4, None)] == ["free\n\ntext\n", "", "", texts[4][1]]
