"""op3 on whole licence texts, alone and inside longer documents."""

import textwrap

import pytest

from lamella.llm import license_scan as ls


@pytest.fixture(scope="module")
def known():
    return dict(reversed(ls.texts()))  # the first form of each


def test_whole_texts_are_found_alone_titled_and_inside(spark, known):
    gpl, apache, bsd = known["GPL-3.0"], known["Apache-2.0"], known["BSD-3-Clause"]
    comment = "\n".join(f" * {line}" for line in textwrap.wrap(bsd, 60))
    texts = [
        (1, f"MIT License\n\nCopyright (c) 2020 Someone\n\n{ls._MIT}"),
        (2, gpl),
        (3, f"Some words before.\n\n{apache}\n\nSome words after."),
        (4, f"/*\n{comment}\n */\nint main;\nReleased under the MIT License."),
        (5, f"{ls._ISC}\n\n{ls._ISC_END}"),
        (6, apache[: len(apache) // 3]),
        (7, f"{ls._ISC}\nmore"),
    ]
    got = {r[0]: tuple(r)[1:] for r in ls.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {
        1: ("MIT", 1, True), 2: ("GPL-3.0", 1, True), 3: ("Apache-2.0", 1, False), 4: ("BSD-3-Clause,MIT", 2, False),
        5: ("ISC", 2, True), 7: ("ISC", 1, False),
    }


def test_notices_and_broken_lines_are_found(spark, known):
    """An MIT text wrapped so that a line begins with COPYRIGHT HOLDERS, notices in comments, and lines that are no notice."""
    mit = ls._MIT.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    notice = next(t for i, _, t in ls.SHORT if i == "Apache-2.0")
    gpl = next(t for i, _, t in ls.SHORT if i == "GPL-3.0-or-later")
    comment = "\n".join(f"# {line}" for line in textwrap.wrap(notice, 70))
    texts = [
        (1, f"The MIT License (MIT)\n\nCopyright (c) 2019-2021 A. B.\nCopyright © Someone\n\n{mit}"), (2, f"#!/bin/sh\n# Copyright 2020 Someone\n{comment}\necho"),
        (3, f"prose before {gpl} and after"), (4, known["Unlicense"]), (5, "Copyright holders of great works met in town.\nAll agreed."), (6, "Copyright 2021 Someone"),
    ]
    got = {r[0]: (r[1], r[3]) for r in ls.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", True), 2: ("Apache-2.0", False), 3: ("GPL-3.0-or-later", False), 4: ("Unlicense", True)}


def test_a_list_too_long_for_tasks_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ls, "LONG_BYTES", 1000)
    with pytest.raises(ValueError, match="every task holds them"):
        ls.license_scan(spark.createDataFrame([(1, "MIT")], "doc_id long, text string"))


def test_nulls_empty_table_and_long_text(spark, known):
    schema = "doc_id long, text string, licenses string, digest string, c long"
    assert ls.license_scan(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(None, known["MIT"] if "MIT" in known else ls._MIT, "x", "y", 1), (1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, f"{long}\n{known['Apache-2.0']}\n{long}", "x", "y", 1)]
    got = {r.doc_id: (r.licenses, r.whole_text) for r in ls.license_scan(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: ("MIT", True), 3: ("Apache-2.0", False)}
