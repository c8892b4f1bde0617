from collections import Counter

from pyspark.sql import Row

import corpus_pipeline
from lamella.llm import registry
from tests.llm.test_mixing_packing import shares
from tests.llm.test_models import corpus
from tests.llm.test_near_dedup import brute_force as near_brute_force


def test_stages_take_effect(spark, tmp_path):
    docs = [(i, t, x, f"s{i % 3}", len(t)) for i, t, x in corpus(150)]
    docs += [(1000, docs[0][1], "aa", "s0", 1), (1001, docs[1][1] + " more", "aa", "s1", 1), (1002, "12 34", None, "s1", 5), (1003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert 1002 not in counts[0] and 1003 not in counts[0] and len(counts[0]) >= 151
    assert 0 not in counts[1] and 1000 in counts[1]
    assert 1001 not in counts[2] and 1 in counts[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in packed.select("doc_id").distinct().collect()).keys() == counts[3]


def test_stages_equal_brute_force(spark, tmp_path):
    """Rows of every stage against plain searches over its own input, with clashing extra columns."""
    docs = [(i, t, x, f"s{i % 3}", len(t), 1, "q") for i, t, x in corpus(60)]
    words = docs[0][1].split()
    docs += [(500, docs[3][1], "aa", "s0", 1, 1, "q"), (500, docs[3][1], "aa", "s0", 1, 1, "q"), (501, " ".join([*words[:-1], "kato"]), "aa", "s1", 1, 1, "q"), (None, docs[4][1], None, None, 1, 1, "q")]
    docs += [(600, "", "aa", "s0", 0, 1, "q"), (601, None, "aa", "s0", None, 1, "q"), (602, "語言識別 測試文字 " * 9, None, "s2", 1, 1, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, score string"
    kept = spark.createDataFrame(docs, schema)
    rows = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    plain = lambda pairs: sorted(str(Row(doc_id=i, text=t)) for i, t in pairs)

    identified = [(i, t) for i, t, *_ in docs if t and i != 602]
    one = corpus_pipeline.identify_languages(spark, kept, str(tmp_path))
    assert rows(one) == plain(identified)

    texts = {}
    for i, t in identified:
        texts.setdefault(t, []).append(i)
    exact = [(max((i for i in ids if i is not None), default=None), t) for t, ids in texts.items()]
    two = corpus_pipeline.drop_copies(spark, one, str(tmp_path))
    assert rows(two) == plain(exact)

    component = near_brute_force(exact)
    near = [(i, t) for i, t in exact if component[i][1] == i]
    three = corpus_pipeline.drop_near(spark, two, str(tmp_path))
    assert rows(three) == plain(near) and len(near) == len(exact) - 1

    four = corpus_pipeline.mix_sources(spark, three, str(tmp_path))
    assert four.columns == kept.columns
    source, size, taken = {r.doc_id: r.source for r in three.collect()}, Counter(), Counter()
    for i, t in near:
        size[source[i]] += len(t.split())
    for r in four.collect():
        taken[r.source] += len(r.text.split())
    for s, target in shares(dict(size)).items():
        assert abs(taken[s] - target) <= 45  # half the longest document
    packed = corpus_pipeline.pack(spark, four, str(tmp_path)).collect()
    assert sum(r.n_words for r in packed) == sum(taken.values())


def test_every_operator_has_its_query():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
