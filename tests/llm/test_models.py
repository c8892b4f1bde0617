import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lamella.llm import language_id as li
from lamella.llm import lm_score as lm
from lamella.llm._words import SEGMENT, word_hashes

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["ka", "to", "mi", "su"], "bb": ["zer", "glo", "pra", "uth"], "cc": ["ñé", "ço", "èl", "ab"]}


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        docs.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80))).capitalize(), lang))
    return docs


def table(spark, docs):
    return spark.createDataFrame([(i, t, x, "clash") for i, t, x in docs], SCHEMA)


def test_language_held_out_accuracy_and_rejection(spark):
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", None), (904, "kato misu " * 30_000, "aa"), (905, "kato", None), (None, "kato misu", None)]
    alien = {910 + k: "qjx wvy hjq xwq vvy qqj xxj wyw " * n for k, n in enumerate((1, 3, 20))} | {920: "語言識別 測試文字 " * 5, 921: "\U00030000\U00030001 " * 20}
    docs = corpus() + odd + [(i, t, None) for i, t in alien.items()]
    rows = {r.doc_id: r for r in li.language_id(table(spark, docs)).collect()}
    assert len(rows) == len(docs)
    held = [d for d in corpus() if rows[d[0]].held_out]
    assert {i for i, _, _ in corpus() if rows[i].held_out} == {i for i, _, _ in corpus() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(rows[i].lang_pred == x for i, _, x in held) >= 0.98 * len(held) > 0
    assert not any(rows[i].rejected for i, _, _ in corpus())
    assert [rows[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(rows[i].rejected and rows[i].lang_pred != "und" for i in alien), [(i, rows[i]) for i in alien]
    assert rows[904].lang_pred == "aa" and not rows[904].rejected and rows[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_without_labels_or_rows(spark):
    assert li.language_id(table(spark, [])).count() == 0
    assert [r.lang_pred for r in li.language_id(table(spark, [(1, "some text", None)])).collect()] == ["und"]


def test_languages_in_several_passes(spark, monkeypatch):
    docs = corpus(120)
    one = {r.doc_id: tuple(r)[:4] for r in li.language_id(table(spark, docs)).collect()}
    monkeypatch.setattr(li, "LANGS_AT_ONCE", 2)
    several = {r.doc_id: tuple(r)[:4] for r in li.language_id(table(spark, docs)).collect()}
    assert {i: r[:3] for i, r in one.items()} == {i: r[:3] for i, r in several.items()}
    assert all(abs(one[i][3] - several[i][3]) < 1e-6 for i in one)


def test_long_labelled_texts_are_learned(spark):
    long = [(i, " ".join(["gulo", "pato"] * 6000), "dd") for i in range(3000, 3012)]
    rows = {r.doc_id: r for r in li.language_id(table(spark, corpus(100) + long)).collect()}
    assert all(rows[i].lang_pred == "dd" for i, _, _ in long)


def test_identified_rows_keep_clashing_columns(spark):
    docs = corpus(80) + [(500, None, "aa"), (None, "kato misu kato", None)]
    df = spark.createDataFrame([(i, t, x, 1.5, False, "q", "r") for i, t, x in docs], "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string, _text string")
    kept = li.keep_identified(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.doc_id != 500)


def symbols_of(text):
    """Letters and single spaces of a text, framed by spaces, in plain Python."""
    return [0, *(ord(c) if c.isalpha() else 0 for c in re.sub(r"[\W\d_]+", " ", text.lower()).strip()), 0]


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts, d=0.75):
        self.d, self.tri = d, Counter()
        for t in texts:
            s = symbols_of(t)
            self.tri.update(zip(s, s[1:], s[2:]))
        self.bi = Counter((b, c) for _, b, c in self.tri)
        self.uni = Counter(c for _, c in self.bi)

    def level(self, counts, history, symbol, low):
        own = {k: n for k, n in counts.items() if (k[:-1] if isinstance(k, tuple) else ()) == history}
        if not own:
            return low
        total = sum(own.values())
        n = own.get((*history, symbol) if history else symbol, 0)
        return max(n - self.d, 0) / total + self.d * len(own) / total * low

    def bits(self, a, b, c):
        low = self.level(self.uni, (), c, 1 / 0x110000)
        return -math.log2(self.level(self.tri, (a, b), c, self.level(self.bi, (b,), c, low)))


def test_models_equal_plain_kneser_ney():
    texts = [t for _, t, x in corpus(30) if x == "cc"][:6]
    plain = PlainKneserNey(texts)
    letters = li._letters()
    code, n = np.unique(np.concatenate([c for t in texts for c in li._trigrams(t, letters)]), return_counts=True)
    scorer = li._Scorer([li.LanguageModel.fit(code, n)])
    for text in (texts[0], "ñéço unseen 12 words, ß"):
        s = symbols_of(text)
        want = [plain.bits(*x) for x in zip(s, s[1:], s[2:])]
        for _ in range(2):  # computed, then remembered
            got = np.concatenate([b[:, 0] for b in scorer.pieces(text)])
            assert np.allclose(got, want, rtol=1e-5)


def test_kneser_ney_sums_to_one():
    code = lambda a, b, c: (a << 42) | (b << 21) | c
    codes = np.array([code(1, 1, 3), code(1, 3, 4), code(3, 4, 3)], np.uint64)
    model = li.LanguageModel.fit(codes, np.array([5, 3, 2]))
    for a, b in ((1, 1), (3, 4), (9, 9)):
        every = np.arange(0x110000, dtype=np.uint64) | np.uint64(code(a, b, 0))
        assert abs(np.exp2(-model.bits(every)).sum() - 1) < 1e-6


def test_chunks_of_a_text_are_seamless(monkeypatch):
    letters, text = li._letters(), "Some words, 12 and more -- of them  all"
    whole = np.concatenate(list(li._trigrams(text, letters)))
    monkeypatch.setattr(li, "CHUNK", 5)
    assert np.array_equal(np.concatenate(list(li._trigrams(text, letters))), whole)
    assert len(whole) == len(symbols_of(text)) - 2 and not list(li._trigrams("12 ,", letters))


def test_words_equal_regex():
    import pyarrow as pa

    texts = ["One  two\tTHREE", None, "", " \n", "é É ß", "x" * (SEGMENT + 10) + " tail", "w " * SEGMENT]
    seen = {}
    for first, end, words, offsets in word_hashes(pa.array(texts)):
        for i in range(first, end):
            own = words[offsets[i - first] : offsets[i - first + 1]].tolist()
            expected = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
            assert len(own) == len(expected)
            for h, w in zip(own, expected):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lm_base_is_exact_and_the_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 60)  # so that some tokens are rare
    docs = corpus() + [(900, None, None), (901, "", None), (902, "NEVER seen-before words", None), (5, "kato", "aa")]
    got = sorted(((r.doc_id, r) for r in lm.lm_score(table(spark, docs)).collect()), key=lambda x: (x[0], x[1].n_tokens))
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t, _ in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    gain = 0.0
    for (i, ws), (j, r) in zip(sorted(tokens, key=lambda x: (x[0], len(x[1]))), got):
        assert (i, len(ws), held(i), n) == (j, r.n_tokens, r.held_out, r.train_tokens)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        gain += (r.score - r.base_score) * held(i)
        assert r.score < 0
    assert gain > 0


def test_lm_scores_equal_plain_sums(spark, monkeypatch):
    """The model's probabilities sum to one for every history, and scores are the plain sums of their logarithms."""
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    docs = [d for d in corpus(80)] + [(900, "", None), (901, "ka zzz ka", None)]
    kept = {}
    score = lm._score
    monkeypatch.setattr(lm, "_score", lambda model: kept.setdefault("model", model) and score(model))
    got = {r.doc_id: r.score for r in lm.lm_score(table(spark, docs)).collect()}
    m = kept["model"]
    v, by_class = m.vocabulary, np.concatenate([lm._log_softmax(m.weights, h) for h in np.array_split(np.arange(lm.N_HISTORY * lm.N_BEFORE), 8)])
    place = {int(k): i for i, k in enumerate(v.keys.tolist())}
    size = [sum(v.counts[v.classes == c]) for c in range(lm.N_CLASSES)]

    def inside(before, i):
        c = v.classes[i]
        return math.log(v.counts[i] / size[c]) + float(m.theta[before, i]) - m.norm[before, c]

    for before in range(lm.N_BEFORE):
        for c in range(lm.N_CLASSES):
            own = [i for i in range(len(v.keys)) if v.classes[i] == c]
            assert not own or math.isclose(sum(math.exp(inside(before, i)) for i in own), 1.0, rel_tol=1e-5)
    counts = Counter()
    tokens = {i: [int(h) for _, _, w, _ in word_hashes(pa.array([t])) for h in w] + [lm.END] for i, t, _ in docs}
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(ts)
    rare = math.log(m.rare_tokens + m.rare_distinct + 1)
    for i, ts in tokens.items():
        total, last, before_last = 0.0, (lm.DIRECT + v.BEGIN, v.BEGIN), v.BEGIN
        for t in ts:
            at = place.get(t)
            c = v.RARE if at is None else v.classes[at]
            total += by_class[last[0] * lm.N_BEFORE + before_last, c] + (math.log(counts[t] + 1) - rare if at is None else inside(last[1], at))
            before_last = last[1]
            last = (lm.DIRECT + v.RARE if at is None else v.rank[at] if v.rank[at] < lm.DIRECT else lm.DIRECT + c), c
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-6, abs_tol=1e-6), i


def test_lm_pairs_of_rare_tokens_count(spark, monkeypatch):
    """Rare tokens are tilted by all their pairs with the class before them; after every class the rare and the unknown token sum to one."""
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    docs = [d for d in corpus(80)] + [(900, "", None), (901, "ka zzz ka zzz", None), (902, None, None)]
    plain = {r.doc_id: r for r in lm.lm_score(table(spark, docs)).collect()}
    kept, score, weights = {}, lm._score, lm._rare_weights
    monkeypatch.setattr(lm, "_score", lambda model: kept.setdefault("model", model) and score(model))
    monkeypatch.setattr(lm, "_rare_weights", lambda *a: kept.setdefault("weights", weights(*a)))
    got = {r.doc_id: r for r in lm.lm_score(table(spark, docs), rare_pairs=True).collect()}
    m, (gain, norm) = kept["model"], kept["weights"]
    v, place = m.vocabulary, {int(k): i for i, k in enumerate(m.vocabulary.keys.tolist())}
    counts, pairs, asked = Counter(), Counter(), {}
    for i, t, _ in docs:
        ts, before, asked[i] = [int(h) for _, _, w, _ in word_hashes(pa.array([t])) for h in w] + [lm.END], v.BEGIN, []
        for t in ts:
            if t not in place:
                asked[i].append((before, t))
                if zlib.crc32(str(i).encode()) % 7 != 2:
                    counts[t] += 1
                    pairs[before, t] += 1
            before = v.RARE if t not in place else v.classes[place[t]]
    whole = m.rare_tokens + m.rare_distinct + 1
    assert sum(counts.values()) == m.rare_tokens and (gain > 0).any()
    share = lambda b, t: (counts[t] + 1 + gain[b] * pairs[b, t]) / whole / 10 ** norm[b]
    for b in range(lm.N_BEFORE):
        assert math.isclose(sum(share(b, t) for t in counts) + 1 / whole / 10 ** norm[b], 1.0, rel_tol=1e-9)
    for i, own in asked.items():
        change = sum(math.log10(share(b, t)) - math.log10((counts[t] + 1) / whole) for b, t in own)
        assert math.isclose(got[i].score, plain[i].score + change, rel_tol=1e-6, abs_tol=1e-6), i
        assert math.isclose(got[i].base_score, plain[i].base_score, rel_tol=1e-9, abs_tol=1e-9) and got[i].n_known == plain[i].n_known
    held = [i for i in got if got[i].held_out and i < 900]
    assert sum(got[i].score - plain[i].score for i in held) > 0


def test_lm_class_model_is_a_distribution():
    rng = np.random.RandomState(0)
    weights = rng.normal(size=(lm.FEATURES, lm.N_CLASSES))
    p = np.exp(lm._log_softmax(weights, np.arange(200)))
    assert np.allclose(p.sum(axis=1), 1)


def test_lm_empty_tables(spark):
    assert lm.lm_score(table(spark, [])).count() == 0


def test_lm_empty_tables_with_rare_pairs(spark):
    assert lm.lm_score(table(spark, []), rare_pairs=True).count() == 0
