"""Language identification with interpolated Kneser-Ney character trigram models.

Fitting takes about ``SAMPLE_PER_LANG`` labelled rows per language, whole texts of any length,
chosen by id hash; trigrams are counted in Spark. One model per language is kept as sorted
hash arrays of n-grams with their interpolated probabilities. The alphabet is open: every
letter is a symbol of its own. A model's size follows the distinct n-grams of its sample, so
it travels with the scoring tasks; languages beyond ``LANGS_AT_ONCE`` are scored in further passes.

Scoring reads every whole text. A worker looks an n-gram up in the sorted arrays when it
meets it and remembers its scores in a table of fixed size.

Rejection is calibrated on texts that the counts leave out: windows of 2^k symbols of some of them give
mean and deviation of the cross-entropy by length for each language. The limit is the
quantile of the standardised values of ``CALIBRATION_PER_LANG`` whole texts, by order, so that a further text of the
language lies over it with a chance of ``FALSE_REJECT``; fewer texts than that takes are extrapolated by their tail.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, durable, positional, read

SAMPLE_PER_LANG = 400
LANGS_AT_ONCE = 64
DISCOUNT = 0.75
COUNTED_SHARE = 0.75  # of the sample; where labels are few, the rest calibrates
CALIBRATION_PER_LANG = 4000  # whole texts a language that set the limits
WINDOWED_PER_LANG = 100  # of these, as many are cut into windows
FALSE_REJECT = 5e-4  # share of a language's own texts that the limits may reject
TAIL = 0.1  # share of the standardised values that an extrapolation rests on
WINDOWS = range(3, 13)  # lengths 2^k at which the cross-entropy's spread is measured
TEMPERATURE = 8.0

_SPACE = 0  # anything that is no letter
_POINTS = 0x110000
CHUNK = 1 << 18
CACHE = 1 << 18


def _letters() -> np.ndarray:
    """Symbol of every code point: itself if it is a letter, else a space."""
    table = np.arange(_POINTS, dtype=np.uint64)
    table[[i for i in range(_POINTS) if not chr(i).isalpha()]] = _SPACE
    return table


def _symbols(text: str, letters: np.ndarray):
    """Symbols of a text, a CHUNK at a time, with runs of non-letters as one space, framed by spaces."""
    yield np.zeros(1, np.uint64)
    last = _SPACE
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = letters[points]
        keep = np.ones(len(symbols), bool)
        keep[0] = symbols[0] != _SPACE or last != _SPACE
        keep[1:] = (symbols[1:] != _SPACE) | (symbols[:-1] != _SPACE)
        last = symbols[-1]
        yield symbols[keep]
    if last != _SPACE:
        yield np.zeros(1, np.uint64)


_SYMBOL, _PAIR = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)
_ONE, _TWO = np.uint64(21), np.uint64(42)


def _trigrams(text: str, letters: np.ndarray):
    """Three code points of 21 bits in one integer, for every place of the text; none if it has no letter."""
    held = np.zeros(0, np.uint64)
    for symbols in _symbols(text, letters):
        held = np.concatenate([held, symbols])
        if len(held) >= CHUNK:
            yield (held[:-2] << _TWO) | (held[1:-1] << _ONE) | held[2:]
            held = held[-2:]
    if len(held) > 2:
        yield (held[:-2] << _TWO) | (held[1:-1] << _ONE) | held[2:]


@dataclass
class LanguageModel:
    """Sorted trigram, bigram and unigram codes with Kneser-Ney terms."""

    tri: np.ndarray
    tri_top: np.ndarray  # max(count - D, 0) / count of the context
    context: np.ndarray  # bigram contexts
    context_left: np.ndarray  # D * types / count
    bi: np.ndarray
    bi_top: np.ndarray  # from continuation counts
    middle: np.ndarray
    middle_left: np.ndarray
    uni: np.ndarray
    uni_top: np.ndarray  # from continuation counts
    base: float  # probability of any one code point, met or not

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> LanguageModel:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        context, start = np.unique(codes >> _ONE, return_index=True)
        total, types = np.add.reduceat(counts, start), np.diff(np.append(start, len(codes)))
        at = np.searchsorted(context, codes >> _ONE)
        bi, cont = np.unique(codes & _PAIR, return_counts=True)  # distinct left neighbours
        middle, start2 = np.unique(bi >> _ONE, return_index=True)
        total2, types2 = np.add.reduceat(cont.astype(float), start2), np.diff(np.append(start2, len(bi)))
        at2 = np.searchsorted(middle, bi >> _ONE)
        uni, cont1 = np.unique(bi & _SYMBOL, return_counts=True)
        n1 = float(cont1.sum())
        return cls(
            codes, np.maximum(counts - DISCOUNT, 0) / total[at], context, DISCOUNT * types / total,
            bi, np.maximum(cont - DISCOUNT, 0) / total2[at2], middle, DISCOUNT * types2 / total2,
            uni, np.maximum(cont1 - DISCOUNT, 0) / n1, DISCOUNT * len(uni) / n1 / _POINTS,
        )

    @staticmethod
    def _find(keys, values, wanted, default):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the interpolated probability of each trigram's last symbol."""
        low = self._find(self.uni, self.uni_top, codes & _SYMBOL, 0.0) + self.base
        low = self._find(self.bi, self.bi_top, codes & _PAIR, 0.0) + self._find(self.middle, self.middle_left, (codes >> _ONE) & _SYMBOL, 1.0) * low
        top = self._find(self.tri, self.tri_top, codes, 0.0)
        return -np.log2(top + self._find(self.context, self.context_left, codes >> _ONE, 1.0) * low)


@dataclass
class Identifier:
    """Models of some languages and their calibrated limits: mean and deviation of the bits by log2 of the length."""

    langs: list[str]
    models: list[LanguageModel]
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    quantile: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def excess(self, k: int, bits: float, n: int) -> float:
        """How many of language k's limits the bits of a text of n symbols amount to: over 1 is rejected."""
        at = np.clip(np.log2(max(n, 1)), WINDOWS[0], WINDOWS[-1])
        mean, spread = np.interp(at, WINDOWS, self.mean[k]), np.interp(at, WINDOWS, self.spread[k])
        return float((bits - mean) / spread / self.quantile[k])


class _Scorer:
    """A worker's view of the models: scores by trigram, remembered in CACHE places."""

    def __init__(self, models: list[LanguageModel]):
        self.models, self.letters = models, _letters()
        self.keys = np.full(CACHE, np.iinfo(np.uint64).max, np.uint64)
        self.bits = np.zeros((CACHE, len(models)), np.float32)

    def trigram_bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each trigram (rows) in each language."""
        at = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        out = self.bits[at]
        missed = np.flatnonzero(self.keys[at] != codes)
        if len(missed):
            new, where = np.unique(codes[missed], return_inverse=True)
            bits = np.column_stack([m.bits(new) for m in self.models]).astype(np.float32)
            out[missed] = bits[where]
            place = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
            self.keys[place], self.bits[place] = new, bits  # of those with one place, numpy keeps the last in both
        return out

    def pieces(self, text: str):
        """Bits by trigram and language, a part of the text at a time."""
        for codes in _trigrams(text, self.letters):
            yield self.trigram_bits(codes)

    def entropies(self, text: str) -> tuple[int, np.ndarray]:
        """Symbols read, and the cross-entropy in bits a symbol for each language."""
        sums, n = np.zeros(len(self.models)), 0
        for bits in self.pieces(text):
            sums += bits.sum(axis=0, dtype=np.float64)
            n += len(bits)
        return n, sums / max(n, 1)


def _sample(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Whole texts of each language in ``counts``, by id hash: a filter, no shuffle of texts.

    About COUNTED_SHARE of SAMPLE_PER_LANG are counted, CALIBRATION_PER_LANG others calibrate, the first WINDOWED_PER_LANG of them by windows, too.
    """
    place = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1_000_000_007)) / 1_000_000_007.0
    share = lambda extra: F.try_element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, COUNTED_SHARE * min(1.0, SAMPLE_PER_LANG / n) + extra / n)]), F.col("lang"))
    near = rows.withColumn("_place", place).filter(F.col("_place") < share(CALIBRATION_PER_LANG))
    return durable(near.select("lang", "text", (F.col("_place") >= share(0)).alias("calibrates"), (F.col("_place") < share(WINDOWED_PER_LANG)).alias("windowed")))


def _count_trigrams(batches):
    letters = _letters()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            own = [codes for t, x in zip(texts, langs) if x == lang for codes in _trigrams(t, letters)]
            code, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def fit(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> list[Identifier]:
    """Models and rejection limits from a bounded sample of the labelled rows of ``df``, LANGS_AT_ONCE languages each.

    The sample's texts are collected as trigram counts only; the limits come from the
    cross-entropies of sample rows that the counts leave out.
    """
    bounded_batches(df.sparkSession)
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    labels = durable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    out, last = [], None
    while True:
        page = (labels if last is None else labels.filter(F.col("lang") > last)).orderBy("lang").limit(LANGS_AT_ONCE).collect()
        if not page:
            return out
        last = page[-1]["lang"]
        sample = _sample(rows, {r["lang"]: r["rows"] for r in page})
        counted = sample.filter("NOT calibrates").select("lang", "text").mapInArrow(_count_trigrams, "lang string, code long, n long")
        table = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
        if not len(table):
            continue
        own = sorted(table.groupby("lang"), key=lambda x: x[0])
        model = Identifier([lang for lang, _ in own], [LanguageModel.fit(part["code"].to_numpy().view(np.uint64), part["n"].to_numpy()) for _, part in own])
        rest = sample.filter(F.col("calibrates") & F.col("lang").isin(model.langs)).select("lang", "text", "windowed")
        _limits(model, rest.mapInArrow(_calibration(model), "lang string, k int, bits array<double>"))
        out.append(model)


def _calibration(model):
    """Cross-entropies of the windows of 2^k symbols of each windowed text; cross-entropy and length of each whole text (k = 0)."""

    def run(batches):
        scorer = _Scorer(model.models)
        for batch in batches:
            langs, ks, bits = [], [], []
            for lang, text, windowed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                j = model.langs.index(lang)
                n, whole = scorer.entropies(text)
                if n:
                    langs.append(lang), ks.append(0), bits.append([float(whole[j]), float(n)])
                if not windowed:
                    continue
                total = np.append(0, np.cumsum(np.concatenate([np.zeros(0), *(b[:, j].astype(float) for b in scorer.pieces(text))])))
                for k in WINDOWS:
                    ends = np.arange(1 << k, len(total), 1 << k)
                    langs.append(lang), ks.append(k), bits.append((total[ends] - total[ends - (1 << k)]) / (1 << k))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ks, pa.int32()), pa.array(bits, pa.list_(pa.float64()))], ["lang", "k", "bits"])

    return run


def _limits(model: Identifier, seen: DataFrame) -> None:
    """Fill the limits of a model from windows of the calibration texts.

    Lengths without enough windows take the deviation of the longest one that has them,
    which is on the safe side: deviations fall with the length.
    """
    seen = durable(seen)
    windows = seen.filter("k > 0").select("lang", "k", F.explode("bits").alias("bits"))
    moments = {(r["lang"], r["k"]): r for r in windows.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("sd")).collect()}
    size = len(model.langs), len(WINDOWS)
    model.mean, model.spread = np.full(size, 4.0), np.full(size, 2.0)
    for i, lang in enumerate(model.langs):
        for j, k in enumerate(WINDOWS):
            r = moments.get((lang, k))
            if r is not None and r["n"] >= 20:
                model.mean[i, j], model.spread[i, j] = r["mean"], max(r["sd"], 0.02)
            elif j:
                model.mean[i, j], model.spread[i, j] = model.mean[i, j - 1], model.spread[i, j - 1]
    model.quantile = np.ones(len(model.langs))
    own: dict[str, list[float]] = {lang: [] for lang in model.langs}
    for r in seen.filter("k = 0").select("lang", "bits").collect():  # CALIBRATION_PER_LANG a language
        own[r["lang"]].append(model.excess(model.langs.index(r["lang"]), r["bits"][0], int(r["bits"][1])))
    model.quantile = np.array([_quantile(np.sort(own[lang])) for lang in model.langs])


def _quantile(z: np.ndarray) -> float:
    """The limit that a further value exceeds with a chance of FALSE_REJECT; at least what a normal distribution gives."""
    least = NormalDist().inv_cdf(1 - FALSE_REJECT)
    rank = int(np.ceil((len(z) + 1) * (1 - FALSE_REJECT)))
    if rank <= len(z):
        return max(float(z[rank - 1]), least)
    tail = z[int(len(z) * (1 - TAIL)) :]
    if not len(tail):
        return least
    return max(float(tail[0] + (tail - tail[0]).mean() * np.log(TAIL / FALSE_REJECT)), float(z[-1]), least)


def _predict(model: Identifier, first: bool):
    """Adds (best, bits, n, odds, excess) of a group of languages to those of the groups before it."""

    def run(batches):
        scorer = _Scorer(model.models)
        for batch in batches:
            width = batch.num_columns if first else batch.num_columns - 5
            before = None if first else [batch.column(width + i).to_pylist() for i in range(5)]
            out = [[] for _ in range(5)]
            for row, text in enumerate(batch.column(width - 1)):
                n, h = scorer.entropies(text.as_py() or "")
                best = int(h.argmin())
                lang, bits = model.langs[best], float(h[best])
                # Posterior of the best language; TEMPERATURE symbols count as one independent observation.
                odds = float(np.exp2(np.maximum(-(h - bits) * n / TEMPERATURE, -1000.0)).sum())
                excess = model.excess(best, bits, n)
                if before is not None and n:
                    other = [c[row] for c in before]
                    if other[1] <= bits:
                        lang, bits, excess = other[0], other[1], other[4]
                        odds = other[3] + odds * float(np.exp2(max(-(float(h[best]) - bits) * n / TEMPERATURE, -1000.0)))
                    else:
                        odds = odds + other[3] * float(np.exp2(max(-(other[1] - bits) * n / TEMPERATURE, -1000.0)))
                for column, value in zip(out, (lang, bits, n, odds, excess)):
                    column.append(value)
            types = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(c, t) for c, t in zip(out, types))], [*batch.schema.names[:width], *_SCORES])

    return run


_SCORES = ["r_lang", "r_bits", "r_n", "r_odds", "r_excess"]


def _scored(rows: DataFrame, models: list[Identifier]) -> DataFrame:
    """``rows`` (the text last) with the five columns of _SCORES; they are null if nothing was learned."""
    if not models:
        kinds = ["string", "double", "long", "double", "double"]
        return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(_SCORES, kinds)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows
    for k, model in enumerate(models):
        out = out.mapInArrow(_predict(model, k == 0), f"{schema}, r_lang string, r_bits double, r_n long, r_odds double, r_excess double")
    return out


_UNKNOWN = "coalesce(r_n, 0) = 0"  # no trigram: no letter


def identify(df: DataFrame, models: list[Identifier], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred, score, bits, rejected`` for every row; only the text is looked at.

    ``und`` (score 0, rejected) is given to null, empty and letterless texts, and to all
    if nothing could be learned. Ties go to the first language in order. Repeated
    rows get equal results; an empty table gives an empty one. A text is rejected if even
    the best model's cross-entropy lies above the calibrated limit for its length.
    """
    bounded_batches(df.sparkSession)
    scored = _scored(df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text")), models)
    unknown = F.expr(_UNKNOWN)
    return scored.select(
        *[F.col(f"`{c}`") for c in keep], F.when(unknown, "und").otherwise(F.col("r_lang")).alias("lang_pred"),
        F.when(unknown, 0.0).otherwise(1 / F.col("r_odds")).alias("score"), F.when(~unknown, F.col("r_bits")).alias("bits"),
        (unknown | (F.col("r_excess") > 1)).alias("rejected"),
    )


def held_out(id_col):
    """Rows whose id has a CRC-32 divisible by five; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def language_id(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits, rejected``: learned from the rows that are not held out."""
    marked = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    models = fit(marked.filter("NOT held_out"), "doc_id", "text", "lang")
    return identify(marked, models, ["doc_id", "held_out"])


def keep_identified(df: DataFrame, text_col="text", id_col="doc_id", lang_col="lang") -> DataFrame:
    """The rows of ``df`` whose language is identified, with all its columns, whatever their names.

    Null, empty and letterless texts go, and texts beyond the calibrated limits of all
    languages; if no row is labelled, all rows go. Rows without an id are judged like others.
    """
    models = fit(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    at = df.columns.index(text_col)
    bounded_batches(df.sparkSession)
    moved = positional(df)
    others = [c for i, c in enumerate(moved.columns) if i != at]
    scored = _scored(moved.select(*others, f"c{at}"), models)
    kept = scored.filter(f"NOT ({_UNKNOWN}) AND r_excess <= 1")
    return kept.select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def op9(spark, sf_dir):
    return language_id(read(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9}
ORACLE = {}
