"""Language-model scoring with a hashed maximum-entropy model.

The probability of a token is factored by class: P(class | history) * P(token | class).

* Counts of every training token are made by a distributed aggregate and stay a table;
  only the ``VOCABULARY`` most frequent ones are known to the workers. All other tokens
  form the class of rare ones; their counts are joined by token when scoring.
* Frequent tokens get the class of the frequent token after which they stand most
  above expectation (``ANCHORS`` of them); the end mark has a class of its own.
* P(token | class, history) is a softmax inside the class: each token's frequency in its class,
  tilted by a weight for every pair of previous token's class and token that occurs. The counts of
  these pairs come from all training text; weights move by gradient steps in the tasks that hold the
  counts of one previous class. Tokens that do not occur after a class keep weight 0 there.
  Rare tokens have their add-one frequencies among the rare. With ``rare_pairs`` these are tilted, too: all
  pairs of previous class and rare token are counted in a table that grows with the corpus, and their
  weights have a closed form (``_rare_weights``), so that no token's pairs are left out.
* P(class | history) is a maximum-entropy model over hashed features of the two
  previous tokens: the bigram, the trigram, and the skip feature that looks past the
  previous token. Its sufficient statistics, counts of (history, class), come from all
  training text; gradient and curvature of the likelihood are summed over their
  partitions at each step and the weights move by a damped Newton step.

A text's tokens are its words and one end mark. Scores are sums of log10
probabilities, computed by sparse numpy look-ups over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, durable, read
from lamella.llm._words import mix, word_hashes

VOCABULARY = 65_536
ANCHORS = 32
DIRECT = 128  # most frequent tokens that are a history of their own; others are known by class
FEATURES = 4096  # rows of the hashed weight table
STEPS = 8
RIDGE = 1.0
INSIDE_STEPS, INSIDE_RIDGE = 20, 0.5
PRIORS = tuple(10.0**k for k in range(1, 9))  # choices for the tokens that the frequencies of rare tokens weigh against pairs
FLUSH = 2_000_000  # words gathered before counts are passed on

END = 0x0E0D  # key of the end mark
_END_KEY = np.array([END], np.uint64).view(np.int64)[0]


def _count(batches):
    """(token, n) of training texts, summed over many batches before they leave the task."""
    held, size, rows = [], 0, 0

    def flush():
        keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for batch in batches:
        rows += batch.num_rows
        for _, _, words, _ in word_hashes(batch.column(0)):
            held.append(words)
            size += len(words)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([_END_KEY]), pa.array([rows], pa.int64())], ["key", "n"])


@dataclass
class Vocabulary:
    """The frequent tokens: sorted keys, frequency ranks and counts; history and class codes by place."""

    keys: np.ndarray  # sorted uint64
    rank: np.ndarray
    counts: np.ndarray
    classes: np.ndarray | None = None

    RARE, LAST, BEGIN = ANCHORS, ANCHORS + 1, ANCHORS + 2  # classes: rare tokens, the end mark, the start of a text

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in ``keys``, -1 if it is rare."""
        if not len(self.keys):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, at, -1)

    def histories(self) -> np.ndarray:
        """Code of each place as a previous token; the last row is that of rare tokens."""
        own = np.where(self.rank < DIRECT, self.rank, DIRECT + self.classes)
        return np.append(own, DIRECT + self.RARE)

    def class_of(self) -> np.ndarray:
        return np.append(self.classes, self.RARE)


N_CLASSES = ANCHORS + 2  # outcomes
N_HISTORY = DIRECT + ANCHORS + 3
N_BEFORE = ANCHORS + 3


def _streams(batch_column, vocabulary: Vocabulary):
    """(first row, end row, words, places, text of each token, first token of each text); the end marks are included."""
    end_place = vocabulary.places(np.array([END], np.uint64))[0]
    for first, end, words, offsets in word_hashes(batch_column):
        n = end - first
        sizes = np.diff(offsets) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        token = np.ones(int(sizes.sum()), bool)
        last = starts + sizes - 1
        token[last] = False
        places = np.empty(len(token), np.int64)
        places[token] = vocabulary.places(words)
        places[last] = end_place
        keys = np.full(len(token), END, np.uint64)
        keys[token] = words
        yield first, end, keys, places, np.repeat(np.arange(n), sizes), starts


def _anchor_counts(vocabulary: Vocabulary):
    """(cell, n): how often each frequent token follows each anchor (the last: any other token)."""

    def run(batches):
        cells = np.zeros(len(vocabulary.keys) * ANCHORS, np.int64)
        for batch in batches:
            for _, _, _, places, text, _ in _streams(batch.column(0), vocabulary):
                rank = np.append(vocabulary.rank, ANCHORS)[places[:-1]]
                use = (text[1:] == text[:-1]) & (places[1:] >= 0)
                at = places[1:][use] * ANCHORS + np.minimum(rank[use], ANCHORS - 1)
                np.add(cells, np.bincount(at, minlength=len(cells)), out=cells)
        hit = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(cells[hit])], ["cell", "n"])

    return run


def _histories(places, text, starts, vocabulary):
    """Code of the (token before last, last token) history of every token."""
    last, before = vocabulary.histories()[places], vocabulary.class_of()[places]
    one = np.empty(len(places), np.int64)
    one[1:] = last[:-1]
    one[starts] = DIRECT + Vocabulary.BEGIN
    two = np.full(len(places), Vocabulary.BEGIN, np.int64)
    two[2:] = before[:-2]
    two[starts] = Vocabulary.BEGIN
    second = starts + 1
    second = second[second < len(places)]
    two[second] = Vocabulary.BEGIN
    return one * N_BEFORE + two


def _history_counts(vocabulary: Vocabulary):
    """(history, class, n) of all training tokens."""

    def run(batches):
        cells = np.zeros(N_HISTORY * N_BEFORE * N_CLASSES, np.int64)
        for batch in batches:
            for _, _, _, places, text, starts in _streams(batch.column(0), vocabulary):
                at = _histories(places, text, starts, vocabulary) * N_CLASSES + vocabulary.class_of()[places]
                np.add(cells, np.bincount(at, minlength=len(cells)), out=cells)
        hit = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(hit // N_CLASSES), pa.array(hit % N_CLASSES), pa.array(cells[hit])], ["history", "cls", "n"])

    return run


def _previous(places, starts, vocabulary):
    """Class of the token before each token; BEGIN at the start of a text."""
    out = np.empty(len(places), np.int64)
    out[1:] = vocabulary.class_of()[places[:-1]]
    out[starts] = Vocabulary.BEGIN
    return out


def _pair_counts(vocabulary: Vocabulary):
    """(before, place, n): how often each frequent token follows each class."""

    def run(batches):
        size = len(vocabulary.keys)
        cells = np.zeros(N_BEFORE * size, np.int64)
        for batch in batches:
            for _, _, _, places, _, starts in _streams(batch.column(0), vocabulary):
                known = places >= 0
                at = _previous(places, starts, vocabulary)[known] * size + places[known]
                np.add(cells, np.bincount(at, minlength=len(cells)), out=cells)
        hit = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(hit // max(size, 1)), pa.array(hit % max(size, 1)), pa.array(cells[hit])], ["before", "place", "n"])

    return run


def tilt(classes: np.ndarray, share: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the tokens seen after one class, and the log of each class's normaliser.

    ``classes`` and ``share`` (frequency inside the class) and counts ``n`` of the tokens seen. Damped
    Newton steps on the penalised likelihood of the softmax inside each class; the tokens not seen
    keep weight 0 and their share of the normaliser.
    """
    theta, total = np.zeros(len(n)), np.bincount(classes, n, N_CLASSES)
    norm = np.ones(N_CLASSES)
    for _ in range(INSIDE_STEPS):
        norm = 1 + np.bincount(classes, share * np.expm1(theta), N_CLASSES)
        p = share * np.exp(theta) / norm[classes]
        slope = total[classes] * p * (1 - p) + INSIDE_RIDGE
        theta = theta + 0.7 * np.clip((n - total[classes] * p - INSIDE_RIDGE * theta) / slope, -2.0, 2.0)
    return theta, np.log(1 + np.bincount(classes, share * np.expm1(theta), N_CLASSES))


def _tilt_group(vocabulary: Vocabulary):
    """One row a previous class: places, weights and normalisers."""
    size = np.bincount(vocabulary.classes, vocabulary.counts, N_CLASSES) if len(vocabulary.keys) else np.ones(N_CLASSES)

    def run(key, table):
        place, n = table.column("place").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(place)
        place, n = place[order], n[order]
        classes = vocabulary.classes[place]
        theta, norm = tilt(classes, vocabulary.counts[place] / size[classes], n)
        blobs = [place.astype(np.int32), theta.astype(np.float32), norm]
        return pa.table({"before": pa.array([key[0].as_py()], pa.int64()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("places", "theta", "norm"), blobs)}})

    return run


def train_inside(texts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights (previous class, place) and log normalisers (previous class, class); both bounded by the parameters."""
    theta, norm = np.zeros((N_BEFORE, len(vocabulary.keys) + 1), np.float32), np.zeros((N_BEFORE, N_CLASSES))
    pairs = texts.mapInArrow(_pair_counts(vocabulary), "before long, place long, n long").groupBy("before", "place").agg(F.sum("n").alias("n"))
    for row in pairs.groupBy("before").applyInArrow(_tilt_group(vocabulary), "before long, places binary, theta binary, norm binary").collect():
        theta[row["before"], np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["theta"], np.float32)
        norm[row["before"]] = np.frombuffer(row["norm"], np.float64)
    return theta, norm


def _rare_pairs(vocabulary: Vocabulary):
    """(key, before, n): how often each rare token follows each class, summed over many batches before they leave the task."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, before = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((before, keys))
            keys, before = keys[order], before[order]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (before[1:] != before[:-1]))[: len(keys)])
            return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(before[first]), pa.array(np.diff(np.append(first, len(keys))))], ["key", "before", "n"])

        for batch in batches:
            for _, _, keys, places, _, starts in _streams(batch.column(0), vocabulary):
                rare = places < 0
                held.append((keys[rare], _previous(places, starts, vocabulary)[rare]))
                size += int(rare.sum())
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def rare_table(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``key, n, pairs``: count of each rare token, and by previous class (a map of N_BEFORE at most)."""
    # Both sums are made where a key's rows are.
    pairs = texts.mapInArrow(_rare_pairs(vocabulary), "key long, before long, n long").repartition("key").groupBy("key", "before").agg(F.sum("n").alias("n"))
    return durable(pairs.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("before", "n"))).alias("pairs")))


def _rare_weights(table: DataFrame, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, log10 of the normaliser) by previous class: a rare token's share is (n + 1 + gain * pairs) / whole / normaliser.

    This is a softmax over the rare tokens whose weights match the counts of pairs, smoothed by a prior of
    so many tokens at their frequencies: gain = whole / prior, normaliser = 1 + pairs of the class / prior. The prior of
    a class is the one of ``PRIORS`` under which its pairs are likeliest, each left out in turn; if frequencies alone do better, gain is 0.
    """
    one = table.select("n", F.explode("pairs").alias("before", "own"))
    share, own = (F.col("n") + 1) / float(whole), F.col("own")
    sums = [F.sum(own * F.log(own - 1 + prior * share)).alias(f"s{i}") for i, prior in enumerate(PRIORS)]
    gain, norm = np.zeros(N_BEFORE), np.zeros(N_BEFORE)
    for r in one.groupBy("before").agg(F.sum("own").alias("own"), F.sum(own * F.log(share)).alias("plain"), *sums).collect():
        likely = [r[f"s{i}"] - r["own"] * np.log(r["own"] - 1 + prior) for i, prior in enumerate(PRIORS)]
        best = int(np.argmax(likely))
        if likely[best] > r["plain"]:
            gain[r["before"]], norm[r["before"]] = whole / PRIORS[best], np.log10(1 + r["own"] / PRIORS[best])
    return gain, norm


def features(history: np.ndarray) -> np.ndarray:
    """Rows of the weight table that a history switches on: bias, bigram, skip, trigram."""
    one, two = history // N_BEFORE, history % N_BEFORE
    kinds = [np.zeros_like(history), 1 + one, 1_000 + two, 1_000_000 + history]
    hashed = [mix(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)) % np.uint64(FEATURES - 1) + np.uint64(1) for i, k in enumerate(kinds)]
    return np.stack([np.zeros(len(history), np.int64), *[h.astype(np.int64) for h in hashed[1:]]], axis=1)


def _log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    logits = weights[features(history)].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _gradient(weights):
    """Sums over a partition's histories of gradient and curvature, as sparse rows of the table."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        history, cls, n = (table.column(c).to_numpy() for c in ("history", "cls", "n"))
        own, at = np.unique(history, return_inverse=True)
        seen = np.zeros((len(own), N_CLASSES))
        np.add.at(seen, (at, cls), n)
        p = np.exp(_log_softmax(weights, own))
        total = seen.sum(axis=1, keepdims=True)
        g, h = np.zeros_like(weights), np.zeros_like(weights)
        rows = features(own)
        for k in range(rows.shape[1]):
            np.add.at(g, rows[:, k], seen - total * p)
            np.add.at(h, rows[:, k], total * p * (1 - p))
        hit = np.flatnonzero(h.any(axis=1))
        sums = np.concatenate([g[hit], h[hit]], axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([hit.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["rows", "sums"])

    return run


def train(statistics: DataFrame) -> np.ndarray:
    """Weights of the maximum-entropy model: STEPS full passes over the (history, class, n) table.

    The bias starts at the class frequencies. A step divides each gradient by the
    curvature of its feature times the number of features that share a token.
    """
    weights = np.zeros((FEATURES, N_CLASSES))
    seen = np.full(N_CLASSES, 0.5)
    for row in statistics.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        seen[row["cls"]] += row["n"]
    weights[0] = np.log(seen / seen.sum())
    start = weights.copy()
    parts = statistics.repartition("history")  # as many as the cluster's shuffles have
    for _ in range(STEPS):
        g, h = np.zeros_like(weights), np.zeros_like(weights)
        for part in parts.mapInArrow(_gradient(weights), "rows binary, sums binary").collect():
            rows = np.frombuffer(part["rows"], np.int32)
            sums = np.frombuffer(part["sums"], np.float32).reshape(len(rows), 2 * N_CLASSES)
            g[rows] += sums[:, :N_CLASSES]
            h[rows] += sums[:, N_CLASSES:]
        weights += np.clip((g - RIDGE * (weights - start)) / (3 * h + RIDGE), -2.0, 2.0)
    return weights


@dataclass
class Model:
    """What scoring needs besides the table of counts; its size is bounded by the parameters."""

    vocabulary: Vocabulary
    weights: np.ndarray
    theta: np.ndarray  # inside classes, by (previous class, place)
    norm: np.ndarray  # log normaliser by (previous class, class)
    tokens: int  # N, all training tokens
    distinct: int  # V
    rare_tokens: int
    rare_distinct: int
    rare_norm: np.ndarray  # log10 normaliser of the rare tokens by previous class
    rare_pairs: bool = False  # rare tokens are told apart by the class before them

    def tables(self):
        """log10 P(class | history), log10 share of the class by place, and the base's log10(c + 1) by place."""
        v = self.vocabulary
        history = np.arange(N_HISTORY * N_BEFORE)
        by_class = np.concatenate([_log_softmax(self.weights, h) for h in np.array_split(history, 8)]) / np.log(10)
        size = np.bincount(v.classes, v.counts, N_CLASSES)
        inside = np.log10(v.counts / size[v.classes]) if len(v.keys) else np.zeros(0)
        return by_class, np.append(inside, 0.0), np.append(np.log10(v.counts + 1.0), 0.0)


def _score(model: Model):
    """Sums over a text's frequent tokens, and its rare tokens (after each class, if these tell) with their numbers of times."""

    def run(batches):
        by_class, inside, plain = model.tables()
        v = model.vocabulary
        for batch in batches:
            out = [[] for _ in range(7)]
            for first, end, keys, places, text, starts in _streams(batch.column(2), v):
                n = end - first
                history, before, cls = _histories(places, text, starts, v), _previous(places, starts, v), v.class_of()[places]
                p = by_class[history, cls] + inside[places] + (model.theta[before, places] - model.norm[before, cls]) / np.log(10)
                known = places >= 0
                rare = np.flatnonzero(~known)
                p -= np.where(known, 0.0, model.rare_norm[before])
                after = before if model.rare_pairs else np.zeros_like(before)
                order = rare[np.lexsort((after[rare], keys[rare], text[rare]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1]) | (after[order][1:] != after[order][:-1])
                begin = np.flatnonzero(fresh)
                times = np.diff(np.append(begin, len(order)))
                ends = np.append(0, np.cumsum(np.bincount(text[order][begin], minlength=n))).astype(np.int32)
                for column, values in zip(out, (
                    np.bincount(text, minlength=n), np.bincount(text, known, n).astype(np.int64), np.bincount(text, plain[places], n), np.bincount(text, p, n),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order][begin].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(after[order][begin])),
                )):
                    column.append(pa.array(values))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 3]
            arrays = [pa.concat_arrays([x.cast(t) for x in c]) if c else pa.array([], t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["doc_id", "held_out", "n_tokens", "n_frequent", "plain", "model", "rare", "times", "after"]
            )

    return run


def _vocabulary(counts: DataFrame, texts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "key").limit(VOCABULARY).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    v = Vocabulary(keys[order], np.arange(len(keys))[order], top["n"].to_numpy(np.int64)[order])
    cells = texts.mapInArrow(_anchor_counts(v), "cell long, n long")
    word, anchor = F.expr(f"cell div {ANCHORS}").alias("place"), F.expr(f"cell % {ANCHORS}").alias("anchor")
    summed = cells.groupBy(word, anchor).agg(F.sum("n").alias("n"))
    base = {r["anchor"]: r["n"] for r in summed.groupBy("anchor").agg(F.sum("n").alias("n")).collect()}
    total = max(1, sum(base.values()))
    share = F.create_map(*[F.lit(x) for k, n in base.items() for x in (int(k), n / total)]) if base else F.create_map(F.lit(0), F.lit(1.0))
    # The anchor after which the token stands most above expectation, with 20 expected counts added.
    lift = (F.col("n") + 20 * share[F.col("anchor").cast("int")]) / share[F.col("anchor").cast("int")]
    best = summed.groupBy("place").agg(F.max_by("anchor", F.struct(lift, -F.col("anchor"))).alias("cls")).toPandas()
    v.classes = np.full(len(keys), ANCHORS - 1, np.int64)
    v.classes[best["place"].to_numpy(np.int64)] = best["cls"].to_numpy(np.int64)
    v.classes[v.keys == END] = Vocabulary.LAST
    return v


def held_out(id_col):
    """Rows that training leaves out: CRC-32 of the id leaves 2 modulo 7; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == 2


def lm_score(df: DataFrame, id_col="doc_id", text_col="text", rare_pairs: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the add-one unigram score, ``score`` the model's; both are log10
    probabilities. Null texts count as empty: their only token is the end mark. Rows that
    repeat an id are scored each; with no training rows every token is equally unknown.
    An empty table gives an empty result; extra columns are not read. With ``rare_pairs`` rare tokens
    are tilted by the class before them, as frequent ones are, by a table of all their pairs.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.filter("NOT held_out").select("text")
    counts = durable(texts.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    v = _vocabulary(counts, texts)
    statistics = durable(texts.mapInArrow(_history_counts(v), "history long, cls long, n long").groupBy("history", "cls").agg(F.sum("n").alias("n")))
    rare_tokens, rare_distinct = totals["n"] - int(v.counts.sum()), totals["v"] - len(v.keys)
    gain, norm = np.zeros(N_BEFORE), np.zeros(N_BEFORE)
    if rare_pairs:
        others = rare_table(texts, v)
        gain, norm = _rare_weights(others, rare_tokens + rare_distinct + 1)
    else:
        frequent = int(v.counts.min()) if len(v.keys) else 0
        others = counts.filter(F.col("n") <= frequent)  # rare tokens have no larger count
    model = Model(v, train(statistics), *train_inside(texts, v), totals["n"], totals["v"], rare_tokens, rare_distinct, norm, rare_pairs)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_frequent long, plain double, model double, rare array<long>, times array<long>, after array<long>"
    scored = durable(rows.mapInArrow(_score(model), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times", "after")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"), F.col("r.after").alias("after"))
    weight = F.col("n") + 1
    if rare_pairs:
        weight = weight + F.array(*map(F.lit, gain.tolist()))[F.col("after").cast("int")] * F.coalesce(F.try_element_at("pairs", "after"), F.lit(0))
    joined = rare.join(others, "key").groupBy("row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("lift"), F.sum(F.col("times") * F.log10(weight)).alias("tilted")
    )
    out = scored.drop("rare", "times", "after").join(joined, "row", "left").withColumns({"known": F.coalesce("known", F.lit(0)), "lift": F.coalesce("lift", F.lit(0.0)), "tilted": F.coalesce("tilted", F.lit(0.0))})
    unseen = F.col("n_tokens") - F.col("n_frequent")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.col("known")).alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("plain") + F.col("lift") - F.col("n_tokens") * float(np.log10(totals["n"] + totals["v"] + 1))).alias("base_score"),
        (F.col("model") + F.col("tilted") - unseen * float(np.log10(model.rare_tokens + model.rare_distinct + 1))).alias("score"),
    )


def op6(spark, sf_dir):
    return lm_score(read(spark, sf_dir, "documents"), rare_pairs=True)


QUERIES = {"op6_lm_score": op6}
ORACLE = {}
