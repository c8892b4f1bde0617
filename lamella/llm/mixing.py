"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) as close as possible, in relative
entropy over words, to the natural rate of one, subject to token constraints: each
source supplies its target, and each length class (powers of two) keeps about its
share of the words, so that a mix does not drift to short or long texts. The convex
dual has one multiplier a source and one a class; a document's rate is the exponential
tilt ``exp(source + class)``, at most ``CAP``. Class constraints are soft (ridge), so
the source constraints can always be met.

Documents with one source and one class have one rate, so the sums of each Newton iteration
are taken over cells (source, class) of all documents' words. Sources, their targets and
multipliers are a table: the driver sees one number a length class (at most 64) and scalars.
If the iterations do not meet the source constraints, the class multipliers are set
to nought, where the dual has the closed form ``target / size``.

Rates are rounded into whole copies so that words meet the targets: in each source,
from the longest class to the shortest, documents get their extra copy in order of
their id's hash until the class's words are reached, and what a class misses is
carried into the next shorter one. The order is cut at one of ``BINS`` hash bins, so
this needs a histogram and no sorted source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import durable, read

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)
BINS = 512
ITERATIONS = 40
RIDGE = 0.05
TOLERANCE = 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(df: DataFrame, id_col, text_col, source_col, *keep: Column) -> DataFrame:
    """``_source, _size, _cls`` (floor of log2; -1: empty) and ``_bin`` beside the columns ``keep``."""
    size = n_words(F.col(text_col)).alias("_size")
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(BINS)).cast("int").alias("_bin")
    sized = df.select(*keep, F.col(source_col).cast("string").alias("_source"), size, place)
    return sized.withColumn("_cls", F.when(F.col("_size") > 0, F.length(F.bin("_size")) - 1).otherwise(-1))


def targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """``sid, _source, source_size, target, pinned`` of ``_source, words``: shares by weight, stopped at ``cap`` times the size.

    Sources are ranked by a distributed sort (by code point, null last). The excess is reshared
    in rounds: each pins the sources above their cap and divides the rest anew.
    """
    ranked = durable(sizes.withColumn("_null", F.col("_source").isNull()).orderBy("_null", "_source").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).orderBy("_part").collect()
    start, before = {}, 0
    for r in parts:  # one row a partition
        start[r["_part"]] = before - r["low"]
        before += r["n"]
    shift = F.create_map(*[F.lit(x) for k, v in start.items() for x in (k, v)]) if start else F.create_map(F.lit(0), F.lit(0))
    sid = (F.col("_at") + shift[F.col("_part")].cast("long")).alias("sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    table = durable(ranked.select(sid, "_source", F.col("words").alias("source_size")).withColumn("weight", weight))
    most = F.col("source_size") * float(cap)
    share, last = 0.0, None  # words a unit of weight; all sums are of whole numbers, so the rounds end
    while share != last:
        over = F.lit(False) if last is None else F.col("weight") * share >= most
        r = table.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, most).otherwise(0.0)).alias("pinned"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        last = share if last is not None else -1.0
        share = (r["total"] - r["pinned"]) / r["open"] if r["open"] else share
    pinned = F.col("weight") * share >= most
    return durable(table.select("sid", "_source", "source_size", F.when(pinned, most).otherwise(F.col("weight") * share).alias("target"), pinned.alias("pinned")))


def _tilt(eta):
    """Exponential tilt of the natural rate 1, at most CAP."""
    return F.least(F.exp(eta), F.lit(float(CAP)))


def _sums(cells: DataFrame, duals: DataFrame, mu: dict) -> DataFrame:
    """Per source: its multiplier, residual ``gs``, curvature ``hs`` and, by class, words taken ``g`` and curvature ``h``."""
    by_class = F.create_map(*[F.lit(x) for c, m in mu.items() for x in (int(c), float(m))])
    rated = cells.join(duals, "sid").withColumn("rate", _tilt(F.col("lam") + by_class[F.col("_cls")]))
    took = F.col("words") * F.col("rate")
    curved = F.when(F.col("rate") < CAP, took).otherwise(0.0)
    parts = F.array_sort(F.collect_list(F.struct("_cls", took.alias("g"), curved.alias("h"))))  # at most 64, in one order of summation
    out = rated.groupBy("sid", "lam", "target", "pinned").agg(parts.alias("parts"))
    total = lambda name: F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[name])
    return out.select("sid", "lam", "target", "pinned", "parts", (total("g") - F.col("target")).alias("gs"), total("h").alias("hs"))


def _newton(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``sid, _cls, rate`` of every cell (sid, _cls, words). ``sources``: sid, source_size, target, pinned (its target is CAP times its size)."""
    share = {r["_cls"]: float(r["words"]) for r in cells.groupBy("_cls").agg(F.sum("words").alias("words")).collect()}
    classes = sorted(share)
    total, goal = sum(share.values()), sources.agg(F.sum("target")).first()[0]
    want = np.array([share[c] * goal / total for c in classes])
    mu, at = np.zeros(len(classes)), {c: i for i, c in enumerate(classes)}
    start = F.when(F.col("pinned"), 60.0).otherwise(F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9))))
    duals = sources.filter("source_size > 0").select("sid", "target", "pinned", start.alias("lam"))
    closed = duals
    met = False
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")  # noqa: E731  the same in any order of summation
    ridge = RIDGE * want
    for _ in range(ITERATIONS):
        sums = durable(_sums(cells, duals, dict(zip(classes, mu))))
        free, inverse = ~F.col("pinned"), 1 / F.greatest("hs", F.lit(1e-9))
        off = F.when(free, F.abs("gs") / F.greatest("target", F.lit(1.0))).alias("off")
        pairs = sums.select("gs", F.when(free, inverse).otherwise(0.0).alias("inv"), off, "parts", F.explode("parts").alias("p")).select("gs", "inv", "off", "p", F.explode("parts").alias("q"))
        one = F.col("p._cls") == F.col("q._cls")
        rows = pairs.groupBy(F.col("p._cls").alias("c"), F.col("q._cls").alias("d")).agg(
            exact(F.col("p.h") * F.col("inv") * F.col("q.h")).alias("x"), exact(F.when(one, F.col("p.g"))).alias("g"), exact(F.when(one, F.col("p.h"))).alias("h"),
            exact(F.when(one, F.col("p.h") * F.col("inv") * F.col("gs"))).alias("r"), F.max("off").alias("off"),
        ).collect()
        # The sources are eliminated (their block is diagonal); the small system of the classes is left.
        gc, hc, right = ridge * mu - want, np.diag(ridge + 1e-6 * want + 1e-9), np.zeros(len(mu))
        for r in rows:
            i, j = at[r["c"]], at[r["d"]]
            hc[i, j] -= r["x"]
            if i == j:
                gc[i] += r["g"]
                hc[i, i] += r["h"]
                right[i] += r["r"]
        if max(r["off"] or 0.0 for r in rows) <= TOLERANCE and np.abs(gc).max() <= 1e-3 * max(goal, 1.0):
            met = True
            break
        dc = np.clip(np.linalg.solve(hc, right - gc), -1.0, 1.0)
        move = F.create_map(*[F.lit(x) for c, m in zip(classes, dc) for x in (int(c), float(m))])
        cross = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["h"] * move[p["_cls"]])
        step = F.greatest(F.least((-F.col("gs") - cross) * inverse, F.lit(2.0)), F.lit(-2.0))
        mu, duals = mu + dc, sums.select("sid", "target", "pinned", (F.col("lam") + F.when(free, step).otherwise(0.0)).alias("lam"))
    if not met:
        mu, duals = np.zeros(len(classes)), closed
    by_class = F.create_map(*[F.lit(x) for c, m in zip(classes, mu) for x in (int(c), float(m))])
    return cells.join(duals, "sid").select("sid", "_cls", _tilt(F.col("lam") + by_class[F.col("_cls")]).alias("rate"))


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and the hash bin below which a document gets one more, for each class of one source."""
    target, out = float(pdf["target"].iloc[0]), []
    pinned = bool(pdf["pinned"].iloc[0])
    parts = sorted(pdf.groupby("_cls"), key=lambda x: -x[0])
    rates = {c: float(CAP) if pinned else float(p["rate"].iloc[0]) for c, p in parts}
    words = {c: p["words"].sum() for c, p in parts}
    base = {c: int(min(np.floor(rates[c] + 1e-9), CAP)) for c, _ in parts}
    planned = sum(rates[c] * words[c] for c, _ in parts)
    carry = 0.0 if pinned else target - planned  # what the solver left over
    for c, part in parts:
        wanted = (rates[c] - base[c]) * words[c] + carry
        part = part.sort_values("_bin")
        reached = np.concatenate([[0.0], np.cumsum(part["words"].to_numpy(float))])
        if base[c] >= CAP:
            reached = reached[:1]
        k = int(np.abs(reached - wanted).argmin())
        cut = BINS if k == len(part) and k else int(part["_bin"].iloc[k]) if k < len(part) else 0
        carry = 0.0 if pinned else wanted - reached[k]
        out.append((pdf["sid"].iloc[0], c, rates[c], base[c], cut if k else 0))
    return pd.DataFrame(out, columns=["sid", "_cls", "rate", "whole", "cut"])


def plan(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``_source, _cls, source_size, target, rate, whole, cut``: a row per source and length class."""
    placed = _placed(df, id_col, text_col, source_col)
    bins = durable(placed.groupBy("_source", "_cls", "_bin").agg(F.sum("_size").alias("words")))
    sources = targets(bins.groupBy("_source").agg(F.sum("words").alias("words")))
    known = sources.select("sid", F.col("_source").alias("_name"), "source_size", "target", "pinned")
    named = bins.join(known, bins["_source"].eqNullSafe(known["_name"])).select("sid", "_cls", "_bin", "words", "target", "pinned")
    filled = durable(named.filter("_cls >= 0"))
    empty = sources.select("sid", F.lit(-1).alias("_cls"), F.lit(0.0).alias("rate"), F.lit(0).alias("whole"), F.lit(0).alias("cut"))
    rounded = empty
    if not filled.isEmpty():
        cells = durable(filled.groupBy("sid", "_cls").agg(F.sum("words").alias("words")))
        ready = filled.join(_newton(cells, sources), ["sid", "_cls"]).select("sid", "_cls", "_bin", "words", "target", "pinned", "rate")
        rounded = empty.union(ready.groupBy("sid").applyInPandas(_round, "sid long, _cls int, rate double, whole int, cut int"))
    return durable(sources.join(rounded, "sid").select("_source", "_cls", "source_size", "target", "rate", "whole", "cut"))


def with_copies(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """The columns of ``placed`` and of its source and class in the plan, and ``_copies``."""
    p = planned.withColumnsRenamed({"_source": "_psource", "_cls": "_pcls"})
    joined = placed.join(p, placed["_source"].eqNullSafe(p["_psource"]) & (placed["_cls"] == p["_pcls"]), "left")
    return joined.withColumn("_copies", F.col("whole") + F.when(F.col("_bin") < F.col("cut"), 1).otherwise(0))


def mixing(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, rate, copies``.

    Null texts have size 0; texts without words take no part (no copies). The null
    source is a source of its own, last in order. Rows that repeat an id get the same
    number of copies each if their lengths are of one class; so do rows without an id. An
    empty table gives an empty result. Extra columns are not read. Equal inputs give
    equal results: order and chance come from id hashes.
    """
    placed = _placed(df, id_col, text_col, source_col, F.col(id_col).alias("doc_id"))
    out = with_copies(placed, plan(df, id_col, text_col, source_col))
    return out.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size")).alias("taken"), "rate", F.col("_copies").alias("copies"),
    )


def mix(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix itself: every row of ``df`` as many times as it has copies, with all its columns, whatever their names.

    Rows without words are in no mix; nulls, ties and repeated rows as in ``mixing``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    out = with_copies(_placed(df, id_col, text_col, source_col, whole), plan(df, id_col, text_col, source_col)).filter("_copies > 0")
    each = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return each.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def op1(spark, sf_dir):
    return mixing(read(spark, sf_dir, "documents"))


QUERIES = {"op1_mixing": op1}
ORACLE = {}
