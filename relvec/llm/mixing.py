"""Mixing sources to target weights along a curriculum.

Every source has a weight and a shape: how its share of the demand changes over training time 0..1. The integral of the
shape, scaled to the source's target, is its cumulative demand; inverting that function turns a document's place in its
source (in hashed order, in words) into a training time. Documents range-sorted by time are the training order.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and stands last; ties in
the hashed order are broken by content, so repeated rows share the same places in every run; an empty table gives no
rows; other columns are never read. A source with a third of all rows is split into hash ranges and their totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm.common import pick
from relvec.operators.ordered import dense_ids
from relvec.session import materialize, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)  # by position of the source, repeating
SHARE = 1.5  # of all words
MOST_PASSES = 2  # a source's target is at most this many times its size
# Knots (time, height) of each weight's shape, repeating like the weights; heights are relative.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
RANGES_PER_PARTITION = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def training_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the demand with this shape has reached `share` (0..1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    cases = []
    for (t0, h0), (t1, h1), area in zip(knots, knots[1:], areas):
        slope = (h1 - h0) / (t1 - t0)
        left = F.greatest(share * whole - before, F.lit(0.0))
        # Solve h0 * x + slope * x**2 / 2 = left for x in the form that is stable when the slope is near 0.
        x = F.try_divide(2 * left, h0 + F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * slope * left, F.lit(0.0))))
        cases.append((share * whole <= before + area, F.lit(t0) + F.coalesce(x, F.lit(0.0))))
        before += area
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Add `target` to (size, weight). Sources at their limit drop out and the rest share what is left by weight.

    Each round brings four sums to the driver; the level only rises, so the rounds end.
    """
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, budget = (share * total / weights if weights else 0.0), share * total
    while True:
        full = F.col("size") * most <= F.col("weight") * level
        taken, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("size") * most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        higher = (budget - taken) / open_weight if open_weight else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return sources.withColumn("target", F.least(F.col("size") * F.lit(float(most)), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shapes=SHAPES, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken, and a training time per pass.

    `times` holds one entry for each pass that takes the document (at least half of it, for whole documents), earliest
    first; `taken` counts words exactly, the last document of a source being cut at the target.
    """
    spark = docs.sparkSession
    ranges = RANGES_PER_PARTITION * shuffle_partitions(spark)
    source = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), F.col("source")))
    order = F.xxhash64("doc_id", "text")
    sized = materialize(
        pick(docs, "doc_id", "text", "source").select(
            "doc_id", source.alias("src"), word_count(F.col("text")).alias("size"), order.alias("place"),
        ), "sized",
    ).withColumn("part", F.pmod(F.shiftrightunsigned("place", 1), F.lit(ranges)).cast("int"))
    sources = dense_ids(sized.groupBy("src").agg(F.sum("size").alias("size")), [], [F.col("src")], "rank")
    cycle = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), cycle + 1))
    sources = materialize(targets(materialize(sources, "sources"), share, passes).withColumn("shape", F.pmod("rank", F.lit(len(shapes)))), "targets")
    # Place of every document in its source: a running sum in its hash range, plus the ranges before.
    key = ["src", "part"]
    inside = W.partitionBy(*key).orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = sized.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    before = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sized.groupBy(*key).agg(F.sum("size").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    facts = sources.select("src", F.col("size").alias("source_size"), "target", "shape")
    parts = parts.join(facts, "src")
    placed = local.join(parts, key).withColumn("start", F.col("start") + F.col("before"))
    goal = F.floor("target")
    takes = [
        F.greatest(F.least(F.col("start") + F.col("size"), goal - p * F.col("source_size")) - F.col("start"), F.lit(0))
        for p in range(passes)
    ]
    times = []
    for p, take in enumerate(takes):
        at = F.try_divide(p * F.col("source_size") + F.col("start") + F.col("size") / 2, F.col("target"))
        time = training_time(F.least(at, F.lit(1.0)), shapes[0])
        for i in range(1, len(shapes)):
            time = F.when(F.col("shape") == i, training_time(F.least(at, F.lit(1.0)), shapes[i])).otherwise(time)
        times.append(F.when((F.col("size") > 0) & (take * 2 >= F.col("size")), time))
    return placed.select(
        "doc_id", "place", "size", "source_size", "target", sum(takes[1:], takes[0]).cast("long").alias("taken"),
        F.array_compact(F.array(*times)).alias("times"),
    )


def in_training_order(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, range-sorted by training time; same columns.

    Rows meet their times by the hash of their content; rows that share it are told apart by number, in order of id.
    """
    names = docs.columns
    entry = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "times")
    chosen = mix(docs, **settings).groupBy("place").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    chosen = chosen.where(F.exists("entries", lambda e: F.size(e["times"]) > 0))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    found = plain.withColumn("place", F.xxhash64(doc_id, text)).join(chosen, "place")
    number = F.row_number().over(W.partitionBy("place").orderBy(F.coalesce(doc_id, F.lit(-(1 << 63)))))
    rows = found.withColumn("number", number).select(
        *plain.columns, "place", F.explode(F.element_at("entries", F.col("number"))["times"]).alias("time")
    )
    return rows.orderBy("time", "place").select(*plain.columns).toDF(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its part in the mix, sorted by the first time it is used; unused ones follow, spread by hash."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.try_element_at("times", F.lit(1))
    after = F.lit(1.0) + F.pmod("place", F.lit(1 << 30)) / F.lit(float(1 << 30))
    return mixed.orderBy(F.coalesce(first, after), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("first_time"), F.try_element_at("times", F.lit(2)).alias("second_time")
    )


QUERIES = {"op1_mixing": op1_mixing}
