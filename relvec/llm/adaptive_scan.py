"""Nearest neighbours by inner product: an adaptive dimension scan inside probed lists.

One more component makes all vectors equally long, so that the largest inner product is the smallest distance. A random
rotation spreads distance evenly over the dimensions. Lists are cut around centroids fitted on a bounded sample; every
vector is in one list, and a query probes the nearest PROBED share of them. Its nearest list gives the query a first
limit, the distance of its k-th candidate there. In the other lists the rotated columns are read block by block; after
each block a candidate whose partial distance is too large for the limit, by a test of its expectation, is abandoned.
What is left is scored on the original vectors in double precision.

Lists and their queries are cut into blocks, so a list with a third of all rows is many groups. Probing and the test
make the result approximate (tests hold recall at 0.9 or more); a found score is always exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, and neither do those
whose length isn't the most common one; null ids take no part; rows that share an id never find each other; ties go to
the smaller id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.llm.common import pick
from relvec.session import materialize

K = 20
SAMPLE = 20_000  # vectors that centroids are fitted on
ROUNDS = 8
PROBED = 0.8
FIRST_COLUMNS, COLUMNS = 32, 16  # of the first block, which is one matrix product, and of the others
CERTAINTY = 3.0  # deviations by which a partial distance must exceed its expectation
CANDIDATES, QUERIES_AT_ONCE = 4096, 1024
SEED = 11


def list_count(n: int) -> int:
    return max(8, round(n**0.5 / 4))


@cache
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _even(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates, with the component that makes them all `longest` long."""
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0.0))])


def _centroids(x: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centre = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
        sums, counts = np.zeros_like(centre), np.bincount(own, minlength=len(centre))
        np.add.at(sums, own, x)
        centre = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centre)
    return centre


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(sound & F.exists(x, lambda v: v != 0)).select("vec_id", F.col("embedding").alias("x"))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (common[0]["n"] if common else -1))


def _scan(pairs: pa.Table, targets: pa.Table, k: int, longest: float) -> pa.Table:
    """The k best candidates of each query in one block of a list."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not pairs.num_rows or not targets.num_rows:
        return empty
    ids, x = targets.column("vec_id").to_numpy(), _matrix(targets.column("x"))
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    query_ids, q, limit = pairs.column("query_id").to_numpy(), _matrix(pairs.column("q")), pairs.column("limit").to_numpy()
    size = x.shape[1] + 1
    turn = rotation(size)
    far, near = _even(x, longest) @ turn, np.column_stack([q, np.zeros(len(q))]) @ turn
    edges = [0, *range(min(FIRST_COLUMNS, size), size, COLUMNS), size]
    blocks = [slice(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    a, b = near[:, blocks[0]], far[:, blocks[0]]
    first = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0)

    def bound(read: int) -> np.ndarray:
        # After a random rotation, `read` of `size` columns hold read/size of a distance, with this relative deviation.
        deviation = (2 * (size - read) / (read * (size + 2))) ** 0.5
        return (1 + CERTAINTY * deviation) * read / size * limit * (1 + 1e-9) + 1e-12

    i, j = np.nonzero((first <= bound(blocks[0].stop)[:, None]) & (query_ids[:, None] != ids))
    partial = first[i, j]
    for block in blocks[1:]:
        step = near[i, block] - far[j, block]
        partial += (step * step).sum(1)
        on = partial <= bound(block.stop)[i]
        i, j, partial = i[on], j[on], partial[on]
    score = np.empty(len(i))
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        score[part] = (q[i[part]] * x[j[part]]).sum(1)
    best = np.lexsort((ids[j], -score, i))
    i, j, score = i[best], j[best], score[best]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    top = place < k
    return pa.table({"query_id": pa.array(query_ids[i[top]]), "vec_id": pa.array(ids[j[top]]), "score": pa.array(score[top])})


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, probed: float = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all others."""
    rows = materialize(usable(vectors), "vectors")
    n, square = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).first()
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    longest, lists = square**0.5, list_count(n)
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, int(SAMPLE / n * (1 << 30)) + 1))
    sample = np.array([r[0] for r in rows.where(share).orderBy("vec_id").select("x").limit(2 * SAMPLE).collect()], np.float64)
    centre = _centroids(_even(sample, longest), lists)
    probes = max(1, round(probed * len(centre)))

    def lists_of(batches, count: int, query: bool):
        for batch in batches:
            x = _matrix(batch.column("x"))
            x = np.column_stack([x, np.zeros(len(x))]) if query else _even(x, longest)
            near = np.argsort(-(x @ centre.T - 0.5 * (centre * centre).sum(1)), axis=1, kind="stable")[:, :count]
            at = pa.array(np.arange(0, near.size + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(near.ravel().astype(np.int32)))], ["vec_id", "x", "lists"])

    kind = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    placed = rows.mapInArrow(lambda b: lists_of(b, 1, False), kind).select("vec_id", "x", F.col("lists")[0].alias("list"))
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(lambda b: lists_of(b, probes, True), kind)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.posexplode("lists").alias("probe", "list"))
    placed, asked = materialize(placed, "placed"), materialize(asked, "asked")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("parts"))
    # One row per list; lists are about a quarter of the root of the rows, and a shuffled join serves as well.
    sizes = sizes.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("asks")), "list")
    sizes = materialize(sizes, "list-sizes")
    candidates = placed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    candidates = candidates.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("list", "part", "ask", "vec_id", "x")
    key = ["list", "part", "ask"]

    def found(questions: DataFrame) -> DataFrame:
        dealt = questions.join(sizes, "list").withColumn("ask", F.pmod(F.xxhash64("query_id"), "asks").cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "query_id", "q", "limit")
        return dealt.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(
            lambda a, b: _scan(a, b, k, longest), "query_id long, vec_id long, score double"
        )

    nearest = materialize(found(asked.where("probe = 0").withColumn("limit", F.lit(float("inf")))), "nearest")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    worst = nearest.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    limit = F.when(F.col("least").isNull(), float("inf")).otherwise(norm + longest**2 - 2 * F.col("least"))
    others = asked.where("probe > 0").join(worst, "query_id", "left").withColumn("limit", limit)
    every_list = nearest.unionByName(found(others))
    return every_list.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_adaptive_scan": op6_adaptive_scan}
