"""Exact top-k search by whole-number inner product: branch and bound over columns.

Candidates are stored in blocks, column by column, the components with the largest sums of squares first. A block of
questions adds up its scores one group of columns at a time. What the unread columns can still add is at most the product
of the two remaining norms (Cauchy-Schwarz); a candidate that can't reach the k-th best score found so far is given up,
and the others are moved together before the next group is read. No bound ever exceeds what it bounds, so the result is
exact.

Defined cases (see also `whole_vectors`): rows that share an id never find each other; a repeated candidate row counts as
often as it occurs, a repeated question once, and two vectors of one id ask each for itself; zero vectors score 0; ties go
to the smaller id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm import whole_vectors as V
from relvec.session import materialize

K = 5
EVERY = 50
COLUMNS = 8  # components read at a time
SLAB = 64  # questions that share one list of candidates
FIRST = 256  # candidates of the first step, which only finds a first limit
SPARSE = 1 / 16  # share of wanted pairs below which they are scored one by one


def _remaining(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of what is unread before each group of columns, and after the last (0)."""
    squares = x.astype(np.float64) ** 2
    sums = np.add.reduceat(squares, edges[:-1], axis=1)
    return np.sqrt(np.column_stack([np.cumsum(sums[:, ::-1], axis=1)[:, ::-1], np.zeros(len(x))]))


def scan(q: np.ndarray, rest_q: np.ndarray, columns: list[np.ndarray], rest_x: np.ndarray, limit: np.ndarray, edges: list[int]):
    """(question, candidate, score) of all pairs that reach the question's limit. columns: one matrix for each group, a
    component in each row; rest_q and rest_x: remaining norms."""
    at = np.arange(columns[0].shape[1])
    score = np.zeros((len(q), len(at)), q.dtype)
    for g, column in enumerate(columns):
        score += q[:, edges[g] : edges[g + 1]] @ column[:, at]
        reach = score + rest_q[:, g + 1, None] * rest_x[at, g + 1] * (1 + 1e-9) + 1e-6
        wanted = reach >= limit[:, None]
        on = wanted.any(0)
        if on.sum() < 0.75 * len(at):
            at, score, wanted = at[on], score[:, on], wanted[:, on]
        if wanted.size and wanted.mean() < SPARSE:
            break
    i, j = np.nonzero(wanted)
    found = score[i, j]
    for g in range(g + 1, len(columns)):
        found = found + (q[i, edges[g] : edges[g + 1]] * columns[g][:, at[j]].T).sum(1)
        on = found + rest_q[i, g + 1] * rest_x[at[j], g + 1] * (1 + 1e-9) + 1e-6 >= limit[i]
        i, j, found = i[on], j[on], found[on]
    return i, at[j], found.astype(np.int64)


def _cell(asks: pa.Table, many: pa.Table, k: int, size: int) -> pa.Table:
    """The k best of one part of the candidates for each question of a block."""
    ids, askers = V.numbers(asks, "ids", np.int64), V.numbers(asks, "askers", np.int64)
    q = V.numbers(asks, "x", np.int32, size)
    edges = [*range(0, size, COLUMNS), size]
    best, rest_q = V.Best(len(ids), k), _remaining(q, edges) if len(q) else np.zeros((0, len(edges)))
    for row in range(many.num_rows if len(ids) else 0):
        block = many.slice(row, 1)
        own = V.numbers(block, "ids", np.int64)
        whole = [np.frombuffer(c, np.int32).reshape(-1, len(own)) for c in block.column("columns")[0].as_py()]
        rest_x = _remaining(np.concatenate(whole).T, edges)
        exact = np.float64 if V.require_whole(rest_q[:, 0], rest_x[:, 0]) < 2**52 else np.int64  # sums of doubles are exact
        columns, asked = [c.astype(exact) for c in whole], q.astype(exact)
        steps = [0, FIRST, len(own)] if len(own) > FIRST else [0, len(own)]
        for a, b in zip(steps, steps[1:]):
            part = [c[:, a:b] for c in columns]
            for s in range(0, len(ids), SLAB):
                to = slice(s, s + SLAB)
                i, j, found = scan(asked[to], rest_q[to], part, rest_x[a:b], best.limit[to], edges)
                other = ids[to][i] != own[a:b][j]
                best.add(i[other] + s, own[a:b][j[other]], found[other])
    return pa.table({
        "query_id": pa.array(ids[best.question]), "asker": pa.array(askers[best.question]), "vec_id": pa.array(best.id), "score": pa.array(best.score),
    })


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all others."""
    rows, size = V.usable(vectors)
    rows = materialize(rows, "whole")
    n = rows.count()
    order = np.argsort(-np.array(V.energies(rows, size)), kind="stable")
    edges = [*range(0, size, COLUMNS), size]

    def vertical(table: pa.Table) -> dict:
        x = V.matrix(table.column("x"), size)[:, order].astype(np.int32)
        columns = [np.ascontiguousarray(x[:, a:b].T).tobytes() for a, b in zip(edges, edges[1:])]
        return {"ids": table.column("vec_id").to_numpy().astype(np.int64).tobytes(), "columns": columns}

    def asked(table: pa.Table) -> dict:
        x = V.matrix(table.column("x"), size)[:, order].astype(np.int32)
        return {"ids": table.column("vec_id").to_numpy().astype(np.int64).tobytes(), "askers": table.column("asker").to_numpy().tobytes(), "x": x.tobytes()}

    many = materialize(V.blocks(rows, max(1, V.NUMBERS_IN_BLOCK // size), vertical, "ids binary, columns array<binary>"), "columns")
    questions = materialize(rows.where(F.col("vec_id") % every == 0).withColumn("asker", F.xxhash64("vec_id", "x")).dropDuplicates(["vec_id", "asker"]), "questions")
    n_asks = questions.count()
    asks = V.ask_blocks(questions, n_asks, asked, "ids binary, askers binary, x binary")
    found = V.cells(asks, many, n_asks, n).applyInArrow(lambda a, b: _cell(a, b, k, size), "query_id long, asker long, vec_id long, score long")
    by = W.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_columnar_topk": op11_columnar_topk}
ORACLE = {"op11_columnar_topk": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), common AS (SELECT len(x) AS n FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
whole AS (SELECT vec_id, x FROM sound WHERE len(x) = (SELECT n FROM common)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""}
