"""Vectors of whole numbers, packed into blocks, and the best answers to each question.

Vectors take part if they and their ids are not null, they are not empty, all components are finite, and their length is
the most common one (the smallest of equally common ones). Components are scaled and rounded down; a scaled component of
2**31 or more, or a score that 64 bits can't hold, fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvec.llm.common import pick

SCALE = 256
LIMIT = 1 << 62
LEAST_PARTS, ROWS_IN_PART = 16, 1 << 17
ASKS_AT_ONCE = 1024
NUMBERS_IN_BLOCK = 1 << 17


def usable(vectors: DataFrame, *others: str) -> tuple[DataFrame, int]:
    """(vec_id, others, x) of the vectors that take part, whole, and their length; other rows with nulls in `others` go."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = pick(vectors, "vec_id", *others, "embedding").dropna().where(sound & (F.size("embedding") > 0))
    scaled = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    large = F.exists("embedding", lambda v: F.abs(v.cast("double")) >= float((1 << 31) // SCALE))
    failure = F.raise_error(F.lit("a component is too large for whole-number scores")).cast("array<int>")
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = common[0]["n"] if common else 1
    whole = F.when(large, failure).otherwise(scaled.cast("array<int>")).alias("x")
    return rows.where(F.size("embedding") == size).select("vec_id", *others, whole), size


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, size)


def blocks(rows: DataFrame, most: int, lay: Callable[[pa.Table], dict[str, bytes | list[bytes]]], kind: str) -> DataFrame:
    """One row for each `most` rows of a partition: `block`, a number of its own, and what `lay` makes of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def packed() -> pa.RecordBatch:
            laid = lay(pa.Table.from_batches(held))
            return pa.RecordBatch.from_pydict({"block": pa.array([first + made], pa.int64()), **{c: pa.array([v]) for c, v in laid.items()}})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, most - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == most:
                    yield packed()
                    made, held, n = made + 1, [], 0
        if n:
            yield packed()

    return rows.mapInArrow(run, f"block long, {kind}")


def cells(asks: DataFrame, many: DataFrame, n_asks: int, n: int):
    """Each block of questions beside each part of the candidates, once. The parts follow the number of rows `n` only, so
    there are few answers to merge, and a part is a list of blocks that a task can hold."""
    parts, groups = max(LEAST_PARTS, -(-n // ROWS_IN_PART)), max(1, -(-n_asks // ASKS_AT_ONCE))
    number = lambda of: F.pmod(F.xxhash64("block"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = asks.withColumn("ask", number(groups)).withColumn("part", each(parts))
    right = many.withColumn("part", number(parts)).withColumn("ask", each(groups))
    return left.groupBy("part", "ask").cogroup(right.groupBy("part", "ask"))


def ask_blocks(asks: DataFrame, n_asks: int, lay: Callable[[pa.Table], dict[str, bytes]], kind: str) -> DataFrame:
    return blocks(asks.repartition(max(1, -(-n_asks // ASKS_AT_ONCE)), "asker"), ASKS_AT_ONCE, lay, kind)


def numbers(table: pa.Table, column: str, kind: type, size: int | None = None) -> np.ndarray:
    """Values of packed bytes of all rows, end to end."""
    whole = np.frombuffer(b"".join(table.column(column).to_pylist()), kind)
    return whole if size is None else whole.reshape(-1, size)


class Best:
    """The k answers of each question with the highest scores, ties by smaller id."""

    def __init__(self, questions: int, k: int):
        self.k, self.limit = k, np.full(questions, -LIMIT, np.int64)  # score of the k-th answer so far
        self.question, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, question: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        if not len(question):
            return
        q, i, s = np.concatenate([self.question, question]), np.concatenate([self.id, id_]), np.concatenate([self.score, score])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.question, self.id, self.score = q[top], i[top], s[top]
        last = place == self.k - 1
        self.limit[q[last]] = s[last]


def require_whole(a: np.ndarray, b: np.ndarray) -> float:
    """The largest score that vectors of these norms can have; it must fit 64 bits."""
    most = float(a.max(initial=0.0)) * float(b.max(initial=0.0))
    if most >= LIMIT:
        raise ValueError("a score is too large for 64 bits")
    return most


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def energies(rows: DataFrame, size: int) -> Sequence[float]:
    """Sum of squares of each component over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = matrix(batch.column(0), size).astype(np.float64)
            total += (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size, dtype=np.int32)), "e": total})

    found = rows.select("x").mapInArrow(run, "at int, e double").groupBy("at").agg(F.sum("e").alias("e")).orderBy("at").collect()
    return [r["e"] for r in found]  # one number for each component
