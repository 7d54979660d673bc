"""Hard negatives: one-bit codes with stored alignment give intervals of scores; what they leave open is scored whole.

A vector is rotated and cut to its signs, the code. The alignment, the inner product of the code and the vector, is
stored with it; what the code leaves of the vector has a code and an alignment of its own, LEVELS in all, and the norm of
the last rest is stored too. An anchor is rotated and rounded to eight bits for each component, stored as bit planes, so
its inner product with a code is a few population counts of planes and code. The sum of these products by alignment
estimates the score; it is wrong by at most the rounding error times the alignments plus the norms of the rest and of the
anchor (Cauchy-Schwarz). Pairs whose interval can't hold an answer go after each level; the rest get their whole-number score.

Positives are found first, as the best of the same label; each then asks for the best of the other labels in its window.

Defined cases (see also `whole_vectors`): rows without a label take no part; rows that share an id are no answers to each
other; a repeated row counts as often as it occurs among the answers and asks once, and two rows of one id ask each for
itself; anchors without positives, and positives whose window is empty, give no rows; zero vectors score 0; ties go to the
smaller id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm import whole_vectors as V
from relvec.llm.adaptive_scan import rotation
from relvec.session import materialize

EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LEVELS = 4
PLANES = 8
SLAB = 32  # anchors that are compared with a block at a time
FIRST = 256  # candidates of the first step, which only finds first limits
ROUNDING = 1e-9  # of double arithmetic, relative to the two norms


def _bits(on: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(on, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the codes by (row, level), alignments by (row, level), and norms by (row, level) of what is left; both with
    the vector's own norm."""
    size = x.shape[1]
    rest = x.astype(np.float64) @ rotation(size)
    words, aligned, left = [], [], []
    for _ in range(LEVELS):
        up = rest >= 0
        words.append(_bits(up))
        aligned.append(np.abs(rest).sum(1) / np.sqrt(size))
        rest = rest - np.where(up, 1.0, -1.0) * (aligned[-1] / np.sqrt(size))[:, None]
        left.append(np.sqrt((rest * rest).sum(1)))
    return np.stack(words, 1), np.stack(aligned, 1), np.stack(left, 1)


class Planes:
    """Rotated anchors rounded to PLANES bits for each component."""

    def __init__(self, q: np.ndarray):
        self.size = q.shape[1]
        turned = q.astype(np.float64) @ rotation(self.size)
        self.norm, self.low = V.norms(q), turned.min(1, initial=0.0)
        self.step = (turned.max(1, initial=0.0) - self.low) / ((1 << PLANES) - 1)
        whole = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        off = turned - self.low[:, None] - whole * self.step[:, None]
        self.error, self.sum = np.sqrt((off * off).sum(1)), whole.sum(1)
        self.planes = [_bits((whole >> t & 1).astype(bool)) for t in range(PLANES)]

    def dot(self, i: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Inner products of rounded anchors i with the unit codes `words`."""
        inside = np.zeros(len(i), np.int64)
        for t, plane in enumerate(self.planes):
            inside += np.bitwise_count(plane[i] & words).sum(1, dtype=np.int64) << t
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        return (self.step[i] * (2 * inside - self.sum[i]) + self.low[i] * (2 * ones - self.size)) / np.sqrt(self.size)


def filtered(planes: Planes, i: np.ndarray, j: np.ndarray, words: np.ndarray, aligned: np.ndarray, left: np.ndarray, norm: np.ndarray, wanted):
    """The pairs (anchor i, candidate j) whose interval is `wanted(i, low, high)` at every level."""
    middle, error = np.zeros(len(i)), ROUNDING * (planes.norm[i] * norm[j] + 1)
    for level in range(LEVELS):
        part = aligned[j, level]
        middle = middle + part * planes.dot(i, words[j, level])
        error = error + part * planes.error[i]
        half = error + left[j, level] * planes.norm[i]
        on = wanted(i, middle - half, middle + half)
        i, j, middle, error = i[on], j[on], middle[on], error[on]
    return i, j


def _cell(asks: pa.Table, many: pa.Table, size: int, k: int, windows: int) -> pa.Table:
    """The k best answers of one part of the candidates to each question of a block of anchors.

    Without windows an anchor asks one question, for rows of its label. With windows it asks one question in each, for
    rows of other labels; windows that aren't used hold no score.
    """
    ids, askers, labels = (V.numbers(asks, c, np.int64) for c in ("ids", "askers", "labels"))
    q = V.numbers(asks, "x", np.int32, size).astype(np.int64)
    each = max(1, windows)
    low, high = np.full((len(ids), each), -V.LIMIT), np.full((len(ids), each), V.LIMIT)
    if windows:
        low, high = V.numbers(asks, "low", np.int64, windows), V.numbers(asks, "high", np.int64, windows)
    best = V.Best(len(ids) * each, k)
    for row in range(many.num_rows if len(ids) else 0):
        block = many.slice(row, 1)
        own, own_labels, x = V.numbers(block, "ids", np.int64), V.numbers(block, "labels", np.int64), V.numbers(block, "x", np.int32, size).astype(np.int64)
        words = V.numbers(block, "words", np.uint64).reshape(len(own), LEVELS, -1)
        aligned, left = V.numbers(block, "aligned", np.float64, LEVELS), V.numbers(block, "rest", np.float64, LEVELS)
        norm = V.norms(x)
        V.require_whole(V.norms(q), norm)
        steps = [0, FIRST, len(own)] if len(own) > FIRST else [0, len(own)]
        for a, b in zip(steps, steps[1:]):
            for s in range(0, len(ids), SLAB):
                to = slice(s, s + SLAB)
                fits = (labels[to, None] != own_labels[a:b]) if windows else (labels[to, None] == own_labels[a:b])
                i, j = np.nonzero(fits & (ids[to, None] != own[a:b]))
                least = np.maximum(low[to], best.limit.reshape(-1, each)[to])

                def wanted(i, down, up):
                    return ((up[:, None] >= least[i]) & (down[:, None] <= high[to][i])).any(1)

                i, j = filtered(Planes(q[to]), i, j + a, words, aligned, left, norm, wanted)
                score = (q[to][i] * x[j]).sum(1)
                for w in range(each):
                    on = (score >= least[i, w]) & (score <= high[to][i, w])
                    best.add((i[on] + s) * each + w, own[j[on]], score[on])
    anchor, place = best.question // each, best.question % each
    return pa.table({
        "anchor_id": pa.array(ids[anchor]), "asker": pa.array(askers[anchor]), "place": pa.array(place.astype(np.int32)),
        "vec_id": pa.array(best.id), "score": pa.array(best.score),
    })


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see the module's text.

    Negatives score from 50 to 95 percent of their positive.
    """
    rows, size = V.usable(vectors, "label")
    label = F.col("label").cast("long")
    rows = materialize(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)), "whole")
    n = rows.count()
    longs = lambda table, *names: {f"{c}s": table.column(c).to_numpy().astype(np.int64).tobytes() for c in names}
    same = lambda table: {**longs(table.rename_columns({"vec_id": "id"}), "id", "label"), "x": V.matrix(table.column("x"), size).astype(np.int32).tobytes()}

    def coded(table: pa.Table) -> dict:
        words, aligned, left = codes(V.matrix(table.column("x"), size))
        return {**same(table), "words": words.tobytes(), "aligned": aligned.tobytes(), "rest": left.tobytes()}

    def asked(table: pa.Table) -> dict:
        return {**same(table), **longs(table, "asker")}

    def windowed(table: pa.Table) -> dict:
        low, high = np.full((table.num_rows, positives), V.LIMIT), np.full((table.num_rows, positives), -V.LIMIT)
        for r, scores in enumerate(table.column("scores").to_pylist()):
            s = np.array(scores, np.int64)
            low[r, : len(s)], high[r, : len(s)] = -(-s // 2), s // 100 * 95 + s % 100 * 95 // 100
        return {**asked(table), "low": low.tobytes(), "high": high.tobytes()}

    kind, out = "ids binary, labels binary, x binary", "anchor_id long, asker long, place int, vec_id long, score long"
    many = materialize(V.blocks(rows, max(1, V.NUMBERS_IN_BLOCK // size), coded, f"{kind}, words binary, aligned binary, rest binary"), "codes")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("asker", F.xxhash64("vec_id", "label", "x")).dropDuplicates(["vec_id", "asker"])
    anchors = materialize(anchors, "anchors")
    n_asks = anchors.count()
    asks = V.ask_blocks(anchors, n_asks, asked, f"{kind}, askers binary")
    found = V.cells(asks, many, n_asks, n).applyInArrow(lambda a, b: _cell(a, b, size, positives, 0), out)
    nearest = W.partitionBy("anchor_id", "asker").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(nearest) - 1).where(F.col("place") < positives)
    best = materialize(best, "positives")
    scores = best.groupBy(F.col("anchor_id").alias("vec_id"), "asker").agg(F.array_sort(F.collect_list(F.struct("place", "score")))["score"].alias("scores"))
    asking = anchors.join(scores, ["vec_id", "asker"])
    asks = V.ask_blocks(asking, n_asks, windowed, f"{kind}, askers binary, low binary, high binary")
    found = V.cells(asks, many, n_asks, n).applyInArrow(lambda a, b: _cell(a, b, size, negatives, positives), out)
    nearest = W.partitionBy("anchor_id", "asker", "place").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    pairs = best.select("anchor_id", "asker", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return top.join(pairs, ["anchor_id", "asker", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_one_bit_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_one_bit_mining": op12_one_bit_mining}
ORACLE = {"op12_one_bit_mining": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), common AS (SELECT len(x) AS n FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
whole AS (SELECT vec_id, x, label FROM sound WHERE len(x) = (SELECT n FROM common)),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""}
