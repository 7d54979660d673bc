"""Runs of words that repeat with a period, found through string synchronising sets.

A run is a stretch of words with smallest period q, at least TIMES periods and LEAST words long, that no neighbouring word
extends. All documents of a slice lie end to end. For each power of two t, a position is selected if, among the hashes of
the t words from it and from each of the next t positions, the least is its own or the last one's. Selection depends on the next
2t words only, so a run selects the same positions in each of its periods: for a period of t to 2t - 1, the next selected
position with the same 2t words stands one period later. Positions inside a stretch with a period of t / 3 or less are left out,
which bounds the number selected; those stretches are found on their own, by comparing each of every t / 8 positions
with the next t / 3, and propose their small periods. Every proposal is extended by binary search over hashes of
prefixes (two primes, so 62 bits), and each run's words are compared in the end.

Defined cases: a null text has no words; a null id changes nothing in the words; runs never cross documents; rows that share an id or
repeat are rows of their own; other columns are never read; a text of any length is one row's work, and its arrays grow in
proportion to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.llm.common import WHITE, mix, pick, slices, utf8, words

TIMES, LEAST = 4, 6
SLICE = 1_000_000  # bytes of text at a time
PRIMES = ((2_147_483_647, 1_186_372_391), (2_147_483_629, 903_481_771))  # moduli and bases of the hashes
_NEVER = np.uint64((1 << 64) - 1)


@cache
def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out


def _power(prime: int, base: int, n: int) -> np.ndarray:
    return _powers(prime, base, 1 << max(n, 1).bit_length())[:n]


class Hashes:
    """Hashes of any stretch of a sequence of numbers below 2**31."""

    def __init__(self, numbers: np.ndarray):
        self.parts = []
        for prime, base in PRIMES:
            p, n = np.uint64(prime), len(numbers)
            # The sum of n numbers below 2**31 fits 64 bits.
            sums = np.cumsum((mix(numbers.astype(np.uint64)) % p) * _power(prime, base, n) % p) % p
            self.parts.append((p, np.concatenate([np.zeros(1, np.uint64), sums]), _power(prime, pow(base, -1, prime), n + 1)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        found = [(sums[start + length] + p - sums[start]) % p * inverse[start] % p for p, sums, inverse in self.parts]
        return found[0] << np.uint64(32) | found[1]


def _least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width], for every i at which the window fits."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, _NEVER)]).reshape(-1, width)
    after = np.minimum.accumulate(padded, axis=1).ravel()
    before = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


class Sequence:
    """Documents end to end: `numbers` equal for equal words, and the end of its document for each position."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray):
        self.numbers, self.end, self.begin = numbers, np.repeat(np.cumsum(counts), counts), np.repeat(np.cumsum(counts) - counts, counts)
        self.hashes = Hashes(numbers)

    def _common(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far words `period` apart are equal from `at` on (or before it, going back), at most `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            start = at - middle if back else at
            same = self.hashes.of(start, middle) == self.hashes.of(start + period, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def stretches(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct maximal stretches (start, end, period) around words that recur one period after `at`."""
        ahead = self._common(at, period, self.end[at] - at - period, False)
        behind = self._common(at, period, at - self.begin[at], True)
        found = np.unique(np.stack([at - behind, at + period + ahead, period]), axis=1)
        return found[0], found[1], found[2]

    def periodic(self, t: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal stretches of t words or more with a period of t / 3 or less."""
        step, half, most = max(1, t // 8), t // 2, t // 3
        grid = where[where % step == 0]
        grid = grid[self.end[grid] - grid >= half + 1]
        own, period = self.hashes.of(grid, half), np.zeros(len(grid), np.int64)
        reach = np.minimum(most, self.end[grid] - grid - half)  # distances to look at
        if len(grid) < most:
            for k, (g, far) in enumerate(zip(grid.tolist(), reach.tolist())):
                same = np.flatnonzero(self.hashes.of(np.arange(g + 1, g + far + 1), half) == own[k])
                period[k] = same[0] + 1 if len(same) else 0
        else:
            for d in range(1, most + 1):
                open_ = np.flatnonzero((period == 0) & (reach >= d))
                period[open_[self.hashes.of(grid[open_] + d, half) == own[open_]]] = d
        hit = np.flatnonzero(period)
        # Neighbours on the grid with one period are in one stretch.
        first = np.ones(len(hit), bool)
        first[1:] = (grid[hit[1:]] != grid[hit[:-1]] + step) | (period[hit[1:]] != period[hit[:-1]])
        start, end, period = self.stretches(grid[hit[first]], period[hit[first]])
        long = end - start >= t
        return start[long], end[long], period[long]

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances at which a run's words recur; every run has one with its period."""
        n, t = len(self.numbers), 1
        left = self.end - np.arange(n)
        size = self.end - self.begin
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while n and size.max() >= TIMES * t:
            where = np.flatnonzero((size >= TIMES * t) & (left >= t))  # a run with a period of t or more needs as many words
            rank = np.full(n, _NEVER)
            rank[where] = mix(self.hashes.of(where, t)) >> np.uint64(1)
            if t >= 3:
                start, end, period = self.periodic(t, where)
                found.append((start, period))
                inside = np.zeros(n + 1, np.int64)
                np.add.at(inside, start, 1)
                np.add.at(inside, end - t + 1, -1)
                rank[np.cumsum(inside[:-1]) > 0] = _NEVER
            # Windows that cross documents come first or last only at positions that aren't kept.
            fits = where[left[where] >= 2 * t]
            least = _least_of_next(rank, t + 1)[fits] if n > t else np.zeros(0, np.uint64)
            fits = fits[: len(least)]
            chosen = fits[(least != _NEVER) & ((least == rank[fits]) | (least == rank[fits + t]))]
            context = self.hashes.of(chosen, 2 * t)
            order = np.argsort(context, kind="stable")
            at, context = chosen[order], context[order]
            distance = at[1:] - at[:-1]
            pair = (context[1:] == context[:-1]) & (distance < 2 * t)
            at, distance = at[:-1][pair], distance[pair]
            # Those whose words overlap and that have one distance are in one stretch.
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            first = np.ones(len(at), bool)
            first[1:] = (distance[1:] != distance[:-1]) | (at[1:] - at[:-1] > 2 * t)
            found.append((at[first], distance[first]))
            t *= 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, by start, then period."""
        start, end, period = self.stretches(*self.proposals())
        long = end - start >= np.maximum(LEAST, TIMES * period)
        start, end, period = start[long], end[long], period[long]
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
            if not np.array_equal(self.numbers[s : e - q], self.numbers[s + q : e]):
                raise ValueError("words with equal hashes differ")
        # A stretch with a period has it in all multiples too; its smallest counts.
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts, each with a blank behind it; numbers equal for equal words; words in each text."""
    closed = pc.binary_join_element_wise(texts.fill_null("").cast(pa.large_string()), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    data, at = utf8(closed)
    start, end, row = words(data, at, ~WHITE)
    kept = ~WHITE[data]
    kept[end] = True
    blank = data.copy()
    blank[end] = 0x20
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start + 1, out=offsets[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(blank[kept])])
    return found, found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(row, minlength=len(texts))


def _planted(n: int, h: int) -> np.ndarray | None:
    """Places that the words of a changed document come from."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]


def _rows(texts: pa.Array, seeds: list[int | None]) -> Iterator[tuple]:
    found, numbers, counts = tokens(texts)
    begin = np.cumsum(counts) - counts
    changed = [_planted(int(n), h) if h is not None else None for n, h in zip(counts, seeds)]
    place = np.arange(len(numbers))
    for b, n, p in zip(begin.tolist(), counts.tolist(), changed):
        if p is not None:
            place[b : b + n] = b + p
    start, end, period = Sequence(numbers[place], counts).runs()
    owner = np.searchsorted(begin + counts, start, side="right")
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    keep = np.cumsum(cover[:-1]) == 0
    text = found.take(pa.array(place[keep]))
    border = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
    body = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    ends = np.concatenate([[0], np.cumsum(keep)])[begin + counts].tolist()
    first = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
    at = 0
    for r, to in enumerate(ends):
        a, b = first[r], first[r + 1]
        lines = [(int(s) - int(begin[r]), int(e - s), int(q)) for s, e, q in zip(start[a:b], end[a:b], period[a:b])]
        longest = min(lines, key=lambda x: (-x[1], x[0], x[2])) if lines else None
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in lines).encode()).hexdigest()
        kept = hashlib.sha256(body[border[at] : border[to] - 1] if to > at else b"").hexdigest()
        yield (len(lines), *(longest or (None, None, None)), 1000 * longest[1] // longest[2] if longest else None, digest, kept)
        at = to


def runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, the longest run, digests of all runs and of the text without repeats) of every row.

    With `planted`, about a tenth of the documents, by a checksum of the id, first become periodic from some word on.
    """
    seed = F.crc32(F.col("doc_id").cast("string")) if planted else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in slices(batches, SLICE):
            rows = list(zip(*_rows(batch.column("text"), batch.column("seed").to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(rows, types)]], ["doc_id", *NAMES])

    return pick(docs, "doc_id", "text").withColumn("seed", seed).mapInArrow(run, f"doc_id long, {COLUMNS}")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
