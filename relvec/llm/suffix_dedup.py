"""Exact substring deduplication: every byte under a string of LENGTH bytes that also starts earlier goes.

Sparse anchors find where strings may repeat. Of the GRAM-byte hashes inside a string's LENGTH bytes, the smallest is its
anchor; neighbouring strings mostly share one, and equal strings have equal anchors at equal offsets. The strings of one
anchor are a cell, so a cell stands for dozens of suffixes. Anchors whose hash occurs once are done with. Cells with
equal content repeat as a whole, all but the first; their content is told by two hashes of independent bases, 128 bits
together, beside the anchor's. What is left are cells that share an anchor but differ further out,
such as those at the ends of a copied passage: their suffixes are sorted, all that have one anchor and offset together,
by a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
hashes; equal neighbours are verified byte by byte.

Map tasks merge what they can before anything moves: of equal cells only the first, and one cell per anchor to ask for
repeats. Anchors with very many different cells are split by a hash of the content; strings that are first in their
part are then packed by hash and compared whole across parts.

Order: smaller id (null last), then earlier start, then a hash of the text for texts that share an id. Defined cases: a
null text is empty; texts below LENGTH bytes lose nothing; repeated rows are one document and get equal results; empty
tables give no rows; other columns are never read. Texts are bytes of UTF-8 and no string crosses documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm.common import BASE_INVERSE, OTHER_BASE, OTHER_INVERSE, mix, pick, powers, prefix_hashes, slices, span_hashes, utf8
from relvec.session import materialize, shuffle_partitions, shuffles_dropped

LENGTH, GRAM = 100, 20
WINDOW = LENGTH - GRAM + 1  # hashes that a string's anchor is chosen from
PLACE_BITS = 16  # of a hash that give way to a place; windows are found in blocks of as many places
SLICE_BYTES = 500_000  # of text whose cells are found at once
FLUSH = 1_000_000  # cells that a map task merges at once
PART = 4096  # cells of one anchor in a part
SORTED_AT_ONCE = 8192  # cells whose suffixes are sorted together, and at least one part
BUCKETS_PER_PARTITION = 4
_LAST = (1 << 63) - 1
_LAYOUT = (("id", np.int64), ("tie", np.int64), ("p", np.int32), ("n", np.uint8), ("off", np.uint8), ("known", np.uint8), ("h", np.uint64), ("ch", np.uint64), ("cg", np.uint64))
_WIDTH = sum(np.dtype(k).itemsize for _, k in _LAYOUT)
ASK, CELL, REPEAT = 0, 1, 2  # kinds of packed rows

Cells = dict[str, np.ndarray]


def _anchors(h: np.ndarray) -> np.ndarray:
    """Place of the smallest of WINDOW hashes from each place on; of hashes that differ in their last PLACE_BITS only, the leftmost.

    A place is kept in the low bits of its hash, so one minimum finds both; blocks are short enough to stay near the processor.
    """
    out = np.empty(len(h) - WINDOW + 1, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - WINDOW + 1
    place = np.arange(1 << PLACE_BITS, dtype=np.uint64)
    for begin in range(0, len(out), step):
        value = h[begin : begin + (1 << PLACE_BITS)] & ~low
        value |= place[: len(value)]
        size = 1
        while size * 2 <= WINDOW:
            value = np.minimum(value[size:], value[:-size])
            size *= 2
        if WINDOW > size:
            value = np.minimum(value[WINDOW - size :], value[: size - WINDOW])
        np.add(value & low, np.uint64(begin), out=out[begin : begin + step].view(np.uint64))
    return out


def cells_of(data: np.ndarray, at: np.ndarray) -> Cells:
    """Cells of every text: row, first string's start in its text, number of strings, anchor offset, hashes."""
    counts = np.maximum(np.diff(at) - LENGTH + 1, 0)
    if not counts.sum():
        return {k: np.zeros(0, t) for k, t in (("row", np.int64), ("p", np.int64), ("n", np.int64), ("off", np.int64), ("h", np.uint64), ("ch", np.uint64), ("cg", np.uint64))}
    prefix, inverse = prefix_hashes(data), powers(BASE_INVERSE, len(data) + 1)
    other, other_inverse = prefix_hashes(data, OTHER_BASE), powers(OTHER_INVERSE, len(data) + 1)
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts)
    anchor = _anchors(h)[place]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(row)))
    start, row, anchor = place[first], row[first], anchor[first].astype(np.int64)
    return {
        "row": row, "p": start - at[row], "n": n, "off": anchor - start, "h": h[anchor],
        "ch": span_hashes(prefix, start, start + n - 1 + LENGTH, inverse),
        "cg": span_hashes(other, start, start + n - 1 + LENGTH, other_inverse),
    }


def _packed(cells: Cells, kind: int, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    press = zstandard.ZstdCompressor(level=1)
    for part in np.split(order, cuts) if len(order) else []:
        yield kind, int(bucket[part[0]]), press.compress(b"".join(cells[k][part].astype(t).tobytes() for k, t in _LAYOUT))


def _unpacked(blobs: list[bytes]) -> Cells:
    open_ = zstandard.ZstdDecompressor()
    columns: dict[str, list[np.ndarray]] = {k: [] for k, _ in _LAYOUT}
    for blob in blobs:
        raw = open_.decompress(blob)
        n, at = len(raw) // _WIDTH, 0
        for k, t in _LAYOUT:
            columns[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, dict(_LAYOUT)[k]) for k, v in columns.items()}


def _merged(cells: Cells, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Merge the cells of a map task, and pack what is to move."""
    take = lambda rows: {k: v[rows] for k, v in cells.items()}
    h = cells["h"]
    order = np.argsort(h)
    twin = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[order[1:][twin]] = shared[order[:-1][twin]] = True
    ask, cell, repeat = [np.flatnonzero(~shared)], np.zeros(0, np.int64), np.zeros(0, np.int64)
    several = np.flatnonzero(shared)
    if len(several):
        c = take(several)
        order = np.lexsort((c["tie"], c["p"], c["id"], c["cg"], c["ch"], c["h"]))
        several, c = several[order], {k: v[order] for k, v in c.items()}
        new_h = np.append(True, c["h"][1:] != c["h"][:-1])
        new = new_h | np.append(True, (c["ch"][1:] != c["ch"][:-1]) | (c["cg"][1:] != c["cg"][:-1]))
        leader = np.flatnonzero(new)
        own = leader[np.cumsum(new) - 1]
        same = (c["id"] == c["id"][own]) & (c["p"] == c["p"][own]) & (c["tie"] == c["tie"][own])
        repeat = several[~same]
        group = np.cumsum(new_h)[leader] - 1  # anchor of each different cell
        many = np.bincount(group)[group] > 1
        head = np.append(True, group[1:] != group[:-1])
        cells["known"][several[leader[many]]] = 1
        ask.append(several[leader[head]])
        cell = several[leader[~head]]
    ask = np.sort(np.concatenate(ask))
    for rows, kind in ((ask, ASK), (np.sort(cell), CELL), (np.sort(repeat), REPEAT)):
        part = take(rows)
        key = part["h"] if kind == ASK else mix(part["h"] ^ part["ch"])
        yield from _packed(part, kind, ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))


def repeated_cells(docs: DataFrame) -> DataFrame:
    """(id, tie, p, n, off, h, ch, cg, repeat): cells whose anchor occurs again; `repeat` marks those known to be repeats.

    docs: (id, tie, text).
    """
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS_PER_PARTITION * partitions

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Cells] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(_merged({k: np.concatenate([c[k] for c in held]) for k in held[0]}, buckets))
                held.clear()
                for i in range(0, len(rows), 100):
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows[i : i + 100]), (pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "cells"])

        for batch in slices(batches, most=SLICE_BYTES):
            found = cells_of(*utf8(batch.column("text")))
            row = found.pop("row")
            if len(row):
                found |= {k: batch.column(k).to_numpy()[row] for k in ("id", "tie")}
                found["known"] = np.zeros(len(row), np.uint8)
                held.append(found)
            if sum(len(c["h"]) for c in held) >= FLUSH:
                yield from flush()
        yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[bytes] = []

        def out(c: Cells, repeat: bool) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(c["h"]), 200_000):
                part = {k: v[i : i + 200_000] for k, v in c.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["id"]), pa.array(part["tie"]), *[pa.array(part[k].astype(np.int32)) for k in ("p", "n", "off")],
                     pa.array(part["h"].view(np.int64)), *[pa.array(part[k].view(np.int64)) for k in ("ch", "cg")], pa.array(np.full(len(part["h"]), repeat))],
                    ["id", "tie", "p", "n", "off", "h", "ch", "cg", "repeat"],
                )

        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("cells")):
                if kind == ASK:
                    asked.append(blob.as_py())
                else:
                    yield from out(_unpacked([blob.as_py()]), kind == REPEAT)
        c = _unpacked(asked)
        order = np.argsort(c["h"])
        twin = c["h"][order[1:]] == c["h"][order[:-1]]
        keep = c["known"] > 0
        keep[order[1:][twin]] = True
        keep[order[:-1][twin]] = True
        yield from out({k: v[keep] for k, v in c.items()}, False)

    packed = docs.mapInArrow(find, "kind int, bucket int, cells binary").repartition(partitions, "bucket")
    return packed.mapInArrow(resolve, "id long, tie long, p int, n int, off int, h long, ch long, cg long, repeat boolean")


class _Suffixes:
    """Suffixes of joined contexts, compared over LENGTH bytes by their prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.prefix = data, prefix_hashes(data)
        self.inverse = powers(BASE_INVERSE, len(data) + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        p = self.prefix
        return (p[a + n] - p[a]) * self.inverse[a] == (p[b + n] - p[b]) * self.inverse[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most LENGTH, by binary search."""
        p = self.prefix
        (pa_, ia), (pb, ib) = ((p[x], self.inverse[x]) for x in (a, b))
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = (p[a + middle] - pa_) * ia == (p[b + middle] - pb) * ib
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        out = or_equal.copy()
        differ = np.flatnonzero(~self.equal(a, b, LENGTH))  # suffixes that are equal as a whole need no search
        a, b = a[differ], b[differ]
        at = np.minimum(self.common(a, b), LENGTH - 1)
        out[differ] = self.data[a + at] < self.data[b + at]
        return out

    def heads(self, start: np.ndarray) -> np.ndarray:
        """The first eight bytes of each suffix as a number in their order."""
        out = np.zeros(len(start), np.uint64)
        for i in range(8):
            out = (out << np.uint64(8)) | self.data[start + i]
        return out

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        span = np.arange(LENGTH)
        for i in range(0, len(a), 50_000):
            part = slice(i, i + 50_000)
            out[part] = (self.data[a[part, None] + span] == self.data[b[part, None] + span]).all(1)
        return out


def sort_suffixes(suffixes: _Suffixes, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside their segments; `segment` is ascending. Those that differ in their first eight bytes are ordered
    by these; the others by a bottom-up mergesort of all at once."""
    head = suffixes.heads(start)
    order = np.lexsort((head, segment))
    head = head[order]
    first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (head[1:] != head[:-1])))
    size = np.diff(np.append(first, len(start)))
    base, limit = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while width < (size.max() if len(size) else 0):
        at = np.flatnonzero(limit > width)  # segments that aren't one run yet
        inside = at - base[at]
        block = inside // (2 * width) * (2 * width)
        is_right = inside - block >= width
        # Rank in the other run: of a right suffix after its equals, of a left one before them.
        low = base[at] + np.where(is_right, block, np.minimum(block + width, limit[at]))
        begin = low.copy()
        high = base[at] + np.where(is_right, block + width, np.minimum(block + 2 * width, limit[at]))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            before = suffixes.less(start[order[middle]], start[order[at[open_]]], is_right[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        to = base[at] + block + (inside - block - np.where(is_right, width, 0)) + (low - begin)
        moved = order.copy()
        moved[to] = order[at]
        order = moved
        width *= 2
    return order


def _resolved(table: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Repeats among the strings of cells that share an anchor, and the first strings of anchors in several parts.

    The latter are packed by a hash of the string: `p` is the bucket, and `strings` holds them with their places.
    """
    data, at = utf8(table.column("content").combine_chunks())
    c = {k: table.column(k).to_numpy() for k in ("id", "tie", "p", "n", "off", "h", "part", "parts")}
    group = np.cumsum(np.append(True, (c["h"][1:] != c["h"][:-1]) | (c["part"][1:] != c["part"][:-1]))) - 1
    rank = np.empty(len(group), np.int64)
    ordered = np.lexsort((c["tie"], c["p"] + c["off"], c["id"]))
    keys = [c["id"][ordered], (c["p"] + c["off"])[ordered], c["tie"][ordered]]
    rank[ordered] = np.cumsum(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    cell = np.repeat(np.arange(len(group)), c["n"])
    shift = np.arange(len(cell)) - np.repeat(np.cumsum(c["n"]) - c["n"], c["n"])
    start = at[cell] + shift
    segment = group[cell] * LENGTH + (c["off"][cell] - shift)
    by = np.argsort(segment, kind="stable")
    suffixes = _Suffixes(data)
    order = by[sort_suffixes(suffixes, start[by], segment[by])]
    left, right = order[:-1], order[1:]
    pair = np.flatnonzero(segment[left] == segment[right])
    pair = pair[suffixes.equal(start[left[pair]], start[right[pair]], LENGTH)]
    sound = suffixes.verified(start[left[pair]], start[right[pair]])
    if not sound.all():
        raise ValueError("two different strings have one hash; choose another BASE")
    new = np.ones(len(order), bool)
    new[pair + 1] = False
    best = np.minimum.reduceat(rank[cell[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    repeat = np.zeros(len(order), bool)
    repeat[order] = rank[cell[order]] > best
    # Repeats side by side in a cell are one run.
    found = np.flatnonzero(repeat)
    begin = np.append(True, (cell[found][1:] != cell[found][:-1]) | (shift[found][1:] != shift[found][:-1] + 1))[: len(found)]
    head = found[begin]
    n = np.diff(np.append(np.flatnonzero(begin), len(found))) if len(found) else np.zeros(0, np.int64)
    owner = cell[head]
    places = {"id": c["id"][owner], "tie": c["tie"][owner], "p": (c["p"][owner] + shift[head]).astype(np.int32), "n": n.astype(np.int32)}
    yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in places.values()], pa.nulls(len(head), pa.binary())], [*places, "strings"])
    rest = np.flatnonzero(~repeat & (c["parts"][cell] > 1))
    own = mix((suffixes.prefix[start[rest] + LENGTH] - suffixes.prefix[start[rest]]) * suffixes.inverse[start[rest]]) % np.uint64(buckets)
    by = np.argsort(own, kind="stable")
    rest, own, press = rest[by], own[by], zstandard.ZstdCompressor(level=1)
    for part in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(own)) + 1) if len(rest) else []:
        at_ = rest[part]
        text = data[start[at_][:, None] + np.arange(LENGTH)]
        raw = [c["id"][cell[at_]], c["tie"][cell[at_]], (c["p"][cell[at_]] + shift[at_]).astype(np.int32), text]
        blob = press.compress(b"".join(x.tobytes() for x in raw))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(own[part[0]])], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([blob], pa.binary())],
            [*places, "strings"],
        )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal strings from several parts, all but the first. Equal strings are in one bucket, one from each part."""
    open_, held = zstandard.ZstdDecompressor(), []
    for batch in batches:
        for n, blob in zip(batch.column("n").to_pylist(), batch.column("strings").to_pylist()):
            raw = open_.decompress(blob)
            held.append((
                np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n),
                np.frombuffer(raw, f"V{LENGTH}", n, 20 * n),
            ))
    if not held:
        return
    ids, tie, p, text = (np.concatenate(x) for x in zip(*held))
    group = np.unique(text, return_inverse=True)[1].ravel()
    order = np.lexsort((tie, p, ids, group))
    ids, tie, p, group = (x[order] for x in (ids, tie, p, group))
    new = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = (ids != ids[first]) | (p != p[first]) | (tie != tie[first])
    columns = [ids[late], tie[late], p[late], np.ones(late.sum(), np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "tie", "p", "n"])


def _sorted_parts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Hand whole parts on for sorting, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = 0
        while rows < batch.num_rows:
            rest = batch.slice(rows, SORTED_AT_ONCE)
            held_rows = sum(b.num_rows for b in held)
            if held_rows >= SORTED_AT_ONCE:
                h, part = rest.column("h").to_numpy(), rest.column("part").to_numpy()
                last = held[-1].slice(held[-1].num_rows - 1)
                other = np.flatnonzero((h != last.column("h")[0].as_py()) | (part != last.column("part")[0].as_py()))
                cut = int(other[0]) if len(other) else rest.num_rows
                if cut:
                    held.append(rest.slice(0, cut))
                if len(other):
                    yield from _resolved(pa.Table.from_batches(held), buckets)
                    held = []
                rows += cut
            else:
                held.append(rest)
                rows += rest.num_rows
    if held:
        yield from _resolved(pa.Table.from_batches(held), buckets)


def _pressed(docs: DataFrame) -> DataFrame:
    """`text` as compressed bytes `packed`, which is what joins move: less than half of what shuffles make of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            kept = [batch.column(k) for k in ("doc_id", "id", "tie")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "id", "tie", "packed"])

    return docs.select("doc_id", "id", "tie", "text").mapInArrow(run, "doc_id long, id long, tie long, packed binary")


def _opened(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    texts = [open_.decompress(x) for x in packed.to_pylist()]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def repeats(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, tie, p, n): runs of n strings from p on that also start earlier. docs: (id, tie, text); packed: their bytes."""
    with shuffles_dropped(docs.sparkSession):
        return _repeats(docs, packed)


def _repeats(docs: DataFrame, packed: DataFrame) -> DataFrame:
    cells = materialize(repeated_cells(docs), "cells")
    known = cells.where("repeat").select("id", "tie", "p", "n")
    # Equal cells: at most one from each flush of a map task.
    same = W.partitionBy("h", "ch", "cg")
    place = F.struct("id", "p", "tie")
    ranked = cells.where("not repeat").withColumn("first", F.min(place).over(same)).withColumn("i", F.row_number().over(same.orderBy("id", "p", "tie")))
    ranked = materialize(ranked.withColumn("repeat", place > F.col("first")).drop("first"), "ranked")
    later = ranked.where("repeat").select("id", "tie", "p", "n")
    first = ranked.where("i = 1")
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("cells")).where("cells > 1")
    parts = F.ceil(F.col("cells") / PART).cast("int")
    differ = first.join(several, "h").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("ch"), parts).cast("int"))
    wanted = differ.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "p", "n", "off", "part", "parts")).alias("cells"))  # as many as the text is long

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1_000_000, column="packed"):
            data, at = _opened(batch.column("packed"))
            lists = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            fields = {k: flat.field(k).to_numpy() for k in ("h", "p", "n", "off", "part", "parts")}
            content = [data[s : s + n + LENGTH - 1].tobytes() for s, n in zip((at[row] + fields["p"]).tolist(), fields["n"].tolist())]
            columns = [pa.array(batch.column(k).to_numpy()[row]) for k in ("id", "tie")]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(v) for v in fields.values()], pa.array(content, pa.binary())], ["id", "tie", *fields, "content"]
            )

    kind = "id long, tie long, h long, p int, n int, off int, part int, parts int, content binary"
    dealt = packed.join(wanted, ["id", "tie"]).select("id", "tie", "packed", "cells").mapInArrow(contexts, kind)
    dealt = dealt.repartition("h", "part").sortWithinPartitions("h", "part")
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS_PER_PARTITION * partitions
    found = materialize(dealt.mapInArrow(lambda b: _sorted_parts(b, buckets), "id long, tie long, p int, n int, strings binary"), "found")
    across = found.where("strings is not null").select(F.col("p").alias("bucket"), "n", "strings").repartition(partitions, "bucket")
    crossed = across.mapInArrow(_later, "id long, tie long, p int, n int")
    runs = [known, later, found.where("strings is null"), crossed]
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more.select("id", "tie", "p", "n"))
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row: what is left of the text, and the removed byte spans (start, end)."""
    rows = pick(docs, "doc_id", "text").withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).withColumn("tie", F.xxhash64("text"))
    packed = _pressed(rows)
    removed = repeats(rows.select("id", "tie", "text"), packed).groupBy("id", "tie").agg(F.collect_set(F.struct("p", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1_000_000, column="packed"):
            data, at = _opened(batch.column("packed"))
            kept, spans = [], []
            for i, runs in enumerate(batch.column("runs")):
                whole = data[at[i] : at[i + 1]]
                if not runs.is_valid:
                    kept.append(whole.tobytes())
                    spans.append([])
                    continue
                p, n = (runs.values.field(k).to_numpy() for k in ("p", "n"))
                change = np.zeros(len(whole) + 1, np.int64)
                np.add.at(change, p, 1)
                np.add.at(change, p + n - 1 + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept.append(whole[~gone].tobytes())
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"]
            )

    joined = packed.join(removed, ["id", "tie"], "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring deduplication removes from every document."""
    left = keep_first(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return left.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, str]]:
    """(removed bytes, spans, digest of the rest) by id, from a table of all strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(texts):
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - LENGTH + 1):
            string = text[p : p + LENGTH]
            if string in seen:
                gone[p : p + LENGTH] = True
            seen.add(string)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[doc_id] = int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone) if not g)).hexdigest()
    return out
