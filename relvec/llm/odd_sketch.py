"""Near-duplicate groups: MinHash bands find candidates, odd sketches weed them, whole shingle sets confirm them.

A document is the set of its distinct shingles of `width` lower-case words. SAMPLES minima, four to a band, make it
likely beyond doubt (misses below 1e-7 at similarity 0.8) that linked documents share a band. The minima are also folded
into a bitmap of parities; the bits in which two bitmaps differ estimate how many minima differ, and pairs far from
the threshold go no further. What is left is confirmed on the full sets, so no wrong link is made.

Equal sets are one node. A bucket of a band first compares its members with two of them only; once components are
known, those outside its largest component are compared with all, in blocks of a bounded number of shingles, so a group of any
size needs no task of its own and no table of its pairs. Two members that share several bands are compared in the first only.

Defined cases: null or empty texts have no shingles and no links; fewer words than `width` make one shingle; rows
without an id stay apart (component null, kept); rows that share an id count as one document; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.llm.common import (
    BASE_INVERSE, WHITE, lower_ascii, mix, per_row, pick, powers, prefix_hashes, slices, span_hashes, utf8, words,
)
from relvec.llm.components import components
from relvec.session import materialize

WIDTH = 5
SIMILAR = 80  # percent
SAMPLES, ROWS = 128, 4  # minima, and minima in a band
BITS = 512
MOST_DIFFERING_BITS = 92  # of two bitmaps; at similarity 0.8 they differ in 46 with a deviation of 8
BLOCK = 1 << 18  # shingles of the members that one task compares with as many others
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every row, ascending, end to end, and how many each row has."""
    rows = len(at) - 1
    data = lower_ascii(data)
    start, end, row = words(data, at, ~WHITE)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    one = span_hashes(prefix_hashes(data), start, end, powers(BASE_INVERSE, len(data) + 1))
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    run, size = np.zeros(len(one), np.uint64), np.minimum(counts, width)[row]
    left = counts[row] - (np.arange(len(row)) - first[row])  # words from here to the row's end
    whole = left >= size
    where = np.flatnonzero(whole)
    for i in range(width):
        on = where[size[where] > i]
        run[on] = mix(run[on] + one[on + i] * np.uint64(2 * i + 1))
    found, owner = run[where], row[where]
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=rows)


def _minima(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.empty((len(begin), SAMPLES), np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(found * factor, begin)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    parts = minima.reshape(len(minima), SAMPLES // ROWS, ROWS)
    key = np.broadcast_to(np.arange(SAMPLES // ROWS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + parts[:, :, r] * np.uint64(2 * r + 1))
    return key.view(np.int64)


def _bitmaps(minima: np.ndarray) -> np.ndarray:
    """Parities of BITS cells into which the numbered minima fall, as 64-bit integers."""
    cell = (mix(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)).astype(np.int64)
    flat = (np.arange(len(minima))[:, None] * BITS + cell).ravel()
    odd = (np.bincount(flat, minlength=len(minima) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, bits) of every row; set_a and set_b tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, counts = shingles(*utf8(batch.column("text")), width)
            some = np.flatnonzero(counts)
            begin = (np.cumsum(counts) - counts)[some]
            sums = np.zeros((2, len(counts)), np.int64)
            bands, bits = np.zeros((0, SAMPLES // ROWS), np.int64), np.zeros((0, BITS // 64), np.int64)
            if len(some):
                minima = _minima(found, begin)
                bands, bits = _bands(minima), _bitmaps(minima)
                sums[0, some] = np.add.reduceat(found, begin).view(np.int64)
                sums[1, some] = np.bitwise_xor.reduceat(mix(found + np.uint64(1)), begin).view(np.int64)
            has = (counts > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                 per_row(bands.ravel(), has * bands.shape[1], pa.int64()), per_row(bits.ravel(), has * bits.shape[1], pa.int64())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
            )

    kind = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
    return pick(docs, "doc_id", "text").mapInArrow(run, kind)


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, column="text_a"), column="text_b"):
            # A text that many rows share is cut into shingles once.
            sides = [batch.column(c).dictionary_encode() for c in ("text_a", "text_b")]
            sets = []
            for side in sides:
                found, counts = shingles(*utf8(side.dictionary), width)
                sets.append((np.split(found, np.cumsum(counts)[:-1]), side.indices.to_numpy()))
            keep = []
            for i, j in zip(sets[0][1].tolist(), sets[1][1].tolist()):
                x, y = sets[0][0][i], sets[1][0][j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _held(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by their keys."""
    open_: list[pa.RecordBatch] = []  # rows of the group that may go on in the next batch
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns], axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(start, end - start)
            if open_ and any(open_[-1].column(c)[0] != part.column(c)[0] for c in keys):
                yield pa.Table.from_batches(open_)
                open_ = []
            if part.num_rows:
                open_.append(part)
    if open_:
        yield pa.Table.from_batches(open_)


def _links_in(table: pa.Table, width: int) -> list[tuple[int, int]]:
    """Links between components in one group: rows that are `few` against all rows of the group's column."""
    few, many, node, component = (table.column(c).to_numpy() for c in ("is_few", "is_many", "node", "component"))
    wide = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    bits, bands, here = wide("bits").view(np.uint64), wide("bands"), table.column("band")[0].as_py()
    left, right = np.flatnonzero(few), np.flatnonzero(many)
    sizes, begin, codes, mark = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    above = {int(c): int(c) for c in component}

    def top(c: int) -> int:
        while above[c] != c:
            c = above[c]
        return c

    links, now = [], component[right]
    for i in left:
        own = top(int(component[i]))
        other = right[now != own]
        other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= MOST_DIFFERING_BITS]
        other = other[~(bands[other, :here] == bands[i, :here]).any(1)]
        if not len(other):
            continue
        if not len(codes):
            found, sizes = shingles(*utf8(table.column("text").combine_chunks()), width)
            begin = np.cumsum(sizes) - sizes
            unique, codes = np.unique(found, return_inverse=True)
            mark = np.zeros(len(unique), bool)
        other = other[sizes[other] > 0]
        if not len(other):
            continue
        mine = codes[begin[i] : begin[i] + sizes[i]]
        mark[mine] = True
        each = sizes[other]
        at = np.repeat(begin[other] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        both = np.add.reduceat(mark[codes[at]].astype(np.int64), np.cumsum(each) - each)
        mark[mine] = False
        for j in other[100 * both >= SIMILAR * (each + sizes[i] - both)]:
            to = top(int(component[j]))
            if to != own:
                links.append((int(node[i]), int(node[j])))
                above[max(to, own)] = own = min(to, own)
                now = np.array([top(int(c)) for c in component[right]])
    return links


def _across(members: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different components. members: (bucket, band,
    node, size, component).

    Of buckets with the same members only the first band's counts. The members outside a bucket's largest component are its
    few; they are compared with all, in groups of a block of the few and a block of all, so pairs inside the largest component
    are never looked at. A group confirms its links on full sets and returns no more of them than it joins components.
    """
    by_component = members.groupBy("bucket", "component").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"),
        F.sum(F.xxhash64("node") % 1_000_000_007).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("mixed"),
    )
    alike = by_component.groupBy("bucket").agg(
        F.min("band").alias("band"), F.max(F.struct("k", "component", "size")).alias("top"), F.count(F.lit(1)).alias("parts"),
        *[F.sum(c).alias(c) for c in ("k", "size", "sum")], F.bit_xor("mixed").alias("mixed"),
    ).where("parts > 1").groupBy("k", "sum", "mixed").agg(F.min(F.struct("band", "bucket", "size", "top")).alias("first"))
    mixed = alike.select("first.bucket", F.col("first.size").alias("whole"), F.col("first.top.component").alias("largest"), F.col("first.top.size").alias("inside"))
    placed = members.join(mixed, "bucket")
    columns = F.ceil(F.col("whole") / BLOCK).cast("int")
    rows = F.ceil((F.col("whole") - F.col("inside")) / BLOCK).cast("int")
    few = F.col("component") != F.col("largest")
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), rows).cast("int"), F.pmod(F.xxhash64("node"), columns).cast("int")
    place = lambda r, c: F.struct(r.alias("row"), c.alias("column"))
    as_many = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: place(r, column))
    as_few = F.when(few, F.transform(F.sequence(F.lit(0), columns - 1), lambda c: place(row, c))).otherwise(F.array().cast("array<struct<row:int,column:int>>"))
    dealt = placed.select("bucket", "band", "node", "component", few.alias("few"), row.alias("own_row"), column.alias("own_column"), F.explode(F.array_union(as_many, as_few)).alias("at"))
    dealt = dealt.select(
        "bucket", "band", "at.row", "at.column", "node", "component", (F.col("few") & (F.col("at.row") == F.col("own_row"))).alias("is_few"),
        (F.col("at.column") == F.col("own_column")).alias("is_many"),
    )
    key = ["bucket", "row", "column"]
    whole = dealt.join(nodes, "node").join(texts, "node").select(*key, "band", "node", "component", "is_few", "is_many", "bits", "bands", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, key):
            links = _links_in(table, width)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return whole.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest id that links reach."""
    rows = materialize(signatures(docs, width), "signatures")
    known = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = ["n_shingles", "set_a", "set_b"]
    nodes = materialize(known.groupBy(*sets).agg(F.min(F.struct("doc_id", "bands", "bits")).alias("first")).select(
        *sets, "first.doc_id", "first.bands", "first.bits"
    ), "nodes").withColumnRenamed("doc_id", "node")
    members = nodes.select("node", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(
        F.min("node").alias("hub"), F.min_by("node", F.xxhash64("node")).alias("second"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    shared = materialize(members.join(buckets, "bucket"), "shared")
    involved = shared.select("node").distinct()
    texts = materialize(pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "node").join(involved, "node", "left_semi").distinct(), "texts")
    bits = nodes.select("node", "bits").join(involved, "node", "left_semi")
    hubs = shared.groupBy("node").agg(F.min("hub").alias("hub"), F.min_by("second", F.xxhash64("second")).alias("second"))
    tried = hubs.select(F.explode(F.array_distinct(F.array("hub", "second"))).alias("hub"), "node").where("hub <> node")
    tried = tried.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    tried = tried.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    near = tried.where(_differing(F.col("bits_a"), F.col("bits_b")) <= MOST_DIFFERING_BITS)
    links = materialize(_confirmed(near, texts, width), "hub-links")
    # Rows that share an id are one document, whatever sets they have.
    joined = materialize(components(links), "joined")
    label = F.coalesce("component", F.col("node")).alias("component")
    labelled = shared.select("bucket", "band", "node", "size").join(joined, "node", "left").select("bucket", "band", "node", "size", label)
    more = _across(labelled, texts, nodes.select("node", "bits", "bands"), width)
    final = materialize(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    by_set = nodes.select(*sets, "node").join(final, "node", "left").select(*sets, label)
    by_set = by_set.groupBy(*sets).agg(F.min("component").alias("component"))
    own = rows.join(by_set, sets, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).alias("component_id")
    )
    return own


def without_near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows and columns of `docs` that are the first of their group: all rows of an id stay or go, and rows without an id stay."""
    names = docs.columns
    groups = near_groups(docs, width)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id = F.col(f"c{names.index('doc_id')}")
    return plain.join(gone, doc_id == F.col("gone"), "left_anti").toDF(*names)


def op8_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies (shingles of four words)."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op8_odd_sketch": op8_odd_sketch}
