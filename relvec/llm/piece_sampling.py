"""SentencePiece encoding by sampling, and its lossless inverse.

A text is a sentence of units (blanks and the word after them), and no piece crosses a unit's border. The pieces that
fit into a unit form a lattice. Forward filtering sums, at every place, the probability of all ways to get there;
backward sampling then draws the last piece, the one before it, and so on, with the probabilities that forward
filtering gives. The draws are a hash of the row's key, the unit's number and the step, so a row always gets the same
segmentation, in whatever task it is read.

Characters without a piece are spelled by byte pieces, a blank is put before the first unit, and decoding removes it:
every text comes back unchanged.

Defined cases: a null text has null ids; an empty text has none; equal rows get equal ids; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relvec.llm.common import mix, pick, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.5  # power of the rank by which a piece gets less likely; higher is closer to one best segmentation
DRAW_BITS = 30
LETTER_LOG_P = -50.0  # of a letter that is spelled
SLICE = 300_000  # bytes of text whose lattices a task holds at a time
_UNIT = re.compile(r" +[^ \n]*|\n|[^ \n]+")


class Pieces:
    """Vocabulary of a model as a trie: child = children[parent, letter]; pieces end at some of its nodes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.byte_ids = np.zeros(256, np.int32)
        self.spelled: list[bytes] = []
        known: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                text = piece.replace("▁", " ")
                known[text] = (i, -SHARPNESS * log(10.0 - model.get_score(i)))
                self.spelled.append(text.encode())
        if any("\n" in p or " " in p.lstrip(" ") for p in known):
            raise ValueError("a piece crosses the border of a unit")
        self.longest = max(map(len, known))
        nodes = {"": 0}
        for text in known:
            for end in range(1, len(text) + 1):
                nodes.setdefault(text[:end], len(nodes))
        inner = [t for t in nodes if t]
        self._keys = pd.Index(np.array([nodes[t[:-1]] << 21 | ord(t[-1]) for t in inner], np.int64))
        self._child = np.array([nodes[t] for t in inner] + [-1], np.int64)
        self.piece, self.weight_of = np.full(len(nodes), -1, np.int64), np.zeros(len(self.spelled))
        for text, (i, weight) in known.items():
            self.piece[nodes[text]], self.weight_of[i] = i, weight
        if self.longest > 31:
            raise ValueError("a piece has more than 31 letters")

    def children(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self._child[self._keys.get_indexer(parent << 21 | letter)]


class Lattices:
    """The lattices of many units at once.

    Node (j, unit) is the border after j letters; units stand by falling length, so the nodes of one j are consecutive.
    Edges are sorted by the node they lead to; `upto` cumulates the shares of a node's edges, in units of 2**-DRAW_BITS.
    """

    def __init__(self, pieces: Pieces, units: list[str]) -> None:
        length = np.fromiter(map(len, units), np.int64, len(units))
        rank = np.empty(len(units), np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(len(units))
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at_least = len(units) - np.searchsorted(np.sort(length), np.arange(length.max() + 2))  # units of j letters or more
        first = np.concatenate([[0], np.cumsum(at_least)])
        place = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - place
        unit = np.repeat(rank, length)
        alive, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        packed, alone = [], np.ones(len(letters), bool)

        def edges(start: np.ndarray, size: int, piece: np.ndarray) -> None:
            to = first[place[start] + size] + unit[start]
            packed.append(to << 37 | size << 32 | piece)

        for size in range(1, pieces.longest + 1):
            node = pieces.children(node, letters[alive + size - 1])
            on = node >= 0
            alive, node = alive[on], node[on]
            piece = pieces.piece[node]
            ends = piece >= 0
            edges(alive[ends], size, piece[ends])
            if size == 1:
                alone[alive[ends]] = False
            on = left[alive] > size
            alive, node = alive[on], node[on]
        # Letters without a piece: an edge of their own, whose number past the vocabulary says which letter to spell.
        odd = np.flatnonzero(alone)
        self.odd, number = np.unique(letters[odd], return_inverse=True)
        edges(odd, 1, len(pieces.spelled) + number)
        packed = np.sort(np.concatenate(packed))
        to, size, self.piece = packed >> 37, packed >> 32 & 31, packed & 0xFFFFFFFF
        level = np.repeat(np.arange(len(first) - 1), np.diff(first))[to]
        self.origin = to - first[level] + first[level - size]
        weight = np.concatenate([pieces.weight_of, np.full(len(self.odd), LETTER_LOG_P)])[self.piece]
        self.into = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=first[-1]))])  # edges before each node
        total = np.zeros(first[-1])  # log forward sums
        share = np.empty(len(to), np.int64)
        for j in range(1, int(length.max()) + 1):
            a, b = self.into[first[j]], self.into[first[j + 1]]
            begin = self.into[first[j] : first[j + 1]] - a
            reach = total[self.origin[a:b]] + weight[a:b]
            most = np.maximum.reduceat(reach, begin)
            here = to[a:b] - first[j]
            grown = np.exp(reach - most[here])
            whole = np.add.reduceat(grown, begin)
            total[first[j] : first[j + 1]] = most + np.log(whole)
            share[a:b] = grown / whole[here] * (1 << DRAW_BITS)
        # Whole numbers, so that a unit's shares don't depend on the units around it.
        cumulated = np.cumsum(share)
        self.upto = cumulated - (cumulated - share)[self.into[to]]
        self.upto[self.into[1:][np.diff(self.into) > 0] - 1] = 1 << DRAW_BITS
        self.end = first[length] + rank  # of each unit
        self.starts = len(units)  # nodes below this one are starts

    def draw(self, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The edge into each node whose share holds the drawn number."""
        edge = self.into[node]
        open_ = np.flatnonzero(self.upto[edge] <= bits)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.upto[edge[open_]] <= bits[open_]]
        return edge


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Sampler:
    def __init__(self, path: str = MODEL) -> None:
        self.pieces = _pieces(path)

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has. seeds: 64 bits per text."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        if not counts.sum():
            return np.zeros(0, np.int32), counts
        which, units = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        lattices = Lattices(self.pieces, list(units))
        row = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mix(seeds.astype(np.uint64)[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active, node = np.arange(len(row)), lattices.end[which]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        length = np.zeros(len(row), np.int64)
        while len(active):
            edge = lattices.draw(node, (mix(seed + np.uint64(len(steps))) >> np.uint64(64 - DRAW_BITS)).astype(np.int64))
            steps.append((active, lattices.piece[edge]))
            length[active] += 1
            node = lattices.origin[edge]
            on = node >= lattices.starts
            active, node, seed = active[on], node[on], seed[on]
        last = np.cumsum(length) - 1
        ids = np.zeros(int(length.sum()), np.int32)
        for i, (unit, found) in enumerate(steps):
            ids[last[unit] - i] = found
        owner = np.repeat(row, length)
        return self._spelled_out(ids, owner, lattices.odd, len(texts))

    def lists(self, texts: pa.Array, seeds: pa.Array) -> pa.ListArray:
        """Ids of each text; null for null."""
        ids, counts = self.encode(texts.fill_null("").to_pylist(), seeds.to_numpy())
        at = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(ids), mask=texts.is_null())

    def _spelled_out(self, ids: np.ndarray, owner: np.ndarray, odd: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace every letter without a piece by the ids of its bytes."""
        size = len(self.pieces.spelled)
        bytes_of = [self.pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in odd.tolist()]
        copies = np.ones(len(ids), np.int64)
        spelled = ids >= size
        copies[spelled] = np.array([len(b) for b in bytes_of] or [0])[ids[spelled] - size]
        at = np.cumsum(copies) - copies
        out = np.repeat(ids, copies)
        if spelled.any():
            table = np.zeros((len(bytes_of), 4), np.int32)
            for i, b in enumerate(bytes_of):
                table[i, : len(b)] = b
            where = np.flatnonzero(spelled)
            for j in range(4):
                has = where[copies[where] > j]
                out[at[has] + j] = table[ids[has] - size, j]
        return out, np.bincount(owner, weights=copies, minlength=rows).astype(np.int64)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the bytes of all pieces end to end, cut where lists end and a blank begins."""
        at = ids.offsets.to_numpy().astype(np.int64)
        spelled = pa.array(self.pieces.spelled, pa.large_binary()).take(ids.values.slice(at[0], at[-1] - at[0]).cast(pa.int64()))
        border = np.frombuffer(spelled.buffers()[1], np.int64)[: len(spelled) + 1]
        data = spelled.buffers()[2].to_pybytes() if len(spelled) else b""
        cut = border[at - at[0]].tolist()
        texts = [None if not ok else data[a + 1 : b].decode("utf-8", "surrogatepass") for ok, a, b in zip(ids.is_valid().to_pylist(), cut, cut[1:])]
        return pa.array(texts, pa.string())


@cache
def _sampler(path: str) -> Sampler:
    return Sampler(path)


def encode(docs: DataFrame, model: str = MODEL, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `ids`. The draws of a row depend on its key (null is a key as well), the seed and the model only."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place, column = names.index(key), names.index(text)
    seeded = plain.withColumn("seed", F.xxhash64(F.col(f"c{place}").cast("string"), F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model)
        for batch in slices(batches, column=f"c{column}", most=SLICE):
            lists = sampler.lists(batch.column(column), batch.column("seed"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], [*batch.schema.names[: len(names)], "ids"])

    out = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return seeded.mapInArrow(run, out).toDF(*names, "ids")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the text that `ids` stand for; null for null."""
    names = rows.columns
    place = names.index(ids)
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = sampler.decode(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())])).toDF(*names, "decoded")


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = 0) -> DataFrame:
    """(doc_id, ids, lossless): sampled ids, and whether decoding them gives back the whole text, in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model)
        for batch in slices(batches, most=SLICE):
            texts = batch.column("text")
            lists = sampler.lists(texts, batch.column("seed"))
            same = pc.fill_null(pc.equal(sampler.decode(lists), texts), True)  # null decodes to null
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, same], ["doc_id", "ids", "lossless"])

    seeded = pick(docs, "doc_id", "text").withColumn("seed", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)))
    return seeded.mapInArrow(run, "doc_id long, ids array<int>, lossless boolean")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every document, and whether decoding gives back its whole text."""
    coded = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), "lossless")


QUERIES = {"op5_piece_sampling": op5_piece_sampling}
