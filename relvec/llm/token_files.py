"""Token counts of flat token files without an index.

A file is nothing but identifiers of two bytes, each document ending with an end-of-document identifier. Files are read
in blocks, in any order and on any machine. A block finds all its separators at once and reports its length, the
number of separators, the tokens before the first and after the last, and the lengths between. A prefix scan over the
blocks of a file then gives each block its first document's number and how much of it came before.

Defined cases: a null text is an empty document of 0 tokens; tokens after a file's last separator form an unfinished
last document; an empty file has none; texts that spell the separator encode as ordinary text; other columns are never
read. Equal rows are separate documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm.common import per_row, pick, slices
from relvec.session import materialize, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # end of document; fixed by the vocabulary
# How the vocabulary cuts text before merging; fixed by the vocabulary.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FILE_TOKENS = 16_000_000
BLOCK_BYTES = 4 << 20


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    return _encoding(vocabulary).encode_ordinary(text)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all texts to flat files. Returns (doc_id, file, number), stored, one row per document in file order.

    A task that runs again writes files of other names; the returned table names those of the attempt that counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, held, number = "", None, 0, 0
        for batch in slices(batches):
            names, numbers = [], []
            for text in batch.column("text").to_pylist():
                if out is None or held >= file_tokens:
                    if out is not None:
                        out.close()
                    name, held, number = uuid4().hex, 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                ids = np.array([*token_ids(text or "", vocabulary), END], "<u2")
                out.write(ids.tobytes())
                names.append(name)
                numbers.append(number)
                held += len(ids)
                number += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["doc_id", "file", "number"])
        if out is not None:
            out.close()

    return materialize(pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, file string, number long"), "token-files")


def scan_blocks(files: DataFrame, folder: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, tokens, ends, head, tail, inner) of every block of the named files, whatever their length."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = store.get_file_info([f"{base}/{f}" for f in batch.column("file").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([f.size for f in found], pa.int64())], ["file", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for one in range(batch.num_rows):
                part = batch.slice(one, 1)
                with store.open_input_file(f"{base}/{part.column('file')[0].as_py()}") as source:
                    ids = np.frombuffer(source.read_at(block_bytes, part.column("block")[0].as_py() * block_bytes), "<u2")
                ends = np.flatnonzero(ids == end)
                head = int(ends[0]) if len(ends) else len(ids)
                tail = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                inner = np.diff(ends) - 1
                values = [pa.array([v], pa.int64()) for v in (len(ids), len(ends), head, tail)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("file"), part.column("block"), *values, per_row(inner, np.array([len(inner)]), pa.int64())],
                    ["file", "block", "tokens", "ends", "head", "tail", "inner"],
                )

    sized = files.select("file").mapInArrow(sizes, "file string, bytes long").where(F.col("bytes") > 0)
    last = F.floor((F.col("bytes") - 1) / block_bytes).cast("long")
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    dealt = blocks.repartition(max(2 * files.sparkSession.sparkContext.defaultParallelism, 1), "file", "block")
    return dealt.mapInArrow(run, "file string, block long, tokens long, ends long, head long, tail long, inner array<long>")


def token_counts(blocks: DataFrame) -> DataFrame:
    """(file, number, n_tokens) of every document, stitched across blocks by running sums per file."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("file")
    placed = blocks.withColumn("read", F.sum("tokens").over(upto)).withColumn(
        "closed", F.when(F.col("ends") > 0, F.col("read") - F.col("tail"))  # place after the block's last separator
    )
    placed = placed.select(
        "file", "ends", "head", "inner",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
        (F.col("read") - F.col("tokens") - F.coalesce(F.max("closed").over(before), F.lit(0))).alias("carried"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"),
        (F.col("read") - F.coalesce(F.max("closed").over(upto), F.lit(0))).alias("open"),
    )
    started = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    unfinished = F.when(F.col("is_last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    return placed.select("file", "first", F.posexplode(F.concat(started, unfinished)).alias("i", "n_tokens")).select(
        "file", (F.col("first") + F.col("i")).alias("number"), "n_tokens"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of all documents by their separators alone."""
    folder = scratch_path(spark, "tokens")
    written = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    counts = token_counts(scan_blocks(written.select("file").distinct(), folder))
    # Both sides grow with the documents, and the counts look small to the planner: not to be broadcast.
    return written.join(counts.hint("merge"), ["file", "number"], "left").select("doc_id", F.col("n_tokens"))


QUERIES = {"op10_token_counts": op10_token_counts}
