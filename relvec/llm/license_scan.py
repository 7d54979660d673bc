"""License scans by diagonal voting.

Every run of K words of every text is hashed; Spark joins the hashes to the positions of the same runs in templates. A
hit votes for its diagonal, the word at which the template would start. A phrase stands where one diagonal holds all its
runs; a longer template may lose and gain words, so neighbouring diagonals are merged and the span they cover is
verified by the share of the template it holds and by its length.

Defined cases: a null text is empty: no words, no labels, score 0. Equal rows get equal results, each its own row. Other
columns are never read. Texts of any length are scanned whole; no votes are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm.common import (
    BASE_INVERSE, lower_ascii, mix, per_row, pick, powers, prefix_hashes, slices, span_hashes, utf8, words,
)

K = 3  # words in a run; no phrase is shorter
LETTERS = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
# Fixed phrases and labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "cc-by": "this work is licensed under a creative commons attribution international license",
}
NEAR = 3  # diagonals at most this far apart are merged
LEAST_SHARE = 0.6  # of a template's runs that a span must hold
LONGEST = 2.0  # times the template's words that a span may have


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K words, and the number of words of each row."""
    data = lower_ascii(data)
    start, end, row = words(data, at, LETTERS)
    counts = np.bincount(row, minlength=len(at) - 1)
    one = span_hashes(prefix_hashes(data), start, end, powers(BASE_INVERSE, len(data) + 1))
    n = max(len(one) - K + 1, 0)
    run = np.zeros(n, np.uint64)
    for i in range(K):
        run = mix(run + one[i : i + n] * np.uint64(2 * i + 1))
    return run[row[:n] == row[K - 1 :]] if n else run, counts


def run_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as 64-bit integers, row by row, and the number of runs of each row."""
    run, counts = _runs(*utf8(texts))
    return run.view(np.int64), np.maximum(counts - K + 1, 0)


def template_runs(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """(run, template, label, phrase, at, runs): as many rows as the templates have words, which is what is broadcast."""
    rows = []
    for number, (phrase, label, text) in enumerate(
        [*((True, *x) for x in phrases.items()), *((False, *x) for x in templates.items())]
    ):
        hashes = run_hashes(pa.array([text]))[0].tolist()
        rows += [(h, number, label, phrase, at, len(hashes)) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "run long, template int, label string, phrase boolean, at long, runs int")


def find_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, content, spans): spans of every document that holds any, by id and a hash of the content.

    A span has label, phrase, first word, end (exclusive) and score, the share of the template's runs that it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = run_hashes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), per_row(hashes, counts, pa.int64())], ["doc_id", "content", "runs"]
            )

    texts = pick(docs, "doc_id", "text").withColumn("content", F.xxhash64("text"))
    hashed = texts.mapInArrow(run, "doc_id long, content long, runs array<long>")
    every = hashed.select("doc_id", "content", F.posexplode("runs").alias("word", "run"))
    hits = every.join(F.broadcast(template_runs(docs.sparkSession, phrases, templates)), "run")
    diagonal = ["doc_id", "content", "template"]
    votes = hits.groupBy(*diagonal, "label", "phrase", "runs", (F.col("word") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("held")  # a set, since repeated rows vote twice; no longer than the template
    )
    by = W.partitionBy(*diagonal).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(True)) | F.col("phrase")
    votes = votes.withColumn("band", F.sum(apart.cast("long")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    words_at = F.col("diagonal") + F.array_min("held"), F.col("diagonal") + F.array_max("held") + K
    bands = votes.groupBy(*diagonal, "label", "phrase", "runs", "band").agg(
        F.min(words_at[0]).alias("start"), F.max(words_at[1]).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"),
    )
    score = F.col("n") / F.col("runs")
    verified = F.when(F.col("phrase"), F.col("n") == F.col("runs")).otherwise(
        (score >= LEAST_SHARE) & (F.col("end") - F.col("start") <= LONGEST * (F.col("runs") + K - 1))
    )
    spans = bands.where(verified).select("doc_id", "content", F.struct("label", "phrase", "start", "end", score.alias("score")).alias("span"))
    return spans.groupBy("doc_id", "content").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its license phrases and labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("content"), count.cast("long").alias("n_words"))
    found = find_licenses(docs)
    same = rows.doc_id.eqNullSafe(found.doc_id) & (rows.content == found.content)
    joined = rows.join(found, same, "left").select(rows.doc_id, "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
    base = F.filter("spans", lambda s: s["phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return joined.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op9_license_scan": op9_license_scan}
