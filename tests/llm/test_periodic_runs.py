"""Periodic runs against a search of every period from every word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relvec.llm import periodic_runs as P


def brute(words):
    """(start, length, period) of all runs of a list."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * top[1] // top[2] if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(runs), *top, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)


def of_lists(lists):
    counts = np.array([len(x) for x in lists])
    start, end, period = P.Sequence(np.array([w for x in lists for w in x], np.int64), counts).runs()
    begin = np.cumsum(counts) - counts
    owner = np.searchsorted(begin + counts, start, side="right")
    return [[(int(s - begin[r]), int(e - s), int(q)) for s, e, q, o in zip(start, end, period, owner) if o == r] for r in range(len(lists))]


def periodic_words(rng, n):
    """Blocks that repeat, some made of blocks that repeat themselves, with single words changed."""
    out = []
    while len(out) < n:
        q = rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 11, 16, 17, 31, 40])
        block = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(q)]
        if rng.random() < 0.4:
            block = block * rng.randint(2, 7) + [rng.randrange(60)] * rng.randint(0, 2)
        out += block * rng.randint(1, 9)
        if rng.random() < 0.3 and out:
            out[rng.randrange(len(out))] = 99
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_periodic_sequences(seed):
    rng = random.Random(seed)
    lists = [periodic_words(rng, rng.choice([0, 1, 5, 6, 7, 20, 64, 200, 700])) for _ in range(40)]
    assert of_lists(lists) == [brute(x) for x in lists]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=70), min_size=1, max_size=4), st.integers(1, 5))
def test_runs_of_small_alphabets(lists, times):
    lists = [x * times for x in lists]
    assert of_lists(lists) == [brute(x) for x in lists]


def test_special_sequences():
    fibonacci, thue = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 4096:
        thue += [1 - x for x in thue]
    nested = ([0] * 9 + [1]) * 6 + [2] + ([0, 1] * 12 + [3]) * 5
    for x in (fibonacci[-1], thue[:1500], nested, [0] * 1000, list(range(50)) * 5, (list(range(64)) + [0]) * 4):
        assert of_lists([x, x]) == [brute(x)] * 2
    assert of_lists([thue * 4])[0] == [(0, 4 * 4096, 4096)]
    for period in range(1, 70):
        body = list(range(period))
        for length in (4 * period - 1, 4 * period, 4 * period + 1):
            x = [-1] + (body * 5)[:length] + [-2]
            assert of_lists([x])[0] == ([(1, length, period)] if length >= max(6, 4 * period) else [])


def test_selected_positions_are_few_and_consistent():
    rng = np.random.default_rng(0)
    sequence = P.Sequence(rng.integers(0, 5000, 20_000), np.array([20_000]))
    at, _ = sequence.proposals()
    assert len(at) < 50  # words at random hardly recur nearby
    assert P._least_of_next(np.array([5, 3, 8, 1, 9, 7], np.uint64), 3).tolist() == [3, 1, 1, 1]


def test_rows_of_documents(spark, docs, repeated, empty):
    for planted in (True, False):
        for frame in (docs, repeated):
            texts = [(r[0], r[1]) for r in frame.collect()]
            found = P.runs(frame.repartition(3), planted)
            assert found.columns == ["doc_id", *P.NAMES]
            key = lambda r: tuple((x is None, x) for x in r)
            assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, *expected(i, t, planted)) for i, t in texts), key=key)
    assert P.runs(empty).count() == 0


def test_long_and_odd_texts(spark):
    rng = random.Random(5)
    line = " ".join(str(rng.randrange(10**6)) for _ in range(700))
    texts = [(0, f"{line}\n" * 30), (1, "a " * 60_000), (2, "\x0b\x0c \t"), (3, "x" * 10_000), (4, " ".join(map(str, range(30_000)))),
             (5, "a\x00b c d " * 9), (30, "日本 語 " * 400)]
    found = {r[0]: r for r in P.runs(spark.createDataFrame(texts, "doc_id long, text string, TEXT string".replace(", TEXT string", "")), True).collect()}
    assert (found[0].n_runs, found[0].start, found[0].length, found[0].period, found[0].exponent_milli) == (1, 0, 21_000, 700, 30_000)
    assert (found[1].n_runs, found[1].length, found[1].period) == (1, 60_000, 1)
    for i, text in texts[2:4] + texts[5:]:
        assert tuple(found[i])[1:] == expected(i, text)


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in P.op13_periodic_runs(spark, small).collect()}
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    assert len(short) > 150 and all(found[i] == expected(i, t) for i, t in short)


def test_words_are_numbered_by_content():
    found, numbers, counts = P.tokens(pa.array(["a b\ta", None, "", "b  \n", "ä a"]))
    assert found.to_pylist() == [b"a ", b"b ", b"a ", b"b ", "ä ".encode(), b"a "]
    assert counts.tolist() == [3, 0, 0, 1, 2]
    assert numbers.tolist() == [0, 1, 0, 1, 2, 0]
