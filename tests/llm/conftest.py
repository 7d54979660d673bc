import random

import pytest
from pyspark.sql import Row

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["an", "ther", "ing", "ou", "ble", "sch", "ñe", "é", "to", "re", "lor", "um"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, secrets, licenses, junk, nulls and very short ones."""
    rng = random.Random(seed)
    shared, line = sentence(rng, 60), sentence(rng, 30)
    texts = []
    for i in range(n):
        kind = i % 10
        text = "\n".join(sentence(rng, rng.randint(5, 60)) + "." for _ in range(rng.randint(1, 6)))
        if kind == 1 and texts:
            text = texts[0]
        elif kind == 2:
            words = texts[0].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = text[: len(text) // 2] + shared + text[len(text) // 2 :]
        elif kind == 4:
            text = "\n".join([line, text, line, line])
        elif kind == 5:
            text += f"\npassword={rng.getrandbits(64):016x} AKIA{'ABCD1234' * 2}XY {rng.getrandbits(128):032x} Under the MIT License"
        elif kind == 6:
            text = "abab" * rng.randint(1, 120)
        texts.append(text)
    return [*texts, None, "", " ", "x", "a" * 99, "b" * 100, "c" * 101, "日本語😀 ▁ " * 30, texts[0] * 40]


@pytest.fixture(scope="session")
def texts():
    return made()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with null sources, and columns whose names clash with those of operators and of the documents themselves."""
    rows = [(i * 7 % 101, t, None, [None, "b", "a", "ä"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "other", 1, "n") for r in rows], NAMES + ", TEXT string, size int, IDS string").cache()
    assert len({r[0] for r in rows}) == len(rows)
    return frame


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows, ids that stand for two texts, and rows without an id."""
    body = sentence(random.Random(1), 40)
    rows = [(1, body), (1, body), (1, body + " more"), (None, body), (None, None), (2, body), (3, None), (3, "")]
    return spark.createDataFrame([Row(doc_id=i, text=t, lang=None, source="s", n_chars=0) for i, t in rows], NAMES)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NAMES)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}
