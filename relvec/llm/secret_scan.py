"""Secret scans with combined automata.

Every rule has two patterns. Its trigger has a bounded length and says where a match must be looked at; the triggers of
all rules form one automaton that reads each byte once, in blocks of all texts side by side. Where it fires, the
automaton of the whole rules measures the longest match from the trigger's start. A rule's matches are leftmost and do
not overlap one another, and a match that is too short still uses up its text.

Defined cases: a null text is empty; an empty text has no spans; rows are judged one by one, so repeated rows get equal
results; other columns are kept and never read; text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.llm.automaton import Automaton, compile_rules
from relvec.llm.common import pick, slices, utf8


class Rule(NamedTuple):
    """`least` counts the characters of a whole match; `value` those of its last run of value characters."""

    kind: str
    trigger: str
    whole: str
    least: int = 0
    value: int = 0


KEYWORDS = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]",
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy]",
)
_ASSIGN = f"({'|'.join(KEYWORDS)})[\"']?\\x20*[:=]\\x20*[\"']?"
# The first three kinds and their lengths are fixed; their order breaks ties between spans that start together.
BASE_RULES = (
    Rule("assign", "|".join(KEYWORDS), _ASSIGN + "[A-Za-z0-9+/_.=-]+", value=6),
    Rule("access", "AKIA", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", least=24),
)
_BLANK, _BODY = "[\\x20\\t]", "[A-Za-z0-9+/=]"
_LINE_END = f"{_BLANK}*([\\r\\n]|\\\\[nr]){_BLANK}*"  # also as written inside a JSON string
_PEM_HEADER = "(Proc-Type|DEK-Info|Comment|Version):[\\x20-\\x7e]*[\\r\\n]"
# A key runs to its END line. Without one it is the header line and all lines of body characters after it; then only long
# runs may follow a blank, so that prose after a bare header stays.
_PEM_WHOLE = f"({_BODY}|{_BLANK}|{_LINE_END}|{_PEM_HEADER})*-----END( [A-Z0-9]+)* PRIVATE KEY-----"
_PEM_CUT_OFF = f"(({_LINE_END}|{_PEM_HEADER})*{_BODY}+|{_BLANK}+{_BODY}{{20}})*"
MORE_RULES = (
    Rule("pem", "-----BEGIN", f"-----BEGIN( [A-Z0-9]+)* PRIVATE KEY-----({_PEM_WHOLE}|{_PEM_CUT_OFF})"),
    Rule("prefixed", "(gh[pousr]_|xox[abprs]-|sk-)", "(gh[pousr]_|xox[abprs]-|sk-)[A-Za-z0-9-]+", least=24),
    Rule("jwt", "eyJ", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
BLOCK, LOOKBACK = 1024, 32  # no trigger is longer than LOOKBACK bytes

Span = tuple[str, int, int]


def fired(data: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions after which a trigger has ended, and the state there. One table step reads a byte of every block."""
    blocks = max(1, -(-len(data) // BLOCK))
    room = np.zeros(LOOKBACK + blocks * BLOCK, np.uint8)
    room[LOOKBACK : LOOKBACK + len(data)] = data
    step = np.lib.stride_tricks.sliding_window_view(room, LOOKBACK + BLOCK)[::BLOCK].T.copy()
    flat = machine.next.ravel() * 256
    hit_state = machine.accepts.any(1)
    hit_scaled = np.zeros(len(hit_state) * 256, bool)
    hit_scaled[::256] = hit_state
    state = np.zeros(blocks, np.int32)
    at, states = [], []
    for t in range(LOOKBACK + BLOCK):
        state = flat[state + step[t]]
        if t >= LOOKBACK:
            where = np.flatnonzero(hit_scaled[state])
            if len(where):
                at.append(where * BLOCK + t - LOOKBACK + 1)
                states.append(state[where] // 256)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, state = np.concatenate(at), np.concatenate(states)
    order = np.argsort(place, kind="stable")
    return place[order], state[order]


def _longest(text: bytes, start: int, machine: Automaton, rule: int, flat: list[list[int]]) -> int:
    """End of the longest match of the rule from `start`, or -1."""
    state, end = 0, -1
    accepts = machine.accepts[:, rule]
    for i in range(start, len(text)):
        state = flat[state][text[i]]
        if state == machine.dead:
            break
        if accepts[state]:
            end = i + 1
    return end


def _starts(text: bytes, end: int, rule: Rule, backward: Automaton, flat: list[list[int]]) -> int:
    """Start of the longest trigger that ends at `end`, read backwards."""
    state, start = 0, end
    for i in range(end - 1, max(-1, end - 1 - LOOKBACK), -1):
        state = flat[state][text[i]]
        if state == backward.dead:
            break
        if backward.accepts[state, 0]:
            start = i
    return start


@cache
def _tables(rules: Sequence[Rule]):
    """Triggers anywhere, whole rules from a start, and triggers read backwards from their end."""
    search, whole = compile_rules([r.trigger for r in rules], True), compile_rules([r.whole for r in rules])
    backward = [compile_rules([_reversed(r.trigger)]) for r in rules]
    return search, whole, whole.next.tolist(), backward, [b.next.tolist() for b in backward]


def _reversed(pattern: str) -> str:
    """The pattern that matches the reversed strings; for the few forms that triggers use."""
    import re._parser as parser

    def show(tree) -> str:
        return "".join(part(str(op), value) for op, value in reversed(list(tree)))

    def byte(b: int) -> str:
        return f"\\x{b:02x}"

    def part(op: str, value) -> str:
        if op == "LITERAL":
            return byte(value)
        if op == "IN":
            return "[" + "".join(byte(v) if str(o) == "LITERAL" else f"{byte(v[0])}-{byte(v[1])}" for o, v in value) + "]"
        if op == "SUBPATTERN":
            return f"({show(value[3])})"
        if op == "BRANCH":
            return "(" + "|".join(show(arm) for arm in value[1]) + ")"
        if op == "MAX_REPEAT":
            return f"({show(value[2])}){{{value[0]},{value[1]}}}"
        raise ValueError(f"unsupported in a trigger: {op}")

    return show(parser.parse(pattern))


def _spans_in(text: bytes, hits: list[tuple[int, int]], rules: Sequence[Rule]) -> list[tuple[int, int, int]]:
    """(rule, start, end) in bytes, of one text. hits: (byte after a trigger, state of the search automaton)."""
    search, whole, flat, backward, back_flat = _tables(tuple(rules))
    used = [0] * len(rules)
    found = []
    for end, state in hits:
        for r in np.flatnonzero(search.accepts[state]).tolist():
            if end <= used[r]:
                continue
            rule = rules[r]
            start = max(_starts(text, end, rule, backward[r], back_flat[r]), used[r])
            stop = _longest(text, start, whole, r, flat)
            if stop < 0:
                continue
            used[r] = stop
            run = stop
            if rule.value:
                # The value is the run after the sign and its optional quote, which value characters may continue.
                run = stop - _value_start(text, start, stop)
            if stop - start >= rule.least and run >= rule.value:
                found.append((r, start, stop))
    return found


def _value_start(text: bytes, start: int, stop: int) -> int:
    """Where the value of an assignment begins: after the first : or =, blanks and one optional quote."""
    i = start
    while text[i] not in b":=":
        i += 1
    i += 1
    while text[i] == 0x20:
        i += 1
    return i + (text[i] in b"\"'")


def scan(texts: pa.Array, rules: Sequence[Rule] = RULES) -> list[list[Span]]:
    """Spans (kind, start, end) of each text in code points, ordered by start, then kind."""
    rules = tuple(rules)
    data, at = utf8(texts)
    apart = np.full(len(data) + len(texts), 0xFF, np.uint8)  # a byte that no text holds stands after each text
    apart[np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(at))] = data
    data, at = apart, at + np.arange(len(at))
    place, state = fired(data, _tables(rules)[0])
    row = np.searchsorted(at, place - 1, side="right") - 1
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    cuts = np.flatnonzero(np.diff(row)) + 1
    for group in np.split(np.arange(len(place)), cuts) if len(place) else []:
        i = int(row[group[0]])
        text = data[at[i] : at[i + 1] - 1].tobytes()
        hits = list(zip((place[group] - at[i]).tolist(), state[group].tolist()))
        spans = _spans_in(text, hits, rules)
        if not spans:
            continue
        ascii_only = text.isascii()
        chars = (lambda b: b) if ascii_only else (lambda b, t=text: len(t[:b].decode("utf-8", "replace")))
        out[i] = [(rules[r].kind, chars(s), chars(e)) for r, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2]))]
    return out


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Add `spans` (array of kind, start, end) to every row; needs `doc_id` and the text column only."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, column="text"):
            spans = scan(batch.column("text"), rules)
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    narrow = pick(docs, "doc_id", text).toDF("doc_id", "text")
    return narrow.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The same rows and columns, with every span of `text` replaced by its kind in brackets and `n_chars` counted anew.

    Overlapping spans are replaced once, under the kind of the first. Null texts stay null.
    """
    rules = tuple(rules)
    names = docs.columns
    place = names.index("text")

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=f"c{place}"):
            column = batch.column(place)
            if not (hits := {i: s for i, s in enumerate(scan(column, rules)) if s}):
                yield batch
                continue
            texts = column.to_pylist()
            for i, s in hits.items():
                texts[i] = clean(texts[i], s)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = plain.mapInArrow(run, plain.schema)
    if "n_chars" in names:
        i = names.index("n_chars")
        out = out.withColumn(f"c{i}", F.when(F.col(f"c{place}").isNull(), F.col(f"c{i}")).otherwise(F.length(f"c{place}").cast(docs.schema[i].dataType)))
    return out.toDF(*names)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every whole document, with a digest of the base spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}


def brute_force(text: str | None) -> list[Span]:
    """The base spans by Python's own regular expressions; for tests."""
    import re

    text = text or ""
    assign = r"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(KEYWORDS)
    found = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
