"""Document fingerprints: an invertible Bloom lookup sketch of paragraphs.

A text is cut at line ends and after every sentence. A sentence longer than LONGEST is also cut after words, and a word
longer than WORD after characters: each WINDOW of them in a row has a cut after the one with the least hash. A text of more than
FEW such units is then joined to pieces of at most JOINED units in the same way. So a piece
is bounded, and the same words are cut alike wherever they stand. The digest of each piece is added to one cell in each of three tables. A cell holds a count, the exclusive
or of its digests and that of their check values. Subtracting the cells of two sketches cancels what the texts share;
peeling takes a digest out of a cell that holds one only, until nothing is left. A sketch too small for its differences
can't be peeled to the end; then both are built larger.

The base sketch is the fingerprint. Likeness is the share of pieces (of both texts) that don't differ. For a whole table the larger
sketches are aggregates: a cell is one group of its document, part of the sketch and place, so none that no digest falls into is made,
and their groups stand where the documents do. Only finding the next document and bringing its counts back move rows.

Defined cases: a character U+0001 ends a unit and is part of none; a null text is empty; empty texts have equal fingerprints and likeness 1; equal ids are ordered by a hash
of their texts, and null ids come last; the next document of an only one is itself; other columns are never read; a long
text only makes its own row's arrays longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relvec.llm.common import pick
from relvec.session import shuffle_partitions

TABLES = 3
BASE_CELLS = 8  # in each table of the fingerprint
LONGEST = 128  # characters of a sentence that is one piece
WORD = 64  # characters of a word that is one unit
WINDOW = 16  # units in a piece of a longer sentence or word, at most
FEW, JOINED = 64, 8  # units that are pieces of their own; units in a piece of a longer text, at most
SHINGLE = 8  # characters whose hash decides on a cut inside a long word
GROUP = 4  # pieces (of both texts) that one part of a larger sketch holds, about
GROUP_CELLS = (6, 12, 24)  # cells in each table of such a part, first and where that fails
SPARSE_TABLES, SPARSE_CELLS = 2, 256  # tables and cells in each where a sketch is an aggregate, and cells without a digest cost nothing
ROUNDS, GROUP_ROUNDS = 30, 12
RANGES_PER_PARTITION = 8
_LOWEST = -(1 << 63)
_CUT = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted 64-bit digests of a text's pieces. A piece's second, third .. occurrence counts as another piece."""

    def numbered(found: Column) -> Column:
        """Equal digests stand together. Each run is numbered from its start."""
        n = F.size(found)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(found, i - 1) != F.get(found, i)))
        return _let(starts, lambda s: F.flatten(F.transform(s, lambda start, k: _let(F.get(found, start), lambda d: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(s, k + 1), n) - start - 1), lambda r: F.when(r == 0, d).otherwise(F.xxhash64(d, r))
        )))))

    whole = F.coalesce(text, F.lit(""))
    marked = whole
    for border in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(border), F.lit(border + _CUT))
    sentences = F.filter(F.split(marked, _CUT), lambda u: u != "")
    some_long = F.exists(sentences, lambda u: F.length(u) > LONGEST)
    pieces = _let(sentences, lambda u: F.when(some_long, F.flatten(F.transform(u, _bounded))).otherwise(u))
    hashes = _let(F.transform(pieces, lambda u: F.xxhash64(u)), lambda h: F.when(F.size(h) > FEW, _joined(h)).otherwise(h))
    cut = _let(F.array_sort(hashes), lambda h: F.when(F.size(h) > 0, numbered(h)).otherwise(h))
    return F.when(whole == "", F.array().cast("array<long>")).otherwise(cut)


def _ends(hashes: Column, window: int) -> Column:
    """Places, from 0, of the least hash (the last of equal ones) of each `window` in a row, and the last place. At least `window` hashes."""
    placed = F.transform(hashes, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("i"), -i))
    least = _let(placed, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - window), lambda j: -F.array_min(F.slice(p, j + 1, window))["i"]))
    return F.array_distinct(F.concat(least, F.array(F.size(hashes) - 1)))


def _between(ends: Column, use: Callable[[Column, Column], Column]) -> Column:
    """`use(first place from 1, length)` of the stretch up to each end."""
    return _let(ends, lambda c: F.transform(c, lambda end, k: _let(
        F.when(k > 0, F.get(c, k - 1)).otherwise(-1), lambda before: use(before + 2, end - before)
    )))


def _joined(hashes: Column) -> Column:
    """Hashes of pieces of at most JOINED units."""
    return _between(_ends(hashes, JOINED), lambda start, n: F.xxhash64(F.slice(hashes, start, n)))


def _bounded(sentence: Column) -> Column:
    """Pieces of one sentence."""

    def word(w: Column) -> Column:
        def shingles(c: Column) -> Column:
            return F.transform(c, lambda _, i: F.xxhash64(F.array_join(F.slice(c, F.greatest(i - SHINGLE + 2, F.lit(1)), F.least(i + 1, F.lit(SHINGLE))), "")))

        characters = F.filter(F.split(w, ""), lambda c: c != "")
        return F.when(F.length(w) <= WORD, F.array(w)).otherwise(_let(characters, lambda c: _cut(c, shingles(c))))

    words = _let(F.split(F.replace(sentence, F.lit(" "), F.lit(" " + _CUT)), _CUT), lambda u: F.when(F.exists(u, lambda w: F.length(w) > WORD), F.flatten(F.transform(u, word))).otherwise(u))
    by_words = _let(F.filter(words, lambda w: w != ""), lambda u: _cut(u, F.transform(u, lambda w: F.xxhash64(w))))
    return F.when(F.length(sentence) <= LONGEST, F.array(sentence)).otherwise(by_words)


def _cut(units: Column, hashes: Column) -> Column:
    """Units joined to pieces of at most WINDOW, that end after the least hash (the last of equal ones) of each WINDOW in a row."""
    cut = _between(_ends(hashes, WINDOW), lambda start, n: F.array_join(F.slice(units, start, n), ""))
    return F.when(F.size(units) > WINDOW, cut).otherwise(F.array(F.array_join(units, "")))


def _keyed(digest: Column, cells: int) -> list[Column]:
    """A digest's check value and its cell in each table."""
    places = [(F.pmod(F.xxhash64(digest, F.lit(t)), F.lit(cells)) + cells * t).cast("int").alias(f"p{t}") for t in range(TABLES)]
    return [F.shiftrightunsigned(F.xxhash64(digest, F.lit("check")), 32).alias("c"), *places]


def _holds(key: Column, i: Column) -> Column:
    return (key["p0"] == i) | (key["p1"] == i) | (key["p2"] == i)


def _with(cell: Column, key: Column) -> Column:
    """A cell after a key, whose n is 1 or -1, was added."""
    return F.struct(
        (cell["n"] + key["n"]).alias("n"), cell["d"].bitwiseXOR(key["d"]).alias("d"), cell["c"].bitwiseXOR(key["c"]).alias("c")
    )


def _signed(found: Column, sign: int) -> Column:
    return F.transform(found, lambda d: F.struct(F.lit(sign).alias("n"), d.alias("d")))


def _cells(signed: Column, cells: int) -> Column:
    """Array of TABLES * cells cells (n, d, c) with all keys (n, d) added."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    keys = F.transform(signed, lambda k: F.struct(k["n"].alias("n"), k["d"].alias("d"), *_keyed(k["d"], cells)))

    def table(k: Column, t: int) -> Column:
        return F.transform(F.sequence(F.lit(t * cells), F.lit((t + 1) * cells - 1)), lambda i: F.aggregate(F.filter(k, lambda x: x[f"p{t}"] == i), zero, _with))

    return _let(keys, lambda k: F.concat(*[table(k, t) for t in range(TABLES)]))


def sketch(found: Column, cells: int) -> Column:
    """Array of TABLES * cells cells (n, d, c)."""
    return _cells(_signed(found, 1), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["c"].bitwiseXOR(y["c"]).alias("c")
    ))


def peel(cells: Column, size: int, rounds: int = ROUNDS) -> Column:
    """Digests that only one of the two texts has, or null if the sketch was too small for them."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("out"), F.lit(True).alias("on"))

    def keys(state: Column) -> Column:
        one = F.filter(state["cells"], lambda c: F.abs(c["n"]) == 1)
        full = F.transform(one, lambda c: F.struct((-c["n"]).alias("n"), c["d"].alias("d"), c["c"].alias("found"), *_keyed(c["d"], size)))
        return F.array_distinct(F.filter(full, lambda k: k["c"] == k["found"]))

    def step(state: Column, _: Column) -> Column:
        def without(k: Column) -> Column:
            cells = F.transform(state["cells"], lambda c, i: F.aggregate(F.filter(k, lambda x: _holds(x, i)), c, _with))
            return F.struct(
                F.when(F.size(k) > 0, cells).otherwise(state["cells"]).alias("cells"),
                F.concat(state["out"], F.transform(k, lambda x: x["d"])).alias("out"), (F.size(k) > 0).alias("on"),
            )

        return F.when(state["on"], _let(keys(state), without)).otherwise(state)

    def result(state: Column) -> Column:
        empty = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["d"] == 0) & (c["c"] == 0))
        return F.when(empty, state["out"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, result)


def _groups(a: Column, b: Column) -> Column:
    return F.greatest(F.ceil((F.size(a) + F.size(b)) / GROUP).cast("int"), F.lit(1))


def _in_group(keys: Column) -> Column:
    """Number of digests that differ in one part of a larger sketch, given its keys (n, d)."""
    tries = [_count(peel(_cells(keys, cells), cells, GROUP_ROUNDS)) for cells in GROUP_CELLS]
    alone = F.filter(keys, lambda k: ~F.exists(keys, lambda x: (x["d"] == k["d"]) & (x["n"] != k["n"])))
    return F.coalesce(*tries, F.size(alone))


def differing(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """Number of pieces that differ. The base sketches are tried first, then larger ones.

    A larger sketch is a row of small ones, one for about GROUP pieces (of both texts) each, by digest; so its cost follows the
    length of the texts. It is the difference of the texts' sketches, as subtracting is adding with the other sign. A small one that
    can't be peeled is built again with twice the cells, twice; digests that none can peel (chance only) are compared directly.
    """
    signed = F.concat(_signed(a, 1), _signed(b, -1))
    groups = _groups(a, b)

    def larger(row: Column) -> Column:
        """Digests are dealt to groups in two steps, so each is looked at about twice the root of their number."""
        of = lambda k: F.pmod(k["d"], row["groups"])
        width = F.ceil(F.sqrt(row["groups"])).cast("int")

        def chunk(c: Column) -> Column:
            own = F.filter(row["keys"], lambda k: F.floor(of(k) / width) == c)
            last = F.least((c + 1) * width, row["groups"]) - 1
            return _let(own, lambda some: F.transform(F.sequence(c * width, last), lambda g: _let(F.filter(some, lambda k: of(k) == g), lambda k: F.when(F.size(k) > 0, _in_group(k)).otherwise(0))))

        chunks = F.ceil(row["groups"] / width).cast("int")
        return F.aggregate(F.flatten(F.transform(F.sequence(F.lit(0), chunks - 1), chunk)), F.lit(0), lambda x, n: x + n)

    small = _count(peel(subtract(base_a, base_b), BASE_CELLS))
    return F.coalesce(small, _let(F.struct(signed.alias("keys"), groups.alias("groups")), larger))


def _count(found: Column) -> Column:
    return _let(found, lambda f: F.when(f.isNotNull(), F.size(f)))


def sparse_differences(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(range, row, many0, failed0, many1, ..): digests that differ between each pair of columns, without those of failed groups.

    `rows` has range, row (which names a row) and the columns of `pairs`, and is partitioned by range, so nothing moves. A group's
    sketch is peeled once: a digest is found where it is alone in a cell of one table at least. When the digests found make up the
    whole of a table, none is missing; otherwise the group failed and `retried` builds it anew. Rows without any digest are left out.
    """
    p = len(pairs)
    size = SPARSE_TABLES * SPARSE_CELLS

    def keys(i: int, a: Column, b: Column) -> Column:
        groups = _groups(a, b)
        return F.transform(F.concat(_signed(a, 1), _signed(b, -1)), lambda k: F.struct(
            (F.pmod(k["d"], groups) * p + i).alias("part"), k["n"].alias("n"), k["d"].alias("d")
        ))

    check, *places = _keyed(F.col("d"), SPARSE_CELLS)
    found = rows.select("range", "row", F.explode(F.concat(*[keys(i, F.col(a), F.col(b)) for i, (a, b) in enumerate(pairs)])).alias("k"))
    slots = [F.col("part") * size + place for place in places[:SPARSE_TABLES]]
    found = found.select("range", "row", "k.*").select("range", "row", "n", "d", check, F.explode(F.array(*slots)).alias("slot"))
    cells = found.groupBy("range", "row", "slot").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    alone = (F.abs("n") == 1) & (F.col("c") == check)
    place = F.pmod("slot", F.lit(size))
    part = ["range", "row", "part"]
    cells = cells.select(
        "range", "row", ((F.col("slot") - place) / size).cast("long").alias("part"), "n", "d", "c",
        F.when(alone, F.col("d")).alias("key"), (place < SPARSE_CELLS).alias("first"),
    )
    # A digest may be alone in several tables. The first table holds each digest once.
    single = cells.groupBy(*part, "key").agg(
        F.sum(F.when(F.col("first"), F.col("n"))).alias("n"), *[F.bit_xor(F.when(F.col("first"), F.col(x))).alias(x) for x in "dc"], F.max("n").alias("side")
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    has_key = F.col("key").isNotNull()
    whole = (
        (zero(F.sum("n")) == zero(F.sum(F.when(has_key, F.col("side")))))
        & (zero(F.bit_xor("d")) == zero(F.bit_xor("key")))
        & (zero(F.bit_xor("c")) == zero(F.bit_xor(F.when(has_key, _keyed(F.col("key"), SPARSE_CELLS)[0]))))
    )
    parts = single.groupBy(*part).agg(F.count("key").alias("many"), whole.alias("whole"))
    of = lambda i, x: F.when(F.pmod("part", F.lit(p)) == i, x)
    return parts.groupBy("range", "row").agg(*[c for i in range(p) for c in (
        F.sum(of(i, F.when(F.col("whole"), F.col("many")).otherwise(0))).alias(f"many{i}"),
        F.collect_list(of(i, F.when(~F.col("whole"), F.floor(F.col("part") / p)))).alias(f"failed{i}"),
    )])


def retried(a: Column, b: Column, failed: Column) -> Column:
    """Number of digests that differ in the failed groups, whose sketches are built anew, larger and larger."""
    groups = _groups(a, b)
    own = F.filter(F.concat(_signed(a, 1), _signed(b, -1)), lambda k: F.array_contains(failed, F.pmod(k["d"], groups)))
    each = lambda keys: F.transform(failed, lambda g: _let(F.filter(keys, lambda k: F.pmod(k["d"], groups) == g), _in_group))
    return F.when(F.size(failed) > 0, F.aggregate(_let(own, each), F.lit(0), lambda x, n: x + n)).otherwise(0)


def likeness(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - differing(a, b, base_a, base_b) / both)


def fingerprint(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["d"]), F.hex(c["c"]))), "-")


def with_next(docs: DataFrame, sketched: bool = False) -> DataFrame:
    """(range, row, doc_id, text, pieces, next_text, next_pieces): each document beside the next one by falling id, the first after the
    last; `row` names a row. If `sketched`, also base_pieces and next_base_pieces, their base sketches.

    Ids are cut into ranges by approximate quantiles. The first document of a range is also sent to the range before, so
    texts are shuffled once, and the driver sees one id and hash for each range.
    """
    ranges = RANGES_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("value", F.col("id").cast("double")).withColumn("tie", F.xxhash64("text"))
    edges = rows.agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] or []
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="value", outputCol="range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0.0))
    heads = rows.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("h")).orderBy(F.desc("range")).collect()
    # At most `ranges` rows: the head of each range, and the range before it (of the first: the last).
    sent = [(r["h"]["id"], r["h"]["tie"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(sent, "id long, tie long, also double")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    extra = F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("range"), F.lit(True).alias("guest")))
    dealt = rows.join(F.broadcast(guests), ["id", "tie"], "left").select(
        "doc_id", "id", "tie", "text", digests(F.col("text")).alias("pieces"), F.explode(F.array_compact(F.array(own, extra))).alias("to")
    )
    dealt = dealt.select("doc_id", "id", "tie", "text", "pieces", F.col("to.range").cast("int").alias("range"), "to.guest").repartition("range")
    if sketched:
        dealt = dealt.withColumn("base_pieces", sketch(F.col("pieces"), BASE_CELLS))
    by = W.partitionBy("range").orderBy("guest", F.desc("id"), F.desc("tie"), "doc_id")
    told = ["text", "pieces", *(["base_pieces"] if sketched else [])]
    number = F.col("range").cast("long") * (1 << 40) + F.row_number().over(by)
    beside = dealt.select("*", number.alias("row"), *[F.lead(name).over(by).alias(f"next_{name}") for name in told])
    return beside.where(~F.col("guest")).select("range", "row", "doc_id", *told, *[f"next_{name}" for name in told])


def op4_paragraph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they and the next document's are.

    The documents are dealt to ranges once. One branch makes the fingerprints and peels them, the other the larger sketches.
    """
    sketched = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), sketched=True)
    plain = sketched.drop("base_pieces", "next_base_pieces")
    n = F.length("text")
    changed = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - changed), F.substring("next_text", F.lit(1), changed))
    pairs = [("pieces", "edited_pieces"), ("pieces", "next_pieces")]
    counts = sparse_differences(plain.select("range", "row", "pieces", "next_pieces", digests(edited).alias("edited_pieces")), pairs).drop("range")
    rows = sketched.select("row", "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "pieces", "next_pieces", "base_pieces", F.col("next_base_pieces").alias("base_next_pieces"))
    rows = rows.withColumn("edited_pieces", digests(F.col("edited"))).withColumn("edited", F.unhex(F.sha2("edited", 256)))
    rows = rows.withColumn("base_edited_pieces", sketch(F.col("edited_pieces"), BASE_CELLS))
    for i, (a, b) in enumerate(pairs):
        rows = rows.withColumn(f"small{i}", _count(peel(subtract(F.col(f"base_{a}"), F.col(f"base_{b}")), BASE_CELLS)))
    rows = rows.drop("base_next_pieces").join(counts, "row", "left")

    def near(i: int) -> Column:
        a, b = (F.col(name) for name in pairs[i])
        both = F.size(a) + F.size(b)
        larger = F.col(f"many{i}") + retried(a, b, F.col(f"failed{i}"))
        return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - F.coalesce(F.col(f"small{i}"), larger) / both)

    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), fingerprint(F.col("base_pieces")).alias("fingerprint"),
        fingerprint(F.col("base_edited_pieces")).alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"),
    )


QUERIES = {"op4_paragraph_lookup": op4_paragraph_lookup}
