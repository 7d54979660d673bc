import hashlib

import pytest
from pyspark.sql import functions as F

from relvec.functions.scalars import text_key
from relvec.operators import encode, lookup, ordered
from relvec.operators import text_dictionary as TD
from relvec.streaming import incremental

SCHEMA = "event_id long, query_text string, user_profile_text string, candidate_text string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, q, u, c) for i, (q, u, c) in enumerate(texts)], SCHEMA)


def test_null_text_joins_the_empty_text(spark):
    rows = rows_of(spark, [(None, "u", "c"), ("", "u", "c"), ("a", "u", "c")])
    dictionary = TD.text_dictionary(rows)
    found = {(r.role, r.text): (r.text_id, r.source_count) for r in dictionary.collect()}
    assert found[("query", "")] == (0, 2) and found[("query", "a")] == (1, 1)
    ids = {r.event_id: r.query_text_id for r in TD.attach_text_ids(rows, dictionary).collect()}
    assert ids == {0: 0, 1: 0, 2: 1}


def test_ids_order_by_count_then_hash(spark):
    rows = rows_of(spark, [("b", "u", "c"), ("a", "u", "c"), ("Z", "u", "c"), ("n", "u", "c"), ("n", "u", "c")])
    ids = {r.text: r.text_id for r in TD.text_dictionary(rows, ["query"]).collect()}
    rest = sorted("Zab", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert ids == {"n": 0, **{t: i + 1 for i, t in enumerate(rest)}}


def test_texts_that_begin_alike_are_spread(spark, monkeypatch):
    """Texts with one long header, each used once, still make ranges of like size."""
    sizes = []
    kept = ordered.materialize

    def seen(df, name):
        out = kept(df, name)
        if name == "ordered":
            sizes.extend(r["count"] for r in out.groupBy(F.shiftright("_at", 33)).count().collect())
        return out

    monkeypatch.setattr(ordered, "materialize", seen)
    header = "x" * 400
    rows = rows_of(spark, [(f"{header} {i}", "u", "c") for i in range(3000)])
    assert TD.text_dictionary(rows, ["query"]).count() == 3000
    assert len(sizes) == 3 and max(sizes) < 1.5 * 1000


def test_dense_ids_over_many_ranges(spark):
    data = [(g, (i * 7919) % 1000) for g in "xyz" for i in range(300 if g == "y" else 40)]
    df = spark.createDataFrame(data, "g string, v int").repartition(3)
    got = ordered.dense_ids(df, ["g"], [F.desc("v")], "id").collect()
    for g in "xyz":
        ranked = sorted((r.v for r in got if r.g == g), reverse=True)
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == ranked
        assert sorted(r.id for r in got if r.g == g) == list(range(len(ranked)))


def test_unknown_text_fails(spark):
    dictionary = TD.text_dictionary(rows_of(spark, [("a", "u", "c")]))
    with pytest.raises(Exception, match="not in the dictionary"):
        TD.attach_text_ids(rows_of(spark, [("b", "u", "c")]), dictionary).collect()


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_hot_keys_keep_every_row(spark, broadcast):
    """One key owns most rows; with broadcasting off the rest takes the shuffled join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        keys = ["hot"] * 600 + [f"k{i}" for i in range(300)] + [None] * 5
        rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row_id long, key string")
        table = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        table = table.withColumns({"value": F.length("key"), "role": F.lit("r")})
        used = lookup.usage(table, "n", "role")["r"]
        assert used.hot == 1 and used.entries == 301
        out = lookup.lookup(rows, table, "key", ["value"], "n", used)
        got = {r.row_id: r.value for r in out.collect()}
        assert got == {i: (len(k) if k else None) for i, k in enumerate(keys)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_entries_stay_below_the_slot_count(spark):
    table = spark.createDataFrame([("r", i, 10) for i in range(500)], "role string, key int, n int")
    used = lookup.usage(table, "n", "role")["r"]
    assert used.hot < lookup.hot_slots(table) and used.entries == 500


def test_lookup_skips_unwanted_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "row_id long, key int")
    table = spark.createDataFrame([(5, "five")], "key int, name string")
    got = lookup.lookup(rows, table, "key", ["name"], wanted=F.col("row_id") != 2).collect()
    assert {r.row_id: r.name for r in got} == {1: "five", 2: None, 3: None}
    with pytest.raises(Exception, match="no name: 9"):
        lookup.lookup(rows, table, "key", ["name"], missing="no name").collect()


def test_copies_do_not_change_the_texts(spark):
    once = rows_of(spark, [("a", "u", "c"), ("b", "u", "d")])
    twice = once.union(once)
    texts = lambda df: {(r.role, r.text) for r in TD.text_dictionary(df).collect()}
    assert texts(once) == texts(twice)


def test_hash_encoder_golden_values():
    one = encode.HashEncoder(8)
    got = one.encode(["", "coldstart", "a"]).tolist()
    assert got == [
        [b - 128 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in (":0", "coldstart:0", "a:0")
    ]


def test_encoder_output_is_checked():
    import numpy as np

    with pytest.raises(ValueError, match="shape"):
        encode.checked(np.zeros((2, 3)), 2, 4)


def test_encoded_numbers_are_rounded_and_clipped(spark):
    import numpy as np

    class Fixed:
        def encode(self, texts):
            return np.array([[0.5, 1.5, -2.5, 200.7, -300.0]] * len(texts))

    out = encode.encode_texts(spark.createDataFrame([("a",)], "text string"), Fixed, 5).first()
    assert list(out.embedding) == [0, 2, -2, 127, -128]


def test_spark_and_encoder_stand_ins_agree(spark):
    from relvec.functions import vectors as V

    df = spark.createDataFrame([("",), ("ä b",)], "text string").select(V.hashed("text", 40).alias("v"))
    assert [list(r.v) for r in df.collect()] == encode.HashEncoder(40).encode(["", "ä b"]).tolist()


def test_embedding_goes_on_after_a_failure(spark, tmp_path):
    folder = str(tmp_path / "store")
    everything = TD.text_dictionary(rows_of(spark, [(f"q{i}", "u", f"c{i}") for i in range(20)]))

    class Failing:
        def encode(self, texts):
            if any(t == "c7" for t in texts):
                raise RuntimeError("lost")
            return encode.HashEncoder(8).encode(texts)

    with pytest.raises(Exception, match="lost"):
        incremental.embed_pending(spark, everything, folder, Failing, 8)
    before = spark.read.parquet(folder).count()
    assert 0 < before < 41
    assert incremental.embed_pending(spark, everything, folder, lambda: encode.HashEncoder(8), 8) == 41 - before
    assert spark.read.parquet(folder).count() == 41
    assert spark.read.parquet(f"{folder}_progress").count() > 1


def test_store_resumes_with_new_texts_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    make = lambda: encode.HashEncoder(8)
    first = TD.text_dictionary(rows_of(spark, [("a", "u", "c")]))
    assert incremental.embed_pending(spark, first, folder, make, 8) == 3
    assert incremental.embed_pending(spark, first, folder, make, 8) == 0
    second = TD.text_dictionary(rows_of(spark, [("a", "u", "c"), ("b", "u", "d")]))
    progress = {r.role: (r.completed, r.total, r.fraction) for r in incremental.embedding_progress(spark, second, folder).collect()}
    assert progress == {"query": (1, 2, 0.5), "user": (1, 1, 1.0), "candidate": (1, 2, 0.5)}
    assert incremental.embed_pending(spark, second, folder, make, 8) == 2
    stored = spark.read.parquet(folder)
    assert stored.count() == 5 == stored.select("role", "text_key").distinct().count()
    vector = stored.join(spark.createDataFrame([("a",)], "t string").select(text_key("t").alias("text_key")), "text_key").first()
    assert list(vector.embedding) == encode.HashEncoder(8).encode(["a"])[0].tolist()


def test_a_repeated_key_fails_where_ids_are_joined(spark, small):
    from relvec import fixtures as X
    from relvec.operators.features import attach_ids_and_vectors, attach_vectors

    rows, store = X.interactions_and_store(spark, small)
    dictionary = store.drop("embedding")
    repeated = dictionary.unionByName(dictionary.where("role = 'user' and text_id = 1"))
    with pytest.raises(ValueError, match="dictionary repeats keys"):
        TD.attach_text_ids(rows, repeated)
    twice = store.unionByName(store.where("role = 'query' and text_id = 0"))
    for attach in (attach_ids_and_vectors, attach_vectors):
        ready = TD.attach_text_ids(rows, dictionary)
        with pytest.raises(ValueError, match="store repeats keys"):
            attach(ready, twice)
