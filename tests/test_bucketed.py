import glob

import pytest
from pyspark.sql import functions as F

from relvec import fixtures as X
from relvec.operators import features as FE
from relvec.operators import text_dictionary as TD
from relvec.sources import bucketed as B
from relvec.sources import tables
from relvec.streaming import incremental

KEYS = ["query_text_key", "user_text_key", "candidate_text_key"]
BUCKETS = 32


@pytest.fixture
def stored(spark, tmp_path, small):
    """A store in two commits: (its folder, the interactions with text keys, the same store as it came)."""
    rows, store = X.interactions_and_store(spark, small)
    folder = str(tmp_path / "store")
    B.write_bucketed_store(store.where("role = 'query'"), folder, buckets=BUCKETS)
    B.write_bucketed_store(store.where("role <> 'query'"), folder)
    return folder, TD.with_text_keys(rows), store


def contents(store):
    return sorted(map(str, store.select("role", "text_id", "text_key", "source_count", "embedding").collect()))


def test_roundtrip_and_overwrite(spark, stored):
    folder, _, store = stored
    assert contents(tables.read_store(spark, folder)) == contents(store)
    assert contents(spark.read.schema(store.select("text_id", "text_key", "source_count", "embedding", "role").schema).parquet(folder)) == contents(store)
    fewer = store.where("role = 'user' and text_id % 2 = 0")
    B.write_bucketed_store(fewer, folder, "overwrite")
    assert contents(tables.read_store(spark, folder)) == contents(fewer)
    assert B.store_buckets(spark, folder) == BUCKETS


def test_another_session_table_finds_the_store(spark, stored):
    folder, _, store = stored
    for table in spark.catalog.listTables():
        if table.name.startswith("relvec_store_"):
            spark.sql(f"DROP TABLE {table.name}")  # what the end of a session does to a table of its own
    assert contents(tables.read_store(spark, folder)) == contents(store)
    B.write_bucketed_store(store.limit(0), folder)
    assert contents(tables.read_store(spark, folder)) == contents(store)


def test_wrong_uses_fail(spark, tmp_path, stored):
    folder, _, store = stored
    with pytest.raises(ValueError, match="32 buckets"):
        B.write_bucketed_store(store, folder, buckets=8)
    plain = str(tmp_path / "plain")
    tables.write_store(store, plain)
    with pytest.raises(ValueError, match="without buckets"):
        B.write_bucketed_store(store, plain)
    with pytest.raises(ValueError, match="no store with buckets"):
        B.read_bucketed_store(spark, plain)


def test_lookups_do_not_move_the_store(spark, stored):
    folder, rows, store = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = tables.read_store(spark, folder)
        used = FE.store_usage(store)
        plan = FE.attach_ids_and_vectors(rows, bucketed, used)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_k#" in line]
    assert plan.count("Bucketed: true") >= sum(u.hot < u.entries for u in used.values()) >= 1
    assert exchanges == [] and "hashpartitioning(_probe" in plan


def test_few_keys_read_few_buckets(spark, stored):
    folder, rows, store = stored
    few = rows.orderBy("event_id").limit(3)
    store_rows = tables.read_store(spark, folder)
    wanted = B.entries_for(store_rows, few, KEYS)
    keys = {r[k] for r in few.collect() for k in KEYS}
    assert {r.text_key for r in wanted.collect()} == keys
    expected = sorted(map(str, FE.attach_ids_and_vectors(few, store).collect()))
    number = F.pmod(F.hash("text_key"), F.lit(BUCKETS))
    touched = {r[0] for r in store.where(F.col("text_key").isin(list(keys))).select(number).collect()}
    spoilt = 0
    for path in glob.glob(f"{folder}/role=*/*.parquet"):
        if int(path.rsplit("_", 1)[1].split(".")[0]) not in touched:
            with open(path, "wb") as file:
                file.write(b"unreadable")
            spoilt += 1
    assert spoilt > BUCKETS // 2
    # The files of the other buckets can't be read any more, and nothing misses them.
    used = FE.store_usage(store)
    assert sorted(map(str, FE.attach_ids_and_vectors(few, wanted, used).collect())) == expected


def test_many_keys_leave_the_store_whole(spark, stored):
    folder, rows, _ = stored
    store = tables.read_store(spark, folder)
    assert B.entries_for(store, rows, KEYS, listed=2) is store
    assert B.entries_for(store, rows.limit(0), KEYS).count() == 0


def test_stream_over_buckets_equals_plain(spark, tmp_path, stored):
    folder, rows, store = stored
    plain = rows.drop(*KEYS)
    tables.write_store(store, str(tmp_path / "plain"))
    plain.coalesce(3).write.parquet(str(tmp_path / "in"))
    out = []
    for name, place in (("a", folder), ("b", str(tmp_path / "plain"))):
        query = incremental.feature_stream(
            spark, str(tmp_path / "in"), plain.schema, place, [16, 64], str(tmp_path / f"out_{name}"), str(tmp_path / f"cp_{name}"), 1
        )
        query.awaitTermination()
        found = incremental.read_stream_features(spark, str(tmp_path / f"out_{name}"))
        out.append(sorted(map(str, found.select(sorted(found.columns)).collect())))
    assert out[0] == out[1] and len(out[0]) == plain.count()
