import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relvec.fixtures import DIMS, interactions_and_store
from relvec.functions import vectors as V
from relvec.operators import features as FE
from relvec.schema import parse_prefix_dims, require_columns, require_length, require_unique

VECTORS = "q array<tinyint>, u array<tinyint>, c array<tinyint>"


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v array<{kind}>")


def test_quantize_rounds_half_even_and_clips(spark):
    df = column(spark, [[0.5, 1.5, -2.5, 200.7, -300.0]], "double").select(V.quantize("v").alias("v"))
    assert list(df.first().v) == [0, 2, -2, 127, -128]


def test_whole_numbers_wrap(spark):
    df = column(spark, [[300, -200, 127, 128, -129]], "bigint").select(V.wrap_int8("v").alias("v"))
    assert list(df.first().v) == np.array([300, -200, 127, 128, -129]).astype(np.int8).tolist()


def test_zero_vector_has_no_direction(spark):
    df = column(spark, [[0, 0], [3, 4]], "tinyint").select(V.l2_normalized("v").alias("v"))
    assert [list(r.v) for r in df.collect()] == [[0.0, 0.0], [0.6, 0.8]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=5))
def test_prefix_dims(dims):
    assert parse_prefix_dims(dims, 1024) == sorted({*dims, 1024})


@pytest.mark.parametrize("bad", ["0", "1025,4", "-3"])
def test_prefix_dims_out_of_range(bad):
    with pytest.raises(ValueError):
        parse_prefix_dims(bad, 1024)


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def expected_cosines(q, u, c, cold):
    qn, un, cn = unit(q), unit(u), unit(c)
    both = np.where(cold[:, None], qn, unit(qn + un))
    return {
        "qc": (qn * cn).sum(1), "uc": np.where(cold, 0, (un * cn).sum(1)), "qu": np.where(cold, 0, (qn * un).sum(1)),
        "quc": (both * cn).sum(1),
    }


@pytest.mark.parametrize("arrow", [True, False])
@pytest.mark.parametrize("parts", [1, 5])
def test_cosines_match_numpy(spark, arrow, parts):
    rng = np.random.default_rng(3)
    q, u, c = (rng.integers(-128, 128, (60, 12)) for _ in range(3))
    q[0] = u[1] = c[2] = 0
    q[3], u[3] = np.arange(12), -np.arange(12)
    q[4, :4] = 0
    cold = np.arange(60) % 5 == 4
    rows = [(i, bool(cold[i]), q[i].tolist(), u[i].tolist(), c[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, cold boolean, query_vec array<tinyint>, user_vec array<tinyint>, candidate_vec array<tinyint>")
    got = FE.add_cosines(df.repartition(parts), [4, 8, 12], cold=F.col("cold"), arrow=arrow).orderBy("event_id").toPandas()
    for d in (4, 8, 12):
        want = expected_cosines(*(m[:, :d].astype(float) for m in (q, u, c)), cold)
        for kind, values in want.items():
            np.testing.assert_allclose(got[f"{kind}_cosine_{d}"], values, atol=1e-12)
    assert (got["embedding_user_available"].to_numpy() == (~cold).astype(int)).all()


def test_sums_stay_exact_for_extreme_vectors(spark):
    low = [-128] * 2048
    df = spark.createDataFrame([(low, low, low)], VECTORS).select(V.prefix_sums(F.col("q"), F.col("u"), F.col("c"), [1024, 2048]).alias("s"))
    assert list(df.first().s.qq) == [1024 * 16384, 2048 * 16384]


def test_vectors_of_different_length_fail(spark):
    df = spark.createDataFrame([([1, 2], [1, 2], [1, 2]), ([1], [1, 2], [1, 2])], VECTORS).coalesce(1)
    with pytest.raises(Exception, match="one length"):
        df.select(V.prefix_sums(F.col("q"), F.col("u"), F.col("c"), [2])).collect()
    with pytest.raises(Exception, match="expected 2 dimensions"):
        df.select(require_length(F.col("q"), 2)).collect()


def test_concat_zeroes_cold_users_on_request(spark):
    df = spark.createDataFrame([(0, [1, 2], [3, 4], [5, 6]), (1, [1, 2], [3, 4], [5, 6])],
                               "embedding_user_available int, query_vec array<tinyint>, user_vec array<tinyint>, candidate_vec array<tinyint>")
    both = [[list(r.features_int8) for r in FE.feature_vector(df, 1, zero).orderBy("embedding_user_available").collect()] for zero in (True, False)]
    assert both == [[[1, 0, 5], [1, 3, 5]], [[1, 3, 5], [1, 3, 5]]]


def test_prefix_longer_than_the_vector_fails(spark):
    df = spark.createDataFrame([([1, 2], [3, 4], [5, 6])], "query_vec array<tinyint>, user_vec array<tinyint>, candidate_vec array<tinyint>")
    with pytest.raises(Exception, match="prefix length 3 exceeds a vector of 2"):
        FE.feature_vector(df, 3).collect()
    with pytest.raises(ValueError, match="positive"):
        FE.feature_vector(df, 0)


def test_features_do_not_depend_on_partitioning_or_path(spark, small):
    rows, store = interactions_and_store(spark, small)
    one = FE.cosine_features(rows.coalesce(1), store, DIMS)
    many = FE.cosine_features(rows.repartition(7), store, DIMS, once_per_triple=True)
    builtin = FE.cosine_features(rows, store, DIMS, arrow=False)
    columns = sorted(one.columns)
    assert sorted(many.columns) == columns
    frames = [df.select(columns).orderBy("event_id").toPandas() for df in (one, many, builtin)]
    assert frames[0].equals(frames[1]) and frames[0].equals(frames[2])


def test_copies_of_a_row_stay_copies(spark, small):
    """A third of the rows are the same interaction."""
    rows, store = interactions_and_store(spark, small)
    copied = rows.union(rows.where("event_id = 7").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i"))
    out = FE.cosine_features(copied, store, [64], once_per_triple=True)
    assert out.count() == 1500
    assert out.where("event_id = 7").select("qc_cosine_64", "candidate_text_id").distinct().count() == 1


def test_required_columns_and_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="lacks required columns"):
        require_columns(df, ["k", "missing"])
    with pytest.raises(ValueError, match="repeats keys"):
        require_unique(df, ["k"])
    assert require_unique(df, ["k", "v"]) is df


def test_packed_vectors_read_back_as_the_same_matrix(spark):
    import pyarrow as pa

    rows = [[1, -2, 127], None, [-128, 0, 5], [7, 8, 9]]
    table = column(spark, rows, "tinyint").coalesce(1).select("v", V.packed("v").alias("p")).toArrow()
    for cut in (slice(0, 4), slice(1, 4), slice(2, 3)):
        lists, bytes_ = (table[c].combine_chunks()[cut] for c in ("v", "p"))
        assert pa.types.is_binary(bytes_.type)
        for dim in (2, 3):
            assert (V.dense_rows(bytes_, dim) == V.dense_rows(lists, dim)).all()
            assert V.dense_rows(bytes_, dim, np.int8).dtype == np.int8
        with pytest.raises(ValueError, match="at least 4"):
            V.dense_rows(bytes_, 4)
    with pytest.raises(ValueError, match="one length"):
        V.dense_rows(pa.array([b"abc", b"a"]), 1)
