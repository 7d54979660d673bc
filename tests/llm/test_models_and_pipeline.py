"""Neighbour search, toxicity, the pipeline and the registered queries."""

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from relvec.llm import adaptive_scan, components, registry, toxicity


def test_recall_and_exact_scores(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = sorted(vectors.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = adaptive_scan.neighbours(vectors).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = sorted((r for r in found if r["query_id"] == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        for r in mine:
            assert r["score"] == pytest.approx(score[np.searchsorted(ids, r["vec_id"])], abs=1e-12)
        hits += len({r["vec_id"] for r in mine} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_defined_cases(spark):
    kind = "vec_id long, embedding array<float>, label int, VEC_ID string"
    rows = [(i, [1.0, 0.0], 0, "") for i in range(0, 45)] + [
        (100, None, 0, ""), (120, [0.0, 0.0], 0, ""), (140, [float("nan"), 1.0], 0, ""), (160, [None, 1.0], 0, ""), (180, [1.0], 0, ""), (None, [1.0, 1.0], 0, ""),
    ]
    found = adaptive_scan.neighbours(spark.createDataFrame(rows, kind)).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40}
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 20) == [i for i in range(21) if i != 20]
    few = adaptive_scan.neighbours(spark.createDataFrame(rows[:3], kind)).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert adaptive_scan.neighbours(spark.createDataFrame([], kind)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 120)}


def toxic_rows(n):
    """Half of the documents hold a word of each list; only both together are toxic. One word is toxic by itself."""
    rng = np.random.default_rng(4)
    for i in range(n):
        text = " ".join(rng.choice([f"w{j}" for j in range(300)], 40))
        a, b, c = (rng.random(3) < (0.4, 0.4, 0.1)).tolist()
        yield i, text + " insult" * a + " group" * b + " slur" * c, int(c or (a and b))


def test_toxicity_learns_pairs_on_unseen_documents(spark):
    rows = list(toxic_rows(1500))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, TEXT string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, keep=~toxicity.held_out(F.col("doc_id")))
    scored = model.transform(docs)
    assert scored.columns == [*docs.columns, "score"]
    score = {r[0]: r[-1] for r in scored.collect()}
    seen = {r[0]: r[1] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()}
    unseen = [(score[i], y) for i, _, y in rows if seen[i]]
    assert len(unseen) > 200 and sum((s >= 0.3) == y for s, y in unseen) / len(unseen) >= 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.3 for s in score.values())


def test_toxicity_defined_cases(docs, repeated, empty, spark):
    kind = "doc_id long, quality int, toxic int"
    none, one = spark.createDataFrame([], kind), spark.createDataFrame([(7, 1, 1), (None, 1, 0), (14, 1, None)], kind)
    assert {r[-1] for r in toxicity.fit(docs, none).transform(docs).collect()} == {0.0}
    assert {r[-1] for r in toxicity.fit(docs, one).transform(repeated).collect()} == {1.0}
    assert toxicity.fit(empty, one).transform(empty).count() == 0
    held = spark.createDataFrame([(1,), (None,)], "doc_id long").select(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r[0] in (True, False) for r in held)


def test_without_a_machine_no_document_is_dropped(docs, spark):
    kind = "doc_id long, quality int, toxic int"
    for labels in ([(7, 1, 1)], [(7, 1, 1), (14, 1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, kind))
        assert model.machine is None and model.prior >= toxicity.THRESHOLD
        assert sorted(toxicity.without_toxic(docs, model).collect()) == sorted(docs.collect())


def test_pipeline_stages_take_effect(spark, docs, small):
    current, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        current = stage(spark, current, small).cache()
        assert current.columns == docs.columns and 0 < current.count() <= before
        before = current.count()
    mixed = corpus_pipeline.STAGES[3][1](spark, current, small)
    assert mixed.columns == docs.columns and {r[0] for r in mixed.collect()} <= {r[0] for r in current.collect()}
    coded = corpus_pipeline.STAGES[4][1](spark, mixed, small)
    assert coded.columns == [*docs.columns, "ids"]


def test_pipeline_runs_over_documents(spark, small):
    out = corpus_pipeline.run(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1")
    assert out.count() > 0 and "ids" in out.columns
    assert out.join(labels, "doc_id", "left_semi").select("doc_id").distinct().count() < labels.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registered_queries_match_their_sql(spark, small, name):
    assert compare(queries()[name](spark, small), connect(small), oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_registered_queries_return_every_document(spark, small, name):
    out = queries()[name](spark, small)
    rows = out.collect()
    if name.startswith("op6_"):
        assert len(rows) == 20 * spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 20 = 0").count()
    else:
        ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
        assert sorted(r["doc_id"] for r in rows) == ids
