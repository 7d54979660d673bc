"""Views over the test tables that stand in for interactions, stores, predictions and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.functions.vectors import quantize
from relvec.operators.metrics import evaluate_split
from relvec.operators.text_dictionary import text_dictionary
from relvec.schema import LABEL_ORDER
from relvec.session import materialize
from relvec.sources.tables import spread

DIM = 64
DIMS = (16, 32, 64)
ROLE_VECTOR = {"query": (1, 0), "user": (7, 3), "candidate": (13, 5)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recruiter-candidate interactions: a query, a user profile and a candidate text each."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text"))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("candidate_text"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    event, user = F.col("event_id"), F.col("user_id")
    keyed = events.withColumns({
        "item_id": (event + user) % row_count(benchmark),
        "doc_id": (event * 7919 + user * 31) % row_count(documents),
    })
    # Documents come last: no other join moves their long texts.
    joined = (
        keyed.join(benchmark, "item_id")
        .join(customer, F.col("c_custkey") == user, "left")
        .join(documents, "doc_id")
    )
    profile = F.concat("c_mktsegment", F.lit(" nation "), F.col("c_nationkey").cast("string"))
    kind = F.col("event_type")
    return joined.select(
        "event_id", "user_id", (user * 1000 + F.col("item_id")).alias("search_id"), F.col("doc_id").alias("profil_id"),
        F.when(event % 10 < 8, "train").when(event % 10 == 8, "valid").otherwise("test").alias("split"),
        "query_text", F.when(user % 10 == 0, "coldstart").otherwise(profile).alias("user_profile_text"), "candidate_text",
        F.when(kind == "purchase", "Go").when(kind == "signup", "Interesting").when(kind == "click", "Why not")
        .when(kind == "view", "Not interesting").otherwise("Out of scope").alias("label"),
        F.col("value").alias("label_weight"), "ts",
    )


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", quantize("embedding", 127.0).alias("embedding"))


def role_store(spark: SparkSession, sf_dir: str, dictionary: DataFrame) -> DataFrame:
    """Stored vectors: each dictionary text gets a quantized table vector, chosen by its text id."""
    vectors = quantized(spark, sf_dir)

    def of_role(part: int) -> Column:
        value = F.lit(None).cast("bigint")
        for role, numbers in ROLE_VECTOR.items():
            value = F.when(F.col("role") == role, numbers[part]).otherwise(value)
        return value

    position = (F.col("text_id") * of_role(0) + of_role(1)) % row_count(vectors)
    store = dictionary.withColumn("vec_id", position).join(vectors, "vec_id").select(
        "text_id", "text_key", "source_count", "embedding", "role"
    )
    return materialize(store, "store")


def interactions_and_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = interactions(spark, sf_dir)
    return rows, role_store(spark, sf_dir, text_dictionary(rows))


def label_id(label: Column) -> Column:
    out = F.lit(len(LABEL_ORDER) - 1)
    for i in reversed(range(len(LABEL_ORDER) - 1)):
        out = F.when(label == LABEL_ORDER[i], i).otherwise(out)
    return out


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic class scores with many ties, a little better than chance."""
    rows = interactions(spark, sf_dir)
    event, user = F.col("event_id"), F.col("user_id")
    scores = [
        (F.lit(1) + (event * m + user) % 97 + F.when(F.col("label") == name, 20).otherwise(0)).cast("double").alias(f"s{i}")
        for i, (m, name) in enumerate(zip((17, 29, 41, 53, 67), LABEL_ORDER))
    ]
    raw = rows.select("event_id", "user_id", "split", "label", "label_weight", label_id(F.col("label")).alias("label_id"), *scores)
    total = sum((F.col(f"s{i}") for i in range(1, 5)), F.col("s0"))
    return raw.withColumn("_t", total).select(
        "event_id", "user_id", "split", "label", "label_id", "label_weight",
        F.array(*[F.col(f"s{i}") / F.col("_t") for i in range(5)]).alias("probs"),
    )


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a written table, which is what an evaluation of several passes starts from."""
    return materialize(predictions(spark, sf_dir), "predictions")


RUNS = 24


def run_index(user: Column) -> Column:
    return user % RUNS


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recorded experiment per user group; group 5 failed."""
    i = F.col("run_no")
    rows = table(spark, sf_dir, "events").select(run_index(F.col("user_id")).alias("run_no")).distinct()
    name = F.concat(F.lit("run_"), F.lpad(i.cast("string"), 2, "0"))
    return rows.select(
        name.alias("experiment_name"),
        F.when(i % 3 == 0, "mlp").otherwise("logreg").alias("model_type"),
        F.when(i % 2 == 0, "off").otherwise("balanced-sample-weight").alias("class_imbalance_handling"),
        F.when(i % 4 < 2, 32).otherwise(64).alias("embedding_prefix_dim"),
        F.concat(F.lit("runs/"), name).alias("run_dir"), F.concat(F.lit("logs/"), name).alias("log_path"),
        F.when(i == 5, "failed").otherwise("success").alias("status"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall metrics of every finished run, from the predictions of its user group."""
    run = run_index(F.col("user_id"))
    preds = stored_predictions(spark, sf_dir).withColumn("run_no", run).where(F.col("run_no") != 5)
    name = F.concat(F.lit("run_"), F.lpad(F.col("run_no").cast("string"), 2, "0"))
    return evaluate_split(preds.withColumn("run_dir", name), len(LABEL_ORDER), by=["run_dir", "split"])
