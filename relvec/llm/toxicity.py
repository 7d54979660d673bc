"""Toxicity scores from a factorization machine over hashed terms.

Terms are hashed into a fixed space; the buckets that go with the label beyond chance (chi-square of presence and label)
become features, present or not. The machine learns a weight for each feature and a short vector whose products weigh
every pair of them; terms that are neutral alone are not among them, so pairs of these are missed (open). Learning reads at most about `max_rows` labelled documents, chosen by a hash of their id; that
is the only sample. Scoring reads every whole text, row by row.

Defined cases: a null text is empty and gets the score of a text without known terms; conflicting labels of one id count
as the larger one; null labels and ids teach nothing; without labels of both kinds, every score is the share of toxic
labels (0 without labels). Repeated rows get equal scores. Input columns are kept; extra ones are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvec.llm.common import pick

BUCKETS = 1 << 18
MAX_TRAINING_ROWS = 20_000  # the sample bound
FACTORS = 4
ITERATIONS = 50
STEP = 0.15
INIT = 0.1  # deviation of the first pair vectors
LEAST_CHI_SQUARE = 24.0  # about one in a million by chance
THRESHOLD = 0.3


def terms(text: Column) -> Column:
    """Buckets of the lower-case words of letters and digits, as text; a bucket may stand more than once."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda t: F.pmod(F.hash(t), F.lit(BUCKETS)).cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class ToxicityModel:
    """Adds `score` to a frame with a text column. Without features, every score is `prior`."""

    def __init__(self, prior: float, vectors: CountVectorizerModel | None = None, machine=None) -> None:
        self.prior, self.vectors, self.machine = prior, vectors, machine

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Works on any columns: they are renamed while the score is computed."""
        names = rows.columns
        plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
        if self.machine is None:
            return plain.withColumn("score", F.lit(self.prior)).toDF(*names, "score")
        scored = self.machine.transform(self.vectors.transform(plain.withColumn("_terms", terms(F.col(f"c{names.index(text)}")))))
        return scored.select(*plain.columns, vector_to_array("_probability")[1].alias("score")).toDF(*names, "score")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, keep: Column | None = None) -> ToxicityModel:
    """Learn from labelled documents for whose `doc_id` `keep` holds (all, if not given)."""
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    rows, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = toxic / rows if rows else 0.0
    if not 0 < toxic < rows:
        return ToxicityModel(prior)
    if rows > max_rows:
        share = F.lit(int(max_rows / rows * (1 << 30)))
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < share)
    # At most about max_rows pairs of numbers are broadcast.
    sample = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("label", terms(F.col("text")).alias("_terms"))
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, F.hash("_terms")).persist()
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    seen = sample.select("label", F.explode(F.array_distinct("_terms")).alias("bucket"))
    held = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    # n * (observed joint count - expected)**2 over the product of the four margins; the kept buckets are few.
    lift = F.col("k") * n - F.col("n") * positive
    chi_square = lift * lift * n / (F.col("n") * (n - F.col("n")) * positive * (n - positive))
    kept = held.where((F.col("n") < n) & (chi_square >= LEAST_CHI_SQUARE)).select("bucket")
    buckets = sorted(r[0] for r in kept.collect()) if 0 < positive < n else []
    if not buckets:
        sample.unpersist()
        return ToxicityModel(prior)
    vectors = CountVectorizerModel.from_vocabulary(buckets, inputCol="_terms", outputCol="_known").setBinary(True)
    rows = vectors.transform(sample).select("label", "_known").persist()
    machine = FMClassifier(
        featuresCol="_known", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted",
        factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=1e-4, initStd=INIT, tol=1e-9, seed=7,
    ).fit(rows)
    rows.unpersist()
    sample.unpersist()
    return ToxicityModel(prior, vectors, machine)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows and columns of `docs` that score below the threshold; all of them, if no machine could be fitted."""
    if model.machine is None:
        return docs
    scored = model.transform(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))], "score")
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, keep=~held_out(F.col("doc_id")))
    scored = model.transform(pick(docs, "doc_id", "text"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op2_toxicity": op2_toxicity}
