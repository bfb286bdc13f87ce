"""A learned scorer: logistic regression over hashed strain and country and the month, where a neural network may be plugged in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlake.functions.dna import clean
from strainlake.operators.backtest import auc, log_loss
from strainlake.operators.labels import split_by_key, with_sequences

FEATURES = ("Country", "Master", "Month", "Freq")


def outbreak_features(labelled: DataFrame) -> DataFrame:
    """Labelled rows with Year and Month as features (the month as a category)."""
    return labelled.withColumns({"Year": F.year("YearMonth"), "Month": F.month("YearMonth").cast("string")})


class Model:
    """A fitted scorer: ``transform`` adds Probability."""

    def __init__(self, fitted: PipelineModel):
        self.fitted = fitted

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.fitted.transform(rows).withColumn("Probability", vector_to_array("__both")[1]).drop("features", "rawPrediction", "__both", "prediction")


def fit(rows: DataFrame, label: str = "Outbreak", size: int = 1 << 12, rounds: int = 20, features: tuple[str, ...] = FEATURES) -> Model:
    hasher = FeatureHasher(inputCols=list(features), outputCol="features", numFeatures=size)
    regression = LogisticRegression(featuresCol="features", labelCol=label, probabilityCol="__both", maxIter=rounds, regParam=0.001)
    return Model(Pipeline(stages=[hasher, regression]).fit(rows.withColumn(label, F.col(label).cast("double"))))


def scorer(model: Model):
    """A scorer of (Country, Month, Accession) for forecast.scan, from a model of Country, Master and Month."""

    def score(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({"Master": F.col("Accession"), "__month": F.col("Month"), "Month": F.col("Month").cast("string")})
        return model.transform(named).withColumn("Month", F.col("__month")).drop("__month", "Master")

    return score


def point(score, spark, accession: str, country: str, month: int) -> float:
    """Probability of one strain in one country and month."""
    return score(spark.createDataFrame([(country, month, accession)], "Country string, Month int, Accession string")).first().Probability


#: Rows from which a share of them is held out to measure a fit, and that share.
VALIDATED_FROM, VALIDATION = 10, 0.1


def kmers(seq: Column, k: int) -> Column:
    """All runs of k bases of a cleaned sequence, in order."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def sequence_features(sequences: DataFrame, k: int = 6, size: int = 1 << 12) -> DataFrame:
    """Master, kmers (vector of hashed counts of k bases) of each sequence (Master, sequence) that cleans to something."""
    cleaned = sequences.dropDuplicates(["Master"]).select("Master", clean(F.col("sequence")).alias("seq")).where("seq <> ''")
    words = cleaned.select("Master", kmers(F.col("seq"), k).alias("words"))
    return HashingTF(inputCol="words", outputCol="kmers", numFeatures=size).transform(words).select("Master", "kmers")


@dataclass
class SequenceModel:
    """A fitted scorer of rows with the sequence of their Master; validation: log loss and AUC of held-out rows, if there were enough."""

    fitted: PipelineModel
    sequences: DataFrame
    validation: dict[str, float] | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows whose Master has a sequence, with Probability."""
        done = self.fitted.transform(rows.join(self.sequences, "Master"))
        return done.withColumn("Probability", vector_to_array("__both")[1]).drop("kmers", "__meta", "features", "rawPrediction", "__both", "prediction")


def fit_sequences(rows: DataFrame, sequences: DataFrame, label: str = "Outbreak", features: tuple[str, ...] = ("Country", "Month"), k: int = 6, size: int = 1 << 12, rounds: int = 20) -> SequenceModel:
    """Logistic regression of label on the k-mers of the Master's sequence, beside hashed features; features are computed once a
    sequence.  Of VALIDATED_FROM rows and more, a tenth (by a hash) is held out to measure the fit."""
    found = sequence_features(sequences, k, size)
    rows = with_sequences(rows, sequences).withColumn(label, F.col(label).cast("double"))
    stages = [
        FeatureHasher(inputCols=list(features), outputCol="__meta", numFeatures=1 << 10),
        VectorAssembler(inputCols=["kmers", "__meta"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, probabilityCol="__both", maxIter=rounds, regParam=0.001),
    ]
    learn, held = rows, None
    if rows.count() >= VALIDATED_FROM:
        learn, held = split_by_key(rows.withColumn("__key", F.xxhash64(*[c for c in rows.columns if c in ("Accession", "Master", "YearMonth", *features)])), "__key", 1 - VALIDATION)
    model = SequenceModel(Pipeline(stages=stages).fit(learn.join(found, "Master")), found)
    if held is not None:
        scored = model.transform(held)
        model.validation = {"log_loss": log_loss(scored, label, "Probability").first()[0], "auc": auc(scored, label, "Probability").first()[0]}
    return model


def sequence_scorer(model: SequenceModel):
    """A scorer of (Country, Month, Accession) for forecast.scan; accessions without a sequence are left out."""

    def score(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({"Master": F.col("Accession"), "__month": F.col("Month"), "Month": F.col("Month").cast("string")})
        return model.transform(named).withColumn("Month", F.col("__month")).drop("__month", "Master")

    return score
