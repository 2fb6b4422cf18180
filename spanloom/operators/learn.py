"""The classifier: gradient-boosted trees over features(), and decisions that take its probability into account."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import all_common, decide, is_sure
from .context import with_line, words_after, words_before
from .lexicon import has

FEATURES = ("token_count", "char_length", "initials", "known_first", "known_last", "common_share", "first_ambiguous", "place_or_org", "titled", "dictionary", "bare", "n_detections", "reps", "known_share", "honorific", "capital_share", "rule_confidence", "list_confidence", "n_detectors", "after_stopword", "before_punctuation", "quoted", "person_cue", "other_cue", "isolated")
#: Rows that a model is fitted on, at most; those of the smallest hashes of all their columns, so a share of each vector's.
TRAINING_ROWS = 200_000


def split(rows: DataFrame) -> DataFrame:
    """Adds held_out: a fifth of the feature vectors; equal vectors stay on one side."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(*FEATURES), F.lit(5)) == 0)


def train(rows: DataFrame, rounds: int = 20, at_most: int = TRAINING_ROWS) -> PipelineModel | None:
    """A model of rows with FEATURES and label (0 or 1), or None where a side of the split or a class is missing.

    Columns that tell rows apart (doc_id, line_no, start) go into the sample's hash; rows without any are sampled by vector.
    """
    order = F.xxhash64(*rows.columns)
    rows = split(rows).select(*FEATURES, F.col("label").cast("double").alias("label"), "held_out", order.alias("order")).orderBy("order").limit(at_most).drop("order")
    sides = rows.agg(F.countDistinct(F.when(~F.col("held_out"), F.col("label"))).alias("classes"), F.count_if("held_out").alias("held")).first()
    if sides["classes"] < 2 or not sides["held"]:
        return None
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.08, minInstancesPerNode=5, seed=7, validationIndicatorCol="held_out")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(rows)


def scored(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds p, to four places; 0 without a model. Columns that the model doesn't know stay as they are."""
    if model is None:
        return rows.withColumn("p", F.lit(0.0))
    made = ("features", "rawPrediction", "probability", "prediction")
    return model.transform(rows).withColumn("p", F.bround(vector_to_array("probability")[1], 4)).drop(*made)


def save(model: PipelineModel, folder: str, version: int) -> None:
    """Writes a version; one that exists is never overwritten."""
    model.write().save(f"{folder}/v{version:06d}")


def load(spark: SparkSession, folder: str) -> PipelineModel | None:
    """The latest version, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
    return PipelineModel.load(f"{folder}/{names[-1]}") if names else None


def backed(p: Column, isolated: Column) -> Column:
    """Whether knowledge or the model backs a candidate."""
    single, often = F.array_contains("patterns", "dictionary_single_token"), F.col("reps") >= 4
    uncommon = ~F.exists(F.split("key", " "), lambda w: has(w, "common"))
    return is_sure(F.col("patterns"), F.col("reps")) | (single & (p >= 0.10)) | (uncommon & often & ((p >= 0.85) | (isolated & (p >= 0.10))))


def decided(judged: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """judged() with p: adds 1.05 p to the score of what no rule rejects, and decides anew."""
    rows = with_line(judged, docs, text)
    isolated = (F.size(words_before(F.col("prefix"))) == 0) & (F.size(words_after(F.col("suffix"))) == 0)
    gain = F.round(F.lit("1.05").cast("decimal(4,2)") * F.col("p").cast("decimal(6,4)"), 4)
    rows = rows.withColumn("score", F.when(F.col("failed").isNotNull(), F.lit(0)).otherwise(F.col("score") + gain).cast("decimal(8,4)"))
    return rows.withColumn("decision", decide(F.col("score"), backed(F.col("p"), isolated), all_common(F.col("key")))).drop("line", "prefix", "suffix")
