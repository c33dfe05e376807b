"""How the given tables are used by the registered queries, the bench and the tests.

``events`` plays the flow table (label: is it an error event), ``lineitem`` a
second dataset (label: was the item returned), ``embeddings`` the training
table (label: parity of the class). Rule models are fitted pipelines whose only
stage is a SQL projection, so that scoring, voting and metrics have exact
expected results.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowscore.operators.ensemble import VotingEnsemble
from flowscore.sources import read_dataset

LABEL = "Label"

# Rules over events, by model name.
EVENT_RULES = {
    "value_rule": "value > 100",
    "k_rule": "k >= 50",
    "user_rule": "user_id % 3 = 0",
}

# Rules both datasets can be scored with: x, y and z are numeric features.
SHARED_RULES = {
    "x_rule": "x > 25",
    "y_rule": "y > 0.05",
    "z_rule": "z >= 0.04",
}

# What a message must and may carry.
MESSAGE_SCHEMA = StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": "event_id", "type": "long", "nullable": False, "metadata": {}},
            {"name": "user_id", "type": "long", "nullable": True, "metadata": {}},
            {"name": "event_type", "type": "string", "nullable": True, "metadata": {}},
            {"name": "value", "type": "double", "nullable": False, "metadata": {}},
            {"name": "k", "type": "long", "nullable": True, "metadata": {}},
        ],
    }
)


def rule_model(condition: str) -> PipelineModel:
    statement = f"SELECT *, CAST({condition} AS DOUBLE) AS prediction FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=statement)])


def event_models() -> dict[str, PipelineModel]:
    return {name: rule_model(rule) for name, rule in EVENT_RULES.items()}


def shared_models() -> dict[str, PipelineModel]:
    return {name: rule_model(rule) for name, rule in SHARED_RULES.items()}


def event_ensemble(mode: str | None = None) -> VotingEnsemble:
    models = list(event_models().values())
    return VotingEnsemble(models, mode=mode, labelCol=LABEL, numClasses=2)


def with_event_features(events: DataFrame) -> DataFrame:
    """Flow features, batch or stream: ids, ``value``, ``k`` out of ``props``."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", "user_id", "event_type", "value", k.alias("k"))


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with features and label."""
    events = read_dataset(spark, f"{sf_dir}/events.parquet")
    label = (F.col("event_type") == "error").cast("double")
    return with_event_features(events).withColumn(LABEL, label)


def shared_flows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two datasets with the same feature columns."""
    events = event_flows(spark, sf_dir).select(
        (F.col("value") / 10).alias("x"),
        (F.col("k") / 1000).alias("y"),
        ((F.col("user_id") % 100) / 1000).alias("z"),
        LABEL,
    )
    items = read_dataset(spark, f"{sf_dir}/lineitem.parquet").select(
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"),
        F.col("l_tax").alias("z"),
        (F.col("l_returnflag") == "R").cast("double").alias(LABEL),
    )
    return {"events.parquet": events, "lineitem.parquet": items}


def embedding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table: one vector column and a 0/1 label."""
    vectors = read_dataset(spark, f"{sf_dir}/embeddings.parquet")
    return vectors.select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"),
        (F.col("label") % 2).cast("double").alias(LABEL),
    )


def planted_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table whose label one of two features gives away."""
    vectors = read_dataset(spark, f"{sf_dir}/embeddings.parquet")
    label = (F.col("label") % 2).cast("double")
    noise = F.get("embedding", F.lit(0)).cast("double")
    return vectors.select(
        "vec_id", label.alias("planted"), noise.alias("noise"), label.alias(LABEL)
    )
