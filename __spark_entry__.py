"""Registered queries and the SQL each is checked against.

whole of its tables. Fitted models have no SQL equivalent: they are fitted on a
label that one feature gives away, which a right model predicts without mistake.
What is downstream of a model is checked with rule models.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The driver may load this file by path from another folder.
sys.path.insert(0, str(Path(__file__).resolve().parent))

import workload as w
from flowscore.functions.confusion import confusion_class as class_of
from flowscore.operators import messages as M
from flowscore.operators import metrics as X
from flowscore.operators import paging, ranking, sampling, scoring
from flowscore.operators.ensemble import MODES, VotingEnsemble
from flowscore.plans import evaluation, setups, training
from flowscore.session import run_path
from flowscore.sources import read_dataset, stream_dataset
from flowscore.streaming import replay as R
from flowscore.streaming import scoring as S
from flowscore.streaming.faults import fail_once, run_with_restarts

SMOKE_DIR = "/root/testdata/sf0.001"
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
FOLD_SETTINGS = {"metric": "f1", "folds": 2, "parallelism": 4, "fold_keys": "vec_id"}


def entry(spark: SparkSession) -> DataFrame:
    """Every shared rule model on both datasets: confusion counts and ratios."""
    return evaluate_grid(spark, SMOKE_DIR)


# --- sources -----------------------------------------------------------------


def read_whole(spark, sf_dir):
    return read_dataset(spark, f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)


def read_with_schema(spark, sf_dir):
    schema = StructType(
        [
            StructField("event_id", LongType()),
            StructField("value", DoubleType()),
            StructField("absent", StringType()),
        ]
    )
    return read_dataset(spark, f"{sf_dir}/events.parquet", schema)


def drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all there is into a table, then read the table."""
    path = run_path(spark, label)
    query = S.start_table(stream, f"{path}/rows", f"{path}/checkpoint", "available-now")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return stream_dataset(spark, path, read_dataset(spark, path).schema)


def stream_parquet(spark, sf_dir):
    return drain(spark, event_stream(spark, sf_dir).select(*EVENT_COLUMNS), "stream-parquet")


def stream_csv(spark, sf_dir):
    flows = w.event_flows(spark, sf_dir).drop(w.LABEL)
    path = run_path(spark, "events") + "/events.csv"
    flows.write.csv(path)
    return drain(spark, stream_dataset(spark, path, flows.schema), "stream-csv")


# --- messages ----------------------------------------------------------------


def messages_of(flows: DataFrame, fmt: str) -> DataFrame:
    """Events as messages, some of them damaged depending on the event type."""
    part = [F.col(name).cast("string") for name in ("event_id", "user_id", "event_type", "value")]
    if fmt == "csv":
        short = F.concat_ws(",", *part)
        whole = F.concat_ws(",", short, F.col("k").cast("string"))
        bad = F.concat_ws(",", F.lit("bad"), *part[1:], F.col("k").cast("string"))
        extra = F.concat_ws(",", whole, F.lit("extra"))
    else:
        names = [field.name for field in w.MESSAGE_SCHEMA.fields]
        short = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
        whole = F.to_json(F.struct(*names))
        bad = F.to_json(F.struct(F.lit("bad").alias("event_id"), *names[1:]))
        extra = F.to_json(F.struct(*names, F.lit(1).alias("extra")))
    kind = F.col("event_type")
    value = (
        F.when(kind == "signup", short)
        .when(kind == "view", bad)
        .when(kind == "click", extra)
        .when(kind == "purchase", F.lit("" if fmt == "csv" else "nope"))
        .otherwise(whole)
    )
    return flows.select(
        value.cast("binary").alias("value"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
    )


def decoded(spark, sf_dir, fmt):
    return M.decode_messages(
        messages_of(w.event_flows(spark, sf_dir), fmt), w.MESSAGE_SCHEMA, fmt
    )


def flat(df: DataFrame) -> DataFrame:
    names = [field.name for field in w.MESSAGE_SCHEMA.fields]
    return df.select(
        *names, F.col("_meta.partition").alias("part"), F.col("_meta.offset").alias("pos")
    )


def with_nulls(spark, sf_dir):
    flows = w.event_flows(spark, sf_dir)
    kind = F.nullif("event_type", F.lit("view"))
    return flows.select("event_id", "user_id", kind.alias("event_type"), "value", "k")


def encoded(fmt):
    def run(spark, sf_dir):
        keyed = with_nulls(spark, sf_dir).withColumn("id", F.col("event_id"))
        return M.encode_messages(keyed, fmt, keep=["id"])

    return run


# --- scoring, voting, confusion ----------------------------------------------


def scored_events(spark, sf_dir):
    return scoring.score(w.event_flows(spark, sf_dir), w.event_models()["value_rule"])


def voted(spark, sf_dir, mode=None):
    return w.event_ensemble(mode).transform(w.event_flows(spark, sf_dir))


def array_columns(df: DataFrame, name: str, length: int) -> DataFrame:
    return df.select("event_id", *[F.get(name, F.lit(i)).alias(f"c{i}") for i in range(length)])


def verdict(mode):
    return lambda spark, sf_dir: voted(spark, sf_dir, mode).select(
        "event_id", "ensemble_prediction"
    )


def confusion_rows(spark, sf_dir):
    outcome = class_of(w.LABEL, "prediction")
    return scored_events(spark, sf_dir).select("event_id", outcome.alias("actual_predicted"))


def evaluate_grid(spark, sf_dir):
    return evaluation.evaluate(
        spark, w.shared_flows(spark, sf_dir), w.shared_models(), label=w.LABEL
    )


def evaluate_ensemble(spark, sf_dir):
    """The three voting modes over the same members, which are applied once."""
    return evaluation.evaluate(
        spark,
        w.shared_flows(spark, sf_dir),
        w.shared_models(),
        ensemble=MODES,
        label=w.LABEL,
        num_classes=2,
    )


# --- model-selection metrics -------------------------------------------------

# Class of each event type, for metrics over more than two classes.
TYPE_CLASS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def typed_events(spark, sf_dir):
    pairs = [F.lit(item) for pair in TYPE_CLASS.items() for item in pair]
    label = F.create_map(*pairs)[F.col("event_type")]
    return w.event_flows(spark, sf_dir).select(
        label.cast("double").alias("label"), (F.col("k") % 5).cast("double").alias("prediction")
    )


def class_metric(*names):
    def run(spark, sf_dir):
        table = X.class_metrics(typed_events(spark, sf_dir), "label", "prediction")
        return table.select(*[F.round(name, 9).alias(name) for name in names])

    return run


def log_loss(spark, sf_dir):
    table = X.class_metrics(
        voted(spark, sf_dir), w.LABEL, "ensemble_prediction", probability="probability"
    )
    return table.select(F.round("logLoss", 9).alias("logLoss"))


def area(name, **options):
    def run(spark, sf_dir):
        flows = w.event_flows(spark, sf_dir)
        table = ranking.ranking_metrics(flows, w.LABEL, "value", **options)
        return table.select(F.round(name, 9).alias(name))

    return run


# --- sampling ----------------------------------------------------------------


def sampled(spark, sf_dir):
    return sampling.bernoulli_sample(w.event_flows(spark, sf_dir), 0.7, seed=42)


def split(spark, sf_dir):
    first, second = sampling.hash_split(w.event_flows(spark, sf_dir), "event_id", 0.7, seed=42)
    return first.select("event_id", F.lit("train").alias("part")).unionByName(
        second.select("event_id", F.lit("test").alias("part"))
    )


def respread(spark, sf_dir):
    return sampling.repartition_dataset(w.event_flows(spark, sf_dir), 16)


# --- replay ------------------------------------------------------------------


def replayed(**options):
    def run(spark, sf_dir):
        flows = w.event_flows(spark, sf_dir).drop(w.LABEL)
        return R.replay_batches(flows, 300, ["event_id"], **options)

    return run


def stored_order(spark, sf_dir):
    events = read_dataset(spark, f"{sf_dir}/events.parquet")
    return R.replay_stored_order(events.select("event_id", "user_id", "event_type"), 300)


def first_by_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return paging.paginate(events, 300, ["ts", "event_id"], pages=2, carry=["event_id"])


def first_by_far_time(spark, sf_dir):
    """Open ends are often stored as times of the year 9999, a microsecond apart here."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.lit(253_370_764_800_000_000) + F.col("event_id")
    far = events.select("event_id", F.timestamp_micros(micros).alias("until"))
    return paging.paginate(far, 300, ["until"], pages=2, carry=["event_id"])


def replay_counts(spark, sf_dir):
    return R.replay_positive_counts(
        w.event_flows(spark, sf_dir), 300, ["value", "event_id"], label=w.LABEL
    )


# --- training ----------------------------------------------------------------


def embedding_setup(family, **options):
    return setups.build_setup(family, ["vector"], w.LABEL, num_features=64, **options)


def planted_setup(family, **options):
    return setups.build_setup(family, ["planted", "noise"], w.LABEL, num_features=2, **options)


def family_params(family):
    return {
        "GBT": {"maxIter": 5, "maxDepth": 3},
        "RF": {"numTrees": 10},
        "LR": {"maxIter": 20},
        "MLP": {"maxIter": 60},
    }.get(family, {})


def fit_family(family):
    """Fit a family on a label that one of two features gives away; all rows evaluated."""

    def run(spark, sf_dir):
        flows = w.planted_flows(spark, sf_dir)
        model, _ = training.train(spark, planted_setup(family, **family_params(family)), flows)
        return evaluation.evaluate(spark, {"embeddings.parquet": flows}, {family: model})

    return run


def trained_metrics(setup, **options):
    def run(spark, sf_dir):
        first, second = sampling.hash_split(w.planted_flows(spark, sf_dir), "vec_id", 0.7)
        model, _ = training.train(spark, setup(), first, **options)
        return evaluation.evaluate(spark, {"held_out": second}, {"model": model})

    return run


def cross_validation_folds(spark, sf_dir):
    """Rows of each fold that the cross-validated training of the same key sees."""
    fold = sampling.fold_number("vec_id", FOLD_SETTINGS["folds"])
    flows = w.planted_flows(spark, sf_dir)
    return flows.groupBy(fold.alias("fold")).agg(F.count("*").alias("rows"))


def timed_runs(report, *names):
    """A training log without what differs from run to run: whether it was timed instead."""
    timed = (F.col("training_time") > 0) & (F.col("cores") > 0)
    return report.select(*names, timed.alias("timed"))


def train_report(spark, sf_dir):
    output = run_path(spark, "model")
    _, report = training.train(
        spark,
        embedding_setup("DT"),
        w.embedding_flows(spark, sf_dir),
        output=output,
        train_ratio=0.7,
        names={"setup": "DT", "dataset": "embeddings.parquet", "model": "DT.model"},
    )
    return timed_runs(report, "setup", "dataset", "model", "train_ratio")


def sweep(spark, sf_dir):
    report = training.training_sweep(
        spark,
        {family: embedding_setup(family, **family_params(family)) for family in ("DT", "LR")},
        {"embeddings.parquet": w.embedding_flows(spark, sf_dir)},
        partitions=[4, 8],
        train_ratio=0.7,
    )
    return timed_runs(report, "setup", "dataset", "model", "train_ratio", "partitions")


def sweep_manifest(spark, sf_dir):
    """A sweep that goes on where a shorter one ended, and whether it kept those runs."""
    manifest = run_path(spark, "manifest")
    flows = {"embeddings.parquet": w.embedding_flows(spark, sf_dir)}
    setup = {family: embedding_setup(family, **family_params(family)) for family in ("DT", "LR")}
    first = training.training_sweep(
        spark, {"DT": setup["DT"]}, flows, partitions=[4], manifest=manifest, train_ratio=0.7
    )
    first = first.selectExpr("setup", "partitions", "training_time AS first_time").collect()
    early = spark.createDataFrame(first, "setup string, partitions int, first_time double")
    runs = training.training_sweep(
        spark, setup, flows, partitions=[4, 8], manifest=manifest, train_ratio=0.7
    )
    runs = runs.join(F.broadcast(early), ["setup", "partitions"], "left")
    return runs.select(
        "setup",
        "dataset",
        "model",
        "train_ratio",
        "partitions",
        (F.col("training_time") > 0).alias("timed"),
        F.coalesce(F.col("training_time") == F.col("first_time"), F.lit(False)).alias("kept"),
    )


def pca_features(spark, sf_dir):
    """What must hold of the components, whatever their signs: order, no correlation."""
    flows = w.embedding_flows(spark, sf_dir)
    model, _ = training.train(spark, embedding_setup("LR", pca_k=3, **family_params("LR")), flows)
    scored = scoring.score(flows, model)
    reduced = X.as_array(scored, "pca_features")
    parts = scored.select(*[F.get(reduced, F.lit(i)).alias(f"pc{i}") for i in range(3)], "prediction")
    spread = [F.var_samp(f"pc{i}") for i in range(3)]
    pairs = [F.abs(F.corr(f"pc{i}", f"pc{j}")) < 1e-6 for i, j in ((0, 1), (0, 2), (1, 2))]
    return parts.agg(
        F.count("*").alias("rows"),
        ((spread[0] >= spread[1]) & (spread[1] >= spread[2])).alias("ordered"),
        (pairs[0] & pairs[1] & pairs[2]).alias("uncorrelated"),
        F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("predicted"),
    )


def stable_sample(spark, sf_dir):
    """A sample by content, and whether other partitions would have drawn the same rows."""
    rows = w.event_flows(spark, sf_dir).select("user_id", "event_type")
    drawn = [sampling.content_sample(df, 0.3) for df in (rows, rows.repartition(7))]
    names = ["user_id", "event_type"]
    first, second = (df.groupBy(*names).agg(F.count("*").alias(n)) for df, n in zip(drawn, "ab"))
    total = rows.groupBy(*names).agg(F.count("*").alias("rows"))
    every = total.join(first, names, "left").join(second, names, "left")
    same = F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same")
    found = every.agg(F.sum("rows").alias("rows"), F.sum("a").alias("n"), same)
    share = F.abs(F.col("n") / F.col("rows") - 0.3) < 4 * F.sqrt(0.21 / F.col("rows"))
    return found.select("rows", "same", share.alias("share_fits"))


def roundtrip(spark, sf_dir):
    path = run_path(spark, "rule-model")
    w.event_models()["value_rule"].write().overwrite().save(path)
    model = PipelineModel.load(path)
    return scoring.score(w.event_flows(spark, sf_dir), model).select("event_id", "prediction")


def ensemble_roundtrip(spark, sf_dir):
    path = run_path(spark, "ensemble")
    w.event_ensemble("attack").save(path)
    loaded = type(w.event_ensemble()).load(path)
    return loaded.transform(w.event_flows(spark, sf_dir)).select("event_id", "ensemble_prediction")


# --- streaming ---------------------------------------------------------------


def scored_stream(spark, sf_dir, model=None):
    messages = messages_of(w.with_event_features(event_stream(spark, sf_dir)), "csv")
    model = model or w.event_models()["value_rule"]
    return S.score_messages(messages, w.MESSAGE_SCHEMA, model, "csv")


def stream_score(spark, sf_dir):
    rows = drain(spark, scored_stream(spark, sf_dir), "stream-score")
    return rows.select("event_id", "value", "prediction")


def stream_ensemble(spark, sf_dir):
    rows = drain(spark, scored_stream(spark, sf_dir, w.event_ensemble()), "stream-ensemble")
    return rows.select("event_id", "ensemble_prediction")


STREAM_FILES = 4


def message_stream(spark, sf_dir):
    """Events as messages in several files, one for each micro-batch."""
    path = run_path(spark, "messages") + "/messages.parquet"
    messages = messages_of(w.event_flows(spark, sf_dir), "csv")
    messages.repartition(STREAM_FILES).write.parquet(path)
    return stream_dataset(spark, path, messages.schema, max_files_per_trigger=1)


def split_stream(spark, sf_dir, again=()):
    """Scored and rejected messages and the report; some batches fail once before their commit."""
    path = run_path(spark, "split")
    report, output, rejected = (f"{path}/{name}" for name in ("report", "rows", "rejected"))
    stream = message_stream(spark, sf_dir)
    model = w.event_models()["value_rule"]
    handler = S.split_batches(w.MESSAGE_SCHEMA, model, report, output, rejected)
    handler = fail_once(handler, again)
    faults = run_with_restarts(
        lambda: S.start_batches(stream, handler, f"{path}/checkpoint", "available-now")
    )
    if faults != len(again):
        raise RuntimeError(f"{faults} batches failed, not {len(again)}")
    return (
        S.read_batches(spark, output, report),
        S.read_batches(spark, rejected, report),
        S.read_report(spark, report),
    )


def stream_rejected(spark, sf_dir):
    _, rejected, _ = split_stream(spark, sf_dir, again=[1])
    return rejected.select(F.col("offset").alias("pos"), "partition", "reason", "payload")


def stream_restarted(spark, sf_dir):
    rows, _, _ = split_stream(spark, sf_dir, again=[0, STREAM_FILES - 1])
    return rows.select("event_id", "value", "prediction")


def stream_totals(spark, sf_dir):
    _, _, report = split_stream(spark, sf_dir, again=[2])
    return report.agg(
        F.count("*").alias("batches"),
        *[F.sum(name).alias(name) for name in ("events", "positives", "rejected")],
    )


def stream_throughput(spark, sf_dir):
    """Totals of a query that keeps no rows, and whether every batch was timed."""
    path = run_path(spark, "report")
    S.start_scoring(
        scored_stream(spark, sf_dir),
        checkpoint=f"{path}/checkpoint",
        report=f"{path}/report",
        prediction="prediction",
        trigger="available-now",
    ).awaitTermination()
    rate = F.col("events") / F.col("seconds")
    return S.read_report(spark, f"{path}/report").agg(
        F.sum("events").alias("events"),
        F.sum("positives").alias("positives"),
        F.bool_and(F.col("seconds") > 0).alias("timed"),
        F.bool_and(F.abs(F.col("events_per_second") / rate - 1) < 1e-9).alias("rated"),
    )


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "read_dataset": read_whole,
        "read_dataset_with_schema": read_with_schema,
        "stream_csv_source": stream_csv,
        "stream_parquet_source": stream_parquet,
        "decode_csv_messages": lambda s, d: flat(decoded(s, d, "csv")),
        "decode_json_messages": lambda s, d: flat(decoded(s, d, "json")),
        "encode_csv_messages": encoded("csv"),
        "encode_json_messages": encoded("json"),
        "required_fields_filter": lambda s, d: flat(
            M.keep_complete(decoded(s, d, "csv"), w.MESSAGE_SCHEMA)
        ),
        "rejected_rows": lambda s, d: flat(
            M.rejected_rows(decoded(s, d, "csv"), w.MESSAGE_SCHEMA)
        ),
        "positive_count": lambda s, d: X.batch_counts(scored_events(s, d), "prediction").select(
            "positives"
        ),
        "batch_counts": lambda s, d: X.batch_counts(
            scored_events(s, d), "prediction", by=["event_type"]
        ),
        "score_batch": lambda s, d: scored_events(s, d).select("event_id", "prediction"),
        "confusion_class": confusion_rows,
        "confusion_counts": lambda s, d: X.confusion_counts(
            scored_events(s, d), w.LABEL, "prediction"
        ),
        "confusion_matrix": lambda s, d: X.confusion_matrix(
            scored_events(s, d), w.LABEL, "prediction"
        ),
        "binary_metrics": lambda s, d: X.binary_metrics(scored_events(s, d), w.LABEL, "prediction"),
        "evaluate_grid": evaluate_grid,
        "evaluate_ensemble": evaluate_ensemble,
        "ensemble_votes": lambda s, d: array_columns(voted(s, d), "predictions", 3),
        "ensemble_vote_counts": lambda s, d: array_columns(voted(s, d), "rawPrediction", 2),
        "ensemble_vote_share": lambda s, d: array_columns(voted(s, d), "probability", 2),
        "ensemble_majority": verdict("majority"),
        "ensemble_attack": verdict("attack"),
        "ensemble_normal": verdict("normal"),
        "ensemble_roundtrip": ensemble_roundtrip,
        "metric_auc_roc": area("areaUnderROC"),
        "metric_auc_pr": area("areaUnderPR"),
        "metric_auc_roc_ranges": area("areaUnderROC", rows_per_range=500),
        "metric_auc_pr_ranges": area("areaUnderPR", rows_per_range=500),
        "metric_weighted_f1": class_metric("f1"),
        "metric_accuracy": class_metric("accuracy"),
        "metric_weighted_precision": class_metric("weightedPrecision"),
        "metric_weighted_recall": class_metric("weightedRecall"),
        "metric_weighted_tpr": class_metric("weightedTruePositiveRate"),
        "metric_weighted_fpr": class_metric("weightedFalsePositiveRate"),
        "metric_weighted_fmeasure": class_metric("weightedFMeasure"),
        "metric_by_label": class_metric(
            "truePositiveRateByLabel",
            "falsePositiveRateByLabel",
            "precisionByLabel",
            "recallByLabel",
            "fMeasureByLabel",
        ),
        "metric_log_loss": log_loss,
        "metric_hamming_loss": class_metric("hammingLoss"),
        "bernoulli_sample": sampled,
        "content_sample": stable_sample,
        "cross_validation_folds": cross_validation_folds,
        "hash_split": split,
        "repartition_dataset": respread,
        "replay_batches": replayed(),
        "replay_first_batches": replayed(batches=2, fmt="json"),
        "replay_source_order": stored_order,
        "replay_first_by_time": first_by_time,
        "replay_first_by_far_time": first_by_far_time,
        "replay_positive_counts": replay_counts,
        "train_pipeline": trained_metrics(lambda: planted_setup("DT")),
        "train_cross_validator": trained_metrics(
            lambda: planted_setup("DT", grid={"maxDepth": [1, 3]}), **FOLD_SETTINGS
        ),
        "train_report": train_report,
        "training_sweep": sweep,
        "training_manifest": sweep_manifest,
        "fit_decision_tree": fit_family("DT"),
        "fit_gbt": fit_family("GBT"),
        "fit_logistic_regression": fit_family("LR"),
        "fit_mlp": fit_family("MLP"),
        "fit_random_forest": fit_family("RF"),
        "pca_features": pca_features,
        "model_roundtrip": roundtrip,
        "stream_score": stream_score,
        "stream_score_ensemble": stream_ensemble,
        "stream_batch_report": stream_totals,
        "stream_throughput": stream_throughput,
        "stream_rejected_rows": stream_rejected,
        "stream_restart_rows": stream_restarted,
    }


# --- the same in SQL ---------------------------------------------------------

FLOWS_SQL = """
flows AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM events)
"""

SCORED_SQL = f"""
{FLOWS_SQL},
scored AS (
  SELECT *, CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM flows),
confused AS (
  SELECT *, CASE WHEN label = 1 AND prediction = 1 THEN 'TP'
                 WHEN label = 0 AND prediction = 0 THEN 'TN'
                 WHEN label = 0 AND prediction = 1 THEN 'FP'
                 WHEN label = 1 AND prediction = 0 THEN 'FN'
                 ELSE 'Unknown' END AS actual_predicted
  FROM scored)
"""

VOTED_SQL = f"""
{FLOWS_SQL},
votes AS (
  SELECT event_id, label,
         CAST(value > 100 AS DOUBLE) AS v0,
         CAST(k >= 50 AS DOUBLE) AS v1,
         CAST(user_id % 3 = 0 AS DOUBLE) AS v2
  FROM flows),
tallied AS (
  SELECT *, v0 + v1 + v2 AS ones, 3.0::DOUBLE - (v0 + v1 + v2) AS zeros FROM votes)
"""

DECODED_SQL = f"""
{FLOWS_SQL},
decoded AS (
  SELECT CASE WHEN event_type IN ('view', 'purchase') THEN NULL ELSE event_id END AS event_id,
         CASE WHEN event_type = 'purchase' THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_type = 'purchase' THEN NULL ELSE value END AS value,
         CASE WHEN event_type IN ('signup', 'purchase') THEN NULL ELSE k END AS k,
         CAST(user_id % 4 AS INTEGER) AS part,
         event_id AS pos
  FROM flows)
"""

SHARED_SQL = f"""
{FLOWS_SQL},
shared AS (
  SELECT 'events.parquet' AS dataset, value / 10 AS x, k / 1000 AS y,
         (user_id % 100) / 1000 AS z, label
  FROM flows
  UNION ALL
  SELECT 'lineitem.parquet', l_quantity, l_discount, l_tax,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM lineitem),
ruled AS (
  SELECT dataset, label, CAST(x > 25 AS INTEGER) AS px, CAST(y > 0.05::DOUBLE AS INTEGER) AS py,
         CAST(z >= 0.04::DOUBLE AS INTEGER) AS pz
  FROM shared)
"""

RATIOS_SQL = """
matrix AS (
  SELECT "Dataset", "Model",
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn
  FROM predicted GROUP BY 1, 2),
ratios AS (
  SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS prec,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS rec
  FROM matrix)
SELECT {names} tp, tn, fp, fn, accuracy AS "Accuracy", prec AS "Precision", rec AS "Recall",
       CASE WHEN prec + rec > 0 THEN 2 * (prec * rec) / (prec + rec) ELSE 0 END AS "F1"
FROM ratios
"""

# Per class: rows with that label, rows with that prediction, rows with both.
CLASSES_SQL = f"""
{FLOWS_SQL},
typed AS (
  SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 ELSE 4 END AS l,
         k % 5 AS p
  FROM flows),
classes AS (
  SELECT c.cls,
         CAST((SELECT count(*) FROM typed WHERE l = c.cls) AS DOUBLE) AS support,
         CAST((SELECT count(*) FROM typed WHERE p = c.cls) AS DOUBLE) AS claims,
         CAST((SELECT count(*) FROM typed WHERE l = c.cls AND p = c.cls) AS DOUBLE) AS hits,
         CAST((SELECT count(*) FROM typed) AS DOUBLE) AS total
  FROM (SELECT DISTINCT l AS cls FROM typed) c),
rates AS (
  SELECT *, CASE WHEN claims > 0 THEN hits / claims ELSE 0 END AS prec,
         hits / support AS rec, (claims - hits) / (total - support) AS fpr
  FROM classes),
graded AS (
  SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f
  FROM rates)
"""

SCORES_SQL = f"""
{FLOWS_SQL},
scores AS (
  SELECT value AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
  FROM flows GROUP BY value),
curve AS (
  SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
         sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM scores)
"""


def weighted_sql(rate: str, name: str) -> str:
    return f"WITH {CLASSES_SQL} SELECT round(sum({rate} * support / total), 9) AS {name} FROM graded"


def pages_sql(order: str) -> str:
    return f"""
{FLOWS_SQL},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS row_no FROM flows),
paged AS (
  SELECT *, CAST(row_no // 300 AS BIGINT) AS batch_no FROM numbered)
"""


def grid_sql(models: list[tuple[str, str]]) -> str:
    predicted = " UNION ALL ".join(
        f"""SELECT dataset AS "Dataset", '{name}' AS "Model", label, {vote} AS prediction
            FROM ruled"""
        for name, vote in models
    )
    ratios = RATIOS_SQL.format(names='"Dataset", "Model",')
    return f"WITH {SHARED_SQL}, predicted AS ({predicted}), {ratios}"


# A model that found the planted feature makes no mistake.
PLANTED_SQL = """
SELECT '{dataset}' AS "Dataset", '{model}' AS "Model",
       CAST(count(*) FILTER (WHERE label % 2 = 1) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE label % 2 = 0) AS BIGINT) AS tn,
       CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS "Accuracy",
       1.0::DOUBLE AS "Precision", 1.0::DOUBLE AS "Recall", 1.0::DOUBLE AS "F1"
FROM embeddings {where}
"""


def training_sql() -> dict[str, str]:
    families = {
        "decision_tree": "DT", "gbt": "GBT", "logistic_regression": "LR", "mlp": "MLP", "random_forest": "RF",
    }
    out = {
        f"fit_{name}": PLANTED_SQL.format(dataset="embeddings.parquet", model=family, where="")
        for name, family in families.items()
    }
    held_out = "WHERE substr(md5('42|' || vec_id), 1, 8) >= 'b3333333'"
    for name in ("train_pipeline", "train_cross_validator"):
        out[name] = PLANTED_SQL.format(dataset="held_out", model="model", where=held_out)
    log = "'embeddings.parquet' AS dataset, 0.7::DOUBLE AS train_ratio, true AS timed"
    out["train_report"] = f"SELECT 'DT' AS setup, 'DT.model' AS model, {log}"
    out["training_sweep"] = (
        f"SELECT setup, setup || '_embeddings.parquet' AS model, CAST(n AS INTEGER) AS partitions, {log} "
        "FROM (VALUES ('DT'), ('LR')) s(setup), (VALUES (4), (8)) p(n)"
    )
    out["training_manifest"] = f"SELECT *, setup = 'DT' AND partitions = 4 AS kept FROM ({out['training_sweep']})"
    out["pca_features"] = (
        "SELECT count(*) AS rows, true AS ordered, true AS uncorrelated, true AS predicted FROM embeddings"
    )
    digits = "substr(md5('42|' || vec_id), 1, 8)"
    out["cross_validation_folds"] = (
        f"SELECT CAST(CAST('0x' || {digits} AS BIGINT) % 2 AS INTEGER) AS fold, count(*) AS rows "
        "FROM embeddings GROUP BY 1"
    )
    out["content_sample"] = "SELECT count(*) AS rows, true AS same, true AS share_fits FROM events"
    return out


def own_sql() -> dict[str, str]:
    csv_text = "concat_ws(',', event_id, user_id, {kind}, value, k)"
    json_text = (
        "'{{\"event_id\":' || event_id || ',\"user_id\":' || user_id || {kind}"
        " || ',\"value\":' || value || ',\"k\":' || k || '}}'"
    )
    no_view = "CASE WHEN event_type = 'view' THEN '' ELSE {shown} END"
    members = "x_rule/y_rule/z_rule"
    decoded_columns = "event_id, user_id, event_type, value, k, part, pos"
    single = RATIOS_SQL.format(names="")
    scored_as_model = "predicted AS (SELECT '' AS \"Dataset\", '' AS \"Model\", * FROM scored)"
    json_kind = "',\"event_type\":\"' || event_type || '\"'"

    return {
        "read_dataset": "SELECT event_id, user_id, event_type, value, props FROM events",
        "read_dataset_with_schema": (
            "SELECT event_id, value, CAST(NULL AS VARCHAR) AS absent FROM events"
        ),
        "stream_csv_source": (
            f"WITH {FLOWS_SQL} SELECT event_id, user_id, event_type, value, k FROM flows"
        ),
        "stream_parquet_source": "SELECT event_id, user_id, event_type, value, props FROM events",
        "decode_csv_messages": f"WITH {DECODED_SQL} SELECT {decoded_columns} FROM decoded",
        "decode_json_messages": f"WITH {DECODED_SQL} SELECT {decoded_columns} FROM decoded",
        "encode_csv_messages": (
            f"WITH {FLOWS_SQL} SELECT event_id AS id, "
            + csv_text.format(kind=no_view.format(shown="event_type"))
            + " AS value FROM flows"
        ),
        "encode_json_messages": (
            f"WITH {FLOWS_SQL} SELECT event_id AS id, "
            + json_text.format(kind=no_view.format(shown=json_kind))
            + " AS value FROM flows"
        ),
        "required_fields_filter": (
            f"WITH {DECODED_SQL} SELECT {decoded_columns} FROM decoded "
            "WHERE event_id IS NOT NULL AND value IS NOT NULL"
        ),
        "rejected_rows": (
            f"WITH {DECODED_SQL} SELECT {decoded_columns} FROM decoded "
            "WHERE event_id IS NULL OR value IS NULL"
        ),
        "positive_count": "SELECT count(*) AS positives FROM events WHERE value > 100",
        "batch_counts": (
            "SELECT event_type, count(*) AS events, "
            "count(*) FILTER (WHERE value > 100) AS positives FROM events GROUP BY event_type"
        ),
        "score_batch": f"WITH {SCORED_SQL} SELECT event_id, prediction FROM scored",
        "confusion_class": f"WITH {SCORED_SQL} SELECT event_id, actual_predicted FROM confused",
        "confusion_counts": (
            f"WITH {SCORED_SQL} SELECT actual_predicted, count(*) AS count "
            "FROM confused GROUP BY actual_predicted"
        ),
        "confusion_matrix": (
            f"WITH {SCORED_SQL} SELECT "
            + ", ".join(
                f"count(*) FILTER (WHERE actual_predicted = '{cell.upper()}') AS {cell}"
                for cell in ("tp", "tn", "fp", "fn")
            )
            + " FROM confused"
        ),
        "binary_metrics": f"WITH {SCORED_SQL}, {scored_as_model}, {single}",
        "evaluate_grid": grid_sql([("x_rule", "px"), ("y_rule", "py"), ("z_rule", "pz")]),
        "evaluate_ensemble": grid_sql(
            [
                (f"majority({members})", "CASE WHEN px + py + pz >= 2 THEN 1 ELSE 0 END"),
                (f"attack({members})", "CASE WHEN px + py + pz >= 1 THEN 1 ELSE 0 END"),
                (f"normal({members})", "CASE WHEN px + py + pz = 3 THEN 1 ELSE 0 END"),
            ]
        ),
        "ensemble_votes": (
            f"WITH {VOTED_SQL} SELECT event_id, v0 AS c0, v1 AS c1, v2 AS c2 FROM tallied"
        ),
        "ensemble_vote_counts": (
            f"WITH {VOTED_SQL} SELECT event_id, zeros AS c0, ones AS c1 FROM tallied"
        ),
        "ensemble_vote_share": (
            f"WITH {VOTED_SQL} SELECT event_id, zeros / 3 AS c0, ones / 3 AS c1 FROM tallied"
        ),
        "ensemble_majority": (
            f"WITH {VOTED_SQL} SELECT event_id, CAST(ones > zeros AS DOUBLE) AS ensemble_prediction "
            "FROM tallied"
        ),
        "ensemble_attack": (
            f"WITH {VOTED_SQL} SELECT event_id, CAST(ones >= 1 AS DOUBLE) AS ensemble_prediction "
            "FROM tallied"
        ),
        "ensemble_normal": (
            f"WITH {VOTED_SQL} SELECT event_id, CAST(zeros = 0 AS DOUBLE) AS ensemble_prediction "
            "FROM tallied"
        ),
        "ensemble_roundtrip": (
            f"WITH {VOTED_SQL} SELECT event_id, CAST(ones >= 1 AS DOUBLE) AS ensemble_prediction "
            "FROM tallied"
        ),
        "metric_auc_roc": (
            f"WITH {SCORES_SQL} SELECT round(sum(neg * (tp - pos / 2)) "
            '/ (max(all_pos) * max(all_neg)), 9) AS "areaUnderROC" FROM curve'
        ),
        "metric_auc_pr": f"""
            WITH {SCORES_SQL},
            points AS (
              SELECT s, tp / all_pos AS r, tp / (tp + fp) AS p FROM curve),
            steps AS (
              SELECT r - lag(r, 1, 0.0) OVER (ORDER BY s DESC) AS width,
                     p, lag(p) OVER (ORDER BY s DESC) AS before FROM points)
            SELECT round(sum(width * (p + coalesce(before, p)) / 2), 9) AS "areaUnderPR"
            FROM steps""",
        "metric_weighted_f1": weighted_sql("f", '"f1"'),
        "metric_accuracy": (
            f"WITH {CLASSES_SQL} SELECT round(sum(hits) / max(total), 9) AS accuracy FROM graded"
        ),
        "metric_weighted_precision": weighted_sql("prec", '"weightedPrecision"'),
        "metric_weighted_recall": weighted_sql("rec", '"weightedRecall"'),
        "metric_weighted_tpr": weighted_sql("rec", '"weightedTruePositiveRate"'),
        "metric_weighted_fpr": weighted_sql("fpr", '"weightedFalsePositiveRate"'),
        "metric_weighted_fmeasure": weighted_sql("f", '"weightedFMeasure"'),
        "metric_by_label": (
            f"WITH {CLASSES_SQL} SELECT "
            'round(rec, 9) AS "truePositiveRateByLabel", '
            'round(fpr, 9) AS "falsePositiveRateByLabel", '
            'round(prec, 9) AS "precisionByLabel", '
            'round(rec, 9) AS "recallByLabel", '
            'round(f, 9) AS "fMeasureByLabel" FROM graded WHERE cls = 1'
        ),
        "metric_log_loss": (
            f"WITH {VOTED_SQL} SELECT round(avg(-ln(greatest(1e-15::DOUBLE, "
            "least(1.0::DOUBLE - 1e-15::DOUBLE, "
            'CASE WHEN label = 1 THEN ones / 3 ELSE zeros / 3 END)))), 9) AS "logLoss" '
            "FROM tallied"
        ),
        "metric_hamming_loss": (
            f"WITH {CLASSES_SQL} SELECT round((max(total) - sum(hits)) / max(total), 9) "
            'AS "hammingLoss" FROM graded'
        ),
        "hash_split": (
            "SELECT event_id, CASE WHEN substr(md5('42|' || event_id), 1, 8) < 'b3333333' "
            "THEN 'train' ELSE 'test' END AS part FROM events"
        ),
        "repartition_dataset": (
            f'WITH {FLOWS_SQL} SELECT event_id, user_id, event_type, value, k, label AS "Label" '
            "FROM flows"
        ),
        "replay_batches": (
            f"WITH {pages_sql('event_id')} SELECT batch_no, row_no, "
            + csv_text.format(kind="event_type")
            + " AS value FROM paged"
        ),
        "replay_first_batches": (
            f"WITH {pages_sql('event_id')} SELECT batch_no, row_no, "
            + json_text.format(kind=json_kind)
            + " AS value FROM paged WHERE row_no < 600"
        ),
        "replay_source_order": (
            "SELECT file_row_number // 300 AS batch_no, file_row_number AS row_no, "
            "concat_ws(',', event_id, user_id, event_type) AS value FROM "
            "(SELECT *, row_number() OVER () - 1 AS file_row_number FROM events)"
        ),
        "replay_first_by_time": (
            "SELECT row_no // 300 AS batch_no, row_no, event_id FROM (SELECT event_id, "
            "row_number() OVER (ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS row_no "
            "FROM events) WHERE row_no < 600"
        ),
        "replay_first_by_far_time": (
            "SELECT row_no // 300 AS batch_no, row_no, event_id FROM (SELECT event_id, "
            "row_number() OVER (ORDER BY event_id) - 1 AS row_no FROM events) WHERE row_no < 600"
        ),
        "replay_positive_counts": (
            f"WITH {pages_sql('value, event_id')} SELECT batch_no, count(*) AS events, "
            "count(*) FILTER (WHERE label = 1) AS positives FROM paged GROUP BY batch_no"
        ),
        "model_roundtrip": f"WITH {SCORED_SQL} SELECT event_id, prediction FROM scored",
        "stream_score": (
            f"WITH {SCORED_SQL} SELECT event_id, value, prediction FROM scored "
            "WHERE event_type NOT IN ('view', 'purchase')"
        ),
        "stream_score_ensemble": (
            f"WITH {VOTED_SQL} SELECT t.event_id, CAST(CASE WHEN f.event_type = 'signup' "
            "THEN t.v0 + t.v2 >= 2 ELSE ones > zeros END AS DOUBLE) AS ensemble_prediction "
            "FROM tallied t JOIN flows f USING (event_id) "
            "WHERE f.event_type NOT IN ('view', 'purchase')"
        ),
        "stream_batch_report": (
            f"WITH {SCORED_SQL} SELECT CAST({STREAM_FILES} AS BIGINT) AS batches, "
            "CAST(count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase')) AS BIGINT) AS events, "
            "CAST(count(*) FILTER (WHERE prediction = 1 AND event_type NOT IN ('view', 'purchase')) "
            "AS BIGINT) AS positives, "
            "CAST(count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS BIGINT) AS rejected "
            "FROM scored"
        ),
        "stream_throughput": (
            f"WITH {SCORED_SQL} SELECT CAST(count(*) AS BIGINT) AS events, "
            "CAST(count(*) FILTER (WHERE prediction = 1) AS BIGINT) AS positives, "
            "true AS timed, true AS rated FROM scored WHERE event_type NOT IN ('view', 'purchase')"
        ),
        "stream_rejected_rows": (
            f"WITH {FLOWS_SQL} SELECT event_id AS pos, CAST(user_id % 4 AS INTEGER) AS partition, "
            "CASE WHEN event_type = 'view' THEN 'missing: event_id' ELSE 'no field could be read' END "
            "AS reason, CASE WHEN event_type = 'view' "
            "THEN concat_ws(',', 'bad', user_id, event_type, value, k) ELSE '' END AS payload "
            "FROM flows WHERE event_type IN ('view', 'purchase')"
        ),
        "stream_restart_rows": (
            f"WITH {SCORED_SQL} SELECT event_id, value, prediction FROM scored "
            "WHERE event_type NOT IN ('view', 'purchase')"
        ),
    }


# --- training-data operators, if their subpackage is there -------------------

LLM_QUERIES, PIPELINE = "flowscore.llm.queries", "corpus_pipeline"


def optional_module(name: str):
    """The module, or None if it, or a module that it needs, cannot be imported."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = own_queries()
    if (llm := optional_module(LLM_QUERIES)) is not None:
        out |= llm.QUERIES
        if (pipeline := optional_module(PIPELINE)) is not None:
            out["pipeline"] = pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    out = own_sql() | training_sql()
    for name in ("metric_auc_roc", "metric_auc_pr"):
        out[f"{name}_ranges"] = out[name]
    if (llm := optional_module(LLM_QUERIES)) is not None:
        out |= llm.ORACLE_SQL
        pipeline = optional_module(PIPELINE)
        if pipeline is not None and pipeline.ORACLE_SQL is not None:
            out["pipeline"] = pipeline.ORACLE_SQL
    return out
