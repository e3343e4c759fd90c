"""Scores kept up as runs and ground truth arrive, as Structured Streaming jobs over the keyed tables.

What scoring needs of a document and model is a row of ``run_summary``. A batch of runs is reduced to such
rows, merged with those that stand, and the documents it touches are scored again; a batch of ground truth scores
the documents again whose truth it changes. However runs and truth are split over batches, the result table holds what one
run over all of them gives. A batch that runs again after a failure changes nothing: merging keeps one state a run, and rows replace those of their key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from paperlane.operators import evaluation, graph, tables
from paperlane.plans.pipeline import Store


def landed(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _started(rows: DataFrame, step: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(lambda batch, _: step(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _scored(store: Store, summaries: DataFrame, ids: DataFrame) -> None:
    """Scores the summaries, which are those of some documents, and puts the rows in the result table; rows that have no truth any more go."""
    truth = evaluation.bearing_on(store.read("ground_truth_consensus"), ids)
    store.write("score_stage", tables.stamped(evaluation.bundle_of(evaluation.summary_of(summaries), truth)))
    mine = store.read("evaluation_result", store.buckets_of("evaluation_result", ids)).join(summaries, ["invoice_id", "model_name"], "left_semi")
    store.exchange("evaluation_result", mine, store.read("score_stage"))


def add_runs(store: Store, batch: DataFrame) -> None:
    """Takes in runs, in any order and again if need be. Only the buckets of their documents are read."""
    store.write("run_stage", evaluation.run_states(batch))
    new = store.read("run_stage")
    old = store.read("run_summary", store.buckets_of("run_summary", new)).join(new, ["invoice_id", "model_name"], "left_semi")
    store.upsert("run_summary", evaluation.merged(old.unionByName(new)))
    ids = new.select("invoice_id").distinct()
    touched = store.read("run_summary", store.buckets_of("run_summary", new)).join(new, ["invoice_id", "model_name"], "left_semi")
    _scored(store, touched, ids)


def add_truth(store: Store, batch: DataFrame) -> None:
    """Takes in ground truth. A number's truth is that of its last document, so all documents that bear one of the batch's numbers, or bore one, are scored again."""
    known = store.read("ground_truth_consensus")
    before = known.join(batch.select("invoice_id"), "invoice_id", "left_semi")
    store.write("truth_stage", graph.truth_key(before.unionByName(batch, allowMissingColumns=True)).select("invoice_no").distinct())
    store.upsert("ground_truth_consensus", batch.select(*[F.col(c) if c in batch.columns else F.lit(None).alias(c) for c in known.columns]))
    ids = graph.truth_key(store.read("ground_truth_consensus")).join(store.read("truth_stage"), "invoice_no", "left_semi").select("invoice_id")
    _scored(store, store.read("run_summary", store.buckets_of("run_summary", ids)).join(ids, "invoice_id", "left_semi"), ids)


def runs_kept_up(runs: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    return _started(runs, lambda batch: add_runs(store, batch), checkpoint)


def truth_kept_up(truth: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    return _started(truth, lambda batch: add_truth(store, batch), checkpoint)
