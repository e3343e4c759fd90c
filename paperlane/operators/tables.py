"""Upserts and the export table. All are joins of whole tables; there is no row-by-row lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from paperlane.functions import text as T

KEYS = ["invoice_id", "model_name", "run_number"]


def with_value(rows: DataFrame, column: str) -> DataFrame:
    """rows in which the column isn't null.

    A filter would move below the column's expression and spell it out again, in one method too long to be compiled; a generator stays where it is.
    """
    return rows.withColumn(column, F.explode(F.array_compact(F.array(column))))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the greatest ``order`` (of equal ones the greatest row)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("x")).select(*keys, "x.*").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of ``new`` in place of those with the same keys; of rows of ``new`` that share keys the last by ``order`` (or by its columns)."""
    new = latest(new, keys, order or next(c for c in new.columns if c not in keys))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def invoices_after_reading(invoices: DataFrame, read: DataFrame, others: bool = True) -> DataFrame:
    """invoice_id, path, raw_text, ocr_status after text recognition (invoice_id, path, raw_text), of all documents or only of those read.

    A known document keeps its path; without new text it keeps its old text and its status is FAILED.
    """
    both = invoices.select("invoice_id", F.col("path").alias("old_path"), F.col("raw_text").alias("old_text"), F.col("ocr_status").alias("old_status")).join(read.select("invoice_id", F.col("path").alias("new_path"), F.col("raw_text").alias("new_text"), F.lit(True).alias("seen")), "invoice_id", "full" if others else "right")
    status = F.when(F.col("seen"), F.when(F.col("new_text").isNotNull(), "COMPLETED").otherwise("FAILED")).otherwise(F.col("old_status"))
    return both.select("invoice_id", F.coalesce("old_path", "new_path").alias("path"), F.coalesce("new_text", "old_text").alias("raw_text"), status.alias("ocr_status"))


def evaluated(invoices: DataFrame, results: DataFrame, asked: DataFrame) -> DataFrame:
    """invoice_id, evaluation_status: of those asked COMPLETED with a result or else SKIPPED, others as before."""
    n = results.filter("model_name is not null and run_number is not null").groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n"))
    rows = invoices.select("invoice_id", "evaluation_status").join(asked.select("invoice_id", F.lit(True).alias("asked")), "invoice_id", "left").join(n, "invoice_id", "left")
    status = F.when(F.col("asked"), F.when(F.col("n") > 0, "COMPLETED").otherwise("SKIPPED")).otherwise(F.col("evaluation_status"))
    return rows.select("invoice_id", status.alias("evaluation_status"))


SCORES = ["date_accuracy", "date_f1", "amount_accuracy", "amount_f1", "company_accuracy", "company_f1", "overall_entity_accuracy", "relation_completeness", "query_answerability"]
RESULTS = "invoice_id string, model_name string, run_number long, " + ", ".join(f"{c} double" for c in SCORES) + ", graph_idempotent boolean, consistency_score double, created_at timestamp_ntz"
EXPORT = ["invoice_id", "model_name", "run_number", *SCORES, "graph_idempotent", "consistency_score", "created_at"]


def stamped(results: DataFrame) -> DataFrame:
    """Rows for the result table: those without model or run are dropped, others get the time."""
    return results.withColumn("created_at", F.localtimestamp()).select(*EXPORT).na.drop(subset=["model_name", "run_number"])


def export_rows(results: DataFrame) -> DataFrame:
    """Results in the 15 columns of the export, the time as ISO text or null, with ``insert_id``; of repeated ids the latest row."""
    rows = results.select(*EXPORT, F.concat_ws("_", F.col("invoice_id"), F.col("model_name"), F.col("run_number").cast("string")).alias("insert_id"))
    return latest(rows, ["insert_id"], "created_at").withColumn("created_at", T.iso_stamp(F.col("created_at")))


def unsent(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows of the export whose ``insert_id`` was not sent before."""
    return rows.join(sent.select("insert_id"), "insert_id", "left_anti").select(*rows.columns)


def exported(rows: DataFrame, path: str, batch: str) -> int:
    """Writes rows of the export as one batch at ``path``; how many. The same batch again replaces itself, and no other is read."""
    watch = Observation("export")
    rows.observe(watch, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return watch.get["n"]
