"""Extracted values and ground truth as edge tables: (invoice_no, model, is_ground_truth, field, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import jsons, text as T

TRUTH, CSV_TRUTH = "ground_truth", "GROUND_TRUTH"


def run_values(runs: DataFrame) -> DataFrame:
    """invoice_id, model_name, run_number and, of each completed run with JSON, the array fields as ``date``, ``amount``, ``company``; one parse a row."""
    rows = jsons.with_fields(runs.filter("status = 'COMPLETED' and extracted_json is not null").select("invoice_id", "model_name", "run_number", "extracted_json"))
    return rows.select("invoice_id", "model_name", "run_number", *[jsons.array_of(F.col(f"field_{f}")).alias(f.lower()) for f in jsons.FIELDS])


def run_nodes(runs: DataFrame) -> DataFrame:
    """invoice_no, model, run_no: a node for every completed run with JSON, each with an edge to its document and model."""
    return runs.filter("status = 'COMPLETED' and extracted_json is not null").select(F.col("invoice_id").alias("invoice_no"), F.col("model_name").alias("model"), F.col("run_number").alias("run_no")).distinct()


def extracted_edges(runs: DataFrame) -> DataFrame:
    """One edge a distinct value of a document and model, over all its completed runs; only array fields make edges.

    A document's and model's runs meet once, as arrays; values are made distinct there, not by a shuffle of edges.
    """
    arrays = run_values(runs).groupBy("invoice_id", "model_name").agg(*[F.array_distinct(F.flatten(F.collect_list(f.lower()))).alias(f.lower()) for f in jsons.FIELDS])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f.lower()).alias("values")) for f in jsons.FIELDS])
    return arrays.select(F.col("invoice_id").alias("invoice_no"), F.col("model_name").alias("model"), F.explode(each).alias("x")).select("invoice_no", "model", F.lit(False).alias("is_ground_truth"), "x.field", F.explode("x.values").alias("value"))


def truth_key(truth: DataFrame) -> DataFrame:
    """truth with the key its edges bear: the agreed number if not blank, else the document's id."""
    return truth.withColumn("invoice_no", F.coalesce(T.or_null(T.trimmed(F.col("consensus_invoice_no"))), F.col("invoice_id")))


def last_seeds(truth: DataFrame) -> DataFrame:
    """Of the documents that bear one number the last seeds it. An aggregate, so a common number is combined before it is shuffled."""
    rows = truth_key(truth)
    return rows.groupBy("invoice_no").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "invoice_no"]), "invoice_id").alias("x")).select("x.*", "invoice_no")


def truth_edges(truth: DataFrame) -> DataFrame:
    def parts(column: str, normal) -> Column:
        return F.transform(T.csv_parts(F.col(column)), lambda x: T.normalised_or_raw(normal(x), x))

    fields = F.array(*[F.struct(F.lit(f).alias("field"), parts(c, n).alias("values")) for f, c, n in (("DATE", "consensus_dates", T.date_observed), ("AMOUNT", "consensus_amounts", T.amount), ("COMPANY", "consensus_companies", T.company))])
    return last_seeds(truth).select("invoice_no", F.explode(fields).alias("x")).select("invoice_no", F.lit(TRUTH).alias("model"), F.lit(True).alias("is_ground_truth"), "x.field", F.explode("x.values").alias("value")).distinct()


def reseeded(edges: DataFrame, new: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Edges with those of the numbers seeded (``numbers``, or those in ``new``) replaced; other documents keep theirs."""
    return edges.join((new if numbers is None else numbers).select("invoice_no").distinct(), "invoice_no", "left_anti").unionByName(new)


def csv_edges(lines: DataFrame) -> DataFrame:
    """Edges of ground-truth lines; they bear a label of their own, which scoring doesn't read."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("DATE", "date"), ("AMOUNT", "amount"), ("COMPANY", "company"))])
    return lines.select(F.col("invoice_id").alias("invoice_no"), F.explode(fields).alias("x")).select("invoice_no", F.lit(CSV_TRUTH).alias("model"), F.lit(True).alias("is_ground_truth"), "x.field", "x.value").filter("value <> ''").distinct()


def answerable(edges: DataFrame) -> DataFrame:
    """invoice_no, model, answerability: the share of company, amount and the document itself that is there."""
    has = [F.max((F.col("field") == f).cast("int")) for f in ("COMPANY", "AMOUNT")]
    return edges.groupBy("invoice_no", "model").agg(((has[0] + has[1] + 1) / 3.0).alias("answerability"))


def stable(edges: DataFrame) -> DataFrame:
    """invoice_no, model, stable: false if writing the trimmed values again would add one."""
    values = edges.groupBy("invoice_no", "model", "field").agg(F.collect_set("value").alias("v"))
    missing = F.exists("v", lambda x: (T.trimmed(x) != "") & ~F.array_contains(F.col("v"), T.trimmed(x)))
    return values.groupBy("invoice_no", "model").agg((~F.max(missing)).alias("stable"))
