"""Scores of every document, model and run against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import jsons, text as T

from . import graph

_FIELDS = ["date", "amount", "company"]


#: What scoring keeps of a document and model: of each completed run its number, time, values of array fields, and a hash of every field's raw values.
SUMMARY = "invoice_id string, model_name string, runs array<struct<run_number:int,stamp:timestamp_ntz,given:boolean," + ",".join(f"{f}:array<string>" for f in _FIELDS) + "," + ",".join(f"s_{f}:bigint" for f in jsons.ALL) + ">>"


def said(field: Column) -> Column:
    """A hash of a field's raw values, whatever their order."""
    raw = jsons.raw_of(field)
    return F.xxhash64(F.size(raw), raw)


def run_states(runs: DataFrame) -> DataFrame:
    """invoice_id, model_name, ``runs``: the completed runs of a document and model, each in short. One parse a run and one shuffle."""
    rows = jsons.with_fields(runs.filter("status = 'COMPLETED'"))
    stamp = F.col("created_at") if "created_at" in runs.columns else F.lit(None)
    one = F.struct(
        F.col("run_number").cast("int").alias("run_number"), stamp.cast("timestamp_ntz").alias("stamp"), F.col("extracted_json").isNotNull().alias("given"),
        *[jsons.array_of(F.col(f"field_{f}")).alias(f.lower()) for f in jsons.FIELDS],
        *[F.when(F.col("ok"), said(F.col(f"field_{f}"))).alias(f"s_{f}") for f in jsons.ALL],
    )
    return rows.select("invoice_id", "model_name", one.alias("run")).groupBy("invoice_id", "model_name").agg(F.collect_list("run").alias("runs"))


def merged(states: DataFrame) -> DataFrame:
    """States of one document and model put together; of a run that was given several times the last counts, so merging again changes nothing."""
    rows = states.groupBy("invoice_id", "model_name").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    last = F.transform(F.array_distinct(F.transform("runs", lambda r: r["run_number"])), lambda n: F.array_max(F.filter("runs", lambda r: r["run_number"].eqNullSafe(n))))
    return rows.withColumn("runs", last)


def summary_of(states: DataFrame) -> DataFrame:
    """invoice_id, model_name, and what the runs say together.

    run_numbers (of runs with JSON), first_run, date, amount, company (distinct raw values of array fields),
    answerability, consistency (over the runs 1 to 3, 0 unless all are there), among (whether any of these is).
    """
    given, among = F.filter("runs", lambda r: r["given"]), F.filter("runs", lambda r: r["run_number"].between(1, 3))
    rows = states.select("invoice_id", "model_name", "runs", F.transform(given, lambda r: r["run_number"]).alias("run_numbers"), among.alias("three"))

    def values(f: str) -> Column:
        return F.array_distinct(F.flatten(F.array_compact(F.transform("runs", lambda r: r[f])))).alias(f)

    def same(f: str) -> Column:
        return F.forall("three", lambda r: F.coalesce(r[f"s_{f}"] == F.get("three", F.lit(0))[f"s_{f}"], F.lit(False))).cast("int")

    whole = F.size(F.array_distinct(F.transform("three", lambda r: r["run_number"]))) == 3
    out = rows.select("invoice_id", "model_name", "run_numbers", F.array_min("run_numbers").alias("first_run"), *map(values, _FIELDS), F.when(whole, sum(map(same, jsons.ALL), F.lit(0)) / 4.0).otherwise(0.0).alias("consistency"), (F.size("three") > 0).alias("among"))
    return out.withColumn("answerability", ((F.size("company") > 0).cast("int") + (F.size("amount") > 0).cast("int") + 1) / 3.0)


def summary(runs: DataFrame) -> DataFrame:
    """``summary_of`` all completed runs of each document and model."""
    return summary_of(run_states(runs))


def consistency(runs: DataFrame) -> DataFrame:
    """invoice_id, model_name, consistency: the share of the four fields equal over the completed runs 1 to 3, 0 unless all are there.

    Of a field's values only the least and greatest hash are kept, and combined before they are shuffled.
    """
    rows = jsons.with_fields(runs.filter("status = 'COMPLETED' and run_number between 1 and 3"))
    rows = rows.select("invoice_id", "model_name", "ok", F.expr("shiftleft(1, int(run_number)) as run"), *[said(F.col(f"field_{f}")).alias(f) for f in jsons.ALL])
    met = rows.groupBy("invoice_id", "model_name").agg(F.bool_and("ok").alias("ok"), F.bit_or("run").alias("runs"), *[c for f in jsons.ALL for c in (F.min(f).alias(f), F.max(f).alias(f"most_{f}"))])
    same = sum(((F.col(f) == F.col(f"most_{f}")).cast("int") for f in jsons.ALL), F.lit(0))
    return met.select("invoice_id", "model_name", F.when(F.col("ok") & (F.col("runs") == 0b1110), same / 4.0).otherwise(0.0).alias("consistency"))


def accuracy(hit: Column, truth: Column, found: Column) -> Column:
    """The share of the truth that was found; 1 if both are empty, 0 if only the truth is."""
    return F.when(truth == 0, F.when(found == 0, 1.0).otherwise(0.0)).otherwise(hit / truth)


def f1(hit: Column, truth: Column, found: Column) -> Column:
    p, r = hit / found, hit / truth
    return F.when((truth == 0) & (found == 0), 1.0).when((truth == 0) | (found == 0) | (hit == 0), 0.0).otherwise(2 * p * r / (p + r))


def truth_values(truth: DataFrame) -> DataFrame:
    """invoice_id and the distinct values of its ground truth: t_date, t_amount, t_company. Documents without any have no row."""
    edges = graph.truth_edges(truth).withColumn("value", T.trimmed(F.col("value"))).filter("value <> ''")
    wanted = edges.groupBy("invoice_no").agg(*[F.collect_set(F.when(F.col("field") == f.upper(), F.col("value"))).alias(f"t_{f}") for f in _FIELDS])
    return graph.truth_key(truth).select("invoice_id", "invoice_no").join(wanted, "invoice_no").drop("invoice_no")


def bearing_on(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of truth that decide the truth of some documents: all that bear a number of theirs."""
    rows = graph.truth_key(truth)
    return rows.join(rows.join(ids.select("invoice_id"), "invoice_id", "left_semi").select("invoice_no"), "invoice_no", "left_semi").select(*truth.columns)


def _scored(models: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of ``summary`` with scores; documents without truth have no row."""
    rows = models.filter("size(run_numbers) > 0").join(truth_values(truth), "invoice_id")
    rows = rows.withColumns({f"e_{f}": F.array_distinct(F.filter(F.transform(f, T.trimmed), lambda x: x != "")) for f in _FIELDS})
    rows = rows.withColumn("stable", ~F.exists(F.array(*[F.size(F.array_except(f"e_{f}", f)) > 0 for f in _FIELDS]), lambda x: x))
    rows = rows.withColumns({k: v for f in _FIELDS for k, v in ((f"n_{f}", F.size(F.array_intersect(f"e_{f}", f"t_{f}"))), (f"g_{f}", F.size(f"t_{f}")), (f"x_{f}", F.size(f"e_{f}")))})
    n = {f: (F.col(f"n_{f}"), F.col(f"g_{f}"), F.col(f"x_{f}")) for f in _FIELDS}
    scores = [c for f in _FIELDS for c in (accuracy(*n[f]).alias(f"{f}_accuracy"), f1(*n[f]).alias(f"{f}_f1"))]
    total = lambda k: sum((n[f][k] for f in _FIELDS), F.lit(0))
    out = rows.select("invoice_id", "model_name", "run_numbers", "first_run", "consistency", *scores, F.least(F.lit(1.0), total(2) / total(1)).alias("relation_completeness"), F.col("answerability").alias("query_answerability"), "stable")
    return out.withColumn("overall_entity_accuracy", (F.col("date_accuracy") + F.col("amount_accuracy") + F.col("company_accuracy")) / 3.0)


def model_metrics(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores a document and model: values are those of all completed runs together; documents without truth have no row.

    Truth and extracted values are aggregated into small arrays a document before they meet, so no
    product of values arises.
    """
    return _scored(summary(runs), truth).drop("run_numbers", "first_run", "consistency")


def bundle(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for every completed run of a document with truth: the model's scores, consistency, and whether writing again changes nothing.

    Writing again keeps what it adds, so only the first run of a model can find a change. Runs are
    aggregated once and expanded again at the end, so they are never joined with themselves.
    """
    return bundle_of(summary(runs), truth)


def bundle_of(summaries: DataFrame, truth: DataFrame) -> DataFrame:
    """``bundle`` from the summaries of documents and models."""
    out = _scored(summaries, truth).withColumn("run_number", F.explode("run_numbers"))
    return out.select(
        "invoice_id", "model_name", F.col("run_number").cast("long").alias("run_number"),
        *[f"{f}_{m}" for f in _FIELDS for m in ("accuracy", "f1")],
        "overall_entity_accuracy", "relation_completeness", "query_answerability",
        (F.col("stable") | (F.col("run_number") > F.col("first_run"))).alias("graph_idempotent"),
        F.col("consistency").alias("consistency_score"),
    )
