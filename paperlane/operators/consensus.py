"""Ground truth by majority vote over the models' first runs, for all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import jsons, text as T

_NORMAL = {"DATE": T.date_consensus, "AMOUNT": T.amount_consensus, "COMPANY": T.company_key}


def candidates(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of two models or more with a completed first run and no ground truth yet."""
    done = runs.filter((F.col("run_number") == 1) & (F.upper("status") == "COMPLETED"))
    return done.groupBy("invoice_id").agg(F.countDistinct("model_name").alias("models")).filter("models >= 2").join(existing.select("invoice_id"), "invoice_id", "left_anti")


def first_runs(runs: DataFrame) -> DataFrame:
    """One completed first run a document and model key; of several names with one key the least. Adds ``key``."""
    rows = runs.filter((F.col("run_number") == 1) & (F.upper("status") == "COMPLETED")).withColumn("key", T.model_key(F.col("model_name"))).filter("key is not null")
    return rows.groupBy("invoice_id", "key").agg(F.min_by(F.struct(*[c for c in runs.columns if c != "invoice_id"]), "model_name").alias("x")).select("invoice_id", "x.*", "key")


def ballots(firsts: DataFrame) -> DataFrame:
    """invoice_id and, of each first run, arrays of its distinct normalised values: invoice_no, date, amount, company. One parse a row, none if they are parsed already."""
    rows = firsts if "field_DATE" in firsts.columns else jsons.with_fields(firsts)
    number = F.array_compact(F.array(T.invoice_no(jsons.text_of(F.col("field_INVOICE_NO")))))
    values = [F.array_distinct(F.array_compact(F.transform(jsons.set_of(F.col(f"field_{f}")), _NORMAL[f]))).alias(f.lower()) for f in jsons.FIELDS]
    return rows.select("invoice_id", number.alias("invoice_no"), *values)


def votes(firsts: DataFrame) -> DataFrame:
    """invoice_id, field, value, votes: in how many models' outputs a normalised value occurs."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f.lower()).alias("values")) for f in ("INVOICE_NO", *jsons.FIELDS)])
    rows = ballots(firsts).select("invoice_id", F.explode(each).alias("x")).select("invoice_id", "x.field", F.explode("x.values").alias("value"))
    return rows.groupBy("invoice_id", "field", "value").agg(F.count(F.lit(1)).alias("votes"))


def consensus(runs: DataFrame) -> DataFrame:
    """invoice_id, consensus_invoice_no, _dates, _amounts, _companies (comma-joined, sorted), models_agreed, fields_with_consensus.

    Documents with fewer than two models, or without any agreed field, have no row. A document's ballots
    are a few short arrays: they meet once, by document, and votes are counted there.
    """
    names = ("invoice_no", "date", "amount", "company")
    met = ballots(first_runs(runs)).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("models_agreed"), *[F.flatten(F.collect_list(c)).alias(c) for c in names]).filter("models_agreed >= 2")

    def agreed(c: str) -> Column:
        return F.filter(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda x: x == v)) >= T.majority(F.col("models_agreed")))

    rows = met.select("invoice_id", "models_agreed", *[agreed(c).alias(c) for c in names])
    shown = {"date": F.col("date"), "amount": F.col("amount"), "company": F.transform("company", T.title_case)}
    n = sum(((F.size(c) > 0).cast("long") for c in names), F.lit(0).cast("long"))
    out = rows.select("invoice_id", F.array_max("invoice_no").alias("consensus_invoice_no"), *[F.array_join(F.array_sort(shown[c]), ",").alias(f"consensus_{p}") for c, p in (("date", "dates"), ("amount", "amounts"), ("company", "companies"))], F.col("models_agreed").cast("long"), n.alias("fields_with_consensus"))
    return out.filter("fields_with_consensus > 0")


def status(truth: DataFrame) -> DataFrame:
    """One row: totals, rows by number of agreed fields, and their mean (0.0 without rows)."""
    n = F.col("fields_with_consensus")
    return truth.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(n == 4, 1)).alias("full"), F.count(F.when(n < 4, 1)).alias("part"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_fields"))
