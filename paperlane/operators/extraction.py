"""Extractors and the fan-out of documents over models and runs.

An extractor is a function from (id, text, run) to a dict; it runs in the tasks, a batch at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import batched
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import jsons, places, text as T

from . import detections
from .calls import called, in_order

RESULT = "invoice_id string, model_name string, run_number int, extracted_json string, latency_ms int, token_count int, status string, error_message string, created_at timestamp_ntz"
RUNS = 3
#: Rows of results that leave a task together.
ROWS = 1000


@dataclass(frozen=True)
class Model:
    """A model of the fan-out; ``call`` gives (response text, token count), or these and the response's whole body, for a prompt or path and a temperature.

    ``at_once``: so many calls a task has open, so all tasks of the cluster together that many times their number.
    """

    name: str
    order: int
    call: Callable[[str, float], tuple]
    reads_path: bool = False
    sees: bool = False  # its response holds text detections
    at_once: int = 1


def choice(invoices: DataFrame) -> DataFrame:
    """invoices with ``input_text``: the normalised text if there is one (even if empty), else the raw one."""
    return invoices.withColumn("input_text", F.coalesce("normalized_text", "raw_text"))


def fan_out(invoices: DataFrame, models: DataFrame) -> DataFrame:
    """A row a document, model (name, ord, reads_path) and run; text models without text are FAILED from the start.

    Models and runs are arrays in the plan, so documents are not shuffled and nothing is joined.
    """
    names = models.orderBy("ord").select("name", "reads_path").collect()  # a handful of models
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("model_name"), F.lit(m.reads_path).alias("reads_path"), F.lit(r).alias("run_number")) for m in names for r in range(1, RUNS + 1)]))
    rows = choice(invoices).withColumn("m", each).select("invoice_id", "path", "input_text", "m.*")
    lacking = ~F.col("reads_path") & (F.coalesce("input_text", F.lit("")) == "")
    return rows.withColumns({"temperature": F.when(F.col("reads_path"), 0.0).otherwise(T.temperature(F.col("run_number"))), "status": F.when(lacking, "FAILED")})


def failed_models(runs: DataFrame) -> DataFrame:
    """invoice_id, model_name of models all of whose runs failed."""
    return runs.groupBy("invoice_id", "model_name").agg(F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed")).filter(f"failed = {RUNS}")


def extracted(work: DataFrame, models: list[Model], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """Runs the models over the rows of ``fan_out``; a failure is the row's result. Replies are cleaned and checked by column functions.

    A task calls each model for as many rows at a time as it allows, so one slow call doesn't hold the others;
    rows stay in order. A model that ``sees`` gets a path and gives the body of a text detection response, whose entities become its reply.
    """
    by_name, limits = {m.name: m for m in models}, {m.name: m.at_once for m in models}

    def one(row: Any) -> tuple:
        start, model = time.monotonic(), by_name[row.model_name]
        if row.status == "FAILED":
            return row.invoice_id, row.model_name, row.run_number, None, None, None, "no text", 0
        said, error = called(lambda: model.call(row.path if model.reads_path else row.input_text, row.temperature), attempts, wait)
        reply, tokens, body = (*said, None)[:3] if said else (None, None, None)
        return row.invoice_id, row.model_name, row.run_number, reply, reply if body is None else body, tokens, error, int((time.monotonic() - start) * 1000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for f in frames for row in f.itertuples(index=False))
        for some in batched(in_order(((r.model_name, partial(one, r)) for r in rows), limits), ROWS):
            yield pd.DataFrame(some, columns=names, dtype=object).astype({"token_count": "Int32"})

    kinds = "invoice_id string, model_name string, run_number int, reply string, body string, token_count int, error_message string, latency_ms int"
    names = [k.split()[0] for k in kinds.split(", ")]
    got = work.mapInPandas(run, kinds)
    seeing = [m.name for m in models if m.sees]
    if seeing:
        found = detections.entities_of(detections.detections(F.col("reply")))
        seen = F.col("model_name").isin(seeing) & F.col("reply").isNotNull()
        got = got.withColumns({"reply": F.when(seen, jsons.contract(*[found[c] for c in ("invoice_no", "dates", "amounts", "companies")])).otherwise(F.col("reply")), "token_count": F.when(~seen, F.col("token_count"))})
    return finished(got)


def finished(replies: DataFrame) -> DataFrame:
    """Runs from replies (reply, the ``body`` they came in, error_message): any JSON is COMPLETED, whatever its kind.

    A call that failed is FAILED with its error. A reply that is null, blank or no JSON once its fence is off is PARSE_FAILED,
    with the whole body as its error.
    """
    rows = jsons.with_fields(replies.withColumn("clean", T.without_fence(F.col("reply"))), "clean")
    lost, good = F.col("error_message").isNotNull(), F.col("clean").rlike(r"\S") & F.col("ok")
    status = F.when(lost, "FAILED").when(good, "COMPLETED").otherwise("PARSE_FAILED")
    rows = rows.withColumn("status", status)
    done = F.col("status") == "COMPLETED"
    error = F.when(F.col("status") == "PARSE_FAILED", F.col("body")).otherwise(F.col("error_message"))
    return rows.select("invoice_id", "model_name", F.col("run_number").cast("int").alias("run_number"), F.when(done, F.col("clean")).alias("extracted_json"), F.col("latency_ms").cast("int").alias("latency_ms"), F.when(done, F.col("token_count")).cast("int").alias("token_count"), "status", error.alias("error_message"), F.localtimestamp().alias("created_at"))


# Amounts as written, and the words beside them that rule them out.
AMOUNT_TOKEN = r"\d{1,3}(?:,\d{3})*(?:\.\d{2})"
DATE_WORD = r"(?i)\b(?:date|invoice\s*date|due\s*date|dated)\b"
ACCOUNT_WORD = r"(?i)(?:routing|account\s*(?:number|no))[^\n\r]{0,20}$"
QUANTITY_WORD = r"(?i)\b(?:qty|quantity|pcs|units|ea)\b"
COMPANY_IN_TEXT = r"(?i)(?:client\s+)?(?:company|vendor|supplier|seller|from|bill\s*from|issued\s*by|bank\s*name|account\s*name)[:\s]+([A-Z][a-zA-Z0-9\s&.,'-]{2,60})"
LARGEST_DATE, LARGEST_QUANTITY = 31.12, 12.0


def standing_amounts(rows: DataFrame, text: str = "text", amounts: str = "amounts") -> DataFrame:
    """rows with only those ``amounts`` of which some occurrence is no date, account number or quantity, or that don't occur literally.

    An occurrence is judged by the text around it: 80 code points on each side, 30 before it, and its line.
    """
    at = F.when(F.size(amounts) > 0, places.matches(F.col(text), AMOUNT_TOKEN)).otherwise(F.array().cast(f"array<{places.MATCH}>"))
    rows = rows.withColumn("_at", F.transform(at, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["line"].alias("line"), F.replace(m["v"], F.lit(","), F.lit("")).alias("v"))))
    some = F.size("_at") > 0
    rows = rows.withColumns({"_blocks": F.when(some, places.blocks(F.col(text))), "_counts": F.when(some, F.transform(places.lines(F.col(text)), lambda x: x.rlike(QUANTITY_WORD)))})

    def ruled_out(m: Column) -> Column:
        value = m["v"].cast("double")
        dated = (value <= LARGEST_DATE) & places.between(F.col("_blocks"), m["s"] - 80, m["e"] + 80).rlike(DATE_WORD)
        numbered = places.between(F.col("_blocks"), m["s"] - 30, m["s"]).rlike(ACCOUNT_WORD)
        return dated | numbered | ((value <= LARGEST_QUANTITY) & F.get("_counts", m["line"]))

    standing = F.transform(F.filter("_at", lambda m: ~ruled_out(m)), lambda m: m["v"])
    lost = F.array_except(F.transform("_at", lambda m: m["v"]), standing)
    return rows.withColumn(amounts, F.array_except(amounts, lost)).drop("_at", "_blocks", "_counts")


def pattern_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text to doc_id, invoice_no, dates, amounts, companies, extracted_json, by patterns over free text; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    union = F.array_union(T.amounts_labelled(F.col("text")), T.amounts_in_table(F.col("text")))
    named = F.filter(F.transform(F.regexp_extract_all("text", F.lit(COMPANY_IN_TEXT), 1), T.trimmed), lambda c: T.plausible_company(c, T.ADDRESS_LIKE))
    rows = rows.select("doc_id", "text", T.invoice_no_in(F.col("text")).alias("invoice_no"), T.dates_in(F.col("text")).alias("dates"), union.alias("amounts"), F.array_distinct(F.transform(named, T.company)).alias("companies"))
    rows = standing_amounts(rows).withColumn("amounts", F.array_except("amounts", "dates"))
    return rows.select("doc_id", "invoice_no", "dates", "amounts", "companies", jsons.contract(F.col("invoice_no"), F.col("dates"), F.col("amounts"), F.col("companies")).alias("extracted_json"))
