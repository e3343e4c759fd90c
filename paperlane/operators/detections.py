"""Text detections with boxes: from response bodies to entities, with array functions on one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import text as T

BODY = "struct<data:array<struct<text_detections:array<struct<text_prediction:struct<text:string,confidence:double>,bounding_box:struct<points:array<struct<x:double,y:double>>>>>>>>"
FOUND = "array<struct<text:string,confidence:double,x_min:double,y_min:double,x_max:double,y_max:double>>"
# Confidences, the column's tolerance, and words that rule an amount out.
MIN_CONFIDENCE, MIN_DATE_CONFIDENCE, SMALL_QUANTITY = 0.65, 0.70, 12.00
SLACK, RIGHT_SLACK = 0.02, 0.05
NOT_AMOUNT_CONTEXT = r"(?i)(routing\s+number:|account\s+number:|account\s+no:|phone:|tel:)"
QUANTITY = r"(?i)\b(qty|quantity|pcs|units|ea)\b"


def detections(body: Column) -> Column:
    """Array of text, confidence, x_min, y_min, x_max, y_max; blank texts left out, missing numbers 0."""
    found = F.coalesce(F.get(F.from_json(body, BODY)["data"], 0)["text_detections"], F.array().cast("array<struct<text_prediction:struct<text:string,confidence:double>,bounding_box:struct<points:array<struct<x:double,y:double>>>>>"))

    def one(d: Column) -> Column:
        at = lambda k, axis: F.coalesce(F.get(d["bounding_box"]["points"], k)[axis], F.lit(0.0))
        return F.struct(d["text_prediction"]["text"].alias("text"), F.coalesce(d["text_prediction"]["confidence"], F.lit(0.0)).alias("confidence"), at(0, "x").alias("x_min"), at(0, "y").alias("y_min"), at(2, "x").alias("x_max"), at(2, "y").alias("y_max"))

    return F.transform(F.filter(found, lambda d: d["text_prediction"]["text"].rlike(r"\S")), one)


def reading_order(found: Column) -> Column:
    """Sorted by top, then left edge; equal ones keep their order."""
    keyed = F.transform(found, lambda d, k: F.struct(d["y_min"].alias("y"), d["x_min"].alias("x"), k.alias("k"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda s: s["d"])


def in_amount_column(found: Column) -> Column:
    """Texts of the amounts below the first header ``amount`` or ``total``, within its edges."""
    header = F.get(F.filter(found, lambda d: F.lower(T.trimmed(d["text"])).isin("amount", "total")), 0)

    def inside(d: Column) -> Column:
        return (d["x_min"] >= header["x_min"] - SLACK) & (d["x_max"] <= header["x_max"] + SLACK + RIGHT_SLACK) & (d["y_min"] > header["y_min"]) & T.looks_like_amount(d["text"])

    return F.when(header.isNotNull(), F.filter(found, inside)).otherwise(F.filter(found, lambda d: F.lit(False)))


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.rlike(r"\S")))


def _first_date(c: Column) -> Column:
    hits = [F.regexp_extract(c, p, 0) for p in (T.DAY_FIRST, T.ISO_DATE)]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def _whole_date(c: Column) -> Column:
    return c.rlike(f"^(?:{T.DAY_FIRST})$") | c.rlike(f"^(?:{T.ISO_DATE})$")


def entities_of(found: Column) -> Column:
    """An array of detections to a struct of invoice_no, dates, amounts, companies; a null one counts as empty."""
    sure = F.filter(reading_order(found), lambda d: d["confidence"] >= MIN_CONFIDENCE)
    ready = F.transform(F.coalesce(sure, F.array().cast(FOUND)), lambda d: d.withField("text", T.trimmed(d["text"])))
    return T.let(ready, _entities)


def _entities(found: Column) -> Column:
    number = F.transform(found, lambda d: F.upper(T.or_null(T.trimmed(F.regexp_replace(T.after_prefix(d["text"], T.INVOICE_PREFIXES), r"^[#\s]+", "")))))

    def dates(d: Column) -> Column:
        labelled = T.date_observed(_first_date(T.after_prefix(d["text"], T.DATE_PREFIXES)))
        return F.array(labelled, F.when(_whole_date(d["text"]), T.date_observed(d["text"])))

    def labelled(d: Column) -> Column:
        hit = F.regexp_extract(T.after_prefix(d["text"], T.AMOUNT_PREFIXES), T.AMOUNT_VALUE, 0)
        return F.struct(F.when(hit != "", hit).alias("raw"), d["text"].alias("text"))

    def allowed(x: Column) -> Column:
        before = F.substring(x["text"], F.lit(1), F.greatest(F.instr(F.lower(x["text"]), F.lower(x["raw"])) - 1, F.lit(0)))
        small = T.amount(x["raw"]).try_cast("double") <= SMALL_QUANTITY
        return x["raw"].isNotNull() & ~before.rlike(NOT_AMOUNT_CONTEXT) & T.amount(x["raw"]).isNotNull() & ~_whole_date(x["raw"]) & ~(small & x["text"].rlike(QUANTITY))

    column = F.transform(in_amount_column(found), lambda d: F.struct(d["text"].alias("raw"), d["text"].alias("text")))
    amounts = F.transform(F.filter(F.concat(F.transform(found, labelled), column), allowed), lambda x: T.amount(x["raw"]))
    companies = F.transform(found, lambda d: T.company(T.after_prefix(d["text"], T.COMPANY_PREFIXES)))
    return F.struct(
        F.get(F.array_compact(number), 0).alias("invoice_no"),
        _distinct(F.flatten(F.transform(F.filter(found, lambda d: d["confidence"] >= MIN_DATE_CONFIDENCE), dates))).alias("dates"),
        _distinct(amounts).alias("amounts"),
        _distinct(F.filter(companies, lambda c: T.plausible_company(c, r"(?s)^.*\d+\s+[A-Za-z]+.*$"))).alias("companies"),
    )


def entities(docs: DataFrame) -> DataFrame:
    """docs (doc_id, found: array of detections) to doc_id, invoice_no, dates, amounts, companies."""
    return docs.select("doc_id", entities_of(F.col("found")).alias("x")).select("doc_id", "x.*")
