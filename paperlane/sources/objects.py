"""Objects in a store, text recognition by an injected function, and ground truth in plain lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlane.functions.text import trimmed

# File types that are taken.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def processable(path: Column) -> Column:
    """No folder, no hidden file, and one of the file types."""
    return F.lower(F.regexp_extract(base_name(path), r"^[^.].*\.([^.]+)$", 1)).isin(EXTENSIONS)


def document_id(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """invoice_id, path of all processable files below a folder; contents are not read. Spark lists no files of 0 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.filter(processable(F.col("path"))).select(document_id(F.col("path")).alias("invoice_id"), "path")


def contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (path, ...) with content; null where there is no such file."""
    return wanted.join(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"), "path", "left")


def pending(objects: DataFrame, done: DataFrame) -> DataFrame:
    """Objects whose id isn't done. No side is broadcast by force: both grow with the data."""
    return objects.join(done.select("invoice_id"), "invoice_id", "left_anti")


def recognised(objects: DataFrame, read: Callable[[bytes], str], attempts: int = 3) -> DataFrame:
    """invoice_id, path, raw_text, error; ``read`` runs in the tasks, and is tried again on OSError only."""

    def one(content: bytes | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, "no content"
        for k in range(attempts):
            try:
                return read(bytes(content)), None
            except OSError as e:
                last = str(e)
            except Exception as e:  # any other failure is this row's result, not the job's
                return None, str(e)
        return None, last

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [one(c) for c in frame["content"]]
            yield pd.DataFrame({"invoice_id": frame["invoice_id"], "path": frame["path"], "raw_text": [t for t, _ in both], "error": [e for _, e in both]})

    return objects.select("invoice_id", "path", "content").mapInPandas(run, "invoice_id string, path string, raw_text string, error string")


def truth_lines(lines: DataFrame) -> DataFrame:
    """invoice_id, date, amount, company from lines (value) of comma-separated text without quoting; short and header lines go."""
    part = F.split("value", ",", -1)
    rows = lines.filter(F.col("value").rlike(r"\S") & (F.size(part) >= 4))
    return rows.select(*[trimmed(F.get(part, k)).alias(c) for k, c in enumerate(("invoice_id", "date", "amount", "company"))]).filter(F.lower("invoice_id") != "invoice_id")


def awaiting_extraction(invoices: DataFrame) -> DataFrame:
    return invoices.filter((F.col("ocr_status") == "COMPLETED") & F.col("extraction_status").isNull())


def awaiting_evaluation(invoices: DataFrame) -> DataFrame:
    return invoices.filter((F.col("extraction_status") == "COMPLETED") & F.col("evaluation_status").isNull()).select("invoice_id")


def never_evaluated(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct ids with a completed run and no result."""
    return runs.filter("status = 'COMPLETED'").select("invoice_id").distinct().join(results.select("invoice_id"), "invoice_id", "left_anti")


def finished_batches(spark: SparkSession, out: str) -> set[str]:
    """Names of the batches of an export that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {n.removeprefix("batch=") for n in done if n.startswith("batch=")}
