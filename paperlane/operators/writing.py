"""Writing to a graph store through an injected function, and what failures do to the rows' states.

The function writes one row (a dict) and raises on failure. It runs in the tasks; each row's failure is that
row's result, so the state of all rows is kept whatever the store does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.functions import jsons, text as T

from .calls import in_order
from .tables import KEYS

Write = Callable[[dict], None]


#: Fixed value: how the error of a failed write begins.
FAILED_WRITE = "Neo4j write failed: "


class Transient(Exception):
    """A failure after which another attempt may succeed."""


class SkipLimit(Exception):
    """More rows of a step had to be skipped than it allows."""


def attempted(write: Write, row: dict, attempts: int = 3, wait: float = 2.0, pause: Callable[[float], None] = time.sleep) -> str | None:
    """The error of the last attempt, or none. Only transient failures are tried again, after ``wait``, twice ``wait`` and so on."""
    for k in range(1, attempts + 1):
        try:
            write(row)
            return None
        except Transient as e:
            error = str(e)
            if k < attempts:
                pause(wait * k)
        except Exception as e:
            return str(e)
    return error


def errors(rows: DataFrame, write: Write | None, attempts: int = 3, wait: float = 2.0, at_once: int = 1) -> DataFrame:
    """rows with ``graph_error``: what writing each of them said; null where it worked, or without a function. A task writes ``at_once`` rows at a time."""
    if write is None:
        return rows.withColumn("graph_error", F.lit(None).cast("string"))
    names = [*rows.columns, "graph_error"]

    def run(batches):
        for batch in batches:
            said = list(in_order((("write", partial(attempted, write, row, attempts, wait)) for row in batch.to_pylist()), {"write": at_once}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names)

    return rows.mapInArrow(run, rows.withColumn("graph_error", F.lit(None).cast("string")).schema)


def graph_states(runs: DataFrame, failed: DataFrame) -> DataFrame:
    """runs after their graph write; failed: keys and graph_error. A failed run is NEO4J_FAILED, with the error, in a fixed form, after its own."""
    bad = failed.filter("graph_error is not null").select(*KEYS, "graph_error")
    rows = runs.join(bad, KEYS, "left")
    own = F.col("graph_error").isNotNull()
    return rows.withColumns({"status": F.when(own, "NEO4J_FAILED").otherwise(F.col("status")), "error_message": F.when(own, T.appended_error(F.col("error_message"), F.concat(F.lit(FAILED_WRITE), F.col("graph_error")))).otherwise(F.col("error_message"))}).select(*runs.columns)


def seed_states(truth: DataFrame, failed: DataFrame) -> DataFrame:
    """truth after seeding: pending rows are seeded unless their id is among the failed ones, which stay pending."""
    bad = failed.select("invoice_id").distinct().withColumn("bad", F.lit(True))
    return truth.join(bad, "invoice_id", "left").withColumn("seeded", F.col("seeded") | F.col("bad").isNull()).select(*truth.columns)


def pending_seeds(truth: DataFrame) -> DataFrame:
    """Ground truth that isn't in the graph yet."""
    return truth.filter(~F.col("seeded"))


def readable(runs: DataFrame) -> tuple[DataFrame, Column]:
    """runs with their parsed fields, and which of them are unreadable: completed, with a text that is no JSON."""
    return jsons.with_fields(runs), (F.upper("status") == "COMPLETED") & F.col("extracted_json").isNotNull() & ~F.col("ok")
