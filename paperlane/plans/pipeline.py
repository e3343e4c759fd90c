"""The jobs: one function a step, which may run again without harm and changes only the rows it has to.

Every step says what it did as counts: ``read`` (rows it looked at), ``filtered`` (of these, passed over), ``written``,
``failed`` (rows whose result is a failure) and ``skipped`` (dead letters). They are observed while the step runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from paperlane.functions import jsons
from paperlane.functions.text import text_normalised
from paperlane.operators import consensus, evaluation, extraction, graph, tables, writing
from paperlane.sources import objects
from paperlane.sources.keyed import KeyedStore, Table, counts, whole_plans

_RUN, _EDGE = tuple(tables.KEYS), ("invoice_no", "model", "is_ground_truth", "field", "value")
TABLES = {
    "invoice": Table("invoice_id string, path string, raw_text string, normalized_text string, ocr_status string, extraction_status string, evaluation_status string, created_at timestamp_ntz, updated_at timestamp_ntz", ("invoice_id",)),
    "extraction_run": Table(extraction.RESULT, _RUN, ("invoice_id",)),
    "extraction_stage": Table(extraction.RESULT, _RUN, ("invoice_id",)),
    "run_node": Table("invoice_no string, model string, run_no int", ("invoice_no", "model", "run_no"), ("invoice_no",)),
    "value_edge": Table("invoice_no string, model string, is_ground_truth boolean, field string, value string", _EDGE, ("invoice_no",)),
    "agreement_stage": Table("invoice_id string, model_name string, run_number int, status string, extracted_json string, ok boolean, unreadable boolean, " + jsons.FIELD_COLUMNS, _RUN, ("invoice_id",)),
    "ground_truth_consensus": Table("invoice_id string, consensus_invoice_no string, consensus_dates string, consensus_amounts string, consensus_companies string, models_agreed long, fields_with_consensus long, seeded boolean, created_at timestamp_ntz", ("invoice_id",)),
    "evaluation_stage": Table(tables.RESULTS, _RUN, ("invoice_id",)),
    "evaluation_result": Table(tables.RESULTS, _RUN, ("invoice_id",)),
    "seed_failure": Table("invoice_id string", ("invoice_id",)),
    "dead_letter": Table("invoice_id string, model_name string, run_number int, reason string", _RUN, ("invoice_id",)),
    "sent": Table("insert_id string, batch string", ("insert_id",), blooms=("insert_id",)),
    "sent_batch": Table("batch string", ("batch",), buckets=1),
    "run_summary": Table(evaluation.SUMMARY, ("invoice_id", "model_name"), ("invoice_id",)),
    "run_stage": Table(evaluation.SUMMARY, ("invoice_id", "model_name"), ("invoice_id",)),
    "score_stage": Table(tables.RESULTS, _RUN, ("invoice_id",)),
    "truth_stage": Table("invoice_no string", ("invoice_no",)),
}
#: Unreadable rows that the consensus step passes over before it fails.
SKIP_LIMIT = 50


class Store(KeyedStore):
    """The jobs' tables below a folder. ``buckets``: of every table that has more than one; it stays the same for good, and should make buckets of some hundred megabytes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        super().__init__(spark, root, {n: replace(t, buckets=1 if t.buckets == 1 else buckets) for n, t in TABLES.items()})


def counted(rows: DataFrame, **marks: Column | str) -> tuple[DataFrame, Observation]:
    """rows, and their number and that of those with some property, once an action has run."""
    watch = Observation()
    return rows.observe(watch, F.count(F.lit(1)).alias("read"), *[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in marks.items()]), watch


def read_documents(store: Store, folder: str, read: Callable[[bytes], str]) -> dict[str, int]:
    """Step 1: text of documents not read yet."""
    known = store.read("invoice")
    done = known.filter("ocr_status = 'COMPLETED'").select("invoice_id", F.lit(True).alias("done"))
    listed, seen = counted(objects.listed(store.spark, folder).join(done, "invoice_id", "left"), filtered="done")
    got, found = counted(objects.recognised(objects.contents(store.spark, folder, listed.filter("done is null").drop("done")), read), failed="raw_text is null")
    after = tables.invoices_after_reading(known, got, others=False).join(known.select("invoice_id", "extraction_status", "evaluation_status", "created_at"), "invoice_id", "left")
    after = after.withColumns({"normalized_text": text_normalised(F.col("raw_text")), "created_at": F.coalesce("created_at", F.localtimestamp()), "updated_at": F.localtimestamp()})
    return {"written": store.upsert("invoice", after.select(*known.columns)), **counts(seen, "read", "filtered"), "failed": counts(found, "failed")["failed"]}


def extract(store: Store, models: list[extraction.Model], write: writing.Write | None = None, wait: float = 2.0) -> dict[str, int]:
    """Step 2: all models and runs over documents that wait for it.

    Replies are staged once, with what the graph's writer said of each; edges and nodes of those that
    worked are stored, then the runs with their states, then the documents' status. It may run again after any failure.
    """
    known = store.read("invoice")
    waiting = F.col("invoice_id").isNotNull() & (F.col("ocr_status") == "COMPLETED") & F.col("extraction_status").isNull()
    rows, seen = counted(known, filtered=~F.coalesce(waiting, F.lit(False)))
    kinds = store.spark.createDataFrame([(m.name, m.order, m.reads_path) for m in models], "name string, ord int, reads_path boolean")
    store.write("extraction_stage", extraction.extracted(extraction.fan_out(objects.awaiting_extraction(rows), kinds), models, wait=wait))
    staged = store.read("extraction_stage")
    if write is not None:
        fit = staged.filter("status = 'COMPLETED' and extracted_json is not null")
        said = writing.errors(fit, write, wait=wait).select(*tables.KEYS, "graph_error")
        store.write("extraction_stage", writing.graph_states(staged, said))
        staged = store.read("extraction_stage")
    store.insert("run_node", graph.run_nodes(staged))
    store.insert("value_edge", graph.extracted_edges(staged))
    runs, made = counted(staged, failed="status <> 'COMPLETED'")
    n = store.upsert("extraction_run", runs, "created_at")
    store.upsert("invoice", objects.awaiting_extraction(known).withColumns({"extraction_status": F.lit("COMPLETED"), "updated_at": F.localtimestamp()}))
    return {"written": n, **counts(seen, "read", "filtered"), "failed": counts(made, "failed")["failed"]}


def agree(store: Store, skip_limit: int = SKIP_LIMIT) -> dict[str, int]:
    """Step 3: ground truth of documents that have none.

    Each run is read once: unreadable ones go to the dead letters and have no vote, and their number, counted on
    the way, fails the step beyond the limit. Failures to read or write tables are no rows: they fail the step as they are.
    """
    runs, known = store.read("extraction_run"), store.read("ground_truth_consensus")
    asked = consensus.candidates(runs, known).select("invoice_id")
    parsed, bad = writing.readable(runs.join(asked, "invoice_id", "left_semi").select(*tables.KEYS, "status", "extracted_json"))
    parsed, watch = counted(parsed.withColumn("unreadable", F.coalesce(bad, F.lit(False))), unreadable="unreadable")
    store.write("agreement_stage", parsed)
    staged, skipped = store.read("agreement_stage"), counts(watch, "unreadable")["unreadable"]
    store.write("dead_letter", staged.filter("unreadable").select(*tables.KEYS, F.lit("not JSON").alias("reason")))
    if skipped > skip_limit:
        raise writing.SkipLimit(f"{skipped} runs can't be read, {skip_limit} may be skipped")
    votes, seen = counted(staged.select("invoice_id").distinct())
    new = consensus.consensus(staged.filter("not unreadable")).withColumns({"seeded": F.lit(False), "created_at": F.localtimestamp()})
    n = store.upsert("ground_truth_consensus", votes.join(new, "invoice_id").select(*known.columns))
    looked_at = counts(seen, "read")["read"]
    return {"written": n, "read": looked_at, "filtered": looked_at - n, "skipped": skipped}


def seed(store: Store, write: writing.Write | None = None, wait: float = 2.0) -> dict[str, int]:
    """Step 3b: pending ground truth goes to the graph; what the writer fails for stays pending. Only the edges of its numbers are read and changed."""
    rows, seen = counted(store.read("ground_truth_consensus"), filtered="seeded")
    said = writing.errors(writing.pending_seeds(rows), write, wait=wait)
    store.write("seed_failure", said.filter("graph_error is not null").select("invoice_id"))  # written once: the writer must not be called again
    failed = store.read("seed_failure")
    done = writing.pending_seeds(store.read("ground_truth_consensus")).join(failed, "invoice_id", "left_anti")
    numbers = graph.truth_key(done).select("invoice_no").distinct()
    old = store.read("value_edge", store.buckets_of("value_edge", numbers)).filter(F.col("is_ground_truth") & (F.col("model") == graph.TRUTH)).join(numbers, "invoice_no", "left_semi")
    store.exchange("value_edge", old, graph.truth_edges(done))
    n = store.upsert("ground_truth_consensus", done.withColumn("seeded", F.lit(True)))
    return {"written": n, **counts(seen, "read", "filtered"), "failed": failed.count()}


def seed_lines(store: Store, path: str) -> dict[str, int]:
    """Ground truth from lines of text, under a label of its own; lines seeded before add nothing."""
    edges, seen = counted(graph.csv_edges(objects.truth_lines(store.spark.read.text(path))))
    n = store.insert("value_edge", edges)
    looked_at = counts(seen, "read")["read"]
    return {"written": n, "read": looked_at, "filtered": looked_at - n}


def evaluate(store: Store) -> dict[str, int]:
    """Step 4: scores of documents that wait for them, staged, then in the result table, then the documents' status."""
    known = store.read("invoice")
    asked = objects.awaiting_evaluation(known)
    runs, seen = counted(store.read("extraction_run").join(asked, "invoice_id", "left_semi"), filtered="status <> 'COMPLETED' or extracted_json is null")
    results = evaluation.bundle(runs, store.read("ground_truth_consensus")).withColumn("created_at", F.localtimestamp())
    store.write("evaluation_stage", results.select(*tables.EXPORT))
    staged = store.read("evaluation_stage")
    n = store.upsert("evaluation_result", tables.stamped(staged), "created_at")
    mine = known.join(asked, "invoice_id", "left_semi")
    after = tables.evaluated(mine, staged, asked)
    store.upsert("invoice", mine.drop("evaluation_status").join(after, "invoice_id").select(*known.columns))
    return {"written": n, **counts(seen, "read", "filtered")}


def export(store: Store, out: str) -> dict[str, int]:
    """Step 5: the rows scored last that were never sent, as one batch of the export.

    What was sent stands in a table of ids, of which only the rows' buckets are read, never a batch: except one
    that was written by a step which failed before it noted its ids. Run again, the step replaces its own batch.
    """
    batch = f"v{store.version('evaluation_stage')}"
    noted = {r["batch"] for r in store.read("sent_batch").collect()}  # one name a batch
    for lost in sorted(objects.finished_batches(store.spark, out) - noted - {batch}):
        _note(store, out, lost)
    rows, seen = counted(tables.export_rows(store.read("evaluation_stage")))
    sent = store.read("sent", store.buckets_of("sent", rows)).filter(F.col("batch") != batch)
    with whole_plans(store.spark):
        n = tables.exported(tables.unsent(rows, sent), out, batch)
    _note(store, out, batch)
    looked_at = counts(seen, "read")["read"]
    return {"written": n, "read": looked_at, "filtered": looked_at - n}


def _note(store: Store, out: str, batch: str) -> None:
    store.upsert("sent", store.spark.read.parquet(f"{out}/batch={batch}").select("insert_id", F.lit(batch).alias("batch")))
    store.upsert("sent_batch", store.spark.createDataFrame([(batch,)], "batch string"))


def run_full(store: Store, folder: str, read: Callable[[bytes], str], models: list[extraction.Model], out: str, write: writing.Write | None = None, wait: float = 2.0) -> dict[str, dict[str, int]]:
    """All steps; what each of them counted."""
    return {
        "read": read_documents(store, folder, read),
        "extract": extract(store, models, write, wait),
        "agree": agree(store),
        "seed": seed(store, write, wait),
        "evaluate": evaluate(store),
        "export": export(store, out),
    }
