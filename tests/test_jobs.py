"""The jobs end to end on files, and the stream."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from paperlane.operators import evaluation
from paperlane.operators.calls import Refused
from paperlane.operators.extraction import Model
from paperlane.operators.writing import SkipLimit, Transient
from paperlane.plans import pipeline
from paperlane.sources import derived, objects
from paperlane.streaming import incremental


def test_listing_and_lines(spark, tmp_path):
    for name in ("a.b.PNG", "c.txt", ".hidden.png", "d", "sub/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {r.invoice_id for r in objects.listed(spark, str(tmp_path)).collect()} == {"a.b", "e"}
    lines = spark.createDataFrame([("invoice_id,date,amount,company",), ("",), ("a, 1 ,2",), ('i ,d, "x",y , z',)], "value string")
    assert [tuple(r) for r in objects.truth_lines(lines).collect()] == [("i", "d", '"x"', "y")]


def seen(*texts):
    """A text detection response."""
    return json.dumps({"data": [{"text_detections": [{"text_prediction": {"text": t, "confidence": 0.9}, "bounding_box": {"points": [{"x": 0.1, "y": 0.1 * k}] * 4}} for k, t in enumerate(texts)]}]})


def fails_for(folder, which):
    """A graph writer that fails for some rows, and notes every call as a file."""

    def write(row):
        (folder / uuid.uuid4().hex).touch()
        if which(row):
            raise Transient("store is down")

    return write


def test_full_run(spark, tmp_path):
    folder, calls = tmp_path / "invoices", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    for k in range(6):
        (folder / f"inv{k}.png").write_bytes(b"?" if k == 5 else f"Invoice No: N{k}".encode())

    def read(content):
        if content == b"?":
            raise ValueError("no image")
        return content.decode()

    def good(prompt, heat):
        n = prompt.split("N")[-1].split(".")[0].split("/")[-1]
        return "```json\n" + json.dumps({"INVOICE_NO": f"N{n}", "DATE": ["12.03.2024"], "AMOUNT": ["5.00"], "COMPANY": ["acme"]}) + "\n```", 3

    def refusing(prompt, heat):
        raise Refused("refused")

    def looks(path, heat):
        n = path.split("inv")[-1].split(".")[0]
        return seen(f"Invoice Number: N{n}", "Date: 12.03.2024", "Total: 5.00", "Vendor: Acme"), 9

    models = [Model("one", 1, good), Model("two", 2, good), Model("three", 3, lambda p, h: ("no json", 1)), Model("four", 4, refusing, reads_path=True), Model("eyes", 5, looks, reads_path=True, sees=True)]
    store = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4)
    broken = fails_for(calls, lambda row: row.get("model_name") == "two" and row.get("run_number") == 2 and row["invoice_id"] == "inv1")
    done = pipeline.run_full(store, str(folder), read, models, str(tmp_path / "out"), broken, wait=0)
    assert done == {
        "read": {"written": 6, "read": 6, "filtered": 0, "failed": 1}, "extract": {"written": 75, "read": 6, "filtered": 1, "failed": 31}, "agree": {"written": 5, "read": 5, "filtered": 0, "skipped": 0},
        "seed": {"written": 5, "read": 5, "filtered": 0, "failed": 0}, "evaluate": {"written": 44, "read": 75, "filtered": 31}, "export": {"written": 44, "read": 44, "filtered": 0},
    }
    assert len(list(calls.iterdir())) == 45 + 2 + 5  # each completed run once, the failing one three times; each seed once
    status = {r.invoice_id: (r.ocr_status, r.extraction_status, r.evaluation_status) for r in store.read("invoice").collect()}
    assert status["inv0"] == ("COMPLETED", "COMPLETED", "COMPLETED") and status["inv5"] == ("FAILED", None, None)
    runs = {(r.invoice_id, r.model_name, r.run_number): r for r in store.read("extraction_run").collect()}
    assert {(m, r.status) for (_, m, _), r in runs.items()} == {("one", "COMPLETED"), ("two", "COMPLETED"), ("two", "NEO4J_FAILED"), ("three", "PARSE_FAILED"), ("four", "FAILED"), ("eyes", "COMPLETED")}
    assert runs["inv1", "two", 2].status == "NEO4J_FAILED" and runs["inv1", "two", 2].error_message == "Neo4j write failed: store is down" and runs["inv1", "two", 1].latency_ms >= 0
    assert json.loads(runs["inv3", "eyes", 1].extracted_json) == {"INVOICE_NO": "N3", "DATE": ["2024-03-12"], "AMOUNT": ["5.00"], "COMPANY": ["Acme"]} and runs["inv3", "eyes", 1].token_count is None
    nodes = {tuple(r) for r in store.read("run_node").collect()}
    assert ("inv1", "two", 2) not in nodes and ("inv1", "two", 1) in nodes and len(nodes) == 44
    edges = {(r.invoice_no, r.model, r.field, r.value) for r in store.read("value_edge").collect()}
    assert ("inv1", "two", "DATE", "12.03.2024") in edges and ("N1", "ground_truth", "DATE", "2024-03-12") in edges
    assert all(r.seeded and r.created_at for r in store.read("ground_truth_consensus").collect())
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 44 and {(r.model_name, r.company_accuracy) for r in out} == {("one", 0.0), ("two", 0.0), ("eyes", 1.0)}  # raw against normalised
    again = pipeline.run_full(store, str(folder), read, models, str(tmp_path / "out"), broken, wait=0)
    assert again["read"] == {"written": 1, "read": 6, "filtered": 5, "failed": 1} and again["extract"] == {"written": 0, "read": 6, "filtered": 6, "failed": 0}
    assert again["agree"]["written"] == again["seed"]["written"] == again["export"]["written"] == 0 and len(list(calls.iterdir())) == 52
    assert spark.read.parquet(str(tmp_path / "out")).count() == 44 and store.read("value_edge").count() == len(edges)


def test_seeds_that_fail_stay_pending(spark, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4)
    store.write("ground_truth_consensus", spark.createDataFrame([(f"d{k}", f"N{k}", "1.2.2023", "4.00", "Blau", 3, 4, False, None) for k in range(4)], pipeline.TABLES["ground_truth_consensus"].columns))
    store.write("value_edge", spark.createDataFrame([("N0", "ground_truth", True, "DATE", "old"), ("N1", "ground_truth", True, "DATE", "old"), ("N0", "one", False, "DATE", "read")], pipeline.TABLES["value_edge"].columns))
    for k in range(2):
        (tmp_path / f"calls{k}").mkdir()
    assert pipeline.seed(store, fails_for(tmp_path / "calls0", lambda row: row["invoice_id"] in ("d1", "d2")), wait=0)["failed"] == 2
    assert {r.invoice_id: r.seeded for r in store.read("ground_truth_consensus").collect()} == {"d0": True, "d1": False, "d2": False, "d3": True}
    dates = lambda: {(r.invoice_no, r.model, r.value) for r in store.read("value_edge").filter("field = 'DATE'").collect()}
    assert dates() == {("N0", "ground_truth", "2023-02-01"), ("N1", "ground_truth", "old"), ("N0", "one", "read"), ("N3", "ground_truth", "2023-02-01")}
    assert pipeline.seed(store, fails_for(tmp_path / "calls1", lambda row: False), wait=0)["failed"] == 0 and len(list((tmp_path / "calls1").iterdir())) == 2
    assert all(r.seeded for r in store.read("ground_truth_consensus").collect()) and ("N1", "ground_truth", "2023-02-01") in dates()


def test_lines_are_seeded_once(spark, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4)
    (tmp_path / "truth.csv").write_text("invoice_id,date,amount,company\nq1, 1.1.2020 ,5,Blau\nq2,,7,\n")
    assert pipeline.seed_lines(store, str(tmp_path / "truth.csv")) == {"written": 4, "read": 4, "filtered": 0}
    assert pipeline.seed_lines(store, str(tmp_path / "truth.csv")) == {"written": 0, "read": 4, "filtered": 4}
    assert {(r.model, r.is_ground_truth) for r in store.read("value_edge").collect()} == {("GROUND_TRUTH", True)} and store.read("value_edge").count() == 4


def run(invoice, model, json, number=1, when=None):
    return invoice, model, number, json, 0, 1, "COMPLETED", None, when


def test_unreadable_runs_have_no_vote(spark, tmp_path):
    """Two bad runs would make a majority of four models out of reach; beyond the limit the step fails and agrees on nothing."""
    store, x = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4), '{"INVOICE_NO":"x","DATE":["1.2.2023"]}'
    rows = [run("a", "one", "{}{"), run("a", "two", x), run("a", "three", '{"INVOICE_NO":"x"}'), run("a", "four", '{"DATE":["x"]} ...'), run("b", "one", x), run("b", "two", "[1"), run("c", "one", x), run("c", "two", x)]
    store.write("extraction_run", spark.createDataFrame(rows, pipeline.TABLES["extraction_run"].columns))
    # with the unreadable ones among the voters three of four would have to agree
    assert [r.invoice_id for r in pipeline.consensus.consensus(store.read("extraction_run")).collect()] == ["c"]
    with pytest.raises(SkipLimit):
        pipeline.agree(store, skip_limit=2)
    assert store.read("ground_truth_consensus").count() == 0 and {(r.invoice_id, r.model_name) for r in store.read("dead_letter").collect()} == {("a", "one"), ("a", "four"), ("b", "two")}
    assert pipeline.agree(store) == {"written": 2, "read": 3, "filtered": 1, "skipped": 3}
    assert {(r.invoice_id, r.consensus_invoice_no, r.models_agreed) for r in store.read("ground_truth_consensus").collect()} == {("a", "X", 2), ("c", "X", 2)}


def scores(spark, *keys, value=0.5):
    return spark.createDataFrame([(i, m, n, *[value] * 9, True, 0.5, None) for i, m, n in keys], pipeline.TABLES["evaluation_stage"].columns)


def test_each_row_is_sent_once(spark, tmp_path):
    """Batches with common keys give each id once; what a failed step has sent counts, and the ledger reads only the buckets of its rows."""
    store, out = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4), str(tmp_path / "out")
    sent = lambda: sorted((r.insert_id, r.batch, r.date_f1) for r in spark.read.parquet(out).collect())
    store.write("evaluation_stage", scores(spark, ("a", "m", 1), ("a", "m", 2)))
    for again in range(2):  # the second replaces its own batch
        assert pipeline.export(store, out) == {"written": 2, "read": 2, "filtered": 0}
    store.write("evaluation_stage", scores(spark, ("a", "m", 2), ("b", "m", 1), value=0.75))
    assert pipeline.export(store, out) == {"written": 1, "read": 2, "filtered": 1}
    assert sent() == [("a_m_1", "v1", 0.5), ("a_m_2", "v1", 0.5), ("b_m_1", "v2", 0.75)]
    store.write("evaluation_stage", scores(spark, ("c", "m", 1)))
    note, pipeline._note = pipeline._note, None
    with pytest.raises(TypeError):  # the batch is written, its ids are not
        pipeline.export(store, out)
    pipeline._note = note
    store.write("evaluation_stage", scores(spark, ("c", "m", 1), ("d", "m", 1)))
    assert pipeline.export(store, out) == {"written": 1, "read": 2, "filtered": 1}
    assert [s[0] for s in sent()] == ["a_m_1", "a_m_2", "b_m_1", "c_m_1", "d_m_1"]
    rows = spark.createDataFrame([("a_m_1",)], "insert_id string")
    files = store.read("sent", store.buckets_of("sent", rows)).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files} == {str(b) for b in store.buckets_of("sent", rows)}


def rounded(rows):
    columns = [c for c in pipeline.tables.EXPORT if c != "created_at"]
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rows.collect())


@pytest.mark.parametrize("seed", [1])
def test_scores_are_kept_up_however_runs_and_truth_arrive(spark, sf_dir, tmp_path, seed):
    runs = derived.runs(spark, sf_dir).filter("invoice_id < 'inv_1100'").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    runs.write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    truth = pipeline.consensus.consensus(runs)
    truth = truth.withColumn("consensus_invoice_no", F.when(F.crc32("invoice_id") % 3 == 0, "SHARED").otherwise(F.col("consensus_invoice_no")))  # one number for many documents
    truth.write.parquet(str(tmp_path / "truth"))
    truth = spark.read.parquet(str(tmp_path / "truth"))
    want = rounded(evaluation.bundle(runs, truth))
    assert len(want) > 100
    store, part = pipeline.Store(spark, str(tmp_path / "tables"), buckets=4), F.pmod(F.xxhash64(F.lit(seed), *pipeline.tables.KEYS), F.lit(3))
    late = F.pmod(F.xxhash64(F.lit(seed), "invoice_id"), F.lit(2))
    incremental.add_runs(store, runs.filter(part == 0))
    incremental.add_truth(store, truth.filter(late == 0))
    stale = runs.filter(part == 1).withColumns({"extracted_json": F.lit('{"DATE":["stale"]}'), "created_at": F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")})
    incremental.add_runs(store, stale.unionByName(runs.filter(part == 2)))
    incremental.add_truth(store, truth.filter(late == 1).withColumn("consensus_dates", F.lit("1999-01-01")))
    incremental.add_truth(store, truth.filter(late == 1))
    incremental.add_runs(store, runs.filter(part == 1))
    assert rounded(store.read("evaluation_result")) == want
    incremental.add_runs(store, runs.filter(part == 2))  # a batch that runs again
    assert rounded(store.read("evaluation_result")) == want
    # truth that is taken back: documents without any have no row
    bare = truth.filter("not consensus_invoice_no <=> 'SHARED'").withColumns({f"consensus_{c}": F.lit("") for c in ("dates", "amounts", "companies")})
    incremental.add_truth(store, bare)
    left = evaluation.bundle(runs, truth.filter("consensus_invoice_no = 'SHARED'").unionByName(bare))
    assert rounded(store.read("evaluation_result")) == rounded(left) and 0 < left.count() < len(want)


def test_streams_keep_up_scores(spark, sf_dir, tmp_path):
    runs = derived.runs(spark, sf_dir).filter("invoice_id < 'inv_1050'")
    landing, store = str(tmp_path / "landing"), pipeline.Store(spark, str(tmp_path / "tables"), buckets=4)
    schema = runs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    kept = spark.createDataFrame(pipeline.consensus.consensus(runs).collect())
    kept.write.parquet(str(tmp_path / "truth"))
    for number in (3, 1, 2):  # the runs of each document arrive apart
        runs.filter(F.col("run_number") == number).coalesce(1).write.mode("append").parquet(landing)
        incremental.runs_kept_up(incremental.landed(spark, landing, schema), store, str(tmp_path / "seen")).start().awaitTermination()
        if number == 3:
            stream = incremental.landed(spark, str(tmp_path / "truth"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema))
            incremental.truth_kept_up(stream, store, str(tmp_path / "seen-truth")).start().awaitTermination()
    assert rounded(store.read("evaluation_result")) == rounded(evaluation.bundle(runs, kept))
    assert max(r.consistency_score for r in store.read("evaluation_result").collect()) > 0
