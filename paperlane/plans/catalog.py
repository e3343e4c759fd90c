"""The registered queries: for each operator a Spark query over a whole table and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlane.functions import jsons as J, text as T
from paperlane.operators import consensus, detections, evaluation, extraction, graph, tables, writing
from paperlane.sources import derived, objects
from paperlane.sources.keyed import KeyedStore, Table, scratch

from . import oracle as O

FLAGSHIP = "eval_bundle"
_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _put(name: str, query, sql: str | None = None) -> None:
    _REGISTRY[name] = (query, sql)


def _scalar(name: str, source: str, column: str, body: Callable[[Column], Column], sql: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query of one scalar function over a column of a derived table, after ``rows`` of it."""
    read, prelude, key = {"samples": (derived.samples, f"{O.SAMPLES} SELECT k", "k"), "invoice": (derived.invoices, f"{O.INVOICE} SELECT k", "k"), "runs": (derived.runs, f"{O.RUNS} SELECT invoice_id, model_name, run_number", None)}[source]
    table = "s" if source == "samples" else source
    keys = [key] if key else tables.KEYS

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(read(spark, sf_dir)).select(*keys, body(F.col(column)).alias("value"))

    _put(name, query, f"WITH {prelude}, {sql} AS value FROM {table}")


def _texts() -> None:
    joined = lambda c: F.array_join(c, "|")
    n, a, d = "name_text", "amount_text", "date_text"
    _scalar("str_company", "samples", n, T.company, O.company(n))
    _scalar("str_company_key", "samples", n, T.company_key, O.key(n))
    _scalar("str_title", "samples", n, lambda c: T.title_case(T.company_key(c)), O.title(O.key(n)))
    _scalar("str_invoice_no", "samples", n, T.invoice_no, f"nullif(upper(regexp_replace({n}, '\\s+', '', 'g')), '')")
    _scalar("str_csv_split", "samples", n, lambda c: joined(T.csv_parts(c)), f"array_to_string(list_filter(list_transform(string_split({n}, ','), lambda x: {O.tr('x')}), lambda x: x <> ''), '|')")
    _scalar("str_prefix", "samples", n, lambda c: T.after_prefix(c, T.INVOICE_PREFIXES + T.COMPANY_PREFIXES), O.after(n, T.INVOICE_PREFIXES + T.COMPANY_PREFIXES))
    bare = f"regexp_replace(regexp_replace({n}, '^```(json)?', ''), '```\\n?$', '')"
    _scalar("str_fence", "samples", n, T.without_fence, f"CASE WHEN starts_with({n}, '```') THEN {O.tr(bare)} ELSE {n} END")
    _scalar("str_truncate", "samples", n, T.truncated, f"CASE WHEN length({n}) > 500 THEN {n}[1:500] || '...' ELSE {n} END")
    _scalar("str_prompt", "samples", n, lambda c: T.prompt("Read {{text}}.", c), f"'Read ' || COALESCE({n}, '') || '.'")
    _scalar("flt_company", "samples", n, lambda c: T.plausible_company(c), f"length({n}) BETWEEN 3 AND 80 AND NOT regexp_matches({n}, '(?i)^.*\\d+\\s+.*\\b(?:road|street|ave|avenue|blvd|boulevard)\\b.*$')")
    _scalar("amt_normalize", "samples", a, T.amount, O.amount(a))
    _scalar("amt_consensus", "samples", a, T.amount_consensus, O.amount_consensus(a))
    _scalar("amt_looks_like", "samples", a, T.looks_like_amount, f"regexp_matches({O.tr(a)}, '^\\d{{1,3}}(,\\d{{3}})*\\.\\d{{2}}$')")
    _scalar("date_observed", "samples", d, T.date_observed, O.date_observed(d))
    _scalar("date_ladder", "samples", d, T.date_ladder, O.date_ladder(d))
    _scalar("date_consensus", "samples", d, T.date_consensus, O.date_consensus(d))
    _scalar("mth_temperature", "runs", "run_number", T.temperature, "CASE run_number WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END")
    r, inline = "raw_text", T.AMOUNT_INLINE
    rewritten = f"CASE WHEN {r} IS NOT NULL THEN array_to_string(list_transform(list_zip(string_split_regex({r}, '{inline}'), regexp_extract_all({r}, '{inline}')), lambda z: z[1] || COALESCE({O.amount('z[2]')}, z[2], '')), '') END"
    _scalar("amt_inline", "invoice", r, T.amounts_rewritten, rewritten)
    _scalar("str_normalize_text", "invoice", r, T.text_normalised, O.company(rewritten))
    found = f"list_transform(regexp_extract_all({r}, '{T.DATE_IN_TEXT}'), lambda v: {O.date_observed('v')})"
    _scalar("date_extract", "invoice", r, lambda c: joined(F.array_sort(T.dates_in(c))), f"array_to_string(list_sort(list_distinct({found})), '|')")
    labelled = f"list_transform(regexp_extract_all({r}, '{T.AMOUNT_LABELLED}', 1), lambda v: {O.amount('v')})"
    _scalar("amt_labeled", "invoice", r, lambda c: joined(F.array_sort(T.amounts_labelled(c))), f"array_to_string(list_sort(list_distinct(list_filter({labelled}, lambda v: v IS NOT NULL))), '|')")
    hit = rf"regexp_extract({r}, '{T.INVOICE_LABEL}[A-Z0-9\-]+')"
    _scalar("str_invoice_label", "invoice", r, T.invoice_no_in, f"CASE WHEN {hit} <> '' THEN {O.tr(f'regexp_replace({hit}, {chr(39)}{T.INVOICE_LABEL}{chr(39)}, {chr(39)}{chr(39)})')} END")
    _scalar("src_object_id", "invoice", "path", objects.document_id, r"regexp_extract(path, '([^/]*)\.[^./]*$', 1)")

    listed = lambda c: F.filter(F.array(c, F.lit("a")), lambda x: x.isNotNull())
    _scalar("json_contract", "samples", n, lambda c: J.contract(c, listed(c), listed(c), F.array()), f"to_json({{'INVOICE_NO': {n}, 'DATE': list_filter([{n}, 'a'], lambda x: x IS NOT NULL), 'AMOUNT': list_filter([{n}, 'a'], lambda x: x IS NOT NULL), 'COMPANY': []::VARCHAR[]}})::VARCHAR")
    given = f"COALESCE({n}, '')"
    _scalar("json_chat_request", "samples", n, lambda c: J.chat_request(F.lit("m"), F.coalesce(c, F.lit("")), F.lit(0.3), json_only=True), f"to_json({{'model': 'm', 'messages': [{{'role': 'user', 'content': {given}}}], 'temperature': 0.3::DOUBLE, 'max_tokens': 1024, 'response_format': {{'type': 'json_object'}}}})::VARCHAR")
    _scalar("json_parts_request", "samples", n, lambda c: J.parts_request(F.coalesce(c, F.lit("")), F.lit(0.5), thinking=0), f"to_json({{'contents': [{{'role': 'user', 'parts': [{{'text': {given}}}]}}], 'generationConfig': {{'temperature': 0.5::DOUBLE, 'maxOutputTokens': 1024, 'responseMimeType': 'application/json', 'thinkingConfig': {{'thinkingBudget': 0}}}}}})::VARCHAR")
    pictured = lambda c: J.image_request(T.data_url(F.concat(F.substring(c, 1, 3), F.lit(".PNG")), c.cast("binary")))
    _scalar("json_image_request", "samples", n, lambda c: F.when(c.isNotNull(), pictured(c)), f"CASE WHEN {n} IS NOT NULL THEN to_json({{'input': [{{'type': 'image_url', 'url': 'data:image/png;base64,' || base64(encode({n}))}}]}})::VARCHAR END")

    def pages(spark, sf_dir):
        ends = F.get(F.array(*[F.lit(x) for x in (".png", ".PDF", ".txt", "", ".tar.gif", "/.hidden.jpg")]), (F.col("page_id") % 6).cast("int"))
        path = F.concat("url", ends)
        return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", objects.base_name(path).alias("base"), F.coalesce(objects.processable(path), F.lit(False)).alias("taken"))

    kinds = "|".join(objects.EXTENSIONS)
    _put("src_processable", pages, rf"WITH p AS (SELECT page_id, regexp_extract(url || ['.png', '.PDF', '.txt', '', '.tar.gif', '/.hidden.jpg'][page_id % 6 + 1], '([^/]*)$', 1) AS base FROM pages) SELECT page_id, base, regexp_matches(base, '(?i)^[^.].*\.({kinds})$') AS taken FROM p")


def _fields() -> None:
    for f in J.FIELDS:
        x = f.lower()
        _scalar(f"json_field_set_{x}", "runs", f"field_{f}", lambda c: F.array_join(F.array_sort(J.set_of(c)), "|"), f"COALESCE(array_to_string({O.field_set(f)}, '|'), '')", J.with_fields)
    _scalar("json_field_string", "runs", "field_INVOICE_NO", J.text_of, O.field_text("INVOICE_NO"), J.with_fields)
    raw = ("INVOICE_NO", "DATE", "AMOUNT")
    _scalar("json_raw_set", "runs", "ok", lambda c: F.concat_ws("#", *[F.when(c, F.array_join(J.raw_of(F.col(f"field_{f}")), "|")) for f in raw]), "concat_ws('#', " + ", ".join(f"CASE WHEN json_valid(extracted_json) THEN array_to_string({O.raw_set(f)}, '|') END" for f in raw) + ")", J.with_fields)
    _scalar("json_valid", "runs", "ok", lambda c: c, "COALESCE(json_valid(extracted_json), false)", J.with_fields)

    def replies(kind: str, body: Callable[[Column], Column]):
        def query(spark, sf_dir):
            runs = tables.with_value(derived.runs(spark, sf_dir), "extracted_json")

            def quoted(c: Column) -> Column:
                whole = F.to_json(F.struct(c.alias("t")))
                return T.let(whole, lambda w: F.substring(w, F.lit(6), F.length(w) - 6))  # the value as a JSON string

            j, half = F.col("extracted_json"), F.floor(F.length("extracted_json") / 2).cast("int")
            run, model = F.col("run_number"), F.col("model_name")
            rest = F.substring(j, half + 1, F.length(j) - half - F.when(run == 2, 12).otherwise(0))
            inserts = {"@": quoted(j), "@A": quoted(F.substring(j, F.lit(1), half)), "@B": quoted(rest), "WHY": F.when(run == 2, "MAX_TOKENS").when(run == 3, "SAFETY").otherwise("STOP"), "HIDDEN": (model == "Delta").cast("string"), "N": (run * 10 + F.length("model_name")).cast("string"), "MORE": F.when(model == "Gamma", F.concat(F.lit('"candidatesTokenCount":'), run, F.lit(","))).otherwise("")}
            bodies = runs.select(*tables.KEYS, F.concat(*[inserts.get(p, F.lit(p)) for p in kind.split("~")]).alias("body"))
            return bodies.select(*tables.KEYS, body(F.col("body")).alias("value"))

        return query

    def runs(value: str) -> str:
        return f"WITH {O.RUNS} SELECT invoice_id, model_name, run_number, {value} AS value FROM runs WHERE extracted_json IS NOT NULL"

    part = '{"candidates":[{"finishReason":"~WHY~","content":{"parts":[{"text":"old"},{"thought":true,"text":"hm"},{"thought":~HIDDEN~,"text":~@~},{"text":" "}]}}],"usageMetadata":{~MORE~"totalTokenCount":~N~}}'
    _put("json_last_part", replies(part.replace('{"text":"old"},', ""), J.last_part), runs(f"CASE WHEN model_name = 'Delta' OR run_number = 3 THEN NULL WHEN run_number = 2 THEN {O.recovered('extracted_json')} ELSE extracted_json END"))
    # a stream of two chunks with half a text each; that of a second run is cut off, that of a third one blocked
    half = part.replace('{"text":"old"},', "")
    halves = f"[{half.replace('~WHY~', '').replace('~@~', '~@A~')},{half.replace('~@~', '~@B~')}]"
    cut_off = "left(extracted_json, length(extracted_json) - 12)"
    _put("json_stream_merge", replies(halves, J.stream_text), runs(f"CASE WHEN model_name = 'Delta' OR run_number = 3 THEN NULL WHEN run_number = 2 THEN {O.recovered(cut_off)} ELSE extracted_json END"))
    _put("json_tokens", replies(f"[{part},{part}]", J.stream_tokens), runs("CASE WHEN model_name = 'Gamma' THEN run_number ELSE run_number * 10 + length(model_name) END"))
    chat = '{"choices":[{"message":{"content":~@~}}],"usage":{"total_tokens":9}}'
    _put("json_chat", replies(chat, J.chat_text), runs("extracted_json"))
    both = "CASE WHEN run_number = 2 THEN left(extracted_json, length(extracted_json) - 12) ELSE extracted_json END"
    _put("json_all_parts", replies('[{"candidates":[{"content":{"parts":[{"text":~@A~},{"text":""}]}}]},{"candidates":[{"content":{"parts":[{"text":~@B~}]}}]}]', J.all_parts), runs(both))
    _put("json_first_part", replies('{"candidates":[{"content":{"parts":[{"text":~@A~},{"text":~@B~}]}}]}', J.all_parts), runs("left(extracted_json, length(extracted_json) // 2)"))
    _put("json_chat_parts", replies('{"choices":[{"message":{"content":[{"type":"text","text":~@A~},{"type":"image"},{"type":"text","text":~@B~}]}}]}', J.chat_text), runs(both))
    _put("json_chat_tokens", replies('{"usage":{"total_tokens":~N~},"choices":[]}', J.chat_tokens), runs("run_number * 10 + length(model_name)"))
    _put("json_sse_tokens", replies('data: {"usage":{"total_tokens":~N~}}\n\ndata: {"choices":[{"delta":{"content":~@~}}],"usage":{"total_tokens":0}}\ndata: [DONE]\n', J.sse_tokens), runs("run_number * 10 + length(model_name)"))
    _put("json_sse", replies('data: {"choices":[{"delta":{"content":~@~}}]}\n\ndata: {"choices":[{"delta":{"content":"!"}}],"usage":{"total_tokens":5}}\ndata: [DONE]\n', lambda c: F.concat(J.sse_text(c), J.sse_tokens(c).cast("string"))), runs("extracted_json || '!5'"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(derived.runs(spark, sf_dir))


def _state() -> None:
    inv = lambda s, d: derived.invoices(s, d)
    w = f"WITH {O.INVOICE} "
    _put("src_extraction_pending", lambda s, d: objects.awaiting_extraction(inv(s, d)).select("invoice_id", "path"), w + "SELECT invoice_id, path FROM invoice WHERE ocr_status = 'COMPLETED' AND extraction_status IS NULL")
    _put("src_evaluation_pending", lambda s, d: objects.awaiting_evaluation(inv(s, d)), w + "SELECT invoice_id FROM invoice WHERE extraction_status = 'COMPLETED' AND evaluation_status IS NULL")
    _put("src_ocr_pending", lambda s, d: objects.pending(inv(s, d).filter(objects.processable(F.col("path"))).select(objects.document_id(F.col("path")).alias("invoice_id"), "path"), inv(s, d).filter("ocr_status = 'COMPLETED'")), w + "SELECT invoice_id, path FROM invoice WHERE ocr_status <> 'COMPLETED'")
    _put("src_unevaluated_ids", lambda s, d: objects.never_evaluated(derived.runs(s, d), inv(s, d).filter("evaluation_status = 'COMPLETED'")), f"WITH {O.INVOICE}, {O.RUNS} SELECT DISTINCT invoice_id FROM runs r WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM invoice i WHERE i.invoice_id = r.invoice_id AND evaluation_status = 'COMPLETED')")
    _put("prj_text_choice", lambda s, d: extraction.choice(inv(s, d)).select("invoice_id", "input_text"), w + "SELECT invoice_id, COALESCE(normalized_text, raw_text) AS input_text FROM invoice")
    _put("flt_status", lambda s, d: inv(s, d).groupBy("ocr_status", "extraction_status", "evaluation_status").agg(F.count(F.lit(1)).alias("n")), w + "SELECT ocr_status, extraction_status, evaluation_status, COUNT(*) AS n FROM invoice GROUP BY ALL")

    _put("run_outcomes", lambda s, d: extraction.finished(derived.replies(s, d)).select("invoice_id", "status", "extracted_json", "error_message", "token_count"), f"""WITH r AS ({derived.REPLIES}), c AS (SELECT *, CASE WHEN starts_with(reply, '```') THEN {O.tr("regexp_replace(regexp_replace(reply, '^```(json)?', ''), '```\\n?$', '')")} ELSE reply END AS clean FROM r),
o AS (SELECT *, CASE WHEN error_message IS NOT NULL THEN 'FAILED' WHEN COALESCE(regexp_matches(clean, '\\S') AND json_valid(clean), false) THEN 'COMPLETED' ELSE 'PARSE_FAILED' END AS status FROM c)
SELECT invoice_id, status, CASE WHEN status = 'COMPLETED' THEN clean END AS extracted_json, CASE WHEN status = 'PARSE_FAILED' THEN body ELSE error_message END AS error_message, CASE WHEN status = 'COMPLETED' THEN token_count END AS token_count FROM o""")

    def upsert(s, d):
        known = inv(s, d).filter("extraction_status is not null")
        read = inv(s, d).filter("extraction_status is null or evaluation_status is null").select("invoice_id", F.concat("path", F.lit(".new")).alias("path"), F.when(F.col("ocr_status") == "COMPLETED", F.lit("new text")).alias("raw_text"))
        return tables.invoices_after_reading(known, read)

    _put("snk_invoice_upsert", upsert, w + """, o AS (SELECT * FROM invoice WHERE extraction_status IS NOT NULL), r AS (SELECT invoice_id, path || '.new' AS path, CASE WHEN ocr_status = 'COMPLETED' THEN 'new text' END AS raw_text FROM invoice WHERE extraction_status IS NULL OR evaluation_status IS NULL)
SELECT COALESCE(o.invoice_id, r.invoice_id) AS invoice_id, COALESCE(o.path, r.path) AS path, COALESCE(r.raw_text, o.raw_text) AS raw_text,
  CASE WHEN r.invoice_id IS NULL THEN o.ocr_status WHEN r.raw_text IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS ocr_status FROM o FULL JOIN r ON o.invoice_id = r.invoice_id""")

    def evaluated(s, d):
        results = derived.runs(s, d).filter("status = 'COMPLETED' and run_number = 1 and model_name = 'Beta'")
        return tables.evaluated(inv(s, d), results, objects.awaiting_evaluation(inv(s, d)))

    _put("snk_eval_status", evaluated, f"WITH {O.INVOICE}, {O.RUNS} SELECT i.invoice_id, CASE WHEN extraction_status = 'COMPLETED' AND evaluation_status IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.invoice_id = i.invoice_id AND status = 'COMPLETED' AND run_number = 1 AND model_name = 'Beta') THEN 'COMPLETED' ELSE 'SKIPPED' END ELSE evaluation_status END AS evaluation_status FROM invoice i")

    def kept_in_buckets(s, d):
        """Runs in a keyed table of 32 buckets: all first and second runs, then what a later step changes, adds and removes."""
        columns = "invoice_id string, model_name string, run_number int, status string"
        store = KeyedStore(s, scratch(s), {"runs": Table(columns, tuple(tables.KEYS), ("invoice_id",), 32)})
        runs = derived.runs(s, d).select(*tables.KEYS, "status")
        store.upsert("runs", runs.filter("run_number < 3"))
        store.upsert("runs", runs.filter("run_number > 1 and model_name = 'Beta'").withColumn("status", F.lit("NEW")))
        store.erase("runs", runs.filter("model_name = 'Gamma' and status = 'FAILED'"))
        store.insert("runs", runs.filter("model_name in ('Beta', 'Delta')").withColumn("status", F.lit("ADDED")))
        return store.read("runs")

    _put("snk_keyed_runs", kept_in_buckets, f"WITH {O.RUNS} SELECT invoice_id, model_name, run_number, CASE WHEN model_name = 'Beta' AND run_number > 1 THEN 'NEW' WHEN model_name = 'Delta' AND run_number = 3 THEN 'ADDED' ELSE status END AS status FROM runs WHERE (run_number < 3 OR model_name IN ('Beta', 'Delta')) AND NOT (model_name = 'Gamma' AND status = 'FAILED')")

    def replaced(s, d):
        runs = derived.runs(s, d).select(*tables.KEYS, "status")
        return tables.upserted(runs.filter("run_number < 3"), runs.filter("run_number > 1 and model_name = 'Beta'").withColumn("status", F.lit("NEW")), tables.KEYS)

    _put("snk_run_upsert", replaced, f"WITH {O.RUNS} SELECT invoice_id, model_name, run_number, CASE WHEN run_number > 1 AND model_name = 'Beta' THEN 'NEW' ELSE status END AS status FROM runs WHERE run_number < 3 OR model_name = 'Beta'")
    models = lambda s: s.createDataFrame([("text model", 1, False), ("image model", 2, True)], "name string, ord int, reads_path boolean")
    _put("join_fanout", lambda s, d: extraction.fan_out(inv(s, d), models(s)).select("invoice_id", "model_name", "run_number", "temperature", "status"), w + """SELECT invoice_id, m.name AS model_name, r.run AS run_number,
  CASE WHEN m.path THEN 0.0::DOUBLE WHEN r.run = 2 THEN 0.3::DOUBLE WHEN r.run = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS temperature, CASE WHEN NOT m.path AND COALESCE(normalized_text, raw_text, '') = '' THEN 'FAILED' END AS status
FROM invoice CROSS JOIN (VALUES ('text model', false), ('image model', true)) m(name, path) CROSS JOIN (VALUES (1), (2), (3)) r(run)""")
    _put("agg_failed_models", lambda s, d: extraction.failed_models(derived.runs(s, d).withColumn("status", F.when(F.col("extracted_json").contains("Inc."), "FAILED").otherwise(F.col("status")))), f"WITH {O.RUNS} SELECT invoice_id, model_name, COUNT(*) AS failed FROM runs WHERE status = 'FAILED' OR contains(extracted_json, 'Inc.') GROUP BY ALL HAVING COUNT(*) = 3")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth after seeding, which fails for documents that lack a field."""
    truth = _truth(spark, sf_dir).withColumn("seeded", F.lit(False))
    return writing.seed_states(truth, truth.filter("fields_with_consensus <> 4"))


def _votes() -> None:
    run = derived.runs
    _put("snk_seed_state", lambda s, d: _seeded(s, d).select("invoice_id", "consensus_invoice_no", "seeded"), f"WITH {O.CONSENSUS} SELECT invoice_id, consensus_invoice_no, fields_with_consensus = 4 AS seeded FROM consensus")

    def states(s, d):
        runs = run(s, d).withColumn("error_message", F.when(F.col("run_number") == 1, F.lit("slow")))
        failed = runs.filter("status = 'COMPLETED' and model_name = 'Gamma' and run_number < 3").withColumn("graph_error", F.lit("down"))
        return writing.graph_states(runs, failed).select(*tables.KEYS, "status", "error_message")

    lost = "status = 'COMPLETED' AND model_name = 'Gamma' AND run_number < 3"
    _put("snk_graph_status", states, f"WITH {O.RUNS} SELECT invoice_id, model_name, run_number, CASE WHEN {lost} THEN 'NEO4J_FAILED' ELSE status END AS status, nullif(concat_ws(' | ', CASE WHEN run_number = 1 THEN 'slow' END, CASE WHEN {lost} THEN 'Neo4j write failed: down' END), '') AS error_message FROM runs")
    _put("agg_gt_candidates", lambda s, d: consensus.candidates(run(s, d), derived.invoices(s, d).filter("evaluation_status = 'SKIPPED'")).orderBy("invoice_id"), f"WITH {O.INVOICE}, {O.RUNS} SELECT invoice_id, COUNT(DISTINCT model_name) AS models FROM runs WHERE run_number = 1 AND upper(status) = 'COMPLETED' AND invoice_id NOT IN (SELECT invoice_id FROM invoice WHERE evaluation_status = 'SKIPPED') GROUP BY 1 HAVING COUNT(DISTINCT model_name) >= 2")
    _put("win_first_run_per_model", lambda s, d: consensus.first_runs(run(s, d)).select("invoice_id", F.col("key").alias("model_key"), "model_name"), f"WITH {O.FIRSTS} SELECT invoice_id, mkey AS model_key, model_name FROM firsts")
    _put("agg_required_votes", lambda s, d: consensus.first_runs(run(s, d)).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("models")).withColumn("required", T.majority(F.col("models"))), f"WITH {O.FIRSTS} SELECT invoice_id, COUNT(*) AS models, COUNT(*) // 2 + 1 AS required FROM firsts GROUP BY 1")
    for name, field in (("invoice_no", "INVOICE_NO"), ("dates", "DATE"), ("amounts", "AMOUNT"), ("companies", "COMPANY")):
        _put(f"agg_vote_{name}", lambda s, d, f=field: consensus.votes(consensus.first_runs(run(s, d))).filter(F.col("field") == f).select("invoice_id", "value", "votes"), f"WITH {O.VOTES} SELECT invoice_id, value, votes FROM votes WHERE field = '{field}'")
    _put("agg_consensus", _truth, f"WITH {O.CONSENSUS} SELECT * FROM consensus")
    _put("agg_gt_status", lambda s, d: consensus.status(_truth(s, d)), f"WITH {O.CONSENSUS} SELECT COUNT(*) AS total, COUNT(*) FILTER (fields_with_consensus = 4) AS \"full\", COUNT(*) FILTER (fields_with_consensus < 4) AS part, COALESCE(AVG(fields_with_consensus), 0.0) AS mean_fields FROM consensus")
    _put("prj_gt_key", lambda s, d: graph.truth_key(_truth(s, d)).select("invoice_id", "invoice_no"), f"WITH {O.TRUTH} SELECT invoice_id, invoice_no FROM keyed")
    _put("win_last_seed", lambda s, d: graph.last_seeds(_truth(s, d)).select("invoice_no", "invoice_id"), f"WITH {O.TRUTH} SELECT invoice_no, invoice_id FROM seeds")
    _put("src_gt_pending_seed", lambda s, d: writing.pending_seeds(_seeded(s, d)).select("invoice_id"), f"WITH {O.CONSENSUS} SELECT invoice_id FROM consensus WHERE fields_with_consensus <> 4")
    _put("agg_consistency", lambda s, d: evaluation.consistency(run(s, d)), f"WITH {O.RUNS}, {O.CONSISTENCY} SELECT * FROM consistent")


def _graphs() -> None:
    run = derived.runs
    _put("graph_edges", lambda s, d: graph.extracted_edges(run(s, d)).select("invoice_no", "model", "field", "value"), f"WITH {O.RUNS}, {O.EDGES} SELECT invoice_id AS invoice_no, model_name AS model, field, value FROM edges")
    _put("set_run_union", lambda s, d: graph.extracted_edges(run(s, d)).groupBy("invoice_no", "model").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "field", "value"))), "|").alias("vals")), f"WITH {O.RUNS}, {O.EDGES} SELECT invoice_id AS invoice_no, model_name AS model, string_agg(field || ':' || value, '|' ORDER BY field || ':' || value) AS vals FROM edges GROUP BY 1, 2")
    _put("graph_gt_edges", lambda s, d: graph.truth_edges(_truth(s, d)).select("invoice_no", "field", "value"), f"WITH {O.TRUTH} SELECT invoice_no, field, value FROM truth")

    def reseeded(s, d):
        edges = graph.truth_edges(_truth(s, d))
        return graph.reseeded(edges, edges.filter("field = 'DATE'")).select("invoice_no", "field", "value")

    _put("graph_reseed", reseeded, f"WITH {O.TRUTH} SELECT invoice_no, field, value FROM truth t WHERE field = 'DATE' OR NOT EXISTS (SELECT 1 FROM truth u WHERE u.invoice_no = t.invoice_no AND u.field = 'DATE')")

    def csv(s, d):
        lines = derived.samples(s, d).select(F.concat_ws(",", F.concat(F.lit(" d"), "k"), F.coalesce("date_text", F.lit("")), F.replace(F.coalesce("amount_text", F.lit("")), F.lit(","), F.lit("")), F.lit("Acme ")).alias("value"))
        return graph.csv_edges(objects.truth_lines(lines)).select("invoice_no", "field", "value")

    _put("graph_csv_gt", csv, f"WITH {O.SAMPLES}, l AS (SELECT 'd' || k AS invoice_no, {O.tr('COALESCE(date_text, {0})'.format(chr(39) * 2))} AS d, {O.tr('replace(COALESCE(amount_text, {0}), {1}, {0})'.format(chr(39) * 2, chr(39) + ',' + chr(39)))} AS a FROM s) SELECT invoice_no, 'DATE' AS field, d AS value FROM l WHERE d <> '' UNION SELECT invoice_no, 'AMOUNT', a FROM l WHERE a <> '' UNION SELECT invoice_no, 'COMPANY', 'Acme' FROM l")
    _put("graph_answerability", lambda s, d: graph.answerable(graph.extracted_edges(run(s, d))), f"WITH {O.RUNS}, {O.EDGES} SELECT invoice_id AS invoice_no, model_name AS model, (MAX(CASE WHEN field = 'COMPANY' THEN 1 ELSE 0 END) + MAX(CASE WHEN field = 'AMOUNT' THEN 1 ELSE 0 END) + 1) / 3.0::DOUBLE AS answerability FROM edges GROUP BY 1, 2")
    _put("graph_idempotent", lambda s, d: graph.stable(graph.extracted_edges(run(s, d))), f"WITH {O.RUNS}, {O.EDGES} SELECT invoice_id AS invoice_no, model_name AS model, MIN(CASE WHEN {O.tr('value')} = '' OR EXISTS (SELECT 1 FROM edges f WHERE f.invoice_id = e.invoice_id AND f.model_name = e.model_name AND f.field = e.field AND f.value = {O.tr('e.value')}) THEN 1 ELSE 0 END) = 1 AS stable FROM edges e GROUP BY 1, 2")
    _put("eval_metrics", lambda s, d: evaluation.model_metrics(run(s, d), _truth(s, d)), f"WITH {O.METRICS} SELECT * FROM metrics")
    _put("eval_bundle", lambda s, d: evaluation.bundle(run(s, d), _truth(s, d)), f"WITH {O.BUNDLE} SELECT * FROM bundle")

    def rows_of_export(s, d):
        """Results stamped by run, and of the second runs an earlier and a later one within the second."""
        given = [[("2024-01-02 03:04:05", None)], [("2024-01-02 03:04:05.25", None), ("2024-01-02 03:04:05.249999", -2.0), ("2024-01-02 03:04:05.250001", -1.0)], [("2024-01-02 03:04:00", None)]]
        first, second, other = (F.array(*[F.struct(F.lit(t).cast("timestamp_ntz").alias("created_at"), F.lit(x).cast("double").alias("score")) for t, x in stamps]) for stamps in given)
        rows = evaluation.bundle(run(s, d), _truth(s, d)).withColumn("x", F.explode(F.when(F.col("run_number") == 1, first).when(F.col("run_number") == 2, second).otherwise(other)))
        return tables.export_rows(rows.withColumns({"created_at": F.col("x.created_at"), "date_f1": F.coalesce("x.score", "date_f1")}))

    _put("prj_export_rows", rows_of_export, f"WITH {O.BUNDLE} SELECT * REPLACE (CASE WHEN run_number = 2 THEN -1.0::DOUBLE ELSE date_f1 END AS date_f1), CASE run_number WHEN 1 THEN '2024-01-02T03:04:05' WHEN 2 THEN '2024-01-02T03:04:05.250001' ELSE '2024-01-02T03:04' END AS created_at, concat_ws('_', invoice_id, model_name, run_number) AS insert_id FROM bundle")
    def kept_up(s, d):
        """Scores over states that were built from the first, then the other runs, and merged."""
        runs = run(s, d)
        parts = [evaluation.run_states(runs.filter(f"run_number {test} 1")) for test in ("=", ">")]
        return evaluation.bundle_of(evaluation.summary_of(evaluation.merged(parts[0].unionByName(parts[1]))), _truth(s, d))

    _put("eval_kept_up", kept_up, f"WITH {O.BUNDLE} SELECT * FROM bundle")
    _put("graph_run_nodes", lambda s, d: graph.run_nodes(run(s, d)), f"WITH {O.RUNS} SELECT invoice_id AS invoice_no, model_name AS model, run_number AS run_no FROM runs WHERE status = 'COMPLETED' AND extracted_json IS NOT NULL")


def _boxes() -> None:
    def found(s, d):
        return derived.detections(s, d).select("doc_id", detections.detections(F.col("body")).alias("found"))

    columns = ["text", "confidence", "x_min", "y_min", "x_max", "y_max"]
    _put("src_detections", lambda s, d: found(s, d).select("doc_id", F.explode("found").alias("d")).select("doc_id", *[f"d.{c}" for c in columns]), f"WITH {O.DETECTIONS} SELECT doc_id, {', '.join(columns)} FROM det")
    _put("sort_reading_order", lambda s, d: found(s, d).select("doc_id", F.array_join(F.transform(detections.reading_order(F.col("found")), lambda x: x["text"]), "|").alias("texts")), f"WITH {O.DETECTIONS} SELECT doc_id, string_agg(text, '|' ORDER BY y_min, x_min, k) AS texts FROM det GROUP BY 1")
    _put("join_amount_column", lambda s, d: found(s, d).select("doc_id", F.explode(detections.in_amount_column(detections.reading_order(F.col("found")))).alias("d")).select("doc_id", "d.text"), f"WITH {O.DETECTIONS}, h AS (SELECT * FROM det WHERE text = 'Amount') SELECT d.doc_id, d.text FROM det d JOIN h USING (doc_id) WHERE d.x_min >= h.x_min - 0.02 AND d.x_max <= h.x_max + 0.02 + 0.05 AND d.y_min > h.y_min AND regexp_matches(d.text, '^\\d{{1,3}}(,\\d{{3}})*\\.\\d{{2}}$')")

    def entities(s, d):
        out = detections.entities(found(s, d))
        return out.select("doc_id", "invoice_no", *[F.array_join(c, "|").alias(c) for c in ("dates", "amounts", "companies")])

    _put("detection_entities", entities, f"""WITH {O.DETECTIONS}, sure AS (SELECT * FROM det WHERE confidence >= 0.65), h AS (SELECT * FROM sure WHERE text = 'Amount'),
c AS (SELECT d.doc_id, first(d.text ORDER BY d.y_min, d.x_min, d.k) AS t, MIN((d.y_min, d.x_min, d.k)) AS place FROM sure d JOIN h USING (doc_id) WHERE d.x_min >= h.x_min - 0.02 AND d.x_max <= h.x_max + 0.02 + 0.05 AND d.y_min > h.y_min AND regexp_matches(d.text, '^\\d{{1,3}}\\.\\d{{2}}$') GROUP BY d.doc_id, d.text)
SELECT b.doc_id, 'C' || b.doc_id AS invoice_no, concat_ws('|', CASE WHEN doc_id % 4 <> 0 THEN '2024-0' || (1 + doc_id % 8) || '-0' || (1 + doc_id % 9) END, CASE WHEN doc_id % 5 = 0 THEN '2024-03-15' END) AS dates,
  concat_ws('|', (100 + doc_id % 900) || '.75', CASE WHEN doc_id % 7 <> 0 THEN '4.00' END, (SELECT string_agg(t, '|' ORDER BY place) FROM c WHERE c.doc_id = b.doc_id)) AS amounts,
  concat_ws('|', CASE WHEN doc_id % 6 = 0 THEN 'no box' END, CASE WHEN doc_id % 3 = 0 THEN 'Acme ' || (doc_id % 97) END) AS companies FROM body b""")

    def letters(s, d):
        out = extraction.pattern_entities(derived.letters(s, d).select(F.col("k").alias("doc_id"), "text"))
        return out.select("doc_id", "invoice_no", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("dates", "amounts", "companies")])

    _put("pattern_entities", letters, O.PATTERN_ENTITIES)
    _put("set_amount_union", lambda s, d: derived.invoices(s, d).select("k", F.array_join(F.array_sort(F.array_union(T.amounts_labelled(F.col("raw_text")), T.amounts_in_table(F.col("raw_text")))), "|").alias("amounts")), "WITH " + O.INVOICE + f", e AS (SELECT k, unnest(regexp_extract_all(raw_text, '{T.AMOUNT_LABELLED}', 1) || regexp_extract_all(raw_text, '{T.AMOUNT_IN_TABLE}', 1)) AS v FROM invoice) SELECT i.k, CASE WHEN raw_text IS NOT NULL THEN COALESCE((SELECT string_agg(DISTINCT {O.amount('v')}, '|' ORDER BY {O.amount('v')}) FROM e WHERE e.k = i.k), '') END AS amounts FROM invoice i")
    _put("set_except_dates", lambda s, d: derived.samples(s, d).select("k", F.array_join(F.array_except(F.array_compact(F.array("date_text", "amount_text", "name_text")), F.coalesce(T.dates_in(F.col("date_text")), F.array().cast("array<string>"))), "|").alias("rest")), "WITH " + O.SAMPLES + f" SELECT k, concat_ws('|', CASE WHEN NOT list_contains(list_transform(regexp_extract_all(COALESCE(date_text, ''), '{T.DATE_IN_TEXT}'), lambda v: {O.date_observed('v')}), date_text) THEN date_text END, amount_text, name_text) AS rest FROM s")


for _build in (_texts, _fields, _state, _votes, _graphs, _boxes):
    _build()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _REGISTRY.items() if s}
