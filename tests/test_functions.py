"""Single values with known results."""

import datetime
import json
import re
import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from paperlane.functions import jsons as J, places, text as T
from paperlane.operators import calls, consensus, detections, evaluation, extraction, graph, tables


def value(spark, body, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{k} string" for k in range(len(args))))
    return row.select(body(*[F.col(f"c{k}") for k in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize("given, wanted", [("12.03.2024", "2024-03-12"), ("45.13.2024", "2025-02-14"), ("15/03/2024", "15/03/2024"), ("2024-03-12", "2024-03-12"), (" ", None), (None, None)])
def test_date_observed(spark, given, wanted):
    assert value(spark, T.date_observed, given) == wanted


@pytest.mark.parametrize("given, wanted", [("31.04.2024", "2024-04-30"), ("02/30/2024", "2024-02-29"), ("03/04/2024", "2024-04-03"), ("3.4.2024", "3.4.2024"), ("13.13.2024", "13.13.2024"), ("", None)])
def test_date_consensus(spark, given, wanted):
    assert value(spark, T.date_consensus, given) == wanted


@pytest.mark.parametrize("given, wanted", [("$12.5", "12.50"), ("USD 1,250", "1250.00"), ("12.345", "12.345"), ("0", None), ("-3", None), ("abc", None)])
def test_amount(spark, given, wanted):
    assert value(spark, T.amount, given) == wanted


@pytest.mark.parametrize("given, wanted", [("12.345", "12.35"), ("1,250", "1250.00"), ("$5", "$5"), ("1e3", "1000.00"), ("-1.005", "-1.01"), (" ", None), ("1.00499999999999999999", "1.00"), ("123456789012345678901.5", "123456789012345678901.50"), ("-0.001", "0.00"), ("12e-4", "0.00"), ("5e-3", "0.01"), ("49999e-7", "0.00"), (".5E1", "5.00"), ("7.", "7.00"), (".", "."), ("1e+2", "100.00"), ("+3", "3.00"), ("9" * 40, "9" * 40)])
def test_amount_consensus(spark, given, wanted):
    assert value(spark, T.amount_consensus, given) == wanted


@pytest.mark.parametrize("given, wanted", [("Qty 5 x 0 INV-123 1234.56", "Qty 5.00 x 0 INV-123.00 1234.56.00"), ("2024-03-15", "2024-03.00-15.00"), ("15.03.2024", "15.03.2024"), (" a \t b\nc ", "a b\nc")])
def test_text_normalised(spark, given, wanted):
    assert value(spark, T.text_normalised, given) == wanted


def test_small_text_functions(spark):
    assert value(spark, lambda c: T.title_case(T.company_key(c)), "acme  o'neil-smith LLC") == "Acme O'neil-smith Llc"
    assert value(spark, lambda c: F.regexp_extract(c, T.AMOUNT_VALUE, 0), "1234.56") == "234.56"
    assert value(spark, T.without_fence, '```json\n{"a":1}\n```\n') == '{"a":1}'
    assert value(spark, T.invoice_no_in, "Invoice note") == "te"
    assert value(spark, T.dates_in, "99.12.2024 and 2024-01-05x") == ["9.12.2024", "2024-01-05"] or value(spark, T.dates_in, "99.12.2024")[0] == "2024-12-09"
    assert value(spark, T.amounts_labelled, "Total due: $1,234.50\nVAT 7.25") == ["1234.50", "7.25"]
    assert [r.v for r in spark.range(2, 6).select(T.majority(F.col("id")).alias("v")).collect()] == [2, 2, 3, 3]


def payload(parts, why="STOP", **usage):
    return {"candidates": [{"finishReason": why, "content": {"parts": parts}}]} | ({"usageMetadata": usage} if usage else {})


def test_responses(spark):
    one = payload([{"text": '{"n":1}'}, {"thought": True, "text": "let me see"}, {"text": '{"n":2}'}, {"text": " \n"}, {"thought": True, "text": "done"}])
    assert value(spark, J.last_part, json.dumps(one)) == '{"n":2}'
    assert value(spark, J.last_part, json.dumps(payload([{"thought": True, "text": "only thoughts"}]))) is None
    assert value(spark, J.last_part, json.dumps(payload([{"text": "kept back"}], "RECITATION"))) is None
    cut = '{"AMOUNT":["7.10","8.20"],"COMPANY":["Nordwind"],"DATE":["20'
    assert value(spark, J.last_part, json.dumps(payload([{"text": cut}], "MAX_TOKENS"))) == '{"AMOUNT":["7.10","8.20"],"COMPANY":["Nordwind"]}'
    assert value(spark, J.last_part, json.dumps(payload([{"text": '{"n":3}'}], "MAX_TOKENS"))) == '{"n":3}' and value(spark, J.last_part, json.dumps(payload([{"text": "no json"}], "MAX_TOKENS"))) is None
    chunks = [payload([{"text": '{"a":'}, {"thought": True, "text": "?"}], None, totalTokenCount=8), payload([{"text": "[1,"}], None, candidatesTokenCount=3), payload([{"text": "2]}"}], "STOP")]
    assert value(spark, J.stream_text, json.dumps(chunks)) == '{"a":[1,2]}' and value(spark, J.stream_tokens, json.dumps(chunks)) == 3
    assert value(spark, J.stream_text, json.dumps([payload([{"text": '{"a":[5],"b":"c'}], "MAX_TOKENS")])) == '{"a":[5]}' and value(spark, J.stream_text, json.dumps([payload([{"text": "x"}], "SAFETY")])) is None
    assert value(spark, J.chat_text, json.dumps({"choices": [{"message": {"content": [{"text": "left "}, {"text": "right"}]}}]})) == "left right" and value(spark, J.chat_text, json.dumps({"choices": [{"message": {"content": "plain"}}]})) == "plain"
    events = 'data: {"choices":[{"delta":{"content":"up"}}],"usage":{"total_tokens":4}}\n: note\ndata: {"choices":[{"delta":{"content":"  "}}]}\ndata: {"choices":[{"message":{"content":"per"}}],"usage":{"total_tokens":0}}\ndata: [DONE]'
    assert value(spark, J.sse_text, events) == "upper" and value(spark, J.sse_tokens, events) == 4 and value(spark, J.sse_tokens, '{"usage":{"total_tokens":6}}') == 6
    assert value(spark, J.all_parts, json.dumps([payload([{"thought": True, "text": "a"}, {"text": "b"}])])) == "ab" and value(spark, J.all_parts, json.dumps(payload([{"text": "first"}, {"text": "second"}]))) == "first"


def test_requests(spark):
    body = lambda make: json.loads(value(spark, make, 'say "hi"'))
    said = {"role": "user", "content": 'say "hi"'}
    assert body(lambda c: J.chat_request(F.lit("m"), c, F.lit(0.3))) == {"model": "m", "messages": [said], "temperature": 0.3, "max_tokens": 1024}
    assert body(lambda c: J.chat_request(F.lit("m"), c, F.lit(0.0), 50, stream=True)) == {"model": "m", "messages": [said], "temperature": 0.0, "max_tokens": 50, "stream": True}
    assert body(lambda c: J.chat_request(F.lit("m"), c, F.lit(0.0), json_only=True))["response_format"] == {"type": "json_object"}
    parts = {"contents": [{"role": "user", "parts": [{"text": 'say "hi"'}]}], "generationConfig": {"temperature": 0.5, "maxOutputTokens": 1024, "responseMimeType": "application/json"}}
    assert body(lambda c: J.parts_request(c, F.lit(0.5))) == parts
    assert body(lambda c: J.parts_request(c, F.lit(0.5), thinking=0))["generationConfig"]["thinkingConfig"] == {"thinkingBudget": 0}
    url = value(spark, lambda c: J.image_request(T.data_url(c, F.lit("img").cast("binary"))), "x/Y.PNG")
    assert json.loads(url) == {"input": [{"type": "image_url", "url": "data:image/png;base64,aW1n"}]} and value(spark, lambda c: T.data_url(c, F.lit("img").cast("binary")), "a.jpg").startswith("data:image/jpeg;")
    assert value(spark, T.appended_error, None, "new") == "new" and value(spark, T.appended_error, " ", "new") == "new" and value(spark, T.appended_error, "old", "new") == "old | new"


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    return [r for r in J.with_fields(rows, "j").select("k", "ok", *[f(F.col(f"field_{x}")).alias(f"{n}_{x}") for n, f in (("set", J.set_of), ("raw", J.raw_of), ("text", J.text_of), ("array", J.array_of)) for x in J.ALL]).orderBy("k").collect()]


def test_json_fields(spark):
    one, bad, twice, more, empty = parsed(spark, '{"DATE":"a","AMOUNT":[null," x ",1.5,"x"],"COMPANY":null}', "{not", '{"DATE":"x","DATE":["y"]}', '{"DATE":["a"],"INVOICE_NO":"b"} x', '{"DATE":[],"AMOUNT":[null]}')
    assert one.set_DATE == ["a"] and one.set_AMOUNT == ["x", "1.5"] and one.set_COMPANY == [] and one.array_DATE is None and one.text_DATE == "a"
    assert one.raw_AMOUNT == ["", " x ", "1.5", "x"] and one.raw_COMPANY == [""] and one.raw_INVOICE_NO == []
    assert twice.ok and twice.set_DATE == ["y"]  # of repeated keys the last
    for r in (bad, more):
        assert not r.ok and r.set_DATE == r.raw_DATE == [] and r.text_INVOICE_NO is None and r.array_DATE is None
    assert empty.array_DATE == [] and empty.array_AMOUNT == [""] and empty.raw_DATE == []
    assert value(spark, lambda c: J.contract(F.lit(None).cast("string"), F.array(c), F.array(c), F.array(c)), "v") == '{"INVOICE_NO":null,"DATE":["v"],"AMOUNT":["v"],"COMPANY":["v"]}'


def test_json_numbers_and_containers(spark):
    numbers = '[1250.00,7.0,1e7,12,-0.5,100000000.5,0.1e-3,9223372036854775807,12345678901234567890,true,{"a":1},[2.0],"2.0"]'
    r, scalars, boxes = parsed(spark, f'{{"AMOUNT":{numbers}}}', '{"AMOUNT":7.0,"DATE":12,"INVOICE_NO":1e7,"COMPANY":false}', '{"AMOUNT":{"a":1},"DATE":[[1],[2]],"INVOICE_NO":[1],"COMPANY":[1.0,2]}')
    assert r.array_AMOUNT == ["1250.0", "7.0", "1.0E7", "12", "-0.5", "1.000000005E8", "1.0E-4", "9223372036854775807", "12345678901234567890", "true", "2.0"] and r.set_AMOUNT == r.array_AMOUNT
    assert (scalars.set_AMOUNT, scalars.raw_DATE, scalars.text_INVOICE_NO, scalars.text_COMPANY) == (["7.0"], ["12"], "1.0E7", "false")
    assert boxes.set_AMOUNT == boxes.raw_AMOUNT == boxes.set_DATE == [] and boxes.array_AMOUNT is None and boxes.array_DATE == [] and boxes.text_INVOICE_NO is None and boxes.set_COMPANY == ["1.0", "2"]


def test_json_is_whole(spark):
    good = ['{"a":1}', ' [1, {"b":[]}]\n', '"s"', "12", "null", '{"a":1,"a":2}', '{"a":"x\\",\\"y"}', '{"a":"NaN"}', '\n{"DATE":["Infinity"]} ', '{"X":{"a":1,"a":2}}']
    bad = ['{"a":1} x', '{"a":1} x}', '{"a":1}{"b":2}', "[1] [2]", "1 2", "1,2", "12 abc", "", " ", "1],[2", '{"a":NaN}', '{"DATE":[NaN]}', "{'a':1}", '{"a":1', '1,"c"', '{"a":1},{"b":2}', '{"DATE":[01]}', '{"DATE":["a",]}', '{"DATE":tru}', '{"DATE":["\\x"]}', '{"DATE":[.5]}', None]
    assert [r.ok for r in parsed(spark, *good, *bad)] == [True] * len(good) + [False] * len(bad)
    rows = spark.createDataFrame([(x,) for x in good + bad], "j string").select(J.valid(F.col("j")).alias("v")).collect()
    assert [r.v for r in rows] == [True] * len(good) + [False] * len(bad)


def test_json_is_parsed_once(spark):
    runs = spark.createDataFrame([], "invoice_id string, model_name string, run_number int, extracted_json string, status string")
    for rows in (graph.extracted_edges(runs), evaluation.summary(runs), consensus.ballots(consensus.first_runs(runs))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StructField(INVOICE_NO,VariantType") == 1, plan


def box(text, confidence, x0, y0, x1, y1):
    return (text, confidence, x0, y0, x1, y1)


def test_detection_entities(spark):
    rows = [
        box("From: Nordwind Handel", 0.88, 0.55, 0.05, 0.9, 0.07), box("INVOICE NO. ## kx-7", 0.70, 0.05, 0.02, 0.3, 0.04), box("Invoice number: late-1", 0.99, 0.05, 0.9, 0.3, 0.92),
        box("Due date: pay by 07.11.2023 please", 0.71, 0.1, 0.3, 0.4, 0.33), box("Issue date: 01.01.2021", 0.69, 0.1, 0.35, 0.4, 0.38), box("9.8.2023", 0.95, 0.1, 0.4, 0.2, 0.42),
        box("total", 0.9, 0.6, 0.5, 0.7, 0.52), box("310.40", 0.9, 0.59, 0.6, 0.76, 0.62), box("88.00", 0.9, 0.3, 0.6, 0.4, 0.62), box("19.99", 0.9, 0.6, 0.4, 0.7, 0.42), box("5.10", 0.64, 0.6, 0.7, 0.7, 0.72),
        box("Amount due: EUR 2,040.00", 0.9, 0.1, 0.7, 0.5, 0.73), box("Subtotal: 3.00 units", 0.9, 0.1, 0.75, 0.5, 0.78), box("Total amount: none", 0.9, 0.1, 0.8, 0.5, 0.83), box("Vendor: 4 Elm Street", 0.9, 0.1, 0.85, 0.5, 0.88), box("Supplier: Nordwind   Handel", 0.9, 0.1, 0.95, 0.5, 0.98),
    ]
    schema = f"doc_id long, found {detections.FOUND}"
    out = {r.doc_id: r for r in detections.entities(spark.createDataFrame([(1, rows), (2, []), (3, None)], schema)).collect()}
    assert out[1][1:] == ("KX-7", ["2023-11-07", "2023-08-09"], ["2040.00", "310.40"], ["Nordwind Handel"])
    assert out[2][1:] == (None, [], [], []) == out[3][1:]


def test_pattern_entities(spark):
    text = "Invoice No: A-17\nDate 05.01.2024\nQty 3.00 ea\nTotal: 3.00\nAccount number 12,345.67\nTotal 1,250.00\nVendor: Acme Corp\n"
    out = extraction.pattern_entities(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    one, none = sorted(out, key=lambda r: r.doc_id)
    assert one.invoice_no == "A-17" and one.dates == ["2024-01-05"] and "1250.00" in one.amounts and "12345.67" not in one.amounts and none.amounts == [] and none.invoice_no is None


def stand(spark, *cases):
    rows = spark.createDataFrame([(k, t, a) for k, (t, a) in enumerate(cases)], "k int, text string, amounts array<string>")
    return [r.amounts for r in extraction.standing_amounts(rows).orderBy("k").collect()]


def test_amounts_stand_by_what_is_around_them(spark):
    kept, gone = [], []
    kept += [("qty 5.00\npaid 5.00", ["5.00", "9.00"]), ("qty 13.00", ["13.00"]), ("update 12.25", ["12.25"]), ("due date 31.13", ["31.13"]), ("account no" + " " * 40 + "1,200.00", ["1200.00"]), ("", ["1.00"]), ("none", [])]
    gone += [("qty 5.00", ["5.00"]), ("InvoiceDate 12.25", ["12.25"]), ("duedate: 12.25", ["12.25"]), ("dated 12.25", ["12.25"]), ("account no. 1,200.00", ["1200.00"]), ("x" * 600 + "\n" + "é" * 505 + " qty 5.00 \n", ["5.00"])]
    # at the edges of blocks and windows: the word is cut where the window ends
    for pad in range(500, 516):
        gone += [("\n" * pad + "date 12.25", ["12.25"]), ("y" * pad + " 😀 date" + " " * 75 + "12.25", ["12.25"])]
        kept += [("y" * pad + " date" + " " * 81 + "12.25", ["12.25"])]
    assert stand(spark, *kept) == [a for _, a in kept] and stand(spark, *gone) == [[] for _ in gone]


def test_places(spark):
    text = "a1.00\n\nb😀 22.50,3.00\n" + "x" * 2_000 + "1,234.00" + "\ny 9.99" * 300
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(places.matches(F.col("t"), extraction.AMOUNT_TOKEN).alias("m"), F.transform(places.matches(F.col("t"), extraction.AMOUNT_TOKEN), lambda m: places.between(places.blocks(F.col("t")), m["s"] - 700, m["e"] + 3)).alias("c")).collect()
    want = [(m.start(), m.end(), m[0], text.count("\n", 0, m.start())) for m in re.finditer(extraction.AMOUNT_TOKEN, text)]
    assert [tuple(m) for m in got[0].m] == want and len(want) == 304
    assert got[0].c == [text[max(0, s - 700) : e + 3] for s, e, *_ in want] and got[1].m == [] and not got[2].m


def test_patterns_need_no_python(spark):
    plan = extraction.pattern_entities(spark.createDataFrame([], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_outcomes(spark):
    """FAILED with the error; PARSE_FAILED with the body for no reply, a blank one, or no JSON; COMPLETED for any JSON."""
    cases = [
        (None, None, "refused", "FAILED", None, "refused"), (None, "{body}", None, "PARSE_FAILED", None, "{body}"), (" \n", "b" * 900, None, "PARSE_FAILED", None, "b" * 900), ("no json", "whole", None, "PARSE_FAILED", None, "whole"),
        ("```json\n{}\n```", "x", None, "COMPLETED", "{}", None), ("```\n[1]```", "x", None, "COMPLETED", "[1]", None), ("[1,2]", "x", None, "COMPLETED", "[1,2]", None), ("12", "x", None, "COMPLETED", "12", None), (" {} ", "x", None, "COMPLETED", " {} ", None),
        ("\n ```json\n{}```", "raw", None, "PARSE_FAILED", None, "raw"), ("{} and more", "raw", None, "PARSE_FAILED", None, "raw"), ("``````", "raw", None, "PARSE_FAILED", None, "raw"),
    ]
    rows = [(str(k), "m", 1, reply, body, 5, error, 7) for k, (reply, body, error, *_) in enumerate(cases)]
    out = extraction.finished(spark.createDataFrame(rows, "invoice_id string, model_name string, run_number int, reply string, body string, token_count int, error_message string, latency_ms int")).collect()
    got = {int(r.invoice_id): (r.status, r.extracted_json, r.error_message) for r in out}
    assert [got[k] for k in range(len(cases))] == [c[3:] for c in cases]
    assert all((r.token_count == 5) == (r.status == "COMPLETED") for r in out)


def test_stamps_are_printed_as_iso(spark):
    stamps = ["2024-05-02 06:07:08", "2024-05-02 06:07:08.25", "2024-05-02 06:07:08.250001", "2024-05-02 06:07:00", "2024-05-02 06:07:00.001", None]
    got = spark.createDataFrame([(s,) for s in stamps], "s string").select(T.iso_stamp(F.col("s").cast("timestamp_ntz")).alias("v")).collect()
    assert [r.v for r in got] == ["2024-05-02T06:07:08", "2024-05-02T06:07:08.250", "2024-05-02T06:07:08.250001", "2024-05-02T06:07", "2024-05-02T06:07:00.001", None]


class Gauge:
    """How many calls were open at a time, at most."""

    def __init__(self, seconds):
        self.lock, self.open, self.most, self.seconds = threading.Lock(), 0, 0, seconds

    def call(self, out):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(self.seconds)
        with self.lock:
            self.open -= 1
        return out


def test_calls_run_together_in_order():
    """Sixteen at a time end at least eight times sooner, are never more than that, and keep their order; another kind has a limit of its own."""
    wide, narrow = Gauge(0.2), Gauge(0.05)
    jobs = [("narrow", partial(narrow.call, k)) if k % 9 == 0 else ("wide", partial(wide.call, k)) for k in range(72)]
    start = time.monotonic()
    assert list(calls.in_order(jobs, {"wide": 16, "narrow": 2})) == list(range(72))
    assert time.monotonic() - start < 64 * 0.2 / 8 and 8 < wide.most <= 16 and narrow.most <= 2


def test_calls_are_taken_ahead_only_so_far():
    taken = []

    def jobs():
        for k in range(1000):
            taken.append(k)
            yield "m", lambda k=k: k

    got = calls.in_order(jobs(), {"m": 3})
    assert next(got) == 0 and len(taken) <= 3 * calls.AHEAD + 1
    got.close()
    with pytest.raises(ZeroDivisionError):
        list(calls.in_order([("m", lambda: 1 / 0)], {"m": 1}))


def test_models_are_called_together(spark):
    """Twenty calls of 0.3 s in one task, eight at a time; one failure stays one row."""

    def slow(text, heat):
        time.sleep(0.3)
        if text == "bad7":
            raise ValueError("odd")
        return json.dumps({"DATE": [text]}), 1, "body of " + text

    rows = [(f"i{k}", None, "bad7" if k == 7 else f"t{k}", "m", False, 1, 0.0, None) for k in range(20)]
    work = spark.createDataFrame(rows, "invoice_id string, path string, input_text string, model_name string, reads_path boolean, run_number int, temperature double, status string").coalesce(1)
    out = extraction.extracted(work, [extraction.Model("m", 1, slow, at_once=8)])
    out.limit(1).collect()
    start = time.monotonic()
    got = out.collect()
    assert time.monotonic() - start < 20 * 0.3 / 2 and [r.invoice_id for r in got] == [f"i{k}" for k in range(20)]
    assert [(r.invoice_id, r.error_message) for r in got if r.status != "COMPLETED"] == [("i7", "odd")] and json.loads(got[3].extracted_json) == {"DATE": ["t3"]}


def test_calls_are_tried_again_by_kind():
    def failing(*errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "ok", 1

        return call

    waits = []
    go = lambda *errors: calls.called(failing(*errors), pause=waits.append)
    ended = (None, "LLM API call failed after 3 attempts")
    assert go() == (("ok", 1), None) and go(calls.Refused("400")) == ended and go(ValueError("odd")) == (None, "odd") and waits == []
    assert go(calls.Unavailable(), calls.Unavailable()) == (("ok", 1), None) and waits == []
    assert go(OSError(), OSError()) == (("ok", 1), None) and waits == [2.0, 2.0]
    assert go(*[OSError()] * 3) == go(*[calls.Unavailable()] * 3) == ended and waits == [2.0] * 4


def test_upsert_keeps_one_row_a_key(spark):
    schema = "k string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], schema), spark.createDataFrame([("b", 2), ("b", 3), ("c", None), ("c", None)], schema)
    assert sorted(map(tuple, tables.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", None)]


def test_truth_key_and_edges(spark):
    truth = spark.createDataFrame([("d2", "\t K77 ", " 3.10.2022 ,soon", "€9.5, about 3 ,0", " Blau  & Rot,GmbH "), ("d3", "\n", None, "", ""), ("d1", "K77", "4.4.2004", "", "")], "invoice_id string, consensus_invoice_no string, consensus_dates string, consensus_amounts string, consensus_companies string")
    assert {r.invoice_id: r.invoice_no for r in graph.truth_key(truth).collect()} == {"d2": "K77", "d3": "d3", "d1": "K77"}
    edges = {(r.invoice_no, r.field, r.value) for r in graph.truth_edges(truth).collect()}  # the last seed of a number wins
    assert edges == {("K77", "DATE", "2022-10-03"), ("K77", "DATE", "soon"), ("K77", "AMOUNT", "9.50"), ("K77", "AMOUNT", "about 3"), ("K77", "AMOUNT", "0"), ("K77", "COMPANY", "Blau & Rot"), ("K77", "COMPANY", "GmbH")}


def test_scores(spark):
    row = spark.createDataFrame([(1, 2, 3), (0, 0, 0), (0, 0, 1), (0, 1, 0)], "h int, g int, x int").select(evaluation.accuracy(F.col("h"), F.col("g"), F.col("x")), evaluation.f1(F.col("h"), F.col("g"), F.col("x"))).collect()
    assert [tuple(r) for r in row] == [(0.5, 0.4), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_consistency(spark):
    j = '{"INVOICE_NO":"a","DATE":["%s"],"AMOUNT":["1"],"COMPANY":[]}'
    rows = [("i", "m", r, j % (r == 3), "COMPLETED") for r in (1, 2, 3)] + [("i", "n", r, j % 1, "COMPLETED") for r in (1, 2)] + [("i", "o", r, '{"INVOICE_NO":null}' if r == 1 else "{}", "COMPLETED") for r in (1, 2, 3)]
    got = {r.model_name: r.consistency for r in evaluation.consistency(spark.createDataFrame(rows, "invoice_id string, model_name string, run_number int, extracted_json string, status string")).collect()}
    assert got == {"m": 0.75, "n": 0.0, "o": 0.75}


def test_consensus_needs_two_models(spark):
    rows = [("i", "A", 1, '{"INVOICE_NO":" x1 "}', "completed"), ("i", " a", 1, '{"INVOICE_NO":"zz"}', "COMPLETED"), ("j", "A", 1, '{"INVOICE_NO":"x"}', "COMPLETED"), ("j", "B", 1, '{"INVOICE_NO":"X"}', "COMPLETED"), ("k", "A", 1, "{}", "COMPLETED"), ("k", "B", 1, None, "COMPLETED")]
    got = consensus.consensus(spark.createDataFrame(rows, "invoice_id string, model_name string, run_number int, extracted_json string, status string")).collect()
    assert [(r.invoice_id, r.consensus_invoice_no, r.consensus_dates, r.fields_with_consensus) for r in got] == [("j", "X", "", 1)]


def test_export(spark, tmp_path):
    row = lambda run, score, when: ("i", "m", run, *[score] * 9, True, 0.5, when)
    at = lambda micro: datetime.datetime(2024, 5, 1, 6, 7, 8, micro)
    rows = spark.createDataFrame([row(1, 0.1, at(7)), row(1, 0.2, at(500_000)), row(1, 0.4, at(499_999)), row(2, 0.3, None)], tables.RESULTS)
    out, rows = f"{tmp_path}/out", tables.export_rows(rows)
    assert tables.exported(rows, out, "v1") == 2 and tables.exported(rows, out, "v1") == 2 and tables.exported(rows.filter("run_number = 2"), out, "v2") == 1
    got = spark.read.parquet(out).filter("batch = 'v1'").orderBy("run_number").collect()
    assert [(r.insert_id, r.date_f1, r.created_at) for r in got] == [("i_m_1", 0.2, "2024-05-01T06:07:08.500"), ("i_m_2", 0.3, None)] and len(got[0]) == 15 + 2
