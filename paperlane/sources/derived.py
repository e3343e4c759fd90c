"""Tables of extraction runs derived from the provided tables, in SQL that Spark and DuckDB both read.

One document per order; five models (two names share a key) and three runs each. A number of
order, model and run decides what a run's output looks like: complete, a field missing, a scalar
for an array, other date and amount forms, unquoted numbers, containers among the values, text behind
the JSON, blanks and repeats, nulls, failures.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(o_orderkey AS STRING)"
_Y, _M, _D = ("CAST(year(o_orderdate) AS STRING)", *(f"lpad(CAST({f}(o_orderdate) AS STRING), 2, '0')" for f in ("month", "day")))
_ISO, _DOT = f"{_Y} || '-' || {_M} || '-' || {_D}", f"{_D} || '.' || {_M} || '.' || {_Y}"
_AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_THOUSANDS = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') || '.50'"
_COMPANY = "'Acme ' || CAST(o_custkey % 97 AS STRING) || CASE WHEN o_custkey % 10 = 0 THEN ', Inc.' ELSE ' Trading' END"

INVOICE = f"""
SELECT o_orderkey AS k, 'inv_' || {_K} AS invoice_id, 'store://bucket/invoices/inv_' || {_K} || '.png' AS path,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Invoice Number: #inv-' || {_K} || chr(10) || 'Invoice Date: ' ||
    CASE o_orderkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN {_DOT} WHEN 2 THEN {_D} || '/' || {_M} || '/' || {_Y} ELSE {_D} || '-' || {_M} || '-' || {_Y} END
    || chr(10) || 'Vendor:   ' || {_COMPANY} || chr(10) || 'Qty 5 of 120 at 7.5' || chr(10) || 'Total:  $' || {_THOUSANDS} END AS raw_text,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '' ELSE 'text ' || {_K} END AS normalized_text,
  CASE WHEN o_orderkey % 13 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS ocr_status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'COMPLETED' END AS extraction_status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS evaluation_status
FROM orders"""

_TEXTS = f"{_ISO} AS iso, {_DOT} AS dot, {_AMOUNT} AS amount, {_THOUSANDS} AS thousands, {_COMPANY} AS company"
_EACH_RUN = f"""SELECT 'inv_' || {_K} AS invoice_id, mi, model_name, run_number, (o_orderkey * 31 + mi * 7 + run_number * 3) % 11 AS h, o_orderkey AS k, {_K} AS key_text,
      {_TEXTS}
    FROM orders CROSS JOIN (VALUES (1, 'Alpha Pro'), (2, 'alpha  pro '), (3, 'Beta'), (4, 'Gamma'), (5, 'Delta')) AS m(mi, model_name) CROSS JOIN (VALUES (1), (2), (3)) AS r(run_number)"""
#: The same rows for Spark: an order's texts are made once, not once a run, and ``h`` comes out of the generator, so filters on runs don't spell it out.
_EACH_RUN_ONCE = f"""SELECT invoice_id, r.mi, r.model_name, r.run_number, r.h, k, key_text, iso, dot, amount, thousands, company
    FROM (SELECT 'inv_' || {_K} AS invoice_id, o_orderkey AS k, {_K} AS key_text, {_TEXTS} FROM orders)
    LATERAL VIEW inline(flatten(transform(array((1, 'Alpha Pro'), (2, 'alpha  pro '), (3, 'Beta'), (4, 'Gamma'), (5, 'Delta')), m -> transform(array(1, 2, 3), n -> (m.col1, m.col2, n, (k * 31 + m.col1 * 7 + n * 3) % 11))))) r AS mi, model_name, run_number, h"""

RUNS = f"""
SELECT invoice_id, model_name, run_number, status, CASE WHEN status = 'FAILED' THEN NULL ELSE
  '{{' || CASE WHEN h = 7 THEN '"INVOICE_NO":null,' WHEN h = 9 THEN '' ELSE '"INVOICE_NO":" inv-' || key_text || CASE WHEN h = 5 THEN ' ' ELSE '' END || '",' END
  || CASE h WHEN 2 THEN '' WHEN 3 THEN '"DATE":"' || iso || '",' WHEN 6 THEN '"DATE":["' || dot || '","31.04.2024"],' WHEN 8 THEN '"DATE":["' || iso || '",""," ' || iso || '",null],' ELSE '"DATE":["' || iso || '"],' END
  || CASE CASE WHEN h = 6 THEN 100 + k % 5 ELSE h END WHEN 101 THEN '"AMOUNT":[' || amount || ',7.0,1e7,12,2.5e-4],' WHEN 102 THEN '"AMOUNT":[{{"a":1}},[2],"' || amount || '"],' WHEN 103 THEN '"AMOUNT":' || amount || ',' WHEN 4 THEN '"AMOUNT":["' || thousands || '"],' WHEN 9 THEN '"AMOUNT":["1.005","$5"],' WHEN 7 THEN '"AMOUNT":null,' ELSE '"AMOUNT":["' || amount || '"],' END
  || CASE h WHEN 5 THEN '"COMPANY":["' || upper(company) || '"]' WHEN 8 THEN '"COMPANY":["' || company || '","  ' || company || '"]' WHEN 10 THEN '"COMPANY":[]' ELSE '"COMPANY":["' || company || '"]' END || '}}' || CASE WHEN h = 6 AND k % 5 = 4 THEN ' and more' ELSE '' END END AS extracted_json
FROM (SELECT *, CASE WHEN h = 0 THEN 'FAILED' WHEN h = 1 AND mi = 3 THEN 'PARSE_FAILED' WHEN run_number = 1 AND h = 2 THEN 'completed' ELSE 'COMPLETED' END AS status
  FROM ({_EACH_RUN}) AS x) AS y"""

DETECTIONS = """
SELECT c_custkey AS doc_id, '{"data":[{"index":0,"text_detections":[' ||
  '{"text_prediction":{"text":"Invoice Number: #c' || CAST(c_custkey AS STRING) || '","confidence":0.9},"bounding_box":{"points":[{"x":0.1,"y":0.1},{"x":0.4,"y":0.1},{"x":0.4,"y":0.13}]}},' ||
  '{"text_prediction":{"text":"Amount","confidence":0.95},"bounding_box":{"points":[{"x":0.7,"y":0.2},{"x":0.8,"y":0.2},{"x":0.8,"y":0.23}]}},' ||
  '{"text_prediction":{"text":"' || CAST(c_custkey % 999 AS STRING) || '.50","confidence":0.' || CAST(6 + c_custkey % 4 AS STRING) || '1},"bounding_box":{"points":[{"x":0.71,"y":0.' || CAST(3 + c_custkey % 3 AS STRING) || '},{"x":0.79,"y":0.4},{"x":0.79,"y":0.45}]}},' ||
  '{"text_prediction":{"text":"12.25","confidence":0.9},"bounding_box":{"points":[{"x":0.7' || CAST(c_custkey % 5 AS STRING) || ',"y":0.' || CAST(1 + c_custkey % 5 AS STRING) || '},{"x":0.8,"y":0.4},{"x":0.8' || CAST(c_custkey % 9 AS STRING) || ',"y":0.45}]}},' ||
  '{"text_prediction":{"text":" ","confidence":0.9}}' || CASE WHEN c_custkey % 6 = 0 THEN ',{"text_prediction":{"text":"Vendor: no box","confidence":0.8}}' ELSE '' END ||
  ',{"text_prediction":{"text":"Invoice Date: 0' || CAST(1 + c_custkey % 9 AS STRING) || '.0' || CAST(1 + c_custkey % 8 AS STRING) || '.2024","confidence":' || CASE WHEN c_custkey % 4 = 0 THEN '0.68' ELSE '0.9' END || '},"bounding_box":{"points":[{"x":0.1,"y":0.8},{"x":0.4,"y":0.8},{"x":0.4,"y":0.83}]}}' ||
  CASE WHEN c_custkey % 5 = 0 THEN ',{"text_prediction":{"text":"2024-03-15","confidence":0.9},"bounding_box":{"points":[{"x":0.1,"y":0.85},{"x":0.4,"y":0.85},{"x":0.4,"y":0.87}]}}' ELSE '' END ||
  ',{"text_prediction":{"text":"Total: $' || CAST(100 + c_custkey % 900 AS STRING) || '.75","confidence":0.9},"bounding_box":{"points":[{"x":0.1,"y":0.9},{"x":0.4,"y":0.9},{"x":0.4,"y":0.92}]}}' ||
  ',{"text_prediction":{"text":"Subtotal: 4.00' || CASE WHEN c_custkey % 7 = 0 THEN ' pcs' ELSE '' END || '","confidence":0.9},"bounding_box":{"points":[{"x":0.1,"y":0.93},{"x":0.4,"y":0.93},{"x":0.4,"y":0.94}]}}' ||
  CASE WHEN c_custkey % 3 = 0 THEN ',{"text_prediction":{"text":"Vendor:  Acme ' || CAST(c_custkey % 97 AS STRING) || '","confidence":0.9},"bounding_box":{"points":[{"x":0.1,"y":0.95},{"x":0.4,"y":0.95},{"x":0.4,"y":0.97}]}}' ELSE '' END || ']}]}' AS body
FROM customer"""


SAMPLES = f"""
SELECT o_orderkey AS k,
  CASE o_orderkey % 22 WHEN 0 THEN ' $' || {_THOUSANDS} WHEN 1 THEN 'USD 12' WHEN 2 THEN {_AMOUNT} WHEN 3 THEN '0' WHEN 4 THEN '-3.10' WHEN 5 THEN 'abc' WHEN 6 THEN '12.345' WHEN 7 THEN '  '
    WHEN 8 THEN '7.5' WHEN 9 THEN 'eur 1,250' WHEN 10 THEN '1.005' WHEN 11 THEN '$5' WHEN 12 THEN {_THOUSANDS}
    WHEN 14 THEN '1.00499999999999999999' WHEN 15 THEN '123456789012345678901.5' WHEN 16 THEN '1.5e3' WHEN 17 THEN '-1.005' WHEN 18 THEN '25e-3' WHEN 19 THEN '.995' WHEN 20 THEN '12345.678e-2' WHEN 21 THEN '1.' ELSE NULL END AS amount_text,
  CASE o_orderkey % 13 WHEN 0 THEN {_ISO} WHEN 1 THEN {_DOT} WHEN 2 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 3 THEN {_M} || '/' || {_D} || '/' || {_Y} WHEN 4 THEN {_D} || '-' || {_M} || '-' || {_Y}
    WHEN 5 THEN '31.04.2024' WHEN 6 THEN '02/30/2024' WHEN 7 THEN '45.13.2024' WHEN 8 THEN ' 3.4.2024 ' WHEN 9 THEN '12.03.1950' WHEN 10 THEN 'soon' WHEN 11 THEN '' ELSE NULL END AS date_text,
  CASE o_orderkey % 9 WHEN 0 THEN 'Vendor:  Acme ' || {_K} WHEN 1 THEN ' INVOICE NO: #ab ' || {_K} WHEN 2 THEN 'acme o''neil-smith   llc' WHEN 3 THEN 'x' WHEN 4 THEN '12 Long Street ' || {_K} WHEN 5 THEN 'a, b,, ' || {_K} || ' ,'
    WHEN 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || ' ' ELSE '' END || '```json' || chr(10) || '{{"a":' || {_K} || '}}' || chr(10) || '```' WHEN 7 THEN ' ' || repeat('long ', 120) || {_K} ELSE NULL END AS name_text
FROM orders"""


LETTERS = f"""
SELECT o_orderkey AS k, 'Invoice No: A-' || {_K} || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'Date: ' || {_DOT} || repeat(' and more of this', 6) ELSE 'Sent ' || {_ISO} END || chr(10) ||
  CASE o_orderkey % 10 WHEN 0 THEN 'InvoiceDate total 12.25' WHEN 1 THEN 'duedate: tax 30.25' WHEN 2 THEN 'Total 7.25 pcs' WHEN 3 THEN 'total of account number 4,500.00' WHEN 4 THEN 'balance due, routing 31.00' WHEN 5 THEN 'Total: 31.12'
    WHEN 6 THEN 'tax 8.00' || chr(10) || 'ea' WHEN 7 THEN 'qty of tax 8.00' || chr(10) || 'total 8.00' WHEN 8 THEN 'dated update subtotal 40.00 and total 0.00' ELSE 'Total 11.99 then quantity 3' END
  || chr(10) || repeat('no words that matter here ', 5) || chr(10) || 'Grand total: $' || {_THOUSANDS} || chr(10) || 'item' || chr(9) || 'two   9,123.40' || chr(10) || 'Vendor: ' || {_COMPANY} || chr(10) || 'Seller: ' || CASE WHEN o_orderkey % 2 = 0 THEN '12 Long Road' ELSE 'B' END || chr(10) AS text
FROM orders"""


REPLIES = f"""
SELECT 'inv_' || {_K} AS invoice_id, 'Alpha' AS model_name, 1 AS run_number, 7 AS latency_ms, o_orderkey % 50 AS token_count,
  CASE o_orderkey % 11 WHEN 0 THEN '```json' || chr(10) || '{{"a":' || {_K} || '}}' || chr(10) || '```' WHEN 1 THEN '[1, ' || {_K} || ']' WHEN 2 THEN {_K} WHEN 3 THEN NULL WHEN 4 THEN '  ' || chr(10) WHEN 5 THEN 'no json'
    WHEN 6 THEN chr(10) || ' ```json' || chr(10) || '{{}}' || chr(10) || '```' WHEN 7 THEN NULL WHEN 8 THEN '{{"a":' || {_K} || '}} and more' WHEN 9 THEN '```' || chr(10) || '"' || {_K} || '"```' ELSE ' {{"b":[' || {_K} || ']}} ' END AS reply,
  CASE WHEN o_orderkey % 11 = 7 THEN NULL ELSE '{{"content":"' || {_K} || repeat('long ', 120) || '"}}' END AS body,
  CASE WHEN o_orderkey % 11 = 7 THEN 'LLM API call failed after 3 attempts' END AS error_message
FROM orders"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, REPLIES, "orders", sf_dir)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, LETTERS, "orders", sf_dir, deal=True)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, INVOICE, "orders", sf_dir)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, RUNS.replace(_EACH_RUN, _EACH_RUN_ONCE), "orders", sf_dir, deal=True)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, DETECTIONS, "customer", sf_dir)


def _sql(spark: SparkSession, text: str, table: str, sf_dir: str, deal: bool = False) -> DataFrame:
    """A derived table. ``deal``: rows that become many go to as many tasks as there are cores first, if the file alone makes fewer."""
    path = f"{sf_dir}/{table}.parquet"
    if not deal:
        return spark.sql(text.replace(f"FROM {table}", f"FROM parquet.`{path}`"))
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    view = f"paperlane_{table}_{zlib.crc32(path.encode()):08x}"
    (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).createOrReplaceTempView(view)
    return spark.sql(text.replace(f"FROM {table}", f"FROM {view}"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, SAMPLES, "orders", sf_dir)
