"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from paperlane.functions import text as T
from paperlane.operators import extraction
from paperlane.sources import derived

BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def tr(x: str) -> str:
    return f"regexp_replace({x}, '{BLANKS}', '', 'g')"


def filled(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\S') THEN {x} END"


def collapsed(x: str, what: str = r"\s+") -> str:
    return f"regexp_replace({x}, '{what}', ' ', 'g')"


def company(x: str) -> str:
    return tr(collapsed(x, r"[ \t]+"))


def key(x: str) -> str:
    return f"lower({filled(collapsed(tr(x)))})"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def made(x: str, pattern: str, order: str, clamp: bool) -> str:
    y, m, d = (f"TRY_CAST(regexp_extract({x}, '{pattern}', {order.index(c) + 1}) AS INT)" for c in "ymd")
    first = f"make_date({y}, {m}, 1)"
    day = f"least({d}, day(last_day({first})))" if clamp else d
    more = "" if clamp else f" AND {d} <= day(last_day({first}))"
    return f"CASE WHEN CASE WHEN regexp_matches({x}, '{pattern}') AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN true{more} ELSE false END THEN CAST(({first} + ({day} - 1) * INTERVAL 1 DAY) AS DATE) END"


FORMS = {"dot": (r"^(\d{2})\.(\d{2})\.(\d{4})$", "dmy"), "slash": (r"^(\d{2})/(\d{2})/(\d{4})$", "dmy"), "us": (r"^(\d{2})/(\d{2})/(\d{4})$", "mdy"), "iso": (r"^(\d{4})-(\d{2})-(\d{2})$", "ymd"), "dash": (r"^(\d{2})-(\d{2})-(\d{4})$", "dmy"), "dash_us": (r"^(\d{2})-(\d{2})-(\d{4})$", "mdy")}


def date_consensus(x: str) -> str:
    t = tr(x)
    return f"CASE WHEN regexp_matches({t}, '\\S') THEN COALESCE({', '.join(f'CAST({made(t, *FORMS[f], True)} AS VARCHAR)' for f in ('dot', 'slash', 'us', 'iso', 'dash'))}, {t}) END"


def lenient(x: str) -> str:
    t, p = tr(x), r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    d, m, y = (f"TRY_CAST(regexp_extract({t}, '{p}', {k}) AS INT)" for k in (1, 2, 3))
    date = f"CAST((make_date({y}, 1, 1) + ({m} - 1) * INTERVAL 1 MONTH + ({d} - 1) * INTERVAL 1 DAY) AS DATE)"
    return f"CASE WHEN year({date}) BETWEEN 1990 AND 2035 THEN CAST({date} AS VARCHAR) END"


def date_observed(x: str) -> str:
    return f"CASE WHEN regexp_matches({tr(x)}, '\\S') THEN COALESCE({lenient(x)}, {tr(x)}) END"


def date_ladder(x: str) -> str:
    t = tr(x)
    strict = {f: f"CASE WHEN year({made(t, *FORMS[f], False)}) BETWEEN 1990 AND 2035 THEN CAST({made(t, *FORMS[f], False)} AS VARCHAR) END" for f in FORMS}
    return f"CASE WHEN regexp_matches({t}, '\\S') THEN COALESCE({strict['iso']}, {strict['dot']}, {strict['slash']}, {strict['us']}, {lenient(x)}, {strict['dash']}, {strict['dash_us']}, {t}) END"


def amount(x: str) -> str:
    bare = f"replace(regexp_replace(regexp_replace({tr(x)}, '^[£$€₹]\\s*', ''), '(?i)^(USD|EUR|GBP|INR)\\s*', ''), ',', '')"
    full = f"CASE WHEN NOT contains({bare}, '.') THEN {bare} || '.00' WHEN regexp_matches({bare}, '^[^.]*\\.[^.]$') THEN {bare} || '0' ELSE {bare} END"
    return f"CASE WHEN regexp_matches({bare}, '\\S') AND TRY_CAST({full} AS DOUBLE) > 0 THEN {full} END"


def amount_consensus(x: str) -> str:
    bare = f"replace({tr(x)}, ',', '')"
    form = r"^([+-]?)(\d*)(?:\.(\d*))?$"
    plain = f"regexp_extract({bare}, '{form}', 1) || '0' || regexp_extract({bare}, '{form}', 2) || '.' || substr(regexp_extract({bare}, '{form}', 3) || '000', 1, 3)"
    number = f"CASE WHEN regexp_matches({bare}, '\\d') AND regexp_matches({bare}, '{form}') THEN TRY_CAST({plain} AS DECIMAL(38,3)) WHEN regexp_matches({bare}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)[eE][+-]?\\d{{1,2}}$') THEN TRY_CAST(TRY_CAST({bare} AS DECIMAL(38,12)) AS DECIMAL(38,12)) END"
    return filled(f"COALESCE(CAST(CAST(round({number}, 2) AS DECIMAL(38,2)) AS VARCHAR), {bare})")


def after(x: str, prefixes: list[str]) -> str:
    t = tr(x)
    return "COALESCE(" + ", ".join(f"CASE WHEN starts_with(lower({t}), '{p}') THEN {tr(f'substr({t}, {len(p) + 1})')} END" for p in prefixes) + ")"


def printed(d: str) -> str:
    """A double as Java prints it: plain from a thousandth to ten million, else with an exponent."""
    e = f"CAST(floor(log10(abs({d}))) AS INT)"
    return f"CASE WHEN {d} = 0 OR abs({d}) BETWEEN 0.001 AND 9999999.999999 THEN CAST({d} AS VARCHAR) ELSE CAST({d} / pow(10, {e}) AS VARCHAR) || 'E' || {e} END"


def plain(x: str) -> str:
    """A JSON value as text: '' for null, none for objects and arrays."""
    return f"CASE json_type({x}) WHEN 'NULL' THEN '' WHEN 'DOUBLE' THEN {printed(f'CAST({x} AS DOUBLE)')} WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE {x}->>'$' END"


def good(j: str) -> str:
    return f"(CASE WHEN json_valid({j}) THEN {j} END)"


def values(f: str, j: str) -> str:
    """The values of a field: an array's items, a scalar, '' for null."""
    g = good(j)
    items = f"list_filter(list_transform(json_extract({g}, '$.{f}[*]'), lambda v: {plain('v')}), lambda v: v IS NOT NULL)"
    return f"CASE json_type({g}, '$.{f}') WHEN 'ARRAY' THEN {items} WHEN 'OBJECT' THEN [] WHEN 'NULL' THEN [''] ELSE CASE WHEN json_type({g}, '$.{f}') IS NULL THEN []::VARCHAR[] ELSE [{plain(f'json_extract({g}, {chr(39)}$.{f}{chr(39)})')}] END END"


def field_set(f: str, j: str = "extracted_json") -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({values(f, j)}, lambda x: {tr('x')}), lambda x: x <> '')))"


def raw_set(f: str, j: str = "extracted_json") -> str:
    return f"list_sort(list_distinct({values(f, j)}))"


def field_text(f: str, j: str = "extracted_json") -> str:
    g = good(j)
    return f"CASE WHEN json_type({g}, '$.{f}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN {tr(plain(f'json_extract({g}, {chr(39)}$.{f}{chr(39)})'))} END"


def recovered(j: str) -> str:
    """JSON itself; of a text cut off the part before the last comma ahead of its last bracket or quote, closed."""
    upto = f"regexp_extract({tr(j)}, '^([\\s\\S]+[\\]\"])', 1)"
    cut = f"CASE WHEN contains({upto}, ',') THEN regexp_extract({upto}, '^([\\s\\S]*),', 1) ELSE {upto} END || '}}'"
    return f"CASE WHEN json_valid({j}) THEN {j} WHEN {upto} <> '' AND json_valid({cut}) THEN {cut} END"


INVOICE = f"invoice AS ({derived.INVOICE})"
RUNS = f"runs AS ({derived.RUNS})"
SAMPLES = f"s AS ({derived.SAMPLES})"
DETECTIONS = rf"""body AS ({derived.DETECTIONS}), each_ AS (SELECT doc_id, unnest(json_extract(body, '$.data[0].text_detections[*]')) AS d, generate_subscripts(json_extract(body, '$.data[0].text_detections[*]'), 1) AS k FROM body),
det AS (SELECT doc_id, k, d->>'$.text_prediction.text' AS text, COALESCE(CAST(d->>'$.text_prediction.confidence' AS DOUBLE), 0.0) AS confidence,
  COALESCE(CAST(d->>'$.bounding_box.points[0].x' AS DOUBLE), 0.0) AS x_min, COALESCE(CAST(d->>'$.bounding_box.points[0].y' AS DOUBLE), 0.0) AS y_min,
  COALESCE(CAST(d->>'$.bounding_box.points[2].x' AS DOUBLE), 0.0) AS x_max, COALESCE(CAST(d->>'$.bounding_box.points[2].y' AS DOUBLE), 0.0) AS y_max
  FROM each_ WHERE regexp_matches(d->>'$.text_prediction.text', '\S'))"""

_EACH = {"DATE": date_consensus("v"), "AMOUNT": amount_consensus("v"), "COMPANY": key("v")}
FIRSTS = f"""{RUNS}, firsts AS (SELECT * FROM (SELECT *, {key('model_name')} AS mkey, row_number() OVER (PARTITION BY invoice_id, {key('model_name')} ORDER BY model_name) AS place
  FROM runs WHERE run_number = 1 AND upper(status) = 'COMPLETED') WHERE place = 1)"""
VOTES = f"""{FIRSTS}, counted AS (SELECT invoice_id, COUNT(*) AS n FROM firsts GROUP BY 1 HAVING COUNT(*) >= 2),
ballots AS (SELECT DISTINCT invoice_id, mkey, 'INVOICE_NO' AS field, nullif(upper(regexp_replace({field_text('INVOICE_NO')}, '\\s+', '', 'g')), '') AS value FROM firsts
  {' '.join(f"UNION ALL SELECT DISTINCT invoice_id, mkey, '{f}', {e} FROM (SELECT invoice_id, mkey, unnest({field_set(f)}) AS v FROM firsts)" for f, e in _EACH.items())}),
votes AS (SELECT invoice_id, field, value, COUNT(*) AS votes FROM ballots WHERE value IS NOT NULL GROUP BY ALL),
agreed AS (SELECT v.*, n FROM votes v JOIN counted c USING (invoice_id) WHERE votes >= n // 2 + 1)"""
CONSENSUS = f"""{VOTES}, consensus AS (SELECT invoice_id, MAX(value) FILTER (field = 'INVOICE_NO') AS consensus_invoice_no,
  {', '.join(f"COALESCE(string_agg({v}, ',' ORDER BY {v}) FILTER (field = '{f}'), '') AS {c}" for f, c, v in (('DATE', 'consensus_dates', 'value'), ('AMOUNT', 'consensus_amounts', 'value'), ('COMPANY', 'consensus_companies', title('value'))))},
  n AS models_agreed, COUNT(DISTINCT field) AS fields_with_consensus FROM agreed GROUP BY invoice_id, n)"""
_PART = {"DATE": ("consensus_dates", date_observed("v")), "AMOUNT": ("consensus_amounts", amount("v")), "COMPANY": ("consensus_companies", company("v"))}
TRUTH = f"""{CONSENSUS}, keyed AS (SELECT *, COALESCE(nullif({tr('consensus_invoice_no')}, ''), invoice_id) AS invoice_no FROM consensus),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_no ORDER BY invoice_id DESC) AS place FROM keyed) WHERE place = 1),
truth AS ({' UNION '.join(f"SELECT invoice_no, '{f}' AS field, COALESCE({filled(e)}, v) AS value FROM (SELECT invoice_no, {tr('u')} AS v FROM (SELECT invoice_no, unnest(string_split({c}, ',')) AS u FROM seeds)) WHERE v <> ''" for f, (c, e) in _PART.items())})"""
EDGES = f"""edges AS ({' UNION '.join(f"SELECT invoice_id, model_name, '{f}' AS field, v AS value FROM (SELECT invoice_id, model_name, unnest({values(f, 'extracted_json')}) AS v FROM runs WHERE status = 'COMPLETED' AND json_type({good('extracted_json')}, '$.{f}') = 'ARRAY')" for f in _PART)})"""
CONSISTENCY = f"""consistent AS (SELECT invoice_id, model_name, CASE WHEN COUNT(DISTINCT run_number) = 3 THEN (
  {' + '.join(f"CASE WHEN COUNT(DISTINCT CAST({raw_set(f)} AS VARCHAR)) = 1 AND bool_and(COALESCE(json_valid(extracted_json), false)) THEN 1 ELSE 0 END" for f in ('INVOICE_NO', *_PART))}) / 4.0::DOUBLE ELSE 0.0 END AS consistency FROM runs WHERE status = 'COMPLETED' GROUP BY 1, 2)"""


def _scores() -> str:
    out = []
    for f in _PART:
        x = f.lower()
        out.append(f"CASE WHEN g_{x} = 0 THEN CASE WHEN x_{x} = 0 THEN 1.0 ELSE 0.0 END ELSE n_{x} / g_{x} END AS {x}_accuracy")
        out.append(f"CASE WHEN g_{x} = 0 AND x_{x} = 0 THEN 1.0 WHEN g_{x} = 0 OR x_{x} = 0 OR n_{x} = 0 THEN 0.0 ELSE 2 * (n_{x} / x_{x}) * (n_{x} / g_{x}) / (n_{x} / x_{x} + n_{x} / g_{x}) END AS {x}_f1")
    return ", ".join(out)


def _count(alias: str, table: str) -> str:
    return ", ".join(f"COUNT(DISTINCT {table}) FILTER (field = '{f}')::DOUBLE AS {alias}_{f.lower()}" for f in _PART)


METRICS = f"""{TRUTH}, {EDGES}, {CONSISTENCY},
clean AS (SELECT DISTINCT invoice_id, model_name, field, {tr('value')} AS value FROM edges WHERE {tr('value')} <> ''),
wanted AS (SELECT k.invoice_id, t.field, {tr('t.value')} AS value FROM keyed k JOIN truth t USING (invoice_no)),
g AS (SELECT invoice_id, {_count('g', 'value')} FROM wanted GROUP BY 1),
done AS (SELECT DISTINCT invoice_id, model_name FROM runs WHERE status = 'COMPLETED' AND extracted_json IS NOT NULL),
x AS (SELECT d.invoice_id, d.model_name, {_count('x', 'value')} FROM done d LEFT JOIN clean USING (invoice_id, model_name) GROUP BY 1, 2),
n AS (SELECT d.invoice_id, d.model_name, {_count('n', 'm.value')} FROM done d LEFT JOIN (SELECT c.* FROM clean c JOIN wanted w USING (invoice_id, field, value)) m USING (invoice_id, model_name) GROUP BY 1, 2),
a AS (SELECT d.invoice_id, d.model_name, (MAX(CASE WHEN field = 'COMPANY' THEN 1 ELSE 0 END) + MAX(CASE WHEN field = 'AMOUNT' THEN 1 ELSE 0 END) + 1) / 3.0::DOUBLE AS query_answerability FROM done d LEFT JOIN edges USING (invoice_id, model_name) GROUP BY 1, 2),
unstable AS (SELECT DISTINCT c.invoice_id, c.model_name FROM clean c ANTI JOIN edges e USING (invoice_id, model_name, field, value)),
metrics AS (SELECT *, (date_accuracy + amount_accuracy + company_accuracy) / 3.0::DOUBLE AS overall_entity_accuracy FROM (
  SELECT x.invoice_id, x.model_name, {_scores()}, least(1.0, (x_date + x_amount + x_company) / (g_date + g_amount + g_company)) AS relation_completeness, query_answerability, u.invoice_id IS NULL AS stable
  FROM x JOIN g USING (invoice_id) JOIN n USING (invoice_id, model_name) JOIN a USING (invoice_id, model_name) LEFT JOIN unstable u ON u.invoice_id = x.invoice_id AND u.model_name = x.model_name))"""
BUNDLE = f"""{METRICS}, each_run AS (SELECT invoice_id, model_name, run_number, MIN(run_number) OVER (PARTITION BY invoice_id, model_name) AS first_run FROM runs WHERE status = 'COMPLETED' AND extracted_json IS NOT NULL),
bundle AS (SELECT r.invoice_id, r.model_name, r.run_number::BIGINT AS run_number, date_accuracy, date_f1, amount_accuracy, amount_f1, company_accuracy, company_f1, overall_entity_accuracy, relation_completeness, query_answerability,
  stable OR run_number > first_run AS graph_idempotent, COALESCE(consistency, 0.0) AS consistency_score FROM each_run r JOIN metrics USING (invoice_id, model_name) LEFT JOIN consistent USING (invoice_id, model_name))"""


def _joined(values: str) -> str:
    return f"COALESCE(array_to_string(list_sort(list_distinct({values})), '|'), '')"


_HIT = rf"regexp_extract(text, '{T.INVOICE_LABEL}[A-Z0-9\-]+')"
_FOUND = f"list_transform(regexp_extract_all(text, '{T.DATE_IN_TEXT}'), lambda v: {date_observed('v')})"
_RAW = f"list_filter(list_transform(regexp_extract_all(text, '{T.AMOUNT_LABELLED}', 1) || regexp_extract_all(text, '{T.AMOUNT_IN_TABLE}', 1), lambda v: {amount('v')}), lambda v: v IS NOT NULL)"
_NAMED = f"list_filter(list_transform(regexp_extract_all(text, '{extraction.COMPANY_IN_TEXT.replace(chr(39), chr(39) * 2)}', 1), lambda v: {tr('v')}), lambda v: length(v) BETWEEN 3 AND 80 AND NOT regexp_matches(v, '{T.ADDRESS_LIKE}'))"
#: Places of amounts come from the lengths of all pieces before them; each occurrence is judged by the text around it.
PATTERN_ENTITIES = rf"""WITH l AS ({derived.LETTERS}),
p AS (SELECT k, text, regexp_extract_all(text, '{extraction.AMOUNT_TOKEN}') AS hs, string_split_regex(text, '{extraction.AMOUNT_TOKEN}') AS gs FROM l),
i AS (SELECT *, unnest(range(1, len(hs) + 1)) AS n FROM p),
h AS (SELECT k, text, hs[n] AS raw, list_sum(list_transform(gs[1:n], lambda g: length(g))) + COALESCE(list_sum(list_transform(hs[1:n - 1], lambda g: length(g))), 0) AS a FROM i),
o AS (SELECT k, replace(raw, ',', '') AS v, CAST(replace(raw, ',', '') AS DOUBLE) AS x, a, a + length(raw) AS b, text FROM h),
c AS (SELECT k, v, (x <= 31.12 AND regexp_matches(substr(text, CAST(greatest(a - 80, 0) + 1 AS BIGINT), CAST(b + 80 - greatest(a - 80, 0) AS BIGINT)), '{extraction.DATE_WORD}'))
    OR regexp_matches(substr(text, CAST(greatest(a - 30, 0) + 1 AS BIGINT), CAST(a - greatest(a - 30, 0) AS BIGINT)), '{extraction.ACCOUNT_WORD}')
    OR (x <= 12 AND regexp_matches(regexp_extract(substr(text, 1, CAST(b AS BIGINT)), '[^
]*$') || regexp_extract(substr(text, CAST(b + 1 AS BIGINT)), '^[^
]*'), '{extraction.QUANTITY_WORD}')) AS bad FROM o),
s AS (SELECT k, v FROM c GROUP BY ALL HAVING bool_and(bad)),
e AS (SELECT k, text, {_FOUND} AS dates, unnest({_RAW} || [NULL]) AS v FROM l)
SELECT l.k AS doc_id, CASE WHEN {_HIT} <> '' THEN {tr(f"regexp_replace({_HIT}, '{T.INVOICE_LABEL}', '')")} END AS invoice_no, {_joined(_FOUND)} AS dates,
  COALESCE((SELECT string_agg(DISTINCT e.v, '|' ORDER BY e.v) FROM e WHERE e.k = l.k AND NOT list_contains(e.dates, e.v) AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = e.k AND s.v = e.v)), '') AS amounts,
  {_joined(f"list_transform({_NAMED}, lambda v: {company('v')})")} AS companies
FROM l"""
