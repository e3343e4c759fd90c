"""Fields of extracted JSON, and texts of model responses; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, or_null, trimmed

FIELDS = ["DATE", "AMOUNT", "COMPANY"]
ALL = ["INVOICE_NO", *FIELDS]
_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
_NONE = "array<string>"
#: The columns that ``with_fields`` adds for fields.
FIELD_COLUMNS = ", ".join(f"field_{f} struct<kind:string,values:array<string>>" for f in ALL)


def valid(j: Column) -> Column:
    """Whether the text is one whole JSON value, with nothing after it; repeated keys are allowed.

    The text and its digest, as the items of an array, must be read back as just these two. An object that isn't
    closed at the end is told without a parse: where texts are cut off, the parser's exceptions cost more than all else.
    """
    open_ended = let(trimmed(j), lambda t: t.startswith("{") & ~t.endswith("}"))
    items = F.from_json(F.concat(F.lit("["), j, F.lit(',"'), F.md5(j), F.lit('"]')), "array<string>", _STRICT)
    return F.when(open_ended, False).otherwise(F.coalesce(let(items, lambda x: (F.size(x) == 2) & (F.get(x, F.lit(1)) == F.md5(j))), F.lit(False)))


def _digest(j: Column) -> Column:
    return F.xxhash64(j).cast("string")


def _parsed(j: Column) -> Column:
    """The text's fields as variants and behind them an object with the text's digest: from one parse."""
    kind = "array<struct<" + ",".join(f"{f}:variant" for f in ALL) + ",_END:string>>"
    return F.from_json(F.concat(F.lit("["), j, F.lit(',{"_END":"'), _digest(j), F.lit('"}]')), kind, _STRICT)


def _whole(j: Column, parsed: Column) -> Column:
    """Whether the text is one JSON value: objects are known from their parse, other values and numbers that JSON lacks are looked at again."""
    good = (F.size(parsed) == 2) & (F.get(parsed, F.lit(1))["_END"] == _digest(j))
    other = ~(j.startswith("{") | trimmed(j).startswith("{")) | j.contains("NaN") | j.contains("Infinity") | j.contains("INF")
    return F.when(j.isNull(), False).when(other, valid(j)).otherwise(F.coalesce(good, F.lit(False)))


def _plain(v: Column) -> Column:
    """A value as text: numbers with a fraction or exponent as a double is printed, null as an empty text, objects and arrays as none.

    A variant keeps 7.0 as a decimal without a fraction and 7 as a long; integers beyond a long have 19 digits or more.
    """
    kind = F.schema_of_variant(v)
    double = kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL\((1?\d,0|\d+,[1-9]\d*)\))") & ~kind.rlike(r"^DECIMAL\(19,0")
    return F.when(kind.rlike("^(OBJECT|ARRAY)"), None).when(kind == "VOID", "").when(double, F.try_variant_get(v, "$", "double").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


def _values(v: Column, kind: Column) -> Column:
    """The values of a field as texts: an array's items, a scalar, one empty text for null; nothing of an object."""
    texts = F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("")))
    mixed = F.array_compact(F.transform(F.try_variant_get(v, "$", "array<variant>"), _plain))
    return F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), texts).when(kind.startswith("ARRAY"), mixed).when(kind.startswith("OBJECT"), F.array().cast(_NONE)).when(kind == "VOID", F.array(F.lit(""))).otherwise(F.array(_plain(v)))


def _field(v: Column, kind: Column) -> Column:
    name = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("scalar")
    return F.when(kind.isNotNull(), F.struct(name.alias("kind"), _values(v, kind).alias("values")))


def with_fields(rows: DataFrame, json: str = "extracted_json") -> DataFrame:
    """rows with ``ok``, whether the text is JSON, and ``field_DATE`` and so on: (kind, values), or null where the field is absent or the text is no JSON.

    The text is parsed once a row, and only fields that are used are unpacked. Kinds are array, scalar, null and object; of repeated keys the last counts.
    """
    rows = rows.withColumn("_p", _parsed(F.col(json))).withColumn("ok", _whole(F.col(json), F.col("_p")))
    rows = rows.withColumn("_p", F.when(F.col("ok"), F.get("_p", F.lit(0))))
    rows = rows.withColumns({f"_k{f}": F.schema_of_variant(f"_p.{f}") for f in ALL})
    rows = rows.withColumns({f"field_{f}": _field(F.col(f"_p.{f}"), F.col(f"_k{f}")) for f in ALL})
    return rows.drop("_p", *[f"_k{f}" for f in ALL])


def array_of(x: Column) -> Column:
    """A field's values if it is an array, else null."""
    return F.when(x["kind"] == "array", x["values"])


def set_of(x: Column) -> Column:
    """Trimmed, non-blank, distinct values of an array or scalar; empty where absent, null or an object."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(x["values"], trimmed), lambda v: v != "")), F.array().cast(_NONE))


def text_of(x: Column) -> Column:
    """A trimmed scalar; null where absent, null, an array or object."""
    return F.when(x["kind"] == "scalar", trimmed(F.get(x["values"], F.lit(0))))


def raw_of(x: Column) -> Column:
    """Values as they stand, sorted and distinct: [] where absent, [''] for null."""
    return F.coalesce(F.sort_array(F.array_distinct(x["values"])), F.array().cast(_NONE))


def recovered(j: Column) -> Column:
    """A valid text itself; of a truncated object the part before the last comma ahead of its last ``]`` or quote, closed; else null."""

    def closed(upto: Column) -> Column:
        comma = F.length(upto) - F.instr(F.reverse(upto), ",")
        cut = F.concat(F.when(upto.contains(","), F.substring(upto, F.lit(1), comma)).otherwise(upto), F.lit("}"))
        return F.when(upto != "", let(cut, lambda c: F.when(valid(c), c)))

    return F.when(valid(j), j).otherwise(let(F.regexp_extract(trimmed(j), r'(?s)^(.+[\]"])', 1), closed))


PAYLOAD = "struct<candidates:array<struct<finishReason:string,content:struct<parts:array<struct<thought:boolean,text:string>>>>>,usageMetadata:struct<candidatesTokenCount:int,totalTokenCount:int>>"


def _spoken(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].rlike(r"\S"))


def last_part(body: Column) -> Column:
    """Text of one response: the last part that is no thought; cut-off ones recovered, blocked ones null."""

    def said(first: Column) -> Column:
        text = F.get(F.reverse(_spoken(first["content"]["parts"])), 0)["text"]
        return F.when(first["finishReason"].isin("SAFETY", "RECITATION"), None).when(first["finishReason"] == "MAX_TOKENS", let(text, recovered)).otherwise(text)

    return let(F.get(F.from_json(body, PAYLOAD)["candidates"], 0), said)


def stream_text(body: Column) -> Column:
    """Text of streamed chunks (an array of responses), joined; the last reason to finish decides."""

    def said(firsts: Column) -> Column:
        text = F.array_join(F.flatten(F.transform(firsts, lambda c: F.coalesce(F.transform(_spoken(c["content"]["parts"]), lambda p: p["text"]), F.array().cast("array<string>")))), "")
        why = F.get(F.reverse(F.filter(F.transform(firsts, lambda c: c["finishReason"]), lambda r: r.rlike(r"\S"))), 0)
        return let(why, lambda w: F.when(w.isin("SAFETY", "RECITATION"), None).when(w == "MAX_TOKENS", let(text, recovered)).otherwise(let(text, or_null)))

    return let(F.transform(F.from_json(body, f"array<{PAYLOAD}>"), lambda c: F.get(c["candidates"], 0)), said)


def stream_tokens(body: Column) -> Column:
    """The last chunk's token count: of candidates, else in total."""
    counts = F.transform(F.from_json(body, f"array<{PAYLOAD}>"), lambda c: F.coalesce(c["usageMetadata"]["candidatesTokenCount"], c["usageMetadata"]["totalTokenCount"]))
    return F.get(F.reverse(F.filter(counts, lambda x: x.isNotNull())), 0)


def all_parts(body: Column) -> Column:
    """All parts of a streamed response joined, or the first part of a single one."""
    joined = F.array_join(F.flatten(F.transform(F.from_json(body, f"array<{PAYLOAD}>"), lambda c: F.coalesce(F.transform(F.get(c["candidates"], 0)["content"]["parts"], lambda p: p["text"]), F.array().cast("array<string>")))), "")
    return F.when(trimmed(body).startswith("["), let(joined, or_null)).otherwise(F.get(F.get(F.from_json(body, PAYLOAD)["candidates"], 0)["content"]["parts"], 0)["text"])


def chat_text(body: Column) -> Column:
    """``choices[0].message.content``, textual or an array of text parts."""

    def said(content: Column) -> Column:
        parts = F.try_variant_get(content, "$", "array<struct<text:string>>")
        return F.when(F.schema_of_variant(content).startswith("ARRAY"), let(F.array_join(F.transform(parts, lambda p: p["text"]), ""), or_null)).otherwise(F.try_variant_get(content, "$", "string"))

    return let(F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant"), said)


def chat_tokens(body: Column) -> Column:
    return F.get_json_object(body, "$.usage.total_tokens").try_cast("int")


def _events(body: Column) -> Column:
    lines = F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: x.startswith("data:"))  # trimmed, so \r\n needs no pattern
    return F.filter(F.transform(lines, lambda x: trimmed(F.substring(x, 6, 1 << 30))), lambda x: (x != "") & (x != "[DONE]"))


def sse_text(body: Column) -> Column:
    """Deltas (or messages) of an event stream joined, blank ones left out."""
    said = F.transform(_events(body), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.get_json_object(x, "$.choices[0].message.content")))
    return F.when(body.contains("data:"), F.array_join(F.filter(said, lambda x: x.rlike(r"\S")), "")).otherwise(chat_text(body))


def sse_tokens(body: Column) -> Column:
    seen = F.filter(F.transform(_events(body), lambda x: F.get_json_object(x, "$.usage.total_tokens").try_cast("int")), lambda x: x > 0)
    return F.when(body.contains("data:"), F.coalesce(F.get(F.reverse(seen), 0), F.lit(0))).otherwise(chat_tokens(body))


def contract(number: Column, dates: Column, amounts: Column, companies: Column) -> Column:
    """The extraction contract as JSON; a null number stays as null."""
    return F.to_json(F.struct(number.alias("INVOICE_NO"), dates.alias("DATE"), amounts.alias("AMOUNT"), companies.alias("COMPANY")), {"ignoreNullFields": "false"})


def chat_request(model: Column, prompt_text: Column, heat: Column, most_tokens: int = 1024, stream: bool = False, json_only: bool = False) -> Column:
    """Body of a chat completion request; as a stream of events, or with replies bound to JSON."""
    message = F.struct(F.lit("user").alias("role"), prompt_text.alias("content"))
    more = [F.lit(True).alias("stream")] if stream else []
    more += [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if json_only else []
    return F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages"), heat.alias("temperature"), F.lit(most_tokens).alias("max_tokens"), *more))


def parts_request(prompt_text: Column, heat: Column, most_tokens: int = 1024, thinking: int | None = None) -> Column:
    """Body of a request in parts; ``thinking`` bounds the tokens of thought."""
    content = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt_text.alias("text"))).alias("parts")))
    more = [F.struct(F.lit(thinking).alias("thinkingBudget")).alias("thinkingConfig")] if thinking is not None else []
    return F.to_json(F.struct(content.alias("contents"), F.struct(heat.alias("temperature"), F.lit(most_tokens).alias("maxOutputTokens"), F.lit("application/json").alias("responseMimeType"), *more).alias("generationConfig")))


def image_request(url: Column) -> Column:
    """Body of a text detection request."""
    return F.to_json(F.struct(F.array(F.struct(F.lit("image_url").alias("type"), url.alias("url"))).alias("input")))
