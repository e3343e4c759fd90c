"""Text, date and amount functions on columns; built-in functions only.

Every function takes and returns a Column, and null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and labels that decide results.
AMOUNT_INLINE = r"\b\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\b"
AMOUNT_EXACT = r"^\d{1,3}(,\d{3})*\.\d{2}$"
AMOUNT_VALUE = r"(?i)(?:\$\s*|(?:USD|EUR|GBP|INR)\s*)?\d{1,3}(?:,\d{3})*\.\d{2}"
AMOUNT_LABELLED = r"(?i)(?:total|amount\s*due|balance\s*due|grand\s*total|subtotal|sub\s*total|tax|vat|gst|due|payment\s*due|invoice\s*total|net\s*total)[^\n\r]{0,60}?(\d{1,3}(?:,\d{3})*\.\d{2})"
AMOUNT_IN_TABLE = r"(?m)^.*?(?:\t|  {2,}).*?(\d{1,3}(?:,\d{3})*\.\d{2})\s*$"
DATE_IN_TEXT = r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d{2}\b"
DAY_FIRST = r"\b(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d{2}\b"
ISO_DATE = r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"
ADDRESS_LIKE = r"(?i)^.*\d+\s+.*\b(?:road|street|ave|avenue|blvd|boulevard)\b.*$"
INVOICE_LABEL = r"(?i)invoice\s*(?:number|no|#)[:\s]*[#]?"
INVOICE_PREFIXES = ["invoice number:", "invoice no:", "invoice #:", "invoice no."]
DATE_PREFIXES = ["invoice date:", "date:", "due date:", "payment date:", "issue date:"]
AMOUNT_PREFIXES = ["total:", "amount due:", "balance due:", "grand total:", "subtotal:", "invoice total:", "amount:", "total amount:"]
COMPANY_PREFIXES = ["client company:", "company:", "bank name:", "account name:", "vendor:", "supplier:", "seller:", "from:", "bill from:", "issued by:", "service provider:"]


_BLANKS = "".join(map(chr, range(0x21)))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def or_null(c: Column) -> Column:
    """Null where blank."""
    return F.when(c.rlike(r"\S"), c)


def rewritten(text: Column, pattern: str, body) -> Column:
    """``text`` with every match replaced by ``body(match)``: gaps and matches are zipped, no UDF."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda gap, hit: F.concat(gap, F.coalesce(body(hit), F.lit(""))))
    return F.array_join(pieces, "")


def company(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"[ \t]+", " "))


def company_key(c: Column) -> Column:
    return F.lower(or_null(F.regexp_replace(trimmed(c), r"\s+", " ")))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def invoice_no(c: Column) -> Column:
    return or_null(F.regexp_replace(F.upper(c), r"\s+", ""))


def csv_parts(c: Column) -> Column:
    """Array of the non-blank, trimmed parts."""
    return F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != "")


def normalised_or_raw(normalised: Column, raw: Column) -> Column:
    return F.coalesce(or_null(normalised), raw)


def after_prefix(c: Column, prefixes: list[str]) -> Column:
    """What follows the first of the prefixes, in their order, that the text starts with."""
    text = trimmed(c)
    return F.coalesce(*[F.when(F.startswith(F.lower(text), F.lit(p)), trimmed(F.substring(text, len(p) + 1, 1 << 30))) for p in prefixes])


def without_fence(c: Column) -> Column:
    """Without a Markdown fence around it, if its very first characters are one; else as it stands."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^```(json)?", ""), r"```$", "")
    return F.when(F.startswith(c, F.lit("```")), trimmed(bare)).otherwise(c)


def iso_stamp(c: Column) -> Column:
    """A local time as ISO text: seconds only if there are any below the minute, a fraction in three or six digits."""
    micros = F.date_format(c, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    seconds = F.concat(F.date_format(c, ":ss"), fraction)
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), F.when(seconds == ":00", "").otherwise(seconds))


def truncated(c: Column, most: int = 500, mark: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def prompt(template: str, c: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{text}}"), F.coalesce(c, F.lit("")))


def data_url(path: Column, content: Column) -> Column:
    """Content as a data URL; Spark breaks base64 into lines, which URLs don't have."""
    return F.concat(F.lit("data:"), F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg"), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def appended_error(old: Column, new: Column) -> Column:
    """Errors joined by `` | ``; a blank old one doesn't count."""
    return F.concat_ws(" | ", or_null(old), new)


def model_key(c: Column) -> Column:
    return F.lower(or_null(F.regexp_replace(trimmed(c), r"\s+", " ")))


def date_observed(c: Column) -> Column:
    """``d.M.yyyy`` with overflow of days and months to the ISO form, within 1990..2035; other text as it is, trimmed; blank to null."""

    def moved(v: Column) -> Column:
        date = F.date_add(F.add_months(F.make_date(v[2], F.lit(1), F.lit(1)), v[1] - 1), v[0] - 1)
        return let(date, lambda x: F.when(F.year(x).between(1990, 2035), x.cast("string")))

    def written(text: Column) -> Column:
        form = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
        parts = F.array(*[F.regexp_extract(text, form, i).try_cast("int") for i in (1, 2, 3)])
        return F.when(text.rlike(r"\S"), F.coalesce(F.when(text.rlike(form), let(parts, moved)), text))

    return let(trimmed(c), written)


def _made(c: Column, pattern: str, order: str, clamp: bool) -> Column:
    """A date from digits; ``clamp`` shortens days 29 to 31 to the month's end."""

    def date(v: Column) -> Column:
        y, m, d = (v[order.index(x)] for x in "ymd")
        last = F.day(F.last_day(F.make_date(y, m, F.lit(1))))
        whole = F.make_date(y, m, F.least(d, last))
        return F.when(m.between(1, 12) & d.between(1, 31), whole if clamp else F.when(d <= last, whole))

    parts = F.array(*[F.regexp_extract(c, pattern, k).try_cast("int") for k in (1, 2, 3)])
    return F.when(c.rlike(pattern), let(parts, date))


def date_ladder(c: Column) -> Column:
    """The first of the strict forms that fits within 1990..2035, else as ``date_observed``."""
    forms = [(r"^(\d{4})-(\d{2})-(\d{2})$", "ymd"), (r"^(\d{2})\.(\d{2})\.(\d{4})$", "dmy"), (r"^(\d{2})/(\d{2})/(\d{4})$", "dmy"), (r"^(\d{2})/(\d{2})/(\d{4})$", "mdy"), None, (r"^(\d{2})-(\d{2})-(\d{4})$", "dmy"), (r"^(\d{2})-(\d{2})-(\d{4})$", "mdy")]

    def first(text: Column) -> Column:
        fit = [let(date_observed(text), lambda x: F.when(x.rlike(r"^\d{4}-\d\d-\d\d$"), x)) if f is None else let(_made(text, *f, clamp=False), lambda x: F.when(F.year(x).between(1990, 2035), x.cast("string"))) for f in forms]
        return F.when(text.rlike(r"\S"), F.coalesce(*fit, text))

    return let(trimmed(c), first)


def date_consensus(c: Column) -> Column:
    """The first form that fits, days beyond a month's end shortened; other text trimmed; blank to null."""
    forms = [(r"^(\d{2})\.(\d{2})\.(\d{4})$", "dmy"), (r"^(\d{2})/(\d{2})/(\d{4})$", "dmy"), (r"^(\d{2})/(\d{2})/(\d{4})$", "mdy"), (r"^(\d{4})-(\d{2})-(\d{2})$", "ymd"), (r"^(\d{2})-(\d{2})-(\d{4})$", "dmy")]
    return let(trimmed(c), lambda text: F.when(text.rlike(r"\S"), F.coalesce(*[_made(text, *f, clamp=True).cast("string") for f in forms], text)))


def dates_in(c: Column) -> Column:
    """Distinct dates of a text in order, as ``date_observed`` writes them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({DATE_IN_TEXT})"), 1), date_observed))


def amount(c: Column) -> Column:
    """Without currency and commas, with two decimals where there were none or one; null where not above 0 or no number."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(c), r"^[£$€₹]\s*", ""), r"(?i)^(USD|EUR|GBP|INR)\s*", ""), ",", "")
    full = lambda b: F.when(~b.contains("."), F.concat(b, F.lit(".00"))).when(b.rlike(r"^[^.]*\.[^.]$"), F.concat(b, F.lit("0"))).otherwise(b)
    return let(bare, lambda b: F.when(b.rlike(r"\S"), let(full(b), lambda x: F.when(trimmed(x).try_cast("double") > 0, x))))


def amounts_rewritten(c: Column) -> Column:
    return rewritten(c, AMOUNT_INLINE, lambda hit: F.coalesce(amount(hit), hit))


def text_normalised(c: Column) -> Column:
    """Amounts rewritten, runs of blanks as one, trimmed; line ends stay. Dates stay as they are."""
    return company(amounts_rewritten(c))


def amount_consensus(c: Column) -> Column:
    """Two decimals, half up; no number: without commas, trimmed; blank to null.

    Digits are moved by the exponent as text and cut after the third decimal, which alone decides, so
    nothing is rounded twice. Numbers of more than 35 digits before the point stay as they are.
    """
    form = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,2}))?$"

    def moved(v: Column) -> Column:
        digits, point = F.concat(v[1], v[2]), F.length(v[1]) + F.coalesce(v[3].try_cast("int"), F.lit(0))
        before = F.when(point <= 0, "0").otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
        after = F.concat(F.repeat(F.lit("0"), F.least(-point, F.lit(3))), F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.lit(3)), F.lit("000"))
        return F.concat(v[0], before, F.lit("."), F.substring(after, 1, 3)).try_cast("decimal(38,3)")

    def rounded(bare: Column) -> Column:
        plain = bare.rlike(r"^[+-]?\d{1,35}(\.\d{0,3})?$")  # nearly all: no digit has to move
        number = F.when(plain, bare.try_cast("decimal(38,3)")).when(bare.rlike(r"\d") & bare.rlike(form), let(F.array(*[F.regexp_extract(bare, form, k) for k in (1, 2, 3, 4)]), moved))
        return or_null(F.coalesce(F.round(number, 2).cast("decimal(38,2)").cast("string"), bare))

    return let(F.replace(trimmed(c), F.lit(","), F.lit("")), rounded)


def looks_like_amount(c: Column) -> Column:
    return trimmed(c).rlike(AMOUNT_EXACT)


def _amounts_in(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), amount)))


def amounts_labelled(c: Column) -> Column:
    return _amounts_in(c, AMOUNT_LABELLED)


def amounts_in_table(c: Column) -> Column:
    return _amounts_in(c, AMOUNT_IN_TABLE)


def invoice_no_in(c: Column) -> Column:
    """What follows the first invoice label."""
    hit = F.regexp_extract(c, INVOICE_LABEL + r"[A-Z0-9\-]+", 0)
    return F.when(hit != "", trimmed(F.regexp_replace(hit, INVOICE_LABEL, "")))


def plausible_company(c: Column, address: str = ADDRESS_LIKE) -> Column:
    return F.length(c).between(3, 80) & ~c.rlike(address)


def temperature(run: Column) -> Column:
    return F.when(run == 2, 0.3).when(run == 3, 0.5).otherwise(0.0)


def majority(n: Column) -> Column:
    """Votes that a majority of n needs."""
    return F.floor(n / 2) + 1
