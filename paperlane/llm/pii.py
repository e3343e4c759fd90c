"""Personal data: fixed-form kinds, and bootstrapped contextual extraction. Built-in functions only.

The fixed forms (e-mail, IP address, card number, phone number) are the seeds. Around every token
that looks like an identifier (adjacent groups of digits are one token), lexical patterns are taken:
the word on its left or right, whatever the token's shape. Patterns and tokens form a bipartite graph
that Spark scores in turns: a pattern is as reliable as the tokens it meets, a token as reliable as its
patterns together, seeds being certain. Patterns that stay reliable, on enough different tokens that are
seeds or reached a reliable score in an earlier turn, mark the other tokens they meet.

Offsets count code points. Regular expressions give matches but no places, so a text is also split
by the same expression and places are summed from the pieces. All quantifiers over groups are
possessive and starts are anchored, so that matching takes linear time and no deep recursion. Tokens and
words are taken whole, however long; a pattern names a word of more than 64 characters by its MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import chunked, hot_keys, left_join, let, running, written

#: The kinds in their order, as matched: the same matches as the plain forms give, see the tests.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_GROUP = r"[0-9][0-9()./+-]*+"
TOKEN = rf"(?<!\S)[^\s0-9@]*+(?:{_GROUP}(?: [+(]{{0,2}}{_GROUP}(?=[^\p{{L}}\p{{N}}\s]*+(?:\s|$)))++|[0-9@])\S*+"
TURNS, RELIABLE, SEEDS = 3, 0.8, 3
#: Up to so many reliable patterns go to every task as one hash table; a pattern has 26 characters at most.
LOOKUP, SLOTS = 20_000, 1_024
_SPANS = "array<struct<s:int,e:int,v:string>>"


def found(text: Column, pattern: str) -> Column:
    """All matches as an array of (s, e, v): start, end and text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)

    def place(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), x["h"].alias("v")).alias("one"))

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    return let(F.filter(pairs, lambda x: x["h"].isNotNull()), lambda p: running(p, "struct<s:int,e:int,v:string>", place))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    back = F.reverse(_digits(v))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + let(F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return total % 10 == 0


def _small_parts(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.substr(q, F.lit(1), F.lit(3)).cast("int") <= 255)))


VALID = {"email": lambda v: F.lit(True), "ip": _small_parts, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(8, 15)}


def _valid(kind: str):
    return lambda x: VALID[kind](x["v"])


def base_spans(text: Column) -> list[Column]:
    """For each kind an array of valid spans."""
    return [F.when(HINTS[k](text), F.filter(found(text, p), _valid(k))).otherwise(F.array().cast(_SPANS)).alias(k) for k, p in KINDS.items()]


def _digest(kinds: list[str]) -> Column:
    def written_out(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.col(k), written_out(k)) for k in kinds]), ",")


def _tokens(text: Column) -> Column:
    """Identifier-like tokens (at least four digits, or an @) with the words beside them."""
    gaps = F.split(text, TOKEN, -1)

    def around(g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            value = F.regexp_replace(x["v"], r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
            left = F.regexp_extract(F.get(g, i), r"(?<!\S)(\S++)\s*+$", 1)
            right = F.regexp_extract(F.get(g, i + 1), r"^\s*+(\S++)", 1)
            return F.struct(x["s"].alias("s"), (x["s"] + F.length(value)).cast("int").alias("e"), value.alias("v"), F.lower(left).alias("left"), F.lower(right).alias("right"))

        return F.filter(F.transform(found(text, TOKEN), one), lambda x: (F.length(_digits(x["v"])) >= 4) | x["v"].contains("@"))

    return let(gaps, around)


def reliable_patterns(edges: DataFrame) -> DataFrame:
    """Patterns that stay reliable. edges: pattern, token, seed (boolean), distinct.

    A pattern scores the sum of its tokens' scores over one more than their number; a token 1 if it
    is a seed, else 1 - product(1 - score) over its patterns that score a half or more. Tokens that score
    ``RELIABLE`` count as seeds do in later turns, so that they bring in patterns that no seed meets.
    """
    edges = written(edges, "graph")
    total = edges.count()
    hot = {k: hot_keys(edges, [k], total) for k in ("pattern", "token")}
    score = edges.withColumn("score", F.col("seed").cast("double"))
    for turn in range(TURNS):
        patterns = score.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("weight"), F.sum((F.col("score") >= RELIABLE).cast("int")).alias("seeds"))
        if turn < TURNS - 1:
            weights = written(patterns.filter("weight >= 0.5").select("pattern", "weight"), "weights")
            tokens = left_join(edges, weights, ["pattern"], hot["pattern"]).filter("weight is not null").groupBy("token").agg((1 - F.exp(F.sum(F.log1p(-F.least("weight", F.lit(0.999)))))).alias("gained"))
            score = left_join(edges, written(tokens, "gains"), ["token"], hot["token"]).withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gained", F.lit(0.0))))
    return patterns.filter((F.col("weight") >= RELIABLE) & (F.col("seeds") >= SEEDS)).select("pattern")


def _patterns(t: Column) -> Column:
    """The lexical patterns of a token: side and word."""
    return F.array_compact(F.array(*[F.when(t[w] != "", F.concat(F.lit(f"{side} "), F.when(F.length(t[w]) > 64, F.md5(t[w])).otherwise(t[w]))) for side, w in (("L", "left"), ("R", "right"))]))


def _flagged(tokens: Column, seeds: Column) -> Column:
    """tokens with ``seed``: whether one overlaps a fixed form. Chunk by chunk, so that each token meets only the forms near it."""

    def near(chunk: Column) -> Column:
        lo, hi = F.get(chunk, 0)["s"], F.get(chunk, F.size(chunk) - 1)["e"]
        return let(F.filter(seeds, lambda x: (x["s"] < hi) & (x["e"] > lo)), lambda few: F.transform(chunk, lambda t: t.withField("seed", F.exists(few, lambda x: (x["s"] < t["e"]) & (x["e"] > t["s"])))))

    return F.flatten(F.transform(chunked(tokens), near))


def _looked_up(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows with ``id`` by a hash table of the patterns, an array of ``SLOTS`` arrays, which every task gets: rows stay where they are."""

    def slot(p: Column) -> Column:
        return F.pmod(F.xxhash64(p), F.lit(SLOTS)).cast("int")

    chains = patterns.groupBy(slot(F.col("pattern")).alias("slot")).agg(F.collect_set("pattern").alias("chain"))
    chains = chains.agg(F.map_from_entries(F.collect_list(F.struct("slot", "chain"))).alias("chains"))
    lookup = chains.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.col("chains")[i], F.array().cast("array<string>"))).alias("lookup")).scalar()

    def meets(t: Column) -> Column:
        return ~t["seed"] & F.exists(_patterns(t), lambda p: F.array_contains(F.get(F.col("lookup"), slot(p)), p))

    spans = F.transform(F.filter("tokens", meets), lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v")))
    return rows.withColumn("lookup", lookup).withColumn("id", F.array_sort(F.array_distinct(spans))).drop("lookup")


def _joined(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for any number of patterns: tokens are joined with them, frequent patterns where their tokens are, and go back to their rows."""
    each = rows.select("row_no", F.explode("tokens").alias("t")).filter("not t.seed")
    each = written(each.select("row_no", F.struct("t.s", "t.e", "t.v").alias("x"), F.explode(_patterns(F.col("t"))).alias("pattern")), "met")
    added = left_join(each, patterns.withColumn("reliable", F.lit(True)), ["pattern"]).filter("reliable").groupBy("row_no").agg(F.array_sort(F.collect_set("x")).alias("id"))
    return rows.join(added, "row_no", "left")


def personal_data(docs: DataFrame, lookup: int = LOOKUP, carried: tuple[str, ...] | None = None) -> DataFrame:
    """``row``, a struct of the input columns (all, or those to carry), and for each kind (and ``id``, the added ones) an array of spans.

    Null texts hold nothing. Rows are kept apart by a number of their own, so ids may repeat or be null, and input
    columns of any name stay as they are. Up to ``lookup`` reliable patterns go to every task and no text is
    shuffled; more of them are joined, with the same spans. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carried is None else carried)]).alias("row")
    rows = docs.select(row, *base_spans(text), F.when(text.rlike("[0-9@]"), _tokens(text)).alias("tokens"), F.monotonically_increasing_id().alias("row_no"))
    rows = written(rows.withColumn("tokens", _flagged(F.col("tokens"), F.concat(*KINDS))), "spans")
    each = rows.select(F.explode("tokens").alias("t")).select(F.explode(_patterns(F.col("t"))).alias("pattern"), F.xxhash64("t.v").alias("token"), "t.seed")
    patterns = written(reliable_patterns(each.groupBy("pattern", "token").agg(F.max("seed").alias("seed"))), "patterns")
    find = _looked_up if patterns.count() <= lookup else _joined
    return find(rows, patterns).drop("tokens").withColumn("id", F.coalesce("id", F.array().cast(_SPANS))).drop("row_no")


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans."""
    base = _digest(list(KINDS))
    return spans.select(F.col("row.doc_id").cast("long").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), _digest([*KINDS, "id"]).alias("spans"))


def redacted(docs: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """docs with every span in ``text`` replaced by its kind in brackets; overlapping spans are one, named by the first.

    All columns stay, whatever their names; texts without spans, empty and null ones stay as they are.
    """
    rows = personal_data(docs, lookup)
    text = F.col("row.text").cast("string")

    def named(kind: str):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind.upper()).alias("k"))

    def step(at: Column, x: Column) -> Column:
        return F.struct(F.greatest(at, x["e"]).alias("at"), F.struct(at.alias("p"), x["s"].alias("s"), F.greatest(at, x["e"]).alias("e"), x["k"].alias("k")).alias("one"))

    def pieces(chunk: Column) -> Column:
        base, last = F.get(chunk, 0)["p"], F.get(chunk, F.size(chunk) - 1)["s"]
        own = F.substr(text, base + 1, last - base)  # so that each piece is cut from a short text
        return let(own, lambda t: F.transform(chunk, lambda x: F.concat(F.substr(t, x["p"] - base + 1, x["s"] - x["p"]), F.lit("["), x["k"], F.lit("]"))))

    every = F.array_sort(F.concat(*[F.transform(k, named(k)) for k in [*KINDS, "id"]]))
    walked = running(every, "struct<p:int,s:int,e:int,k:string>", step)
    rows = rows.select("row", F.when(F.size(every) > 0, walked).alias("walked"))
    # a span that starts before the end of the ones before it is covered; the text goes on after the last end
    apart = F.filter("walked", lambda x: x["s"] >= x["p"])
    clean = let(apart, lambda spans: F.concat(F.array_join(F.flatten(F.transform(chunked(spans), pieces)), ""), F.substr(text, F.get(F.col("walked"), F.size("walked") - 1)["e"] + 1, F.length(text))))
    return rows.select(F.col("row").withField("text", F.when(F.col("walked").isNotNull(), clean).otherwise(text)).alias("row")).select("row.*")
