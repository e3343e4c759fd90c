"""Benchmark decontamination: passages of test items are found in training texts, and cut out. Built-in functions only.

A window is so many consecutive words of an item (all of them, if it has fewer). A broadcast hash set of
all items' windows meets every window of every text where the text is; what it proposes is verified word by word.
A text's windows are never shuffled, only hits are. Items beyond ``LOOKUP`` windows are no
broadcast: then the windows' hashes are shuffled to them, dealt further by a salt, and 128 bits decide.

Texts and items that are null or empty have no words, no windows and no hits. A row without an item_id still hits words but
is no item; rows that share an item_id are one item. Every row of documents is judged alone, whatever its id, so
repeated and null ids have a result each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import left_join, written

#: Runs of ASCII digits, letters and everything beyond ASCII; first of texts in lower case, then of texts as written.
WORDS, WORDS_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: Up to so many windows of items are broadcast: some 200 bytes each.
LOOKUP = 400_000
#: Beyond, every window of an item stands in so many partitions.
SALTS = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """len, window (its words), item_id (text): each window of an item once."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    size = F.least(F.size("w"), F.lit(width))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    return rows.select("item_id", F.explode(each).alias("window")).select(F.size("window").alias("len"), "window", "item_id").distinct()


def _hash(w: Column, at: Column, size: int, seed: int = 0) -> Column:
    """A hash of ``size`` words from a place on; codegen reads them where they stand."""
    return F.xxhash64(F.lit(seed), *[F.get(w, at + k) for k in range(size)])


def _windows_of_texts(docs: DataFrame, sizes: list[int], carried: list[str]) -> DataFrame:
    """A row at -1 for each text, with ``carried`` as ``row`` and its n_words, and one for each place where a window may start."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*carried).alias("row"), words(F.col("text")).alias("w"))
    rows = rows.select("uid", "row", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - min(sizes, default=WIDTH), F.lit(-1)))).alias("pos"))
    first = F.col("pos") < 0
    return rows.select("uid", F.when(first, F.col("row")).alias("row"), F.when(first, F.size("w")).alias("n_words"), "pos", "w")


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All hits of items in texts, as two written tables.

    The first has uid, row, n_words, pos, found: of every text a row at -1, and a row for each hit
    with ``found``, an array of (len, group): windows of these lengths start at this word, and the group is
    that of all items with this window. The second has group and item_ids.
    """
    tests = written(item_windows(items, width), "item-windows")
    total, sizes = tests.count(), sorted(r["len"] for r in tests.select("len").distinct().collect())  # at most ``width`` lengths
    shared = tests.groupBy("len", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("group", F.md5(F.to_json("item_ids")))
    shared = written(shared, "shared-windows")
    groups = shared.groupBy("group").agg(F.first("item_ids").alias("item_ids"))
    rows = _windows_of_texts(docs, sizes, carried or docs.columns)
    search = _looked_up if total <= LOOKUP else _shuffled
    return written(search(rows, shared, sizes), "hits"), groups


def _sought(rows: DataFrame, size: int) -> Column:
    at = F.col("pos")
    return F.when((at >= 0) & (at + size <= F.size("w")), _hash(F.col("w"), at, size))


def _found(sizes: list[int]) -> Column:
    kind = "array<struct<len:int,group:string>>"
    if not sizes:
        return F.array().cast(kind)
    return F.array_compact(F.array(*[F.when(F.col(f"group{n}").isNotNull(), F.struct(F.lit(n).alias("len"), F.col(f"group{n}").alias("group"))) for n in sizes])).cast(kind)


def _looked_up(rows: DataFrame, shared: DataFrame, sizes: list[int]) -> DataFrame:
    """The items' windows are broadcast; a hit must have the very words."""
    for n in sizes:
        own = shared.filter(F.col("len") == n).select(_hash(F.col("window"), F.lit(0), n).alias(f"h{n}"), F.col("window").alias(f"window{n}"), F.col("group").alias(f"group{n}"))
        rows = rows.withColumn(f"h{n}", _sought(rows, n)).join(F.broadcast(own), f"h{n}", "left")
    same = [F.col(f"window{n}") == F.slice("w", F.col("pos") + 1, n) for n in sizes]
    rows = rows.filter(reduce(Column.__or__, [F.coalesce(s, F.lit(False)) for s in same], F.col("pos") < 0))
    rows = rows.withColumns({f"group{n}": F.when(s, F.col(f"group{n}")) for n, s in zip(sizes, same)})
    return rows.select("uid", "row", "n_words", "pos", _found(sizes).alias("found"))


def _shuffled(rows: DataFrame, shared: DataFrame, sizes: list[int]) -> DataFrame:
    """The texts' windows are shuffled as two hashes; frequent ones are dealt further by a salt, and every item's window stands in each share."""
    wanted = [F.struct(F.lit(n).alias("len"), _sought(rows, n).alias("h"), _hash(F.col("w"), F.col("pos"), n, seed=1).alias("h2")) for n in sizes]
    # no higher-order functions here: outside generated code a text's words would be copied for each of its windows
    rows = rows.select("uid", "row", "n_words", "pos", F.explode(F.array(*wanted)).alias("x")).filter(F.col("x.h").isNotNull() | (F.col("pos") < 0) & (F.col("x.len") == sizes[0]))
    # the texts' own rows match nothing: they are dealt by their number
    rows = rows.select("uid", "row", "n_words", "pos", "x.len", F.coalesce("x.h", F.xxhash64("uid")).alias("h"), F.when(F.col("pos") >= 0, F.col("x.h2")).alias("h2"), F.pmod(F.col("uid") + F.col("pos"), F.lit(SALTS)).cast("int").alias("salt"))
    own = [shared.filter(F.col("len") == n).select("len", _hash(F.col("window"), F.lit(0), n).alias("h"), _hash(F.col("window"), F.lit(0), n, seed=1).alias("k2"), "group") for n in sizes]
    tests = own[0]
    for more in own[1:]:
        tests = tests.unionByName(more)
    tests = tests.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    met = rows.join(tests, ["len", "h", "salt"], "left").filter((F.col("pos") < 0) | (F.col("h2") == F.col("k2")))
    one = F.when(F.col("pos") >= 0, F.struct("len", "group"))
    return met.select("uid", "row", "n_words", "pos", F.array_compact(F.array(one)).cast("array<struct<len:int,group:string>>").alias("found"))


def runs(found: DataFrame) -> DataFrame:
    """uid and, of each text with hits, ``n_hit`` and ``runs``: the maximal runs of hit words as (s, e), in order, end exclusive.

    Hits are sorted by place in their text's partition, where the sort may spill; runs are put together only when they are few.
    """
    by = Window.partitionBy("uid").orderBy("pos", "end")
    rows = found.filter("pos >= 0").select("uid", "pos", (F.col("pos") + F.array_max(F.transform("found", lambda x: x["len"]))).alias("end"))
    rows = rows.withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.count(F.when(F.col("before").isNull() | (F.col("pos") > F.col("before")), 1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("uid", "run").agg(F.min("pos").alias("s"), F.max("end").alias("e"))
    return rows.groupBy("uid").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def items_of(found: DataFrame, groups: DataFrame) -> DataFrame:
    """uid and ``item_ids`` of each text with hits, distinct and sorted. A group that many texts hold has no task of its own."""
    pairs = written(found.filter("pos >= 0").select("uid", F.explode(F.transform("found", lambda x: x["group"])).alias("group")).distinct(), "text-groups")
    each = left_join(pairs, written(groups, "groups"), ["group"]).select("uid", F.explode_outer("item_ids").alias("item_id"))
    return each.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, carried: list[str] | None = None) -> DataFrame:
    """Every row of docs (``carried`` columns) as ``row``, with n_words, n_hit, runs and item_ids (empty without hits)."""
    found, groups = hits(docs, items, width, carried)
    own = found.filter("pos < 0").select("uid", "row", "n_words")
    out = own.join(runs(found), "uid", "left").join(items_of(found, groups), "uid", "left")
    none = {"n_hit": F.lit(0), "runs": F.array().cast("array<struct<s:int,e:int>>"), "item_ids": F.array().cast("array<string>")}
    return out.select("row", "n_words", *[F.coalesce(F.col(c), x).alias(c) for c, x in none.items()])


def digests(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    listed = F.array_join("item_ids", ",")
    return marked.select("row.doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: Column, hit: Column) -> Column:
    """The text without the words of its runs and what stands between and behind them."""
    own, gaps = F.regexp_extract_all(text, F.lit(WORDS_AS_WRITTEN), 0), F.split(text, WORDS_AS_WRITTEN, -1)
    pieces = F.zip_with(own, F.slice(gaps, F.lit(2), F.size(own)), lambda w, g: F.concat(w, g))
    starts = F.concat(F.array(F.lit(0)), F.transform(hit, lambda r: r["e"]))
    ends = F.concat(F.transform(hit, lambda r: r["s"]), F.array(F.size(own)))
    kept = F.transform(F.array(pieces), lambda p: F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p, a + 1, b - a))))[0]
    return F.concat(gaps[0], F.array_join(kept, ""))


def removed(docs: DataFrame, items: DataFrame, what: str = "spans", width: int = WIDTH) -> DataFrame:
    """docs without contamination: ``spans`` cuts the hit words out, ``documents`` drops every text that has any; other rows stay as they are."""
    marked = decontaminated(docs, items, width)
    if what == "documents":
        return marked.filter("n_hit = 0").select("row.*")
    if what != "spans":
        raise ValueError(what)
    clean = F.when(F.size("runs") > 0, _without(F.col("row.text"), F.col("runs"))).otherwise(F.col("row.text"))
    return marked.select("row.*", clean.alias("_clean")).select(*[F.col("_clean").alias(c) if c == "text" else F.col(c) for c in docs.columns])


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORDS}')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
t AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), {WIDTH}) AS n FROM b WHERE len(w) > 0))),
p AS (SELECT uid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n),
h AS (SELECT uid, i, p.n, item FROM (SELECT uid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p) p JOIN t ON p.win = t.win AND p.n = t.n),
hit AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT uid, i, n FROM h)) GROUP BY uid),
its AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT uid, item FROM h WHERE item IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN its USING (uid)
"""
