"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources' sizes add up to the mix's size, shared by weight; a source stops at
``max_repeats`` times its own size and the excess goes to the others by weight, until none is above.
With sources ordered by (max_repeats * size / weight) the ones that stop are the first, so running sums
over the sources (one row each, in ranges) give the fixed point.

Documents: a document of relative weight v is expected c * v times, at most ``max_repeats`` times, where c
is such that the expected words of the source are its target. Weights are counted in sixteenths, so
a source has at most 256 of them and c comes from the same fixed point over them. By default v grows with the
bits of the size, from 17/16 to 2: longer documents hold more context and are likelier. Its whole part is
certain; the fraction p is the inclusion probability of one copy more. Documents are ranked by random odds
over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken from the least on until the words left of the
target are filled; the document at the boundary is taken if that brings the sum nearer. Thus the words of a
source miss its target by at most half a document's words.

The boundary is found without sorting a source: ranks fall in ``BINS`` bins, words are summed a bin,
the bin that holds the boundary is cut again, and only the last bin's documents are ordered. u comes
from the MD5 of seed, doc_id and the text's MD5, so reruns agree and rows that share an id spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import WORD, left_join, partitions, written

BINS = 4096
WEIGHTS = (5, 2, 1)
#: Up to so many rows (a source and document weight each) go to every task; more are joined.
SMALL = 50_000


def _ordered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, Window]:
    """A written table of the rows in ranges of an order that tells all apart, with ``range``, and the window over a range."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    return written(ranged.withColumn("range", F.spark_partition_id()), "ranged"), Window.partitionBy("range").orderBy(*order)


def _through(ranged: DataFrame, own: Window, sums: dict[str, Column]) -> DataFrame:
    """ranged with ``name_before``, the sum over all rows before, and ``name_all``. Only the ranges' sums, one row each, meet in one task."""
    every = Window.partitionBy()
    before = every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = each.select("range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in sums], *[F.sum(n).over(every).alias(f"{n}_all") for n in sums])
    rows = ranged.join(F.broadcast(each), "range")
    inner = own.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*ranged.columns, *[(F.col(f"{n}_base") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(f"{n}_before") for n, c in sums.items()], *[f"{n}_all" for n in sums]).drop("range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> with weight and target. Weights repeat over the sources by code point, null last.

    One row a source; sources of size 0 have the target 0. Sources may be many: both orders, by code point
    and by cap over weight, are sums over ranges.
    """
    named = _through(*_ordered(sizes, [F.col("source").asc_nulls_last()]), {"n": F.lit(1)})
    ranked = named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n_before") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.select("source", "source_size", "weight", (F.col("source_size") * max_repeats).alias("cap"))
    ranged, own = _ordered(ranked, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()])
    rows = _through(ranged, own, {"cap": F.col("cap"), "weight": F.col("weight"), "source_size": F.col("source_size")})
    rows = rows.withColumns({"left": F.col("source_size_all") - F.col("cap_before"), "weights_left": F.col("weight_all") - F.col("weight_before")})
    # a source stops if its share of what the earlier ones leave is above its cap; later ones then share by weight
    rows = written(rows.withColumn("stops", F.col("left") * F.col("weight") > F.col("cap") * F.col("weights_left")), "stopping")
    first = rows.filter("not stops").agg(F.max(F.struct(F.col("weights_left").alias("w"), F.col("left").alias("l"))).alias("free")).scalar()  # the first free source has the most weight left
    share = F.coalesce((F.col("free")["l"] * F.col("weight")).cast("double") / F.col("free")["w"].cast("double"), F.lit(0.0))
    return rows.withColumn("free", first).select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def uniform(seed: str, *columns: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _bin(lo: Column, width: Column) -> Column:
    return F.least(F.floor((F.col("place") - lo) / width * BINS), F.lit(BINS - 1)).cast("long")


def _met(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows left join a written table with one row a key: broadcast if that is small, else shuffled, hot keys apart."""
    return rows.join(F.broadcast(one), keys, "left") if one.count() <= SMALL else left_join(rows, one, keys)


def _boundary(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source the bin in which the words taken reach what is wanted: skey, lo, width, words_before, wanted."""
    sums = _met(docs, goals, ["skey"]).filter("place >= lo and place < lo + width").groupBy("skey", "lo", "width", "words_before", "wanted", _bin(F.col("lo"), F.col("width")).alias("bin")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("through", F.col("words_before") + F.sum("words").over(Window.partitionBy("skey").orderBy("bin")))
    hit = sums.filter("through >= wanted").groupBy("skey").agg(F.min(F.struct("bin", "lo", "width", "words", "through", "wanted")).alias("b"))
    return hit.select("skey", (F.col("b.lo") + F.col("b.bin") * (F.col("b.width") / BINS)).alias("lo"), (F.col("b.width") / BINS).alias("width"), (F.col("b.through") - F.col("b.words")).alias("words_before"), "b.wanted")


def sized(docs: DataFrame, carried: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, mark (the text's MD5) of every document, ``weight`` if given, and a struct ``row`` of the columns to carry along; null texts have size 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [weight.cast("double").alias("weight")] if weight is not None else []
    more += [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")] if carried else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("mark"), *more)


def expected(levels: DataFrame, goals: DataFrame, max_repeats: int) -> DataFrame:
    """skey, level, level_size (of documents of one weight) -> with source_size, target, whole and p.

    Going from the greatest weight down, those whose share would exceed ``max_repeats`` stop there; the others share the rest.
    """
    every = Window.partitionBy("skey")
    order = every.orderBy(F.desc("level"))
    before, mass = F.coalesce(F.sum("level_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum(F.col("level_size") * F.col("level")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = levels.join(goals, "skey").withColumns({"rest": F.col("target") - max_repeats * before, "mass": mass})
    stops = F.col("rest") * F.col("level") > F.col("mass") * max_repeats
    c = F.min(F.when(~stops & (F.col("mass") > 0), F.struct(-F.col("level"), (F.col("rest") / F.col("mass")).alias("c")))).over(every)["c"]
    rows = rows.withColumn("e", F.least(F.lit(float(max_repeats)), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)) * F.col("level"))))
    return rows.select("skey", "level", "level_size", "source_size", "target", F.floor("e").cast("long").alias("whole"), (F.col("e") - F.floor("e")).alias("p"))


def mixed(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of sizes (doc_id, source, size, mark; ``weight`` is a document's weight; ``row`` is carried along).

    Weights go from 1/16 to 16. Null sources are one source; null ids and repeated rows are documents of
    their own; rows equal in id, text and size are ranked together. Empty tables give no rows. No document gets
    more than ``max_repeats`` copies. sizes is read several times: it should be a written table.
    """
    level = F.greatest(F.lit(1), F.least(F.lit(256), F.round(F.coalesce("weight", F.lit(1.0)) * 16))) if "weight" in sizes.columns else 16 + F.least(F.length(F.bin("size")), F.lit(16))
    skey = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey")
    rows = sizes.withColumns({"skey": skey, "level": level.cast("long")})
    levels = written(rows.groupBy("skey", "source", "level").agg(F.sum("size").alias("level_size")), "levels")
    goals = targets(levels.groupBy("source").agg(F.sum("level_size").alias("source_size")), weights, max_repeats)
    goals = written(expected(levels.drop("source"), goals.select(skey, "source_size", "target"), max_repeats), "targets")
    u = uniform(seed, F.col("doc_id"), F.col("mark"))
    rows = _met(rows, goals.drop("level_size"), ["skey", "level"])
    odds = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # q/(1+q) keeps the order of the ranks q and lies between 0 and 1
    rows = rows.withColumn("q", odds).withColumn("place", F.coalesce(F.col("q") / (1 + F.col("q")), F.lit(0.0)))
    wanted = goals.groupBy("skey").agg(F.max("p").alias("p"), (F.max("target") - F.sum(F.col("whole") * F.col("level_size"))).alias("wanted"))
    wanted = written(wanted.filter("p > 0").select("skey", F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"), F.lit(0).cast("long").alias("words_before"), "wanted"), "wanted")
    part = rows.filter("p > 0").select("skey", "size", "place")
    edge = written(_boundary(part, written(_boundary(part, wanted), "boundary")), "boundary")
    rows = _met(rows, edge.toDF("skey", "cut_lo", "cut_width", "edge_before", "edge_wanted"), ["skey"])
    inside = (F.col("p") > 0) & F.col("cut_lo").isNotNull() & (F.col("place") >= F.col("cut_lo")) & (F.col("place") < F.col("cut_lo") + F.col("cut_width"))
    plain = rows.filter(~F.coalesce(inside, F.lit(False)))
    # below the boundary's bin, or where rounding left no boundary: all of it is wanted
    sure = plain.withColumn("extra", ((F.col("p") > 0) & (F.col("cut_lo").isNull() | (F.col("place") < F.col("cut_lo")))).cast("int"))
    last = rows.filter(F.coalesce(inside, F.lit(False)))  # a bin of a bin: a handful of documents a source
    w = Window.partitionBy("skey").orderBy("place", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("through", F.col("edge_before") + F.sum("size").over(w)).withColumn("extra", (F.col("through") - F.col("size") / 2.0 <= F.col("edge_wanted")).cast("int")).drop("through")
    return sure.unionByName(last).select(*[c for c in ("row",) if c in sizes.columns], "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``mixed`` for documents (doc_id, source, text); the texts are read once, for their sizes."""
    return mixed(written(sized(docs), "sizes"), **options)


def copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns. Texts are written once, not shuffled."""
    out = mixed(written(sized(docs, tuple(docs.columns)), "sizes"), **options).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(text, '')) AS mark FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([5, 2, 1])[((ROW_NUMBER() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap FROM s),
o AS (SELECT *, (SUM(source_size) OVER ())::BIGINT - COALESCE(SUM(cap) OVER w, 0)::BIGINT AS rest,
             (SUM(weight) OVER ())::BIGINT - COALESCE(SUM(weight) OVER w, 0)::BIGINT AS weights_rest
      FROM r WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest * weight > cap * weights_rest AS stops FROM o),
g AS (SELECT arg_max(rest, weights_rest) AS fl, MAX(weights_rest) AS fw FROM f WHERE NOT stops),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (fl * weight)::DOUBLE / fw::DOUBLE END AS target FROM f, g),
b AS (SELECT *, 16 + least(length(bin(size)), 16) AS level FROM d),
v AS (SELECT source, level, SUM(size)::BIGINT AS level_size FROM b GROUP BY ALL),
x AS (SELECT v.*, t.source_size, t.target, t.target - 3 * COALESCE(SUM(level_size) OVER w, 0)::BIGINT AS rest,
             (SUM(level_size * level) OVER (PARTITION BY v.source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS mass
      FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY v.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, arg_max(CASE WHEN rest * level <= mass * 3 AND mass > 0 THEN rest / mass END, CASE WHEN rest * level <= mass * 3 AND mass > 0 THEN level END) OVER (PARTITION BY source) AS c FROM x),
k AS (SELECT source, level, level_size, source_size, target, least(3.0::DOUBLE, greatest(0.0, COALESCE(c, 0.0) * level)) AS n FROM y),
z AS (SELECT source, MAX(target) - SUM(FLOOR(n)::BIGINT * level_size)::BIGINT AS wanted FROM k GROUP BY source),
e AS (SELECT b.*, k.source_size, k.target, z.wanted, FLOOR(n)::BIGINT AS whole, n - FLOOR(n) AS p,
             (('0x' || substr(md5('mix:' || COALESCE(doc_id::VARCHAR, 'null') || ':' || mark), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source AND b.level = k.level JOIN z ON b.source IS NOT DISTINCT FROM z.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM e),
c AS (SELECT *, SUM(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM q)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN p > 0 AND through - size / 2.0 <= wanted THEN 1 ELSE 0 END) AS taken
FROM c
"""
