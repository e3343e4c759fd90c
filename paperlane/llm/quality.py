"""Quality rules: a decision list over text statistics, learned by sequential covering. Built-in functions only.

Statistics come from one pass over the texts. Learning: thresholds are quantiles of the labelled
rows' statistics. A rule grows one condition at a time; each time one aggregate over the rows not
yet covered counts good and bad rows on either side of every threshold, and the condition with the
best FOIL gain is taken. On the third of the rows kept from growing, trailing conditions are pruned
while that doesn't lower the rule's precision, and a rule that isn't precise there ends the list. The list
becomes one ordered ``CASE WHEN`` expression.

Rows that learn are the labelled ones whose crc32(doc_id as text) mod 5 is not 0, all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shared import WORD, let, written

#: Shares at which the statistics' thresholds are taken.
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99]
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 12, 3, 5, 0.9
FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "bar_share", "digit_share", "line_words", "distinct_share"]


def _covered(windows: Column) -> Column:
    """Number of words in windows of five (given by their hashes, in order) that occur twice or more."""

    def positions(s: Column) -> Column:
        twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.array_compact(twice))

    def words(p: Column) -> Column:
        step = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
        return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)

    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(by_hash, positions), words)


def statistics(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and statistics of every row, and a struct ``row`` of the input columns to carry along.

    A null text counts as empty; empty texts have zeros.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")] if carried else []
    also = ["row"] if carried else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row)
    rows = rows.select(
        "doc_id", *also,
        F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"\|")).cast("long").alias("n_bars"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("windows", F.when(F.size("words") >= 6, let(hashes, windows)).otherwise(F.array().cast("array<bigint>")))
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(0)
    return rows.select(
        "doc_id", *also,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        "n_upper", "n_shouts", "n_bars", "n_digits",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def featured(stats: DataFrame) -> DataFrame:
    """The statistics with the ratios that rules test."""
    per_word, per_char = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns({
        "word_length": F.col("word_chars") / per_word,
        "symbol_share": F.col("n_symbols") / per_char,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / per_word,
        "upper_share": F.col("n_upper") / per_char,
        "shout_share": F.col("n_shouts") / per_word,
        "bar_share": F.col("n_bars") / per_word,
        "digit_share": F.col("n_digits") / per_char,
        "line_words": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
        "distinct_share": F.col("n_distinct_words") / per_word,
    })


def _holds(conditions: list[tuple[str, str, float]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) > t if side == ">" else F.col(f) <= t for f, side, t in conditions], F.lit(True))


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    from math import log2

    return p1 * (log2((p1 + 0.5) / (p1 + n1 + 1)) - log2((p0 + 0.5) / (p0 + n0 + 1)))


def learn_rules(labelled: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Ordered conjunctions that mark bad rows. labelled: FEATURES, ``bad`` (0/1), ``pruning`` (boolean)."""
    quantiles = labelled.agg(*[F.percentile_approx(f, QUANTILES, 2000).alias(f) for f in FEATURES]).first()
    if quantiles[0] is None:
        return []
    cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    places = [F.struct(F.lit(f).alias("f"), sum((F.col(f) > t).cast("int") for t in cuts[f]).alias("bin")) for f in FEATURES]
    rules: list[list[tuple[str, str, float]]] = []
    while len(rules) < MAX_RULES:
        open_ = labelled.filter(~reduce(lambda a, b: a | b, [_holds(r) for r in rules], F.lit(False)))
        rule: list[tuple[str, str, float]] = []
        while len(rule) < MAX_CONDITIONS:
            counts = open_.filter(~F.col("pruning") & _holds(rule)).select(F.explode(F.array(*places)).alias("p"), "bad").groupBy("p.f", "p.bin").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
            of = {(r.f, r.bin): (r.bad, r.n - r.bad) for r in counts}  # FEATURES times thresholds
            p0, n0 = (sum(of.get((FEATURES[0], b), (0, 0))[k] for b in range(len(cuts[FEATURES[0]]) + 1)) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in FEATURES:
                p = n = 0
                for b, t in enumerate(cuts[f]):
                    p, n = p + of.get((f, b), (0, 0))[0], n + of.get((f, b), (0, 0))[1]
                    for side, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if x >= MIN_COVER and y < n0:
                            best = max(best, (_gain(p0, n0, x, y), (f, side, t)), key=lambda v: v[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        kept = [rule[: k + 1] for k in range(len(rule))]
        row = open_.filter("pruning").agg(*[F.coalesce(F.sum(F.when(_holds(r), x)), F.lit(0)) for r in kept for x in (F.col("bad"), 1 - F.col("bad"))]).first()
        score = [(row[2 * k] + 1) / (row[2 * k] + row[2 * k + 1] + 2) for k in range(len(kept))]  # Laplace, so few rows prove little
        best_k = max(range(len(kept)), key=lambda k: (round(score[k], 3), -k))
        if score[best_k] < MIN_PRECISION:
            break
        rules.append(kept[best_k])
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The number of the first rule that holds, 0 where none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_holds(rule), k).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[tuple[str, str, float]]]]:
    """Statistics, base_failed, rule and kept of every row of docs (doc_id, text), and the rules.

    labels: doc_id, quality (1 good, 0 bad); rows with nulls teach nothing, of several for an id the
    mean counts. Without labels there are no rules and only the base decides. Repeated rows are
    judged alike; null ids are judged but teach nothing.
    """
    stats = featured(written(statistics(docs, carried), "statistics"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    learning = stats.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).join(marks, "doc_id").select(*FEATURES, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"))
    rules = learn_rules(written(learning, "labelled"))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
