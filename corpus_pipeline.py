"""The corpus pipeline: five operators in a row, each over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of ``documents``.
A stage's result must be written before the next stage starts, which deletes the tables that served it.

All stages keep null and repeated rows as they say, take null texts as empty, and give no rows for no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlane.llm import bpe, mixing, pii, quality
from paperlane.llm.ngram_join import near_duplicates, shingle_keys
from paperlane.llm.queries import vocabulary
from paperlane.llm.shared import deleted, recorded, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # tables behind the last stage's result


def stage(body: Stage) -> Stage:
    """Records the tables that a stage makes, and deletes those of the stage before."""

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(spark, _left)
        _left.clear()
        with recorded() as made:
            out = body(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Equal rows share their fate; rows without an id are judged but teach nothing; null and empty texts are rejected."""
    judged, _ = quality.judged(docs, table(spark, sf_dir, "labels"), tuple(COLUMNS))
    return judged.filter("kept").select("row.*")


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that with the least id; rows without an id stay, repeated rows stay once.

    Of several rows with that id the one stays whose set is the least by key, so that of an id with two texts a
    text goes which copies another document. Texts without words are components of their own: one row an id and text.
    """
    marked = near_duplicates(docs, keys=True).filter("doc_id = component_id and leads").select("doc_id", "key1", "key2").distinct()
    marked = written(marked, "leaders")
    named, columns = docs.filter("doc_id is not null"), [F.col(c) for c in COLUMNS]
    nameless = docs.filter("doc_id is null").select(*columns)
    several = written(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return named.join(marked.select("doc_id"), "doc_id", "left_semi").select(*columns).unionByName(nameless)
    first = named.join(several, "doc_id", "left_anti").join(marked.select("doc_id"), "doc_id", "left_semi").select(*columns)
    rows = named.join(several, "doc_id", "left_semi").select(*columns)
    keyed = written(shingle_keys(rows, carried=True), "keyed")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "key1", "key2")]
    kept = keyed.alias("k").join(marked.alias("m"), same[0] & same[1] & same[2], "left_semi").select("row.*")
    # one row of a set with words; of texts without, one an id and text
    of = F.when(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    kept = kept.withColumn("of", of).groupBy("doc_id", "of").agg(F.min(F.struct(*[F.col(c) for c in COLUMNS[1:]])).alias("x")).select("doc_id", "x.*")
    return first.unionByName(kept.select(*columns)).unionByName(nameless)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows. All rows stay; null texts stay null."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; its copies are equal rows. Null sources are one source; texts without words have no size and follow their source's share."""
    return mixing.copies(docs.select(*COLUMNS))


@stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number, and digests of the ids and of the text decoded from them. Null and empty texts have none."""
    return bpe.encode(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Learned rules, near duplicates and BPE are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``; each one's input is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, one in STAGES[:-1]:
        out = one(spark, docs, sf_dir)
        with recorded() as made:
            docs = written(out, name.replace(" ", "-"))
        deleted(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
