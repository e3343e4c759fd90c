"""Spelling variants: the words of a corpus that are one edit apart, and the common form that each rare one varies.

A word's mask holds, for each letter, whether it occurs an odd number of times. One inserted or deleted
letter flips one bit and a replaced one two, so of three bands of the mask at least one is left alone: words
meet by equal bands, with a filter of length in the key, and are verified. Bands alone leave ever more words
a key as the vocabulary grows; an edit also leaves one half of a word alone, so each key holds one half too.

Counts, masks and pairs cover all words of all texts. A frequent word is one row before anything is shuffled to its neighbours.
Null and empty texts have no words; a null doc_id is written as nothing before the colon; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrowtext import mix, spans_hash
from .decontamination import lower_ascii
from .shared import left_join, written

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, MISSPELT = 7, 2, 10, 31
BANDS = 3
#: The letters by frequency in English text.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
#: The letters in turn to the bands, so that each band tells about as much as the others.
_LETTERS = [ord(c) for c in BY_FREQUENCY] + list(range(0xC0, 0x100))
BITS = np.zeros((BANDS, 256), np.uint64)
for _i, _c in enumerate(_LETTERS):
    BITS[_i % BANDS, _c] = np.uint64(1) << np.uint64(_i // BANDS)
#: Words of a slice of a batch, so that its keys stay small in memory.
_SLICE = 20_000


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run itself; if the checksum of document and run is a multiple of 31, without the letter that it points to."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % MISSPELT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least ``MIN_LENGTH`` letters that occur ``MIN_COUNT`` times or more."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{RUN}{{{MIN_LENGTH},}}"), 0)).alias("run"))
    rows = runs.select("doc_id", lower_ascii(F.col("run")).alias("run")).select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return rows.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def masks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The three bands of each word's mask; words are bytes of Latin-1, none is empty."""
    return np.stack([np.bitwise_xor.reduceat(b[data], offs[:-1]) for b in BITS])


def _keys(words: list[str], shorter: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word, and the number of its word: for each assumed length, band and half one."""
    raw = [w.encode("latin-1") for w in words]
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    offs = np.concatenate(([0], np.cumsum(size)))
    bands, start, end, out = masks(data, offs), offs[:-1], offs[1:], []
    for less in shorter:
        length = size - less
        half = length // 2
        for side, part in enumerate((spans_hash(data, start, start + half), spans_hash(data, end - (length - half), end))):
            for b in range(BANDS):
                tag = (length.astype(np.uint64) * np.uint64(BANDS) + np.uint64(b)) * np.uint64(2) + np.uint64(side)
                out.append(mix(part ^ mix(bands[b] ^ mix(tag))))
    return np.concatenate(out).view(np.int64), np.tile(np.arange(len(words)), len(out))


def _keyed(vocabulary: DataFrame, shorter: tuple[int, ...]) -> DataFrame:
    """key, word, n: the rows by which words of a length meet. ``shorter``: by how much a partner may be shorter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(at, _SLICE)
                key, who = _keys(piece.column("word").to_pylist(), shorter)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(key), piece.column("word").take(take), piece.column("n").take(take)], ["key", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(rows, "key long, word string, n long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words of a written vocabulary that are one edit apart."""
    short = _keyed(vocabulary, (0,)).select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    long = _keyed(vocabulary, (0, 1)).select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    fit = (F.length("b") == F.length("a") + 1) | (F.length("b") == F.length("a")) & (F.col("a") < F.col("b"))
    pairs = short.join(long, "key").filter(fit & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn").distinct()
    names = ("word", "n", "near", "near_n")
    ways = [F.struct(*[F.col(c).alias(name) for c, name in zip(columns, names)]) for columns in (("a", "an", "b", "bn"), ("b", "bn", "a", "an"))]
    return pairs.select(F.inline(F.array(*ways)))


def forms(pairs: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: the near word of largest count (of equal ones the first by code point), if it is frequent enough."""
    best = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    fit = -F.col("best.less") >= RATIO * F.col("n")
    return best.select("word", "n_near", F.when(fit, F.col("best.near")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n"))


def roots(edges: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. A form is ``RATIO`` times as frequent as its word, so there are no cycles, and each turn doubles the steps."""
    links = written(edges.select("word", F.col("form").alias("root")), "links")
    while True:
        nexts = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(left_join(links, nexts, ["root"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    vocabulary = written(counted(docs), "vocabulary")
    near = written(forms(near_pairs(vocabulary)), "forms")
    out = vocabulary.join(near, "word", "left").join(roots(near.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


#: crc32 bit by bit: bytes are taken in, then eight shifts follow each.
SQL_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({hex}) + 1, 2), lambda i: [CAST('0x' || substr({hex}, i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
ORACLE = rf"""
WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
x AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hexed FROM r GROUP BY doc_id, run),
c AS (SELECT run, k, {SQL_CRC.format(hex="hexed")} AS h FROM x),
m AS (SELECT k, CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
q AS (SELECT p.word, v.n, p.near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near
      FROM p JOIN v ON v.word = p.word JOIN v w ON w.word = p.near),
f AS (SELECT word, n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM q WHERE place = 1),
t AS (WITH RECURSIVE s AS (SELECT word, form AS root, 1 AS steps FROM f WHERE form IS NOT NULL
      UNION ALL SELECT s.word, f.form, steps + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, steps) AS root FROM s GROUP BY word)
SELECT v.word, f.form, coalesce(t.root, v.word) AS root, v.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN f USING (word) LEFT JOIN t USING (word)
"""
