"""Importance resampling towards a target: texts whose words, pairs and triples the target has more often score higher.

Every run of one to three words is a feature, hashed into a bucket. Within a task, slices of some megabytes are
sorted as arrays of word ids: neighbours in this suffix array that share their first n words form a run,
which is one n-gram, so an n-gram is hashed once a slice however often it stands there, and its bucket is
scattered back to all its places. Checksums are put together from those of the words, never from built strings.

Two passes read the texts: one sums the buckets' counts, one the gains of a text's places. Between them
only counts of buckets are shuffled. The draw ranks all scores by ranges, so no task sorts more than its range.

Null and empty texts have no features and weight 0; a null doc_id is written as nothing after the colon
and comes last among equal scores, then rows keep the order in which they were written. Repeated rows are ranked each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrowtext import LOWER, SLICE_BYTES, distinct_spans, flat, slices, word_spans
from .shared import written

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes between words: all of ASCII but digits and lower-case letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(48, 58), *range(97, 123)]] = False
#: Words up to so many bytes have a table of their own for joining checksums.
_SHORT = 64


def _first_table() -> np.ndarray:
    """What one zero byte does to a checksum, for each of its four bytes: crc32 is linear, so tables of bytes add up."""
    one = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)  # from an empty state
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    return (x >> np.uint32(8)) ^ one[x & np.uint32(255)]


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to ``_SHORT`` zero bytes, and for powers of two of them."""
    first = _first_table()
    by_length = [np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]]
    for _ in range(_SHORT):
        by_length.append(_through(first, by_length[-1]))
    powers = [first]
    for _ in range(31):
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(by_length), powers


BY_LENGTH, POWERS = _tables()
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def joined_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of texts put together from those of their parts; ``size``: the bytes of the right parts."""
    short = np.minimum(size, _SHORT)
    out = BY_LENGTH[short, 0, left & 255] ^ BY_LENGTH[short, 1, (left >> 8) & 255] ^ BY_LENGTH[short, 2, (left >> 16) & 255] ^ BY_LENGTH[short, 3, left >> 24]
    rest, k = size - short, 0
    while (rest >> k).any():
        on = np.flatnonzero((rest >> k) & 1)
        out[on] = _through(POWERS[k], out[on])
        k += 1
    return out ^ right


def pieces(buf: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes of whole rows, and of long rows in pieces: (rows, bytes, offsets, ends).

    A piece ends between words and brings the next two words along; features start before ``ends`` only.
    """
    for i, j, part, at in slices(buf, offs, limit):
        low = LOWER[part]
        if len(low) <= 2 * limit:
            yield np.arange(i, j), low, at, at[1:]
            continue
        a, n = 0, len(low)
        while a < n:
            b = min(a + limit, n)
            while b < n and not BETWEEN[low[b]]:
                b += 1
            more, step = b, 256
            while more < n and np.count_nonzero(np.diff(BETWEEN[low[b:more]].astype(np.int8)) == 1) < LONGEST - 1:
                more, step = min(n, more + step), step * 2
            if more < n:  # whole words only
                more = b + int(np.flatnonzero(BETWEEN[low[b:more]])[-1])
            yield np.arange(i, i + 1), low[a:more], np.array([0, more - a]), np.array([b - a])
            a = b


def places(low: np.ndarray, offs: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """The features of some texts: each word's text, and for n from 1 on (places, their buckets) and (buckets of runs, lengths of runs).

    A place is the number of a feature's first word.
    """
    start, end, first = word_spans(low, offs, BETWEEN)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if not len(start):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return text, [none] * LONGEST, [none] * LONGEST
    where, word = distinct_spans(low, start, end)
    raw, size = low.tobytes(), (end - start)[where]
    crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist())], np.uint32)
    led = joined_crc(crc, SPACE_CRC, np.ones(len(crc), np.int64))  # with one space behind
    own = start < ends[text]
    ids = np.zeros((LONGEST, len(start)), np.int64)  # ids of the words from a place on, 0 beyond the text
    ids[0] = word + 1
    for k in range(1, LONGEST):
        ids[k, :-k] = np.where(text[k:] == text[:-k], ids[0, k:], 0)
    bits = int(len(where)).bit_length()
    if bits * LONGEST <= 63:
        key = ids[0]
        for k in range(1, LONGEST):
            key = key << bits | ids[k]
        order = np.argsort(key)
    else:
        order = np.lexsort(ids[::-1])
    ids, own = ids[:, order], own[order]
    common = np.zeros(len(order), np.int64)  # words shared with the neighbour before
    same = np.ones(len(order) - 1, bool)
    for k in range(LONGEST):
        same = same & (ids[k, 1:] == ids[k, :-1])
        common[1:] += same
    at, runs, hashed = [], [], np.zeros(len(order), np.uint32)
    for n in range(1, LONGEST + 1):
        head = np.flatnonzero(common < n)
        whole = ids[n - 1, head] > 0
        head, of = head[whole], np.cumsum(common < n) - 1
        last = ids[n - 1, head] - 1
        value = crc[last] if n == 1 else joined_crc(hashed[head], crc[last], size[last])
        number = np.full(len(whole), -1)
        number[whole] = np.arange(len(head))
        of = number[of]  # each place's run, -1 where the text ends
        run_hash = value
        on = of >= 0
        hashed[on] = (led[ids[0, on] - 1] if n == 1 else joined_crc(run_hash, SPACE_CRC, np.ones(len(head), np.int64))[of[on]])
        mine = np.flatnonzero(on & own)
        bucket = (run_hash % np.uint32(buckets)).astype(np.int64)
        at.append((order[mine], bucket[of[mine]]))
        runs.append((bucket, np.bincount(of[mine], minlength=len(head))))
    return text, at, runs


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, low, offs, ends in pieces(*flat(batch.column(0))):
                for bucket, n in places(low, offs, ends, buckets)[2]:
                    np.add.at(total, bucket, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain; as many numbers as there are buckets come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for rows, into in ((docs, s), (target, t)):
        for r in bucket_counts(rows, buckets).collect():
            into[r["bucket"]] = r["n"]
    most, goal = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * most / ((x + 1) * goal))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, columns: tuple[str, ...] | None = None) -> DataFrame:
    """row (``columns`` of docs), n_words, n_features and weight (long): the sum of its features' gains."""
    names = ["n_words", "n_features", "weight"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for rows, low, offs, ends in pieces(*flat(batch.column("_text"))):
                text, at, _ = places(low, offs, ends, len(gain))
                for n, (place, bucket) in enumerate(at):
                    row = rows[text[place]]
                    if n == 0:
                        np.add.at(out[0], row, 1)
                    np.add.at(out[1], row, 1)
                    np.add.at(out[2], row, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, out)], names=["row", *names])

    rows = docs.select(F.struct(*(columns or docs.columns)).alias("row"), F.col("text").alias("_text"))
    kinds = StructType([rows.schema["row"], *[StructField(name, LongType()) for name in names]])
    return rows.mapInArrow(score, kinds)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, fixed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored (row, fit, score, ...) with ``rank``: 1, 2, 3 ... of the best ``drawn`` fit rows, null else.

    Rows are sorted by ranges; a range's first rank is the number of rows in the ranges before, of which only the sizes come to the driver.
    """
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("row.doc_id"), F.asc("uid")]
    parts = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    before, starts = 0, []
    for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    starts = parts.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.col("at") + 1
    return parts.join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("fit") & (place <= drawn), place)).select(*scored.columns, "rank")


def scored(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A written table: row (``columns`` of docs), n_words, n_features, weight, score, fit (enough words to be drawn), uid."""
    rows = weighted(docs, gains(docs, target, buckets), columns)
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col("row.doc_id"), seed), "fit": F.col("n_words") >= least_words, "uid": F.monotonically_increasing_id()})
    return written(rows, "scored")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, columns: tuple[str, ...] | None = None, **settings) -> DataFrame:
    """Every row of docs with n_words, n_features, weight, score and, of those drawn, its rank."""
    rows = scored(docs, target, columns=columns, **settings)
    return ranked(rows, rows.filter("fit").count() * percent // 100)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **settings) -> DataFrame:
    """The rows of docs that are drawn, as they are."""
    return importance(docs, target, percent, **settings).filter("rank is not null").select("row.*")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(hexed) + 1, 2), lambda i: [CAST('0x' || substr(hexed, i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT {_SQL_WORDS} AS w FROM benchmark),
df AS (SELECT uid, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, range(1, {LONGEST + 1}) r(n) WHERE len(w) >= n)),
bf AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, range(1, {LONGEST + 1}) r(n) WHERE len(w) >= n)),
gs AS (SELECT g, sum(s) AS s, sum(t) AS t FROM (SELECT g, 1 AS s, 0 AS t FROM df UNION ALL SELECT g, 0, 1 FROM bf) GROUP BY g),
hs AS (SELECT g, s, t, {_SQL_CRC} % {BUCKETS} AS bucket FROM (SELECT *, hex(encode(g)) AS hexed FROM gs)),
bs AS (SELECT bucket, sum(s) AS s, sum(t) AS t, sum(sum(s)) OVER () AS most, sum(sum(t)) OVER () AS goal FROM hs GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (most + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (goal + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM bs),
w AS (SELECT uid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN hs USING (g) JOIN gain USING (bucket) GROUP BY uid),
x AS (SELECT uid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (uid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS fit FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * fit // 100 THEN place END AS rank FROM r
"""
