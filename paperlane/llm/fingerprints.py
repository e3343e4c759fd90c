"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

Terms are a text's two-word shingles (a lone word is its own term), lower-cased. Every term has
a 128-bit hash; each occurrence votes +1 or -1 on every bit, so a term weighs its number of
occurrences, and the sign of the sum is the fingerprint's bit (a tie is 0). Empty and null texts,
and texts without words, have the fingerprint of zeros. Likeness is the share of equal bits.

Search: the bits are cut in ``radius + 2`` blocks. Two fingerprints within the radius agree on two
blocks at least, so one table for every pair of blocks, permuted to the front as its key, meets every such
fingerprint; among the tables that meet a pair of fingerprints only the first counts. Keys of two blocks
(some 42 bits at a radius of 4) keep the tables' groups small also where one block's value is common.
Equal fingerprints are one row there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import arrowtext as at
from .shared import partitions, written

BITS = 128
PARTITION_BYTES = 128 << 20
#: Registered radius of the search.
RADIUS = 4


def fingerprint_words(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """An (n, 2) array of 64-bit halves for the rows of a flat text buffer."""
    out = np.zeros((len(offs) - 1, 2), np.uint64)
    for i, j, b, o in at.slices(buf, offs):
        word, first = at.words(b, o)
        if not len(word):
            continue
        n = np.diff(first)
        # the last word of a row starts no shingle, unless it is the only one
        term = word.copy()
        term[:-1] = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
        keep = np.ones(len(word), bool)
        last = first[1:][n > 1] - 1
        keep[last] = False
        lone = first[:-1][n == 1]
        term[lone] = word[lone]
        term = term[keep]
        size = np.where(n > 1, n - 1, n)
        rows = np.flatnonzero(size)
        start = np.concatenate(([0], np.cumsum(size[rows])))[:-1]
        step = -(-size[rows] // 255)  # one-byte counters hold the votes of 255 terms
        chunk = np.repeat(start - 255 * np.concatenate(([0], np.cumsum(step)))[:-1], step) + 255 * np.arange(step.sum())
        for half in (0, 1):
            h = at.mix(term + np.uint64(half * 0x632BE59BD9B4E019 + 1))
            lanes = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(-1, 8)  # eight one-byte counters each
            few = np.add.reduceat(lanes, chunk, axis=0).view(np.uint8).reshape(-1, 64)
            ones = np.add.reduceat(few, np.searchsorted(chunk, start), axis=0, dtype=np.int32)
            out[i + rows, half] = np.packbits(2 * ones > size[rows, None], axis=1).view(np.uint64)[:, 0]
    return out


def _hex(fp: np.ndarray) -> list[str]:
    raw = fp.tobytes()
    return [raw[16 * i : 16 * i + 16].hex() for i in range(len(fp))]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _code_points(text: bytes) -> np.ndarray:
    """Byte offsets of the code points, and the length at the end."""
    b = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of ``text``; and ``text`` with its last half replaced by as many of ``following``'s first ones."""
    own = _code_points(text)
    n = len(own) - 1
    half = n // 2
    if not half:
        return n, text
    other = _code_points(following[: 4 * half])
    return n, text[: own[n - half]] + following[: other[min(half, len(other) - 1)]]


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = _ROWS + ", part int, place int, text string"


def _compared(ids: list, texts: list[bytes]) -> dict[str, list]:
    """Results for all rows but the last, whose successor is unknown here."""
    size = [len(t) for t in texts]
    fp = fingerprint_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *size]))
    pairs = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    fe = fingerprint_words(np.frombuffer(b"".join(t for _, t in pairs), np.uint8), np.cumsum([0] + [len(t) for _, t in pairs]))
    return {
        "doc_id": ids[:-1],
        "n_chars": [n for n, _ in pairs],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for _, t in pairs],
        "fingerprint": _hex(fp[:-1]),
        "edited_fingerprint": _hex(fe),
        "near_edited": _likeness(fp[:-1], fe).tolist(),
        "near_next": _likeness(fp[:-1], fp[1:]).tolist(),
    }


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    n = len(rows["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("place", pa.int32()), ("text", pa.string())])


def _walk(batches):
    """Compares each row of a sorted partition with the next; the first and last row go out as edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple[list, list[bytes]] = ([], [])
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        buf, offs = at.flat(batch.column("text"))
        for i, j, b, o in at.slices(buf, offs):
            raw, o = b.tobytes(), o.tolist()
            texts = [raw[x:y] for x, y in zip(o[:-1], o[1:])]
            if not held[0]:
                yield _batch({"doc_id": [ids[i]], "part": [part], "place": [0], "text": [texts[0].decode()]}, _ARROW)
            held = (held[0] + ids[i:j], held[1] + texts)
            if len(held[0]) > 1:
                yield _batch(_compared(*held), _ARROW)
                held = ([held[0][-1]], [held[1][-1]])
    if held[0]:
        yield _batch({"doc_id": held[0], "part": [part], "place": [1], "text": [held[1][0].decode()]}, _ARROW)


def _bridge(batches):
    schema = pa.schema(list(_ARROW)[:7])
    for batch in batches:
        for i, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield _batch(_compared([i, None], [text.encode(), following.encode()]), schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and likenesses to that and to the next document.

    The next document has the next lower doc_id (nulls last; rows with equal ids by the xxhash64 of their
    texts, then the texts); after the last comes the first. Texts are dealt out once, by ranges of doc_id and that
    hash, in partitions of some ``PARTITION_BYTES``, and each partition streams over its sorted rows; what follows
    a partition's last row is found from two edge rows a partition. One row follows itself; no rows give none.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-size // PARTITION_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = own.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    walked = written(dealt.select("doc_id", "text").mapInArrow(_walk, _EDGES), "fingerprints")
    edges = walked.filter("part is not null").select("doc_id", "part", "place", "text")
    heads = edges.filter("place = 0").select(F.col("part").alias("head"), F.col("text").alias("following"))
    # partitions may be empty, so the next one comes from the numbers alone (one a partition); after the last comes the first
    every = Window.partitionBy()
    succession = heads.select(F.col("head").alias("part"), F.coalesce(F.lead("head").over(every.orderBy("head")), F.min("head").over(every)).alias("head"))
    bridged = edges.filter("place = 1").join(succession, "part").join(heads, "head").select("doc_id", "text", "following").mapInArrow(_bridge, _ROWS)
    return walked.filter("part is null").drop("part", "place", "text").unionByName(bridged)


def _number(digits: Column) -> Column:
    """16 hex digits as a long; they exceed a signed one, two pieces of eight do not."""
    hi, lo = (F.conv(F.substring(digits, k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def _keys(hi: Column, lo: Column, radius: int) -> list[Column]:
    """The key of every table: the number of the table and two blocks."""
    blocks = -(-(radius + 2) // 2) * 2  # as many in either half
    cut = [64 * k // (blocks // 2) for k in range(blocks // 2 + 1)]
    values = [F.shiftrightunsigned(half, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for half in (hi, lo) for a, b in zip(cut[:-1], cut[1:])]
    pairs = [(i, j) for i in range(blocks) for j in range(i)]
    return [F.xxhash64(F.lit(t), values[i], values[j]) for t, (i, j) in enumerate(pairs)]


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a, b, distance), a < b, of distinct fingerprints (hex, column ``fingerprint``) at most ``radius`` bits apart."""
    one = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    one = one.select(_number(F.substring("fingerprint", 1, 16)).alias("hi"), _number(F.substring("fingerprint", 17, 16)).alias("lo"))
    rows = one.select(F.explode(F.array(*_keys(F.col("hi"), F.col("lo"), radius))).alias("key"), "hi", "lo")
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key")).filter("x.hi < y.hi or (x.hi = y.hi and x.lo < y.lo)")
    distance = F.bit_count(F.col("x.hi").bitwiseXOR(F.col("y.hi"))) + F.bit_count(F.col("x.lo").bitwiseXOR(F.col("y.lo")))
    near = pairs.withColumn("distance", distance.cast("int")).filter(F.col("distance") <= radius)
    first = F.coalesce(*[F.when(a == b, a) for a, b in zip(_keys(F.col("x.hi"), F.col("x.lo"), radius), _keys(F.col("y.hi"), F.col("y.lo"), radius))])
    digits = [F.lower(F.concat(F.lpad(F.hex(f"{s}.hi"), 16, "0"), F.lpad(F.hex(f"{s}.lo"), 16, "0"))) for s in "xy"]
    return near.filter(F.col("x.key") == first).select(F.least(*digits).alias("a"), F.greatest(*digits).alias("b"), "distance")
