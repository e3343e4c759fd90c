"""Importance resampling against plain counts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from paperlane.llm import importance as I

TARGET = [(1, "alpha beta gamma, delta. Alpha beta"), (2, None), (3, "éclair ÉCLAIR éclair"), (4, "")]


def texts(seed=2):
    rng = random.Random(seed)
    names = ["alpha", "Beta", "gamma", "delta", "éclair", "x", "42", "straße", "w" * 70, "v" * 200]
    rows = [(k, " ".join(rng.choice(names) + rng.choice(["", ",", " -"]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60]))), rng.choice("ab")) for k in range(120)]
    long = " ".join(rng.choice(names) + str(rng.randrange(50)) for _ in range(6_000))
    return rows + [(None, "alpha beta " * 15, None), (None, "alpha beta " * 15, None), (500, None, None), (501, long, "z"), (501, long, "z"), (502, "…–" * 9, None)] + rows[:7]


def features(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target):
    s, t, out = [0] * 10_000, [0] * 10_000, []
    for part, into in ((rows, s), (target, t)):
        for _, text, *_ in part:
            for b in features(text)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (sum(s) + 10_000.0) / ((s[b] + 1.0) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    for doc_id, text, *_ in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * 5 // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def result(df):
    return sorted(map(tuple, df.select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, rank string").repartition(5)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


def test_importance(docs, target):
    got, want = result(I.importance(docs, target)), brute(texts(), TARGET)
    assert got == want and sum(r[4] is not None for r in want) >= 3
    assert I.importance(docs, target).select("row.*").columns == docs.columns
    drawn = I.resampled(docs, target, 50)
    assert drawn.columns == docs.columns and drawn.count() == sum(len(features(t)[0]) >= 20 for _, t, _ in texts()) * 50 // 100


def test_importance_of_the_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(I.importance(docs, items, columns=("doc_id",))) == want


def test_importance_of_nothing(docs, target):
    assert I.importance(docs.limit(0), target).count() == 0
    assert I.importance(docs.filter("text is null"), target.limit(0)).filter("weight = 0 and rank is null").count() == 1


def test_ranks_are_ranges(spark):
    """Ranks over many partitions, with a score that a third of all rows share."""
    rows = spark.range(6_000).selectExpr("struct(id as doc_id) as row", "if(id % 3 = 0, 7, id % 1000) as score", "id % 5 > 0 as fit", "id as uid").repartition(9)
    got = I.ranked(I.written(rows, "rows"), 2_500).collect()
    want = sorted((r for r in got if r.fit), key=lambda r: (-r.score, r.row.doc_id))
    assert [r["rank"] for r in want] == [*range(1, 2_501), *[None] * (len(want) - 2_500)] and all(r["rank"] is None for r in got if not r.fit)


def test_checksums_join():
    rng = random.Random(3)
    left, right = ([bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 300, 9_000]))) for _ in range(200)] for _ in range(2))
    got = I.joined_crc(np.array([zlib.crc32(x) for x in left], np.uint32), np.array([zlib.crc32(x) for x in right], np.uint32), np.array([len(x) for x in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


@pytest.mark.parametrize("limit", [40, 500, 1 << 20])
def test_long_texts_in_pieces(limit, monkeypatch):
    """Pieces of long texts give each feature once, whatever their size; so does a sort of separate ids."""
    rows = [t or "" for _, t, *_ in texts()] + ["a", "", "b c " * 40]
    raw = [t.encode() for t in rows]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = [[] for _ in rows]
    for numbers, low, at, ends in I.pieces(buf, offs, limit):
        text, places, runs = I.places(low, at, ends)
        for (place, bucket), (of_run, n) in zip(places, runs):
            assert np.bincount(bucket, minlength=10_000).tolist() == np.bincount(of_run, n, minlength=10_000).tolist()
            for row, b in zip(numbers[text[place]].tolist(), bucket.tolist()):
                got[row].append(b)
    assert [sorted(x) for x in got] == [sorted(features(t)[1]) for t in rows]
