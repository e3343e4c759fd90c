"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from paperlane.llm import spelling as S

BASE = ["documents", "receiver", "strength", "éclairages", "straßenbahn", "Ünderground", "abcdefg", "abcdefgh", "aaaaaaa", "aaaaaaaa", "aaaaaaab"]


def texts(seed=5):
    rng, out = random.Random(seed), []
    letters = "abdeoréß"
    for k in range(60):
        row = []
        for w in BASE:
            row += [w] * rng.choice([0, 1, 8])
            for _ in range(2):
                i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                row.append(w[:i] + rng.choice(letters) + w[i + (kind == 0) :] if kind < 2 else w[:i] + w[i + 1 :])
        rng.shuffle(row)
        out.append((k, " ".join(row).upper() if k % 9 == 0 else ", ".join(row), "x"))
    long = "".join(rng.choice("abcdefgh") for _ in range(5_000))
    more = [(None, "receiver réceiver " * 3, None), (100, None, None), (101, "", "y"), (102, "ab cd 123", "y"), (103, "documents" * 3 + "1documents", None), (103, long + " " + long[:2_000] + "z" + long[2_000:], "z"), (104, f"{long} {long[:2_000]}z{long[2_000:]}", "z")]
    return out + more + out[:5]


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in count if x != w and edits(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, word string").repartition(5)


def test_variants(docs):
    got, want = sorted(map(tuple, S.variants(docs).collect())), brute(texts())
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and sum(r[1] is None and r[4] > 0 for r in want) > 5


def test_forms_are_followed_to_the_last(spark):
    """A chain of forms, and a root that most words share."""
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(19)]
    edges = spark.createDataFrame(chain + [(f"v{k}", "w03") for k in range(3000)], "word string, form string").repartition(7)
    got = dict(map(tuple, S.roots(S.written(edges, "edges")).collect()))
    assert len(got) == 3019 and set(got.values()) == {"w19"}


def test_variants_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, S.variants(docs).collect()))
    count = {r[0]: r[3] for r in got}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and len(count) == len(want)


def test_no_words(docs):
    assert S.variants(docs.limit(0)).count() == 0 and S.variants(docs.filter("text is null or text = ''")).count() == 0


def test_one_edit_leaves_a_band_and_a_half_alone():
    """Every pair one edit apart shares a key between the shorter word's keys and the longer one's."""
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 12)))
        i, kind = rng.randrange(len(a)), rng.randrange(2)
        b = a[:i] + rng.choice("dfgh") + a[i + kind :]
        keys = [set(S._keys([w], less)[0].tolist()) for w, less in ((a, (0,)), (b, (0, 1)))]
        assert keys[0] & keys[1]
