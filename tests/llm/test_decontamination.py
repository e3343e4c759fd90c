"""Benchmark decontamination against plain loops."""

import hashlib
import re

import pytest

from paperlane.llm import decontamination as D
from paperlane.llm.shared import written

ITEM = "The quick brown fox, it jumps over a lazy dog; and then (again) it sleeps until dawn breaks."
SHORT = "Élan vital!"
ITEMS = [(1, ITEM), (2, ITEM.upper()), (3, SHORT), (4, None), (5, ""), (6, "..!"), (None, "seven words that no item id has"), (10, "one two three four five six seven eight nine ten"), (10, "an item may have two texts")]
DOCS = [
    (1, f"Before. {ITEM} After.", "x"), (1, f"Before. {ITEM} After.", "x"), (2, None, None), (3, "", None), (None, "élan VITAL, Élan Vital Élan.vital ÉLAN vital", "y"),
    (4, "the quick brown fox it jumps over a lazy", None), (5, "fox it jumps over a lazy dog and then again " * 3, None), (6, "seven words that no item id has", None),
    (7, "one two three four five six seven eight nine ten " * 3 + "an item may have two texts, one two three four five six seven eight nine", None), (8, "x " * 30_000 + ITEM, None), (9, "Kelvin " * 12, None),
    (10, "…" * 5 + "!?", None),
]


def words(text, pattern=D.WORDS):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(pattern, low)


def brute(docs, items, width=10):
    out = []
    for doc_id, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(width, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(item_id)} if item_id is not None else set()
        listed = ",".join(sorted(found))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, pos string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("lookup", [D.LOOKUP, 0])
def test_decontamination(docs, items, lookup, monkeypatch):
    """By broadcast and, beyond its bound, by shuffle; short items, repeated and null ids, and a column named as one of ours."""
    monkeypatch.setattr(D, "LOOKUP", lookup)
    got = D.digests(D.decontaminated(docs, items))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, ITEMS)


def test_decontamination_of_nothing(docs, items):
    assert D.digests(D.decontaminated(docs.limit(0), items)).count() == 0
    assert D.digests(D.decontaminated(docs, items.limit(0))).filter("contaminated or n_items > 0 or n_hit > 0").count() == 0


def test_decontamination_of_the_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, D.digests(D.decontaminated(docs, items, carried=["doc_id"])).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[5] for r in got)


def test_removed(spark, docs, items):
    """Cut texts hold no window that was there, words around stay, and other rows are untouched."""
    clean = D.removed(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[1] == "Before. After." and rows[2] is None and rows[3] == "" and rows[None] == "élan VITAL, " and rows[4] == DOCS[5][1] and rows[8].rstrip() == ("x " * 30_000).rstrip()
    assert rows[7] == "one two three four five six seven eight nine"
    clean = written(clean, "clean")
    assert D.digests(D.decontaminated(clean, items)).filter("contaminated").count() == 0
    kept = D.removed(docs, items, "documents")
    bad = sum(r[5] for r in brute(DOCS, ITEMS))
    assert kept.count() == len(DOCS) - bad and D.digests(D.decontaminated(kept, items)).filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        D.removed(docs, items, "nothing")


def test_decontamination_is_native(docs, items):
    plan = D.digests(D.decontaminated(docs, items))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
