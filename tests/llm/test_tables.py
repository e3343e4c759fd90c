"""Mixing, chat formatting and the pipeline."""

import hashlib
import json
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from paperlane.llm import chat, mixing
from paperlane.llm.queries import oracle_sql, queries, vocabulary

from .test_text_operators import SCHEMA, TEXTS, brute_components, brute_identifiers, brute_spans, brute_statistics, rows_of, words


def test_mixing_targets_by_definition(spark):
    odd = spark.createDataFrame(rows_of(TEXTS), SCHEMA)
    got = mixing.mix(odd).collect()
    sizes = {}
    for i, t, _, source, *_ in rows_of(TEXTS):
        sizes[source] = sizes.get(source, 0) + len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    target |= share
    assert len(got) == len(TEXTS)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    largest = {s: max(len(words(t)) for _, t, _, x, *_ in rows_of(TEXTS) if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    assert mixing.mix(odd).exceptAll(mixing.mix(odd)).count() == 0
    assert mixing.mix(odd.filter("false")).count() == 0
    copies = mixing.copies(odd)
    assert copies.columns == odd.columns and copies.count() == sum(r.copies for r in got)


def test_mixing_targets_of_many_sources(spark):
    """The fixed point by plain loops, over sources that stop and others, with equal caps and a null source."""
    rng = np.random.default_rng(9)
    sizes = {f"host{i:04d}": int(x) for i, x in enumerate(rng.choice([0, 1, 3, 3, 50, 2000, 90_000], 900))} | {None: 7}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, set(names), sum(sizes.values())
    while over := {s for s in free if left * weight[s] > 3 * sizes[s] * sum(weight[x] for x in free)}:
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    share = sum(weight[x] for x in free)
    want |= {s: left * weight[s] / share for s in free}
    assert 50 < len(free) < 850
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()
    assert len(got) == len(names) and all(r.weight == weight[r.source] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_mixing_includes_by_odds(spark):
    """Two hundred draws at once: each draw is a pair of sources of its own, with the same documents and other random numbers."""
    rng = np.random.default_rng(4)
    size, weight = rng.integers(20, 400, 120), rng.choice([0.25, 0.5, 1.0, 2.0, 5.0], 120)
    rows = [(int(i), f"{kind}{draw:03d}", int(size[i]), f"{kind}{draw}", float(weight[i])) for draw in range(200) for kind in "ab" for i in range(120)]
    sizes = mixing.written(spark.createDataFrame(rows, "doc_id long, source string, size long, mark string, weight double"), "sizes")
    goal = {"a": 1.5 * size.sum(), "b": 0.5 * size.sum()}  # the first two hundred sources by code point are a's
    got = {}
    for r in mixing.mixed(sizes, (3,) * 200 + (1,) * 200).collect():
        assert abs(r.target - goal[r.source[0]]) < 1e-6 and 0 <= r.copies <= 3
        got.setdefault(r.source[0], np.zeros(120))[r.doc_id] += r.copies / 200
    for kind, target in goal.items():
        c = next(x for x in np.linspace(0, 60, 600_001) if (size * np.minimum(3, x * weight)).sum() >= target)
        want = np.minimum(3, c * weight)
        p = want - np.floor(want)
        assert len(set(np.round(want, 3))) >= 3 and (np.abs(got[kind] - want) < 4.5 * np.sqrt(p * (1 - p) / 200) + 0.02).all()


def test_mixing_with_many_sources_joins_them(spark, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", " ".join("w" for _ in range(5 + i % 50))) for i in range(600)] + [(None, None, f"t {i} x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.execute(oracle_sql()[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries()[name](spark, sf_dir).collect()]
    plain = lambda rows: sorted(str(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)
    assert plain(got) == plain(want)


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_chat_linking(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": ["number", "null"]}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}}
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call(("x", "add", {"a": 1, "b": None}), ("y", "add", {"b": {"$ref": "x"}, "a": 2.5}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": {"z": 1, "ä": [2]}})), (1, 3, "assistant", call(("p", "add", {"a": {"$ref": "q"}}), ("q", "add", {"a": {"$ref": "p"}}))),
        (1, 4, "tool", json.dumps({"tool_call_id": "none", "content": None})), (2, 0, "assistant", call(("x", "add", {"a": "1", "c": 2, "tags": [1]}), ("x", "sub", {}))),
        (2, 1, "assistant", "{not json"), (None, 0, None, None), (3, 0, "assistant", json.dumps({"tool_calls": [{"name": "add", "arguments": '{"a": 3}'}, 7]})), (1, 5, "assistant", call(("w", "add", {"a": {"$ref": "y"}}))),
    ]
    out = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    by = {(r.conv_id, r.turn, r.place): r for r in out}
    assert by[1, 1, 0].status == "linked" and by[1, 1, 0].valid and by[1, 1, 0].level == 0 and by[1, 1, 0].json == '{"arguments":{"a":1,"b":null},"id":"x","name":"add"}'
    assert by[1, 1, 1].status == "no result" and by[1, 1, 1].level == 1 and by[1, 5, 0].level == 2
    assert by[1, 2, 0].status == "linked" and by[1, 2, 0].json == '{"content":{"z":1,"ä":[2]},"id":"x"}'
    assert by[1, 3, 0].level is None and by[1, 3, 1].level is None and by[1, 4, 0].status == "orphan"
    assert by[2, 0, 0].status == "ambiguous" and by[2, 0, 0].problem == "a: not number; c: unexpected; tags: 0: not string" and by[2, 0, 1].problem == "unknown tool"
    assert by[2, 1, 0].kind == "message" and by[None, 0, 0].json == '{"content":null,"role":null}' and by[3, 0, 0].status == "no id" and by[3, 0, 0].valid and by[3, 0, 1].problem == "unknown tool"
    assert chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_query_meets_every_case(spark):
    out = queries()["op5_chat_formatting"](spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in out} >= {"linked", "no result", "ambiguous", "message", "orphan"} and {r.level for r in out} >= {None, 0, 1, 2}
    assert {x for r in out for x in (r.problem or "").split("; ")} >= {"text: missing", "text: not string", "tone: unexpected", "unknown tool"}


AWKWARD = ['{"a":' * 200_000 + "1" + "}" * 200_000, '{"tool_calls":[{"id":"x","name":"reply","arguments":' + "[" * 150 + "]" * 150 + "}]}", '{"tool_call_id":"\\ud800"}', '{"tool_call_id":"x","content":"\\ud800"}', '{"tool_call_id":"x","content":NaN}', '{"tool_call_id":"x","content":[1e400]}', '{"tool_call_id":"x","content":-Infinity}', '{"tool_call_id":"x","content":' + "9" * 5000 + "}", "{", "", '{"tool_calls":[]}', '{"tool_call_id":7}']


def test_chat_takes_awkward_texts_as_messages(spark):
    rows = [row for k, text in enumerate(AWKWARD) for row in ((k, 0, "user", call(("x", "reply", {"text": "t"}))), (k, 1, "tool", text))]
    by = {(r.conv_id, r.turn): r for r in chat.linked(spark.createDataFrame(rows, CHAT)).collect()}
    for k, text in enumerate(AWKWARD):
        assert by[k, 1].kind == "message" and by[k, 1].level == 0 and json.loads(by[k, 1].json) == {"content": text, "role": "tool"} and by[k, 0].status == "no result", text[:50]


def test_chat_numbers_and_quoted_arguments(spark):
    rows = [(1, 0, "a", '{"tool_calls":[{"id":"x","name":"reply","arguments":"{\\"text\\": NaN}"},{"id":"y","name":"reply","arguments":"{\\"text\\": 1.0}"}]}'), (1, 1, "t", '{"tool_call_id":"y","content":{"b":1,"a":1.0,"b":2}}')]
    by = {(r.turn, r.place): r for r in chat.linked(spark.createDataFrame(rows, CHAT)).collect()}
    assert by[0, 0].problem == "not object" and by[0, 1].problem == "text: not string" and by[1, 0].json == '{"content":{"a":1.0,"b":2},"id":"y"}'


@pytest.mark.parametrize("conv", [None, 0, 7])
def test_chat_orders_any_conversation(spark, conv):
    ref = lambda i: {"text": "t", "about": {"$ref": i}}
    rows = [(conv, 0, "a", call(("x", "reply", {"text": "t"}))), (conv, 1, "a", call(("y", "reply", ref("x")), ("self", "reply", ref("self")), ("gone", "reply", ref("nowhere")))), (conv, 2, "a", call(("z", "reply", ref("y")), ("behind", "reply", ref("self"))))]
    rows += [(conv, 3 + k, "a", call((f"c{k}", "reply", ref(f"c{k - 1}" if k else "z")))) for k in range(11)] + [(8, 0, "a", call(("y", "reply", ref("c3"))))]
    rows += rows[:1] * 2  # repeated rows are further calls of one identifier
    out = chat.linked(spark.createDataFrame(rows, CHAT)).collect()
    level = {r.call_id: r.level for r in out if r.conv_id == conv}
    assert level == {"x": 0, "y": 1, "z": 2, "self": None, "gone": None, "behind": None} | {f"c{k}": 3 + k for k in range(11)}
    assert len(out) == len(rows) + 3 and {r.status for r in out if r.call_id == "x"} == {"ambiguous"} and [r.level for r in out if r.conv_id == 8] == [None]


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against a plain version of it, on what the stage before gave."""
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(vocabulary())
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), "step")
        before, after = docs.collect(), out.collect()
        if name != "BPE encoding and decoding":
            assert out.columns == docs.columns
        if name == "quality rules":
            stats = {r.doc_id: brute_statistics(r.text) for r in before}
            sound = {i for i, (n, _, _, _, repeat) in stats.items() if n >= 10 and 100 * repeat <= 20 * n}
            assert {r.doc_id for r in after} <= sound and len(after) > 0.8 * len(sound) and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            assert {r.doc_id for r in after} == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])} and len(after) == len({r.doc_id for r in after}) and set(after) <= set(before)
        if name == "PII":
            learned = brute_identifiers([(r.doc_id, r.text) for r in before])
            want = []
            for k, r in enumerate(before):
                spans = sorted((s, e, kind.upper()) for kind, found in (brute_spans(r.text) | {"id": learned.get(k, ())}).items() for s, e in found)
                text, at = "", 0
                for s, e, kind in spans:
                    text += "" if s < at else r.text[at:s] + f"[{kind}]"
                    at = max(at, e)
                text += r.text[at:]
                want.append((r.doc_id, text, r.lang, r.source, len(text)))
            assert sorted(map(tuple, after)) == sorted(want)
        if name.startswith("mixing"):
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            size = {r.doc_id: len(words(r.text)) for r in before}
            copies = {i: taken // size[i] for i, *_, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall() if taken}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert {i: n for i, n in got.items() if size[i]} == copies and set(after) <= set(before)
        if name.startswith("BPE"):
            rows = {(r.doc_id, tuple(r.ids)): r for r in after}
            for r in before:
                ids = library.encode(r.text, add_special_tokens=False).ids
                assert rows[r.doc_id, tuple(ids)].n_tokens == len(ids) and rows[r.doc_id, tuple(ids)].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
            assert len(after) == len(before)
        docs = out


def test_pipeline_awkward_rows(spark, sf_dir):
    odd = spark.createDataFrame(rows_of(TEXTS), SCHEMA)
    for rows in (odd, odd.filter("false")):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "step")
            if not name.startswith("BPE"):
                assert docs.columns == corpus_pipeline.COLUMNS
        docs.collect()


def test_pipeline_chooses_rows_not_ids(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (7, c), (7, c + " more"), (7, c), (8, ""), (8, ""), (8, " "), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ", ".join(f"{x} {k}" for x, k in zip(corpus_pipeline.COLUMNS, ("long", "string", "string", "string", "long"))))
    got = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, sf_dir).collect()), key=str)
    assert got[:2] == [(1, a), (5, b)] and got[3:] == sorted([(8, ""), (8, " "), (None, a), (None, a)], key=str) and got[2][0] == 7 and got[2][1] in (c, c + " more")


def test_pipeline_deletes_what_it_no_longer_needs(spark, sf_dir):
    from paperlane.llm.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    left = sum(os.path.getsize(os.path.join(d, f)) for x in set(os.listdir(folder)) - before for d, _, files in os.walk(os.path.join(folder, x)) for f in files)
    assert left < 3 * os.path.getsize(f"{sf_dir}/documents.parquet")
