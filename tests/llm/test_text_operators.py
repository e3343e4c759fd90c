"""Each text operator against a plain version over the smallest tables and a fixture of awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import types as T

from paperlane.llm import bpe, fingerprints, masked_lm, pii, quality, token_counts, toxicity
from paperlane.llm.ngram_join import near_duplicates
from paperlane.llm.queries import queries, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key1", T.StringType()), ("size", T.StringType()), ("email", T.StringType()), ("row", T.StringType()))])
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \t\r\n"), (4, "one"), (5, "One two  three\tfour"), (6, "ONE two three four"), (7, BASE), (8, BASE.upper()), (9, BASE + " more"),
    (10, BASE.replace("tok30", "x")), (11, BASE.replace("tok15", "x").replace("tok45", "y")), (12, BASE), (12, BASE), (13, LONG), (14, LONG + " end"), (None, BASE), (None, None),
    (15, "äöü ÄÖÜ naïve   x　y 日本語 🙂🙂 <|endoftext|> it's 12 345"), (16, "a b a b a b a b a b a b a b a b"), (17, "line\nline\n\n line\nline"), (18, "mail a.b@c.org or +49 (30) 123-4567, 10.0.0.300 10.0.0.255 4111 1111 1111 1111, 4111111111111112"),
    (19, "x@y@z.com a@b.c.d. 1.2.3.4.5 00010.1.1.1 +1234567 +12345678"), (20, "z" * 5000),
]


def rows_of(texts):
    return [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None, "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """(doc_id, n, component) of each row, comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (a, x) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(x), least[find(i)] if a is not None else None) for i, (a, x) in enumerate(sets)), key=str)


def near_family(seed=3):
    """Groups of edited copies around the threshold, sharing passages across groups."""
    rng = np.random.default_rng(seed)
    out, n = [], 1000
    passage = [f"p{k}" for k in range(25)]
    for g in range(12):
        base = [f"g{g}w{rng.integers(40)}" for _ in range(int(rng.integers(20, 90)))]
        for _ in range(9):
            own = list(base)
            for _ in range(int(rng.integers(0, 7))):
                own[int(rng.integers(len(own)))] = f"e{rng.integers(10**6)}"
            if rng.random() < 0.3:
                own = own + passage
            out.append((n, " ".join(own)))
            n += 1
    return out


def test_near_duplicates(spark, documents, odd, empty):
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()]), (spark.createDataFrame(near_family(), "doc_id long, text string"), near_family())):
        got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
        want = brute_components(rows)
        if df is odd:  # rows that share an id share a component if any of them does
            assert [g[:2] for g in got] == [w[:2] for w in want]
        else:
            assert got == want
    assert near_duplicates(empty).collect() == []
    by = {r.doc_id: r.component_id for r in near_duplicates(odd).collect()}
    assert by[8] == by[9] == by[12] == 7 and by[14] == 13 and by[5] == 5 and by[1] == 1 and by[None] is None


def test_components_of_many_copies(spark):
    texts = [(i, BASE) for i in range(3000)] + [(5000 + i, BASE + f" extra{i}") for i in range(1500)] + [(9000 + i, f"other text number {i} with words of its own {i}") for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[5000 + i] == 0 for i in range(1500))
    assert all(got[9000 + i] == 9000 + i for i in range(100))


def test_one_list_is_split(spark, monkeypatch):
    """The same with lists in pieces of three, packets of few sets and parts of few postings."""
    from paperlane.llm import ngram_join

    for name, value in (("SPLIT", 3), ("PACKET", 100), ("PART", 20), ("FLUSH_TOKENS", 200), ("BLOCK_TOKENS", 150), ("BLOCK_DOCS", 4), ("ROUNDS", 1), ("MATCHES", 12), ("PAIRS", 5), ("GROUP", 150)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_family(5) + [(1, None), (2, ""), (None, BASE)] + [(10 + i, BASE) for i in range(40)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_components_with_hubs(spark):
    """Stars whose middle holds half of all edges, chains that end in one, loops and repeats: as by plain union."""
    from paperlane.llm.components import components

    edges = [(0, i) for i in range(1, 900)] + [(1000 + i, 5000) for i in range(900)] + [(2000 + i, 2001 + i) for i in range(60)] + [(2060, 5000), (7000, 7000), (3, 0), (8000, 8001)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges for x in e if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_in_few_jobs(spark):
    """The driver keeps a record of every job: edges that are flat take no round, and a round takes few jobs (43 and 62 before, 6 and 32 now)."""
    from paperlane.llm.components import components

    def job(name):
        spark.sparkContext.setJobGroup(name, name)
        spark.sparkContext.parallelize([1], 1).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    stars = {(i, i % 50 - 100) for i in range(50, 2000)}
    chains = {(10 * i + k + 1, 10 * i + k) for i in range(300, 600) for k in range(4)} | {(i, 7) for i in range(8, 2000)}
    for n, (edges, want, most) in enumerate(((stars, stars, 10), (chains, {(a, a - a % 10 if a >= 3000 else 7) for a, _ in chains}, 45))):
        before = job(f"before-{n}")
        got = {tuple(r) for r in components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        jobs = job(f"after-{n}") - before - 1
        assert got == want and jobs <= most, (n, jobs)


@pytest.mark.parametrize("small", [False, True])
def test_similar_pairs(spark, monkeypatch, small):
    from paperlane.llm import ngram_join
    from paperlane.llm.ngram_join import similar_pairs

    if small:
        for name, value in (("SPLIT", 3), ("MATCHES", 12), ("PAIRS", 5), ("GROUP", 150)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = near_family(8) + [(1, None), (2, ""), (None, BASE), (3, BASE), (4, BASE), (5, BASE.replace("tok30", "x")), (6, BASE + " more")]
    pairs, belong = similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {}
    for i, t in rows:
        if i is not None and (s := frozenset(shingle_set(t))):
            sets.setdefault(s, []).append(i)
    want = {tuple(sorted((min(sets[x]), min(sets[y])))) for x in sets for y in sets if x != y and 100 * len(x & y) >= 75 * len(x | y)}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert sorted(map(tuple, belong.collect())) == sorted((i, min(ids)) for ids in sets.values() for i in ids)


def brute_statistics(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    n_dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(covered)


def test_quality(spark, documents, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        out, _ = quality.judged(df, labels, tuple(df.columns))
        got = out.collect()
        stats = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
        assert stats == sorted(((i, *brute_statistics(t)) for i, t in rows), key=str)
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and r.rule == 0)
            assert r.row.doc_id == r.doc_id
    assert quality.judged(empty, labels)[0].collect() == []
    none = quality.judged(odd, labels.filter("false"))[0].collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_decision_list_learns_and_prunes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        rows.append({f: float(rng.random()) for f in quality.FEATURES} | {"bad": int(bad), "pruning": i % 3 == 0})
        if bad:
            rows[-1]["upper_share"] = 2 + float(rng.random())
    rules = quality.learn_rules(spark.createDataFrame(rows))
    assert len(rules) == 1 and all(c[:2] == ("upper_share", ">") for c in rules[0])


def test_quality_is_native(documents, spark, sf_dir):
    plan = quality.statistics(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x * 2 > 9) for i, x in enumerate(d)) % 10 == 0


def brute_spans(text):
    def ok(kind, v):
        n = sum(c.isdigit() for c in v)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 16 <= n <= 19 and luhn(v), "phone": lambda: 8 <= n <= 15}[kind]()

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m[0])] for k, p in PLAIN.items()}


def test_personal_data(documents, odd, empty):
    more = [(100 + i, t) for i, t in enumerate(["a@b.c" * 50, "1.2.3.4 " * 20 + "9" * 300, "12-34 5678-9012 3456 7890 1", "4111-1111-1111-1111-4111-1111-1111-1111", "+1 (2) 3-4.5 678901 +12 345 678 90", "++12345678 +1.2.3.4.5.6.7.8.9", "..@-.-", "x" * 3000 + "@" + "y" * 3000 + ".z", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9"])]
    spark = documents.sparkSession
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()]), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        got = pii.digests(pii.personal_data(df)).collect()
        want = []
        for i, t in rows:
            s = brute_spans(t)
            flat = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in s[k])
            want.append((i, *[len(s[k]) for k in PLAIN], hashlib.sha256(flat.encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        for r in got:
            base = [x for x in r.spans.split(",") if x and not x.startswith("id:")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert pii.digests(pii.personal_data(empty)).collect() == []


def test_context_discovers_identifiers(spark):
    rows = [(i, f"Our record says card {'4111 1111 1111 1111' if i % 3 else '5500-0000-0000-0004'} phone: +4930{1000000 + i * 37} for you") for i in range(60)]
    rows += [(1000 + i, f"Call phone: +4930{i} today" if i < 3 else f"The year {1900 + i} was long and paid {i * 1001} coins") for i in range(40)]
    rows += [(2000, "They wrote phone: +493012 and left")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for lookup in (pii.LOOKUP, 0):  # patterns looked up, and joined
        got = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(df, lookup)).collect()}
        assert got[2000].startswith("id:") and not got[1010]
        clean = {r.doc_id: r.text for r in pii.redacted(df, lookup).collect()}
        assert clean[2000] == "They wrote phone: [ID] and left" and clean[1010] == rows[60 + 10][1] and "[PHONE]" in clean[0] and "4111" not in clean[1]


def test_context_goes_beyond_seeds(spark):
    def card(i):
        v = f"4111 1111 {i:04d} 111"
        return v + next(c for c in "0123456789" if luhn(v + c))

    rows = [(i, f"phone: +4930{1234567 + i}") for i in range(100)] + [(100 + i, f"card {card(i)}") for i in range(30)]
    rows += [(200 + i, f"phone: 030{7654321 + i}") for i in range(12)] + [(300 + i, f"fernruf 030{7654321 + i}") for i in range(12)]  # a word that no seed meets
    ids = {400: "phone: 0301234567", 401: "phone: 555-123-4567", 402: "phone: AB-12345678", 403: "fernruf 0409999999", 404: "card 1234 5678 9012 3456", 405: "phone: " + "1" * 70, 406: "phone: 1-2-3-4", 407: "phone: (030) 123 4567, thanks"}
    rows += [*ids.items(), (500, "lasted 2019 years"), (501, "cost 12345 coins 12 34x5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for lookup in (pii.LOOKUP, 0):
        got = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(df, lookup)).collect()}
        for i, text in ids.items():
            value = text.split(" ", 1)[1].removesuffix(", thanks")
            start = text.index(value)
            assert got[i] == f"id:{start}:{start + len(value)}", (i, got[i])
        assert got[500] == got[501] == ""


def brute_identifiers(rows):
    """doc number to the learned spans: tokens, graph and turns in plain Python."""
    blank = " \\t\\n\\x0b\\f\\r"
    token = regex.compile(pii.TOKEN.replace(r"\s0-9@", blank + "0-9@").replace(r"\p{N}\s", r"\p{N}" + blank).replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]"))
    found, edges = [], {}
    for n, (_, text) in enumerate(rows):
        text, seeds = text or "", [s for k in brute_spans(text).values() for s in k]
        hits = [m.span() for m in token.finditer(text)] if re.search("[0-9@]", text) else []
        for (a, b), before, after in zip(hits, [0] + [e for _, e in hits], [s for s, _ in hits[1:]] + [len(text)]):
            value = regex.sub(r"[^\p{L}\p{N}]+$", "", text[a:b])
            if len(re.sub("[^0-9]", "", value)) < 4 and "@" not in value:
                continue
            left, right = re.split("[ \t\n\x0b\f\r]+", text[before:a].strip(" \t\n\x0b\f\r"))[-1], re.split("[ \t\n\x0b\f\r]+", text[b:after].strip(" \t\n\x0b\f\r"))[0]
            patterns, seed = [side + w.lower() for side, w in (("L ", left), ("R ", right)) if w], any(s < a + len(value) and e > a for s, e in seeds)
            found.append((n, a, a + len(value), patterns, seed))
            for p in patterns:
                edges[p, value] = edges.get((p, value), False) or seed
    of_pattern, of_token = {}, {}
    for p, t in edges:
        of_pattern.setdefault(p, []).append(t)
        of_token.setdefault(t, []).append(p)
    score = {k: float(v) for k, v in edges.items()}
    for turn in range(pii.TURNS):
        weight = {p: sum(score[p, t] for t in ts) / (len(ts) + 1) for p, ts in of_pattern.items()}
        sure = {p for p, ts in of_pattern.items() if weight[p] >= pii.RELIABLE and sum(score[p, t] >= pii.RELIABLE for t in ts) >= pii.SEEDS}
        gained = {t: 1 - np.prod([1 - min(weight[p], 0.999) for p in ps if weight[p] >= 0.5]) for t, ps in of_token.items()}
        score = {(p, t): 1.0 if seed else gained[t] for (p, t), seed in edges.items()}
    out = {}
    for n, a, b, patterns, seed in found:
        if not seed and sure & set(patterns):
            out.setdefault(n, set()).add((a, b))
    return out


def test_learned_spans_by_brute_force(documents, odd, spark):
    rng = np.random.default_rng(6)
    lead, words_ = ["phone:", "call", "ref", "konto", "the", "mail", "x" * 90, "(tel)"], ["and", "of", "it,", "über", "2019", "12", "a1b2c3d4", "55-66-77.", "5678!!!"]
    made = []
    for i in range(300):
        parts = []
        for _ in range(int(rng.integers(1, 9))):
            parts += [str(rng.choice(lead)), str(rng.choice([f"+4930{rng.integers(10**6, 10**7)}", f"0{rng.integers(10**5, 10**6)}", f"u{rng.integers(50)}@x.org", "8" * 120, f"AB-{rng.integers(10**6)}", str(rng.choice(words_))])), str(rng.choice(words_))]
        made.append((i, " ".join(parts)))
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()]), (spark.createDataFrame(made, "doc_id long, text string"), made)):
        want = brute_identifiers(rows)
        flat = sorted(((i, ",".join(f"id:{a}:{b}" for a, b in sorted(want.get(n, ())))) for n, (i, _) in enumerate(rows)), key=str)
        for lookup in (pii.LOOKUP, 0):
            got = sorted(((r.doc_id, ",".join(x for x in r.spans.split(",") if x.startswith("id:"))) for r in pii.digests(pii.personal_data(df, lookup)).collect()), key=str)
            assert got == flat
    assert sum(len(v) for v in brute_identifiers(made).values()) > 50


def test_personal_data_keeps_clashing_columns(spark):
    schema = "doc_id long, text string, email string, id string, row string, tokens long, row_no long, `walked.x` string, lookup string"
    rows = [(1, "mail a@b.org now", "e", "i", "r", 7, 8, "w", "l"), (None, None, None, None, None, None, None, None, None), (2, "", "e", "i", "r", 7, 8, "w", "l")]
    df = spark.createDataFrame(rows, schema)
    for lookup in (pii.LOOKUP, 0):
        out = pii.redacted(df, lookup)
        assert out.columns == df.columns and sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "mail [EMAIL] now", *rows[0][2:]), rows[1], rows[2]], key=str)


def test_many_spans_in_one_text(spark):
    n = 5_000
    df = spark.createDataFrame([(1, " ".join(f"u{i}@x.org 1.2.3.{i % 256}" for i in range(n)))], "doc_id long, text string")
    row = pii.digests(pii.personal_data(df)).first()
    assert row.n_email == row.n_ip == n and pii.redacted(df).first().text == " ".join(["[EMAIL] [IP]"] * n)


def test_bpe_equals_library(documents, odd, empty):
    from tokenizers import Tokenizer

    path = vocabulary()
    library = Tokenizer.from_file(path)
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        want = []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        encoded = bpe.encode(df, path)
        assert sorted((tuple(r) for r in encoded.collect()), key=str) == sorted(want, key=str)
        assert sorted(((r.doc_id, r.text) for r in bpe.decode(encoded, path).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.encode(empty, path).collect() == []


MIXED = [chr(c) for c in range(0x21, 0x7F)] + list("    \n\t\r　 \x1c\x85 ​日本語中文字かなカナ한국어éüßñœåÄÖÜ١٢٣४५²½Ⅷ①абвгдеё🙂😀שלוםمرحبا") + ["'s", "'ll", "'re", "<|endoftext|>", " '", "!'s", "é", "  ", "\n\n"]


def test_bpe_equals_library_on_random_texts():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(vocabulary()), bpe.codec(vocabulary()), np.random.default_rng(0)
    for _ in range(4000):
        text = "".join(rng.choice(MIXED, int(rng.integers(1, 60))))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text, share", [(" ".join("日本語中文字かなカナ" * 300), 0.1), ("日本語中文字かなカナ" * 300, 0.1), (base64.b64encode(bytes(np.random.default_rng(1).integers(0, 256, 6000, dtype=np.uint8))).decode(), 0.3), ("plain words of a text. " * 100, 0.1)])
def test_bpe_cuts_texts_of_every_kind(text, share):
    from tokenizers import Tokenizer

    own, raw = bpe.codec(vocabulary()), np.frombuffer(text.encode(), np.uint8)
    assert own.cut[raw[:-1].astype(np.int64) * 256 + raw[1:]].mean() > share  # white space is not needed
    assert own.encode(raw, np.array([0, len(raw)]))[0].tolist() == Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    from paperlane.llm import arrowtext as at

    monkeypatch.setattr(at, "spans_hash", lambda buf, start, end: np.zeros(len(start), np.uint64))
    buf = np.frombuffer(b"ab cd ab abc", np.uint8)
    where, back = at.distinct_spans(buf, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12]))
    assert where.tolist() == [0, 1, 3] and back.tolist() == [0, 1, 0, 2]


def test_token_counts(documents, odd, empty):
    pieces = token_counts.byte_level_pieces(vocabulary())
    longest = max(map(len, pieces))

    def greedy(word):
        n, i = 0, 0
        while i < len(word):
            k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
            if not k:
                return 1
            n, i = n + 1, i + k
        return n

    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        known = {}
        want = {(i, len(words(t)), sum(known.setdefault(w, greedy(b" " + w.encode())) for w in words(t))) for i, t in rows}
        got = {tuple(r) for r in token_counts.token_counts(df, vocabulary()).collect()}
        assert want == got
    assert token_counts.token_counts(empty, vocabulary()).collect() == []


def test_automaton_walks_long_words_alone():
    """Megabytes in one word, beside others: as many pieces as repeats of a part that ends where a piece does, or one where there is no way."""
    machine = token_counts.Automaton({b" ab", b" a", b"b", b"abc"}, {b"ab", b"b", b"abc", b"c"})
    long, dead = b"ababc" * 400_000, b"ab" * 300_000 + b"x"
    data = np.frombuffer(long + b"abab" + dead, np.uint8)
    edges = np.cumsum([0, len(long), 4, len(dead)])
    assert machine.lengths(data, edges[:-1], edges[1:], b" ").tolist() == [2 * 400_000, 2, 1]


@pytest.mark.parametrize("few", [0, token_counts.FEW])
def test_automaton_with_gaps_and_inner_pieces(monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    rng = np.random.default_rng(2)
    letters = b"ab"
    for _ in range(60):
        first, inner = ({bytes(rng.choice(list(letters), int(rng.integers(1, 5)))) for _ in range(5)} for _ in range(2))
        machine = token_counts.Automaton(first, inner)
        for _ in range(30):
            word = bytes(rng.choice(list(letters), int(rng.integers(1, 12))))
            n, i, pieces = 0, 0, first
            while i < len(word):
                k = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in pieces), 0)
                if not k:
                    n = 1
                    break
                n, i, pieces = n + 1, i + k, inner
            assert machine.lengths(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] == n


def brute_fingerprints(rows):
    signed = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + 2**63) % 2**64
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), (r[1] or "").encode()))
    texts = [t or "" for _, t in order]

    def fp(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return fingerprints.fingerprint_words(raw, np.array([0, len(raw)])).tobytes().hex()

    out = []
    for k, (i, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half] if half else t
        like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), fp(e), like(fp(t), fp(e)), like(fp(t), fp(nxt))))
    return sorted(out, key=str)


def test_fingerprints(documents, odd, empty):
    for df, rows in ((odd, TEXTS), (documents, [(r.doc_id, r.text) for r in documents.collect()]), (odd.limit(1), TEXTS[:1])):
        got = sorted((tuple(r) for r in fingerprints.fingerprints(df).collect()), key=str)
        assert got == brute_fingerprints(rows)
    assert fingerprints.fingerprints(empty).collect() == []


def test_fingerprint_votes_by_definition():
    from paperlane.llm import arrowtext as at

    text = "a b a b c a b a b"
    raw = np.frombuffer(text.encode(), np.uint8)
    word, _ = at.words(raw, np.array([0, len(raw)]))
    term = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
    got = fingerprints.fingerprint_words(raw, np.array([0, len(raw)]))[0]
    for half in (0, 1):
        h = at.mix(term + np.uint64(half * 0x632BE59BD9B4E019 + 1))
        votes = [sum(1 if int(x) >> b & 1 else -1 for x in h) for b in range(64)]
        assert int(got[half]) == sum(1 << b for b, v in enumerate(votes) if v > 0)


@pytest.mark.parametrize("radius", [3, 4])
def test_within_radius(spark, radius):
    rng = np.random.default_rng(radius)
    prints = {bytes(rng.integers(0, 256, 16, dtype=np.uint8)) for _ in range(60)} | {bytes(16), b"\xff" * 16}
    for p in list(prints):
        for n in (1, 3, 4, 5):
            b = int.from_bytes(p, "big")
            for bit in rng.choice(128, n, replace=False):
                b ^= 1 << int(bit)
            prints.add(b.to_bytes(16, "big"))
    hexes = sorted(p.hex() for p in prints)
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b, apart(a, b)) for i, a in enumerate(hexes) for b in hexes[i + 1 :] if apart(a, b) <= radius}
    got = [tuple(r) for r in fingerprints.within_radius(spark.createDataFrame([(h,) for h in hexes + hexes[:5] + [None]], "fingerprint string"), radius).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_fingerprint_query_counts_near_ones(spark, sf_dir):
    out = queries()["op6_document_fingerprints"](spark, sf_dir).collect()
    one = sorted({r.fingerprint for r in out})
    want = {a: sum(a != b and bin(int(a, 16) ^ int(b, 16)).count("1") <= fingerprints.RADIUS for b in one) for a in one}
    assert all(r.n_near == want[r.fingerprint] for r in out)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, _, t in held if t], [s for s, _, t in held if not t]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9
    assert np.mean([p == t for _, p, t in held]) > 0.94


def test_toxicity_awkward_rows(odd, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.filter("false")).collect()) == len(TEXTS)


def plain_terms(text):
    """The terms of a text as (bytes, prefix length or None), in plain Python."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    found = re.findall(b"(?:[A-Za-z0-9]|[\x80-\xff]|[\x00-\x08\x0e-\x1f])+", low)
    return {(w, None) for w in found} | {(w[:k], k) for w in found for k in toxicity.PREFIXES if len(w) > k}


def term_hash(term):
    from paperlane.llm import arrowtext as at

    raw = np.frombuffer(term[0], np.uint8)
    return int(at.spans_hash(raw, np.array([0]), np.array([len(raw)]))[0] + np.uint64(term[1] or 0))


def test_toxicity_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    mark = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = spark.createDataFrame([(texts[i], bool(t)) for i, t in mark.items()], "text string, toxic boolean")
    n1, n0 = sum(mark.values()), len(mark) - sum(mark.values())
    # terms: counts of rows that hold them, and the test that they pass
    toxic, clean = (Counter(t for i, v in mark.items() if v == kind for t in plain_terms(texts[i])) for kind in (1, 0))
    counts = {term_hash(t): (toxic[t], clean[t]) for t in toxic.keys() | clean.keys()}
    table = toxicity.term_counts(sample)
    assert {r.term % 2**64: (r.toxic, r.clean) for r in table.collect()} == counts

    def passes(a, b):
        g = 2 * sum(x * np.log(x / (n * (a + b) / (n1 + n0))) for x, n in ((a, n1), (b, n0)) if x)
        return a >= toxicity.MIN_ROWS and ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)) > toxicity.MIN_ODDS and g > toxicity.MIN_G

    terms, lean = toxicity.lexicon_terms(table, n1, n0)
    assert set(terms.tolist()) == {h for h, (a, b) in counts.items() if passes(a, b)} and len(terms) > 10
    # the fitted model's scores are the logistic function of the weights of a text's terms
    model = toxicity.train(docs, labels)
    assert set(model.terms.tolist()) == set(terms.tolist())
    weight = dict(zip(model.terms.tolist(), model.weights.tolist()))
    for r in toxicity.scored(docs, model).collect():
        z = model.bias + sum(weight.get(h, 0.0) for h in {term_hash(t) for t in plain_terms(texts[r.doc_id])})
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_label_model_by_plain_loops():
    rng = np.random.default_rng(3)
    votes = rng.integers(-1, 2, (60, 5)).astype(np.int8)
    model, q = toxicity.fit_label_model(votes, np.where(votes[:, 0] > 0, 0.9, 0.1), turns=4), np.where(votes[:, 0] > 0, 0.9, 0.1)
    for _ in range(4):
        p = [[[(sum((q[i] if c else 1 - q[i]) for i in range(60) if votes[i, j] == v) + 0.5) / (sum(q if c else 1 - q) + 1.5) for v in (-1, 0, 1)] for c in (0, 1)] for j in range(5)]
        prior = min(max(sum(q) / 60, 0.01), 0.99)
        mean = [[p[j][c][2] - p[j][c][0] for c in (0, 1)] for j in range(5)]
        rest = [[votes[i, j] - q[i] * mean[j][1] - (1 - q[i]) * mean[j][0] for j in range(5)] for i in range(60)]
        cov = [[sum(rest[i][a] * rest[i][b] for i in range(60)) / 60 for b in range(5)] for a in range(5)]
        share = [1 / max(1, sum(min(max(cov[a][b] / np.sqrt(cov[a][a] * cov[b][b]), 0), 1) for b in range(5))) for a in range(5)]
        odds = [sum(share[j] * np.log(p[j][1][votes[i, j] + 1] / p[j][0][votes[i, j] + 1]) for j in range(5)) + np.log(prior / (1 - prior)) for i in range(60)]
        q = np.array([1 / (1 + np.exp(-o)) for o in odds])
    assert np.allclose(model.posterior(votes), q) and np.allclose(model.table, p)


def test_toxicity_takes_one_text_of_a_labelled_id(spark):
    rows = [(1, f"vile words here {i % 2}") for i in range(500)] + [(i, "vile words here again" if i % 2 else "nice words here now") for i in range(2, 60)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame([r for k, r in enumerate(rows) if k == 0 or r[0] != 1] , "doc_id long, text string")
    a, b = toxicity.train(docs, labels), toxicity.train(once, labels)
    assert len(a.terms) == len(b.terms) > 0 and np.allclose(a.weights, b.weights)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    acc = [0.95, 0.8, 0.65, 0.8]
    votes = np.stack([np.where(rng.random(6000) < a, y, ~y) * 2 - 1 for a in acc] , axis=1).astype(np.int8)
    votes = np.concatenate([votes, votes[:, 2:3], votes[:, 2:3]], axis=1)  # a voter repeated twice
    model = toxicity.fit_label_model(votes, 0.3 + 0.4 * (votes[:, 0] > 0))
    assert 0.2 < model.prior < 0.45 and (model.table[:, 1, 2] > 0.5).all() and (model.table[:, 0, 2] < 0.5).all()
    assert model.share[2] < 0.4 < model.share[1] and model.correlation[2, 4] > 0.99
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.84


def small_model(n=400, seed=0):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 500, n))[::-1].astype(np.int64)
    lo = masked_lm.classes(counts)
    m = masked_lm.Model(np.unique(rng.integers(1, 2**63, 2 * n).astype(np.uint64))[:n], counts, lo, 777, masked_lm.initial(counts, lo, 777))
    for k in m.p:
        m.p[k] = m.p[k] + rng.standard_normal(m.p[k].shape).astype(np.float32) * 0.3
    return m


def plain_log_probability(m, word, near):
    """Of one word given its neighbours' ids, with loops and no tables; double precision."""
    p = {k: v.astype(float) for k, v in m.p.items()}
    x = np.concatenate([p["e"][i] for i in near])
    h = np.maximum(x @ p["w"] + p["b"], 0)
    soft = lambda z: z - np.log(sum(np.exp(v) for v in z))
    k = next((k for k in range(len(m.lo) - 1) if m.lo[k] <= word < m.lo[k + 1]), len(m.lo) - 1)
    lp = soft(h @ p["u"] + p["c"])[k]
    if k < len(m.lo) - 1:
        lo, hi = m.lo[k], m.lo[k + 1]
        lp += soft(np.array([h @ p["o"][j] + p["d"][j] for j in range(lo, hi)]))[word - lo]
    return lp


def test_masked_lm_probabilities():
    m, near = small_model(), [3, 401, 0, 399]
    n = len(m.words)
    lp = masked_lm.log_probabilities(m, m.p, np.arange(n + 1), np.tile(near, (n + 1, 1)))
    assert np.allclose(lp, [plain_log_probability(m, w, near) for w in range(n + 1)], atol=1e-4) and abs(np.exp(lp).sum() - 1) < 1e-4
    share = masked_lm.rare_share(np.array([700, 77, 0]), m.rare)  # two words, and all unseen ones
    assert abs(np.exp(share).sum() - 1) < 1e-9


def test_masked_lm_gradients():
    m, rng = small_model(60), np.random.default_rng(1)
    ids, near = rng.integers(0, 61, 200), rng.integers(0, 62, (200, 4)).astype(np.int32)
    near[near == 61] = 60
    g = masked_lm.gradients(m, m.p, ids, near)
    loss = lambda p: -np.mean([plain_log_probability(masked_lm.Model(m.words, m.counts, m.lo, m.rare, p), i, x) for i, x in zip(ids, near)])
    for k in m.p:
        for _ in range(3):
            at_ = tuple(int(rng.integers(s)) for s in m.p[k].shape)
            if k == "e" and at_[0] > 60:
                continue
            up, down = ({x: v.astype(float) for x, v in m.p.items()} for _ in range(2))
            up[k][at_] += 1e-4
            down[k][at_] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - g[k][at_]) < 1e-4, (k, at_)


def lower(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)]


def word_hash(w):
    b = np.frombuffer(w.encode(), np.uint8)
    return masked_lm.at.words(b, np.array([0, len(b)]))[0][0]


def test_masked_lm_by_brute_force(spark, documents, odd, empty, monkeypatch):
    """Counts, vocabulary and every document's score, token by token."""
    monkeypatch.setattr(masked_lm, "VOCABULARY", 300)
    monkeypatch.setattr(masked_lm, "HOME", 3000)
    for df, rows in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (odd, TEXTS)):
        count = Counter(w for _, t in rows for w in lower(t))
        blocks = masked_lm.written(masked_lm.packed(df), "blocks")
        totals, homes = masked_lm.counted(blocks)
        m = masked_lm.trained(blocks, masked_lm.untrained(totals))
        assert homes > 1 or df is odd
        order = sorted(count, key=lambda w: (-count[w], int(word_hash(w).view(np.int64))))[:300]
        assert m.words.tolist() == [int(word_hash(w)) for w in order] and m.counts.tolist() == [count[w] for w in order] and m.rare == sum(count.values()) - m.counts.sum()
        rank = {w: k for k, w in enumerate(order)}
        got = {(r.doc_id, r.n_words): r for r in masked_lm.scored(df).collect()}
        assert len(masked_lm.scored(df).collect()) == len(rows)
        for i, t in sorted(rows, key=str)[:: max(1, len(rows) // 12)]:
            w = lower(t)[:2000] if i != 13 and i != 14 else lower(t)
            if len(w) > 2000 or len(lower(t)) > 2000:
                continue
            ids = [len(order) + 1] * 2 + [rank.get(x, len(order)) for x in w] + [len(order) + 1] * 2
            want = sum(plain_log_probability(m, ids[k], [ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]]) + (0 if x in rank else np.log(count[x] / (m.rare + 1))) for k, x in enumerate(w, 2))
            assert abs(got[i, len(w)].log_likelihood - want) < 1e-3 * (1 + len(w)) ** 0.5, i
            assert got[i, len(w)].per_word is None if not w else abs(got[i, len(w)].per_word - want / len(w)) < 1e-3
    assert masked_lm.scored(empty).collect() == []


def test_masked_lm_learns_from_both_sides(documents, spark):
    rng = np.random.default_rng(0)
    cycle = [f"w{k}" for k in range(50)]
    made = spark.createDataFrame([(i, " ".join(cycle[(int(s) + k) % 50] for k in range(200))) for i, s in enumerate(rng.integers(0, 50, 2000))], "doc_id long, text string")
    mean = lambda df, rounds: (lambda r: r[0] / r[1])(masked_lm.scored(df, rounds).selectExpr("sum(log_likelihood)", "sum(n_words)").first())
    assert mean(made, 2) > mean(made, 0) + 1 and mean(documents, 2) > mean(documents, 0)


def test_masked_lm_whatever_the_partitions(documents, spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "BLOCK_BYTES", 60_000)
    one = {r.doc_id: r.log_likelihood for r in masked_lm.scored(documents.repartition(2)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = {r.doc_id: r.log_likelihood for r in masked_lm.scored(documents.repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one.keys() == other.keys() and all(abs(v - other[k]) < 1e-4 * (1 + abs(v)) for k, v in one.items())


def test_bpe_keeps_fragments_within_bounds(monkeypatch):
    """A fragment of a megabyte is encoded and not kept; the cache starts anew beyond its bytes, and ids stay the library's."""
    monkeypatch.setattr(bpe, "KEEP_BYTES", 20_000)
    codec, rng = bpe.Codec(vocabulary()), np.random.default_rng(8)
    rounds = [["0" * 1_000_000, "a-" * 50]] + [[" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60)) for _ in range(4)] for _ in range(12)]
    most = 0
    for texts in rounds:
        raw = [t.encode() for t in texts]
        ids, offs = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [codec.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert all(len(k) <= bpe.LONGEST_KEPT for k in codec.known) and codec.kept == sum(len(k) + len(v) + bpe.ENTRY for k, v in codec.known.items())
        most = max(most, codec.kept)
    assert 20_000 < most < 20_000 + 4 * 60 * 400
