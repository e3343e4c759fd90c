"""N-gram Jaccard join: near-duplicate documents by adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link
when ``100 * |x & y| >= 75 * |x | y|``. The steps, each a Spark stage over all documents:

1. *Classes.* Documents with equal sets are one class, so copies cost one row each.
2. *Screen.* The shingles in the lowest ``SCREEN_SHARE`` of the hash range are counted exactly, in
   packed blocks dealt out by shingle; of one shingle a task sends two owners at most. A class with more
   unshared shingles than its similarity allows it to miss has no partner at all and leaves.
3. *Prefixes.* Among the classes left all shingles are counted, which gives one global order,
   rarest first: a packet of sets sends each of its distinct shingles once, with its count in the packet, and gets
   back its frequency. For every class and each length ``l`` the prefix of ``n - ceil(3n/4) + l``
   shingles has an estimated cost: the postings it reads, and the candidates (at most postings / l)
   it has to verify. The class takes the cheapest ``l``. Two similar sets share at least
   ``min(lx, ly)`` shingles of their prefixes, and fewer shared ones need no verification. Nor do pairs
   whose shared prefix shingles, with all that stands after a prefix, fall short of the overlap asked for.
4. *Leaders.* On every posting list the most typical member stands for all others; each class is compared
   with the one of its lists' leaders that it has most in common with. So a round verifies one pair a class at
   most, and a group of thousands of near copies never becomes all its pairs.
5. *Rest.* Members of other components than the list's largest one are searched exhaustively, in
   blocks, and compared with everything they may match, until each pair is linked, shown unlike, or
   known to be in one component. No cap, no sampling: components are those of all true links.

So no posting list ever stands in one task: frequencies come from partial counts, long lists are split by a salt
(``SPLIT`` members each), and what a block has to search is split in parts of ``PART`` postings and ``MATCHES`` possible
matches at most; what these find is verified in groups of some ``GROUP`` shingles. Rows of one
large class, and vertices of one large component, meet a broadcast of its label (see ``left_join``), links bring
their components along, and a leader's set is copied for every ``SPLIT`` groups that ask for it.

``near_duplicates`` gives classes; ``similar_pairs`` gives every link between different sets, which in a group
of m near copies is up to m * m of them, and the classes' members.

Results: rows without a doc_id get a null component and link nothing; null and empty texts have
an empty set and link nothing; repeated rows are one class; rows that share a doc_id but not a text
are compared as separate texts. Columns other than the two named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import arrowtext as at
from .components import components
from .shared import HOT_SHARE, bucketed, deleted, dropped, left_join, recorded, written

SCREEN_SHARE = 0.3
BLOCK_TOKENS = 1_500_000
FLUSH_TOKENS = 3_000_000
MAX_MATCHES = 8
BLOCK_DOCS = 256
#: Shingles in a packet of sets, members of a piece of a posting list, postings that a part of a block searches, and pairs in a row.
PACKET, SPLIT, PART, PAIRS = 1_000_000, 512, 100_000, 4096
#: Matches that a part of a block may find, and shingles of the sets that are verified together.
MATCHES, GROUP = 4_000_000, 16_000_000
ROUNDS = 3
_PROBE, _VERIFY = 1.0, 0.02


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = at.mix(s + np.uint64(1)).sum(), at.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return int(at.mix(np.array([a], np.uint64)).view(np.int64)[0]), int(at.mix(np.array([b + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    buf, offs = at.flat(batch.column("text"))
    for _, _, b, o in at.slices(buf, offs):
        yield from at.shingles(*at.words(b, o), k)


def shingle_keys(docs: DataFrame, k: int = 5, carried: bool = False) -> DataFrame:
    """doc_id, n_shingles and the 128-bit key of the shingle set (null for empty sets); all columns as a struct ``row``, if carried."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carried else []))
    fields = [f for f in own.schema if f.name != "text"]
    schema = StructType([*fields, *(StructField(c, LongType()) for c in ("n_shingles", "key1", "key2"))])

    def run(batches):
        for batch in batches:
            n, k1, k2 = [], [], []
            for s in _sets(batch, k):
                n.append(len(s))
                a, b = _key(s) if len(s) else (None, None)
                k1.append(a)
                k2.append(b)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], schema.names)

    return own.mapInArrow(run, schema)


_PACKED = "block int, ids binary, counts binary, tokens binary"


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _packed(ids: list[int], token: np.ndarray, doc: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block each: for every document its id, its number of tokens in the block, and those tokens."""
    block = (token % np.uint64(blocks)).astype(np.int64)
    order, offs = at.scatter(block, blocks)
    token, doc, block = token[order], doc[order], block[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(doc))).astype(np.uint32)
    per = np.concatenate(([0], np.cumsum(np.bincount(block[edge], minlength=blocks))))
    full = np.flatnonzero(np.diff(offs))
    if len(full) == 0:
        return
    o, p = np.append(offs[full], offs[-1]), np.append(per[full], per[-1])
    one = doc[edge]
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), at.binaries(np.array(ids, np.int64)[one], p), at.binaries(count, p), at.binaries(token, o)],
        ["block", "ids", "counts", "tokens"],
    )


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token and id of every (token, id) once, ordered by both."""
    parts = [(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32), np.frombuffer(t, np.uint64)) for i, c, t in zip(*(rows.column(x).to_pylist() for x in ("ids", "counts", "tokens")))]
    doc = np.concatenate([np.repeat(i, c) for i, c, _ in parts])
    token = np.concatenate([t for *_, t in parts])
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])))
    return token[new], doc[new]


def _two_owners(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two postings of every token: enough to know a shared one, however many hold it."""
    order = np.argsort(token, kind="stable")
    t = token[order]
    third = np.zeros(len(t), bool)
    third[2:] = t[2:] == t[:-2]
    keep = np.sort(order[~third])
    return token[keep], doc[keep]


def _frequency(token: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(edge, len(token)))
    return np.repeat(count, count)


def _blocks(rows: float, each: float) -> int:
    return max(1, int(np.ceil(rows / each)))


def unshared(docs: DataFrame, n_tokens: int, k: int = 5) -> DataFrame:
    """For each set key the number of its shingles, of the lowest SCREEN_SHARE of hashes, that no other set has."""
    limit = np.uint64(int(SCREEN_SHARE * 2**64))
    blocks, homes = _blocks(n_tokens * SCREEN_SHARE, BLOCK_TOKENS), _blocks(n_tokens * SCREEN_SHARE, 4 * BLOCK_TOKENS)

    def deal(batches):
        ids, sets, seen, held = [], [], set(), 0
        for batch in batches:
            for s in _sets(batch, k):
                if not len(s) or (key := _key(s)[0]) in seen:
                    continue
                seen.add(key)  # copies within a task are combined here
                low = s[: np.searchsorted(s, limit)]
                ids.append(key)
                sets.append(low)
                held += len(low)
                if held >= FLUSH_TOKENS:
                    yield from _packed(ids, *_two_owners(*_flat(sets)), blocks)
                    ids, sets, seen, held = [], [], set(), 0
        if sets:
            yield from _packed(ids, *_two_owners(*_flat(sets)), blocks)

    def count(rows: pa.Table) -> pa.Table:
        token, doc = _unpacked(rows)
        lone, n = np.unique(doc[_frequency(token) == 1], return_counts=True)
        order, offs = at.scatter((lone % homes).astype(np.int64), homes)
        full = np.flatnonzero(np.diff(offs))
        o = np.append(offs[full], offs[-1])
        return pa.table({"home": pa.array(full.astype(np.int32)), "ids": at.binaries(lone[order], o), "counts": at.binaries(n[order].astype(np.uint32), o)})

    def total(rows: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
        one, where = np.unique(ids, return_inverse=True)
        return pa.table({"key1": pa.array(one), "lone": pa.array(np.bincount(where, n).astype(np.int64))})

    dealt = docs.filter("doc_id is not null").select("text").mapInArrow(deal, _PACKED)
    return dealt.groupBy("block").applyInArrow(count, "home int, ids binary, counts binary").groupBy("home").applyInArrow(total, "key1 long, lone long")


def _allowed(n):
    """How many shingles of a set of n may be missing in a similar set: n - ceil(3n/4)."""
    return n // 4


def _beyond(n, ell):
    """How many shingles of a set of n stand after its prefix."""
    return np.maximum(n - _allowed(n) - ell, 0)


def surviving_sets(docs: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """vertex, n and the shingles of the classes given, from one document of each."""

    def run(batches):
        for batch in batches:
            keep, data = [], []
            for i, s in enumerate(_sets(batch, k)):
                if len(s) and _key(s) == (batch.column("key1")[i].as_py(), batch.column("key2")[i].as_py()):
                    keep.append(i)
                    data.append(s)
            if keep:
                offs = np.cumsum([0] + [len(s) for s in data])
                yield pa.RecordBatch.from_arrays([batch.column("vertex").take(pa.array(keep)), pa.array([len(s) for s in data], pa.int64()), at.binaries(np.concatenate(data), offs)], ["vertex", "n", "tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(classes, "doc_id").select("vertex", "key1", "key2", "text").mapInArrow(run, "vertex long, n long, tokens binary")


def choose_prefix(n: int, lone: int, df: np.ndarray) -> tuple[int, int]:
    """Number of matches asked for, and of shared shingles (rarest first, frequencies ``df``) in the prefix.

    ``lone`` shingles nobody shares come before them. The cost of ``l`` is the postings read and,
    for at most postings / l candidates, verification in proportion to n.
    """
    most = max(1, min(MAX_MATCHES, n - _allowed(n)))
    ell = np.arange(1, most + 1)
    take = np.clip(np.minimum(_allowed(n) + ell, n) - lone, 0, len(df))
    postings = np.concatenate(([0], np.cumsum(df - 1)))[take]
    cost = postings * _PROBE + postings / ell * (n * _VERIFY)
    best = int(np.argmin(cost))
    return int(ell[best]), int(take[best])


def prefixes(sets: DataFrame, n_tokens: int) -> DataFrame:
    """token, vertex, n, lone, ell, df: the shared part of every class's prefix under the global order (frequency, hash), and the token's frequency."""
    blocks = _blocks(n_tokens, BLOCK_TOKENS)

    def pack(batches):
        from pyspark import TaskContext

        packet, held, n = TaskContext.get().partitionId() << 32, [], 0

        def row():
            ids, sizes, tokens = zip(*held)
            data = [np.array(ids, np.int64), np.array(sizes, np.uint32), np.concatenate(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([packet], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["packet", "ids", "sizes", "tokens"])

        for batch in batches:
            for v, size, data in zip(batch.column("vertex").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist()):
                held.append((v, size, np.frombuffer(data, np.uint64)))
                n += size
                if n >= PACKET:
                    yield row()
                    packet, held, n = packet + 1, [], 0
        if held:
            yield row()

    def dealt(tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens in order of their blocks, the blocks' offsets, counts, and for each token of the packet its place there."""
        one, back, count = np.unique(np.frombuffer(tokens, np.uint64), return_inverse=True, return_counts=True)
        order, cut = at.scatter((one % np.uint64(blocks)).astype(np.int64), blocks)
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        return one[order], cut, count[order], place[back]

    def ask(batches):
        for batch in batches:
            for packet, tokens in zip(batch.column("packet").to_pylist(), batch.column("tokens").to_pylist()):
                one, cut, count, _ = dealt(tokens)
                full = np.flatnonzero(np.diff(cut))
                o = np.append(cut[full], cut[-1])
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), packet)), at.binaries(one, o), at.binaries(count.astype(np.uint32), o)], ["block", "packet", "tokens", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
        one, back = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(back, count, len(one)).astype(np.uint32)[back]
        return pa.table({"packet": rows.column("packet"), "block": rows.column("block"), "dfs": at.binaries(df, np.cumsum([0] + [len(t) for t in tokens]))})

    def choose(packets: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        known = dict(zip(answers.column("block").to_pylist(), answers.column("dfs").to_pylist()))
        for ids, sizes, tokens in zip(*(packets.column(c).to_pylist() for c in ("ids", "sizes", "tokens"))):
            _, cut, _, place = dealt(tokens)
            of = np.concatenate([np.frombuffer(known[b], np.uint32) for b in np.flatnonzero(np.diff(cut)).tolist()])
            df, token, sizes = of[place].astype(np.int64), np.frombuffer(tokens, np.uint64), np.frombuffer(sizes, np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            many = df > 1
            doc, df, token = doc[many], df[many], token[many]
            order = np.lexsort((token, df, doc))
            doc, df, token = doc[order], df[order], token[order]
            edge = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc)) if len(doc) else np.zeros(1, np.int64)
            vertex = np.frombuffer(ids, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                n = int(sizes[doc[a]])
                lone = n - (b - a)
                if lone > _allowed(n):
                    continue
                ell, take = choose_prefix(n, lone, df[a:b])
                out.append((token[a : a + take].view(np.int64), np.full(take, vertex[doc[a]]), np.full(take, n), np.full(take, lone), np.full(take, ell), df[a : a + take]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table({c: pa.array(x.astype(np.int64)) for c, x in zip(("token", "vertex", "n", "lone", "ell", "df"), cols)})

    packets, _ = bucketed(sets.mapInArrow(pack, "packet long, ids binary, sizes binary, tokens binary"), "packets", "packet", dealt=True)
    asked = packets.select("packet", "tokens").mapInArrow(ask, "block int, packet long, tokens binary, counts binary")
    answers = asked.groupBy("block").applyInArrow(answer, "packet long, block int, dfs binary")
    return packets.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(choose, "token long, vertex long, n long, lone long, ell long, df long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= 75 * (len(a) + len(b) - same)


def verified(pairs: DataFrame, sets: DataFrame, every: bool = False) -> DataFrame:
    """The links (a, b) among pairs, with their components before (ca, cb); unless ``every`` is wanted, a pair already joined through others of its group is skipped.

    pairs: block, part, piece (which name a group) and arrays of up to some thousand pairs: xs, ys, cx, cy (their components),
    and ``vertices``, the distinct ones among them. A vertex's set goes to each group that names it, once.
    """
    to = ["to", "to_part", "to_piece"]
    need = written(pairs.select(*[(F.col(c) + 0).alias(t) for c, t in zip(("block", "part", "piece"), to)], F.explode("vertices").alias("vertex")).distinct(), "need")
    # fewer than HOT_SHARE vertices, by name only; sets may be long, so they are not broadcast
    hot = F.broadcast(need.groupBy("vertex").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") * HOT_SHARE > need.count()))
    cold = need.join(hot, "vertex", "left_anti").join(sets, "vertex").select(*to, "vertex", "tokens")
    asked = need.join(hot, "vertex").withColumn("salt", F.pmod(F.xxhash64(*to), _pieces()).cast("int")).drop("df")
    need = cold.unionByName(asked.join(_each_piece(sets.join(hot, "vertex")), ["vertex", "salt"]).select(*to, "vertex", "tokens"))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {v: np.frombuffer(t, np.uint64) for v, t in zip(right.column("vertex").to_pylist(), right.column("tokens").to_pylist())}
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (p := root.get(c, c)) != c:
                root[c] = root.get(p, p)
                c = p
            return c

        links: list[tuple[int, int, int, int]] = []
        for row in zip(*(left.column(c) for c in ("xs", "ys", "cx", "cy"))):
            for x, y, cx, cy in zip(*(v.values.to_pylist() for v in row)):
                p, q = (cx, cy) if every else (find(cx), find(cy))
                if p == q and not every:
                    continue
                if _similar(sets[x], sets[y]):
                    root[max(p, q)] = min(p, q)
                    links.append((x, y, cx, cy))
        return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate(("a", "b", "ca", "cb"))})

    return pairs.groupBy("block", "part", "piece").cogroup(need.groupBy(*to)).applyInArrow(check, "a long, b long, ca long, cb long")


def _pieces() -> Column:
    """Into how many pieces a token's list is split."""
    return F.ceil(F.col("df") / SPLIT).cast("int")


def _salt(vertex: str = "vertex") -> Column:
    return F.pmod(F.xxhash64(vertex), _pieces()).cast("int")


def _each_piece(lists: DataFrame) -> DataFrame:
    """A table with one row a token (and df) for every piece of the token's list."""
    return lists.withColumn("salt", F.explode(F.sequence(F.lit(0), _pieces() - 1))).drop("df")


def _open_lists(prefix: DataFrame) -> DataFrame:
    """The rows of posting lists that still span two components or more, with the piece (``salt``) they are in."""
    spans = prefix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("df").alias("df")).filter("lo < hi").select("token", "df")
    return prefix.withColumn("salt", _salt()).join(_each_piece(spans), ["token", "salt"])


def _relabelled(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, drawn between the old components."""
    label = written(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("new")), "labels")
    return left_join(open_, label, ["component"]).select("token", "vertex", "n", "lone", "ell", "df", F.coalesce("new", "component").alias("component"))


def _leader_pairs(open_: DataFrame, seed: int, blocks: int) -> DataFrame:
    """On each list its most typical member (fewest lone shingles; ties by a hash of the round) with every other one; of a vertex's leaders the one with most in common."""
    lead = open_.groupBy("token").agg(F.min(F.struct(F.floor(F.lit(16) * F.col("lone") / F.col("n")).alias("r"), F.xxhash64("vertex", F.lit(seed)).alias("h"), F.col("vertex").alias("y"), F.col("n").alias("ny"), F.col("ell").alias("ly"), F.col("component").alias("cy"))).alias("lead"), F.max("df").alias("df"))
    pairs = open_.join(_each_piece(lead), ["token", "salt"]).select(F.col("vertex").alias("x"), F.col("n").alias("nx"), F.col("ell").alias("lx"), F.col("component").alias("cx"), "lead.y", "lead.ny", "lead.ly", "lead.cy")
    pairs = pairs.filter("cx <> cy and 4 * least(nx, ny) >= 3 * greatest(nx, ny)").groupBy("x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("m"), F.first(F.least("lx", "ly")).alias("asked")).filter("m >= asked")
    best = pairs.groupBy("x", "cx").agg(F.max(F.struct("m", "y", "cy")).alias("b"))  # so a round verifies one pair a vertex
    rows = best.select(F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias("block"), "x", "b.y", "cx", "b.cy")
    packed = rows.groupBy("block").agg(*[F.collect_list(c).alias(d) for c, d in (("x", "xs"), ("y", "ys"), ("cx", "cx"), ("cy", "cy"))])  # some BLOCK_DOCS pairs
    return packed.select("block", F.lit(0).alias("part"), F.lit(0).alias("piece"), "xs", "ys", "cx", "cy", F.array_union("xs", "ys").alias("vertices"))


def _rest_pairs(open_: DataFrame, blocks: int, every: bool = False) -> DataFrame:
    """Candidates with enough shared prefix shingles: of all members outside their lists' largest components, or of every member."""
    lists = open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.max("df").alias("df")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("size"), F.max("df").alias("df"))
    lists = written(lists.select("token", F.col("m.component").alias("main"), "size", "df"), "lists")
    asking = open_ if every else open_.join(_each_piece(lists.select("token", "main", "df")), ["token", "salt"]).filter("component <> main")
    block = F.pmod(F.xxhash64("vertex"), F.lit(blocks)).cast("int").alias("block")
    left = open_.join(asking.select("vertex").distinct(), "vertex").select(block, "token", "vertex", "n", "ell", "component")
    left = written(left, "asking")
    wanted = left.groupBy("block", "token").agg(F.count(F.lit(1)).alias("c")).join(lists.select("token", "size", "df"), "token")
    most = F.greatest(F.sum("size") / PART, F.sum(F.col("size") * F.col("c")) / MATCHES)
    parts = written(wanted.groupBy("block").agg(F.ceil(most).cast("int").alias("parts")), "parts")
    left = left.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    wanted = _each_piece(wanted.select("block", "token", "df").join(parts, "block"))
    right = wanted.select(F.col("block").alias("to"), "token", "salt", "parts").join(open_.withColumnRenamed("vertex", "y"), ["token", "salt"])
    right = right.select("to", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("to_part"), *[(F.col(c) + 0).alias(c) for c in ("token", "y", "n", "ell", "component")])  # new names for Spark: both sides come from one table

    def probe(xs: pa.Table, ys: pa.Table) -> pa.Table:
        x, y = ({c: t.column(c).to_numpy() for c in t.column_names} for t in (xs, ys))
        order = np.argsort(y["token"], kind="stable")
        y = {c: v[order] for c, v in y.items()}
        order = np.argsort(x["vertex"], kind="stable")
        x = {c: v[order] for c, v in x.items()}
        lo, hi = np.searchsorted(y["token"], x["token"], "left"), np.searchsorted(y["token"], x["token"], "right")
        edge = np.append(np.flatnonzero(np.concatenate(([True], x["vertex"][1:] != x["vertex"][:-1]))), len(x["vertex"])) if len(x["vertex"]) else np.zeros(1, np.int64)
        out = [[], [], [], [], []]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            at_ = np.concatenate([np.arange(p, q) for p, q in zip(lo[a:b].tolist(), hi[a:b].tolist())])
            ids, first, m = np.unique(y["y"][at_], return_index=True, return_counts=True)
            at_ = at_[first]
            n, ny = int(x["n"][a]), y["n"][at_]
            # beyond the prefix that ends first the sets share at most the rest of its set
            rest = np.maximum(_beyond(n, int(x["ell"][a])), _beyond(ny, y["ell"][at_]))
            ok = (m >= np.maximum(np.minimum(int(x["ell"][a]), y["ell"][at_]), -(-3 * (n + ny) // 7) - rest)) & (y["component"][at_] != x["component"][a]) & (4 * np.minimum(n, ny) >= 3 * np.maximum(n, ny))
            if every:
                ok &= ids > x["vertex"][a]
            best = np.argsort(-m[ok], kind="stable")
            ids, c = ids[ok][best], y["component"][at_][ok][best]
            for held, v in zip(out, (np.full(len(ids), x["vertex"][a]), ids, np.full(len(ids), x["component"][a]), c, ny[ok][best])):
                held.append(v)
        *cols, sizes = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        piece = np.cumsum(sizes) // GROUP
        cut = np.append(np.union1d(np.arange(0, len(piece), PAIRS), np.flatnonzero(np.diff(piece)) + 1), len(piece)).astype(np.int64)
        k = len(cut) - 1
        lists = [[c[a:b] for a, b in zip(cut[:-1], cut[1:])] for c in cols]
        lists.append([np.unique(np.concatenate(v)) for v in zip(lists[0], lists[1])])
        where = [np.full(k, t[0] if len(t) else 0, np.int32) for t in (x["block"], x["part"])]
        return pa.table({"block": pa.array(where[0]), "part": pa.array(where[1]), "piece": pa.array(piece[cut[:-1]].astype(np.int32))} | {c: pa.array(v, pa.list_(pa.int64())) for c, v in zip(("xs", "ys", "cx", "cy", "vertices"), lists)})

    return left.groupBy("block", "part").cogroup(right.groupBy("to", "to_part")).applyInArrow(probe, "block int, part int, piece int, xs array<long>, ys array<long>, cx array<long>, cy array<long>, vertices array<long>")


def _classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows' keys, and one row a class: key1, key2, doc_id (the least), n, twins, vertex."""
    members = written(shingle_keys(docs, k), "members")
    grouped = members.filter("key1 is not null and doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    twins = grouped.groupBy("key1").agg(F.count(F.lit(1)).alias("twins"), F.min("key2").alias("first"))
    # A vertex is the set's first key; should two sets ever share that, the others take their second key.
    return members, written(grouped.join(twins, "key1").select("key1", "key2", "doc_id", "n", "twins", F.when(F.col("key2") == F.col("first"), F.col("key1")).otherwise(F.col("key2")).alias("vertex")), "classes")


def _indexed(docs: DataFrame, classes: DataFrame, k: int) -> tuple[DataFrame, str, DataFrame]:
    """The sets of the classes that may have partners (and the table's name), and their prefixes, each class a component of its own."""
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lone = unshared(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), total, k)
    left = written(classes.join(lone, "key1", "left").filter("twins > 1 or coalesce(lone, 0) <= n div 4").select("vertex", "key1", "key2", "doc_id", "n"), "survivors")
    rest = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets, name = bucketed(surviving_sets(docs, left.drop("n"), k), "sets", "vertex")
    return sets, name, written(prefixes(sets, rest).withColumn("component", F.col("vertex")), "prefix")


def similar_pairs(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of classes with different sets, and doc_id, class_id of every row that has an id and words.

    A class is named by its least doc_id; its members link with each other and with all members of linked classes.
    """
    members, classes = _classes(docs, k)
    sets, _, prefix = _indexed(docs, classes, k)
    open_ = written(_open_lists(prefix), "open")
    blocks = _blocks(open_.agg(F.countDistinct("vertex")).first()[0], BLOCK_DOCS)
    links = written(verified(written(_rest_pairs(open_, blocks, True), "pairs"), sets, True).select("a", "b"), "links").distinct()
    of = classes.select("vertex", F.col("doc_id").alias("class_id"))
    pairs = links.join(of.toDF("a", "first"), "a").join(of.toDF("b", "second"), "b").select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))
    belong = left_join(members, written(classes.select("key1", "key2", F.col("doc_id").alias("class_id")), "names"), ["key1", "key2"])
    return pairs, belong.filter("doc_id is not null and class_id is not null").select("doc_id", "class_id")


def near_duplicates(docs: DataFrame, k: int = 5, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); see the module's text.

    With ``keys`` also key1, key2 (of the row's set) and ``leads``: whether that set is the first, by key, of those
    that bear the component's id.
    """
    spark = docs.sparkSession
    members, classes = _classes(docs, k)
    with recorded() as made:
        sets, name, prefix = _indexed(docs, classes, k)
        found = None
        for turn in range(ROUNDS + 1):
            open_ = written(_open_lists(prefix), "open")
            ask = open_.agg(F.countDistinct("vertex")).first()[0]
            if not ask:
                break
            blocks = _blocks(ask, BLOCK_DOCS)
            pairs = written(_leader_pairs(open_, turn, blocks) if turn < ROUNDS else _rest_pairs(open_, blocks), "pairs")
            links = written(verified(pairs, sets), "links")
            dropped(pairs)
            found = links if found is None else found.unionByName(links)
            if turn < ROUNDS:
                before, prefix = prefix, written(_relabelled(open_, links), "prefix")  # a list within one component stays so
                dropped(before, open_)
        label = classes.select(F.col("vertex").alias("id"), "key1", "key2", "doc_id")
        if found is not None:
            label = label.join(components(found.select("a", "b")), "id", "left").withColumn("component", F.coalesce("component", "id"))
        else:
            label = label.withColumn("component", F.col("id"))
        label = written(label, "labels")
        least = written(label.groupBy("component").agg(F.min(F.struct("doc_id", "key1", "key2")).alias("first")), "least")
        label = left_join(label, least, ["component"]).select("key1", "key2", F.col("first.doc_id").alias("component_id"), (F.col("first.key1").eqNullSafe(F.col("key1")) & F.col("first.key2").eqNullSafe(F.col("key2"))).alias("leads"))
        made_before = list(made)
        label = written(label, "labels")
    spark.sql(f"DROP TABLE {name}")
    deleted(spark, made_before)
    linked = left_join(members, label, ["key1", "key2"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return linked.select("doc_id", "n_shingles", component, *(["key1", "key2", F.coalesce("leads", F.lit(True)).alias("leads")] if keys else []))
