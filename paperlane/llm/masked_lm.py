"""Language-model scoring by masked pseudo-likelihood.

Every word is predicted from the two words on either side, and a document's score is the sum of the
logarithms of these probabilities.

Words: the ``VOCABULARY`` most frequent words of the corpus have embeddings and outputs of their own. They
are cut, by rank, into classes of equal frequency; all other words are one class more, and one neighbour. A
window network (embeddings of the four neighbours, one layer of rectified units) gives the class given both sides and, by
a softmax over the class, the word given class and both sides. A word beyond the vocabulary that occurs n
times has n / (N + 1) of its class, where N is the number of all such occurrences; all unseen words together
have 1 / (N + 1).

Documents are dealt by a hash of id and text into blocks of about ``BLOCK_BYTES``, sorted, and written once,
each with the table of its distinct words. Words are counted by home (hash): a block sends each of its
distinct words once, the home adds up, and the totals come back to the block. So the counts are of the whole
corpus and grow with it, no word's occurrences meet in one task, and neither texts nor blocks move again.

The network is trained in the tasks with numpy on every document once. Each block starts from the same
parameters and takes steps on its own documents; parameters are averaged by the words seen, ``ROUNDS`` times, each
round over other documents. Blocks, their order and all random numbers depend on the rows alone, so the number
of partitions changes nothing but rounding. A task adds up its blocks, and the tasks' sums are added in a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrowtext as at
from .shared import bucketed, partitions, written

VOCABULARY, CLASSES, WIDTH, HIDDEN, SIDE = 4096, 64, 12, 16, 2
NEAR = [d for d in range(-SIDE, SIDE + 1) if d]
ROUNDS, BATCH, RATE = 2, 8192, 0.1
FAN_IN = 32
#: Bytes of text in a block, words in a piece of one (repeated rows may fill a block), distinct words of blocks in a home.
BLOCK_BYTES, PIECE, HOME = 6 << 20, 4 << 20, 2_000_000
SLICE = 1 << 17


@dataclass
class Model:
    """Vocabulary by rank (64-bit hashes, counts), first ranks of the classes, occurrences of all other words, and parameters."""

    words: np.ndarray
    counts: np.ndarray
    lo: np.ndarray  # one more at the end
    rare: int
    p: dict[str, np.ndarray]

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]
        self.class_of = np.append(np.repeat(np.arange(len(self.lo) - 1), np.diff(self.lo)), len(self.lo) - 1)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words; the size of the vocabulary for those beyond it."""
        if not len(self.words):
            return np.zeros(len(words), np.int32)
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[place] == words, self.order[place], len(self.words)).astype(np.int32)


def classes(counts: np.ndarray) -> np.ndarray:
    """First ranks of classes of equal frequency, at most ``CLASSES`` - 1, and the number of words at the end."""
    if not len(counts):
        return np.zeros(1, np.int64)
    before = np.cumsum(counts) - counts
    group = (before * (CLASSES - 1) // counts.sum()).astype(np.int64)
    return np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(counts))


def initial(counts: np.ndarray, lo: np.ndarray, rare: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training: small random ones, and biases that give each word its share."""
    rng, size = np.random.default_rng(seed), len(counts)
    shapes = {"e": (size + 2, WIDTH), "w": (len(NEAR) * WIDTH, HIDDEN), "u": (HIDDEN, len(lo)), "o": (size, HIDDEN)}
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
    p["e"][size + 1] = 0  # beyond a document's ends
    mass = np.append(np.add.reduceat(counts, lo[:-1]) if size else np.zeros(0), rare)
    return p | {"b": np.full(HIDDEN, 0.1, np.float32), "c": np.log(mass + 1).astype(np.float32), "d": np.log(counts).astype(np.float32)}


def windows(ids: np.ndarray, first: np.ndarray, beyond: int) -> np.ndarray:
    """The neighbours of every word of documents that start at ``first`` (one more at the end), one column each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = np.full((len(ids), len(NEAR)), beyond, np.int32)
    for k, d in enumerate(NEAR):
        a, b = max(0, -d), min(len(ids), len(ids) - d)
        if a < b:
            near[a:b, k] = np.where(doc[a:b] == doc[a + d : b + d], ids[a + d : b + d], beyond)
    return near


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def gradients(m: Model, p: dict[str, np.ndarray], ids: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -log p over a batch of words."""
    of = m.class_of[ids]
    order = np.argsort(of, kind="stable")
    ids, near, of, n = ids[order], near[order], of[order], len(ids)
    x = p["e"].take(near.ravel(), axis=0).reshape(n, -1)
    h = np.maximum(x @ p["w"] + p["b"], 0)
    z = _softmax(h @ p["u"] + p["c"])
    z[np.arange(n), of] -= 1
    z /= n
    back, o, d = z @ p["u"].T, np.zeros_like(p["o"]), np.zeros_like(p["d"])
    cut = np.searchsorted(of, np.arange(len(m.lo)))
    for k in range(len(m.lo) - 1):
        (a, b), (lo, hi) = cut[k : k + 2], m.lo[k : k + 2]
        if a < b and hi - lo > 1:
            q = _softmax(h[a:b] @ p["o"][lo:hi].T + p["d"][lo:hi])
            q[np.arange(b - a), ids[a:b] - lo] -= 1
            q /= n
            o[lo:hi], d[lo:hi] = q.T @ h[a:b], q.sum(axis=0)
            back[a:b] += q @ p["o"][lo:hi]
    back *= h > 0
    into, flat = (back @ p["w"].T).reshape(-1, WIDTH), near.ravel().astype(np.int16 if len(p["e"]) < 1 << 15 else np.int32)
    order = np.argsort(flat, kind="stable")  # 16-bit keys are sorted by radix
    edge = np.flatnonzero(np.diff(flat[order], prepend=-1))
    e = np.zeros_like(p["e"])
    e[flat[order[edge]]] = np.add.reduceat(into[order], edge, axis=0)
    e[-1] = 0
    return {"e": e, "w": x.T @ back, "b": back.sum(axis=0), "u": h.T @ z, "c": z.sum(axis=0), "o": o, "d": d}


def fit(m: Model, p: dict[str, np.ndarray], memory: dict[str, np.ndarray], ids: np.ndarray, near: np.ndarray, seed: int) -> None:
    """One pass of Adagrad over the words given, in place."""
    order = np.random.default_rng(seed).permutation(len(ids))
    for i in range(0, len(ids), BATCH):
        pick = order[i : i + BATCH]
        for k, g in gradients(m, p, ids[pick], near[pick]).items():
            memory[k] += g * g
            p[k] -= RATE * g / (np.sqrt(memory[k]) + 1e-6)


def log_probabilities(m: Model, p: dict[str, np.ndarray], ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log p of every word given its window; of words beyond the vocabulary, of their class."""
    parts = [p["e"] @ p["w"][k * WIDTH : (k + 1) * WIDTH] for k in range(len(NEAR))]  # a table a place
    out = np.empty(len(ids))
    for i in range(0, len(ids), 1 << 16):
        of = m.class_of[ids[i : i + (1 << 16)]]
        order = np.argsort(of, kind="stable")
        of, own, n = of[order], ids[i : i + (1 << 16)][order], near[i : i + (1 << 16)][order]
        h = parts[0][n[:, 0]]
        for k in range(1, len(NEAR)):
            h = h + parts[k][n[:, k]]
        h = np.maximum(h + p["b"], 0)
        z = h @ p["u"] + p["c"]
        z -= z.max(axis=1, keepdims=True)
        lp = z[np.arange(len(z)), of] - np.log(np.exp(z).sum(axis=1))
        cut = np.searchsorted(of, np.arange(len(m.lo)))
        for k in range(len(m.lo) - 1):
            (a, b), (lo, hi) = cut[k : k + 2], m.lo[k : k + 2]
            if a < b and hi - lo > 1:
                z = h[a:b] @ p["o"][lo:hi].T + p["d"][lo:hi]
                z -= z.max(axis=1, keepdims=True)
                lp[a:b] += z[np.arange(b - a), own[a:b] - lo] - np.log(np.exp(z).sum(axis=1))
        out[i + order] = lp
    return out


def rare_share(n: np.ndarray, rare: int) -> np.ndarray:
    """log p(word | class) of words beyond the vocabulary with n occurrences; 0: all unseen ones together."""
    return np.log(np.maximum(n, 1)) - np.log(rare + 1)


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors (column ``v``: float64 as binary) of a table, in a tree of partial sums."""

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column("v").to_pylist():
                v = np.frombuffer(raw, np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    rows = parts.mapInArrow(add, "v binary").collect()
    return np.frombuffer(rows[0].v, np.float64) if rows else np.zeros(0)


_PACKED = "block int, part int, doc_ids array<long>, first binary, place binary, words binary, n binary"


def packed(docs: DataFrame) -> DataFrame:
    """Documents in blocks, one row each (of repeated rows that fill a block, several parts), in partitions by block.

    doc_ids; first (int64: index of each one's first word, one more at the end); place (int32: of each word among
    the block's distinct ones); words (their 64-bit hashes, sorted) and n (uint32: occurrences in the block).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    own = own.withColumn("h", F.xxhash64("doc_id", "text"))
    own = own.withColumn("block", F.pmod("h", F.lit(-(-size // BLOCK_BYTES) or 1)).cast("int"))
    own = own.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "h", "doc_id")  # ties are equal rows, but for hashes that collide

    def row(block: int, part: int, held: list) -> pa.RecordBatch:
        words, place, n = np.unique(np.concatenate([w for _, w, _ in held]), return_inverse=True, return_counts=True)
        starts = np.cumsum([0] + [len(w) for _, w, _ in held])
        first = np.concatenate([f[:-1] + s for (_, _, f), s in zip(held, starts)] + [starts[-1:]])
        ids = pa.concat_arrays([i.combine_chunks() if isinstance(i, pa.ChunkedArray) else i for i, _, _ in held])
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (first.astype(np.int64), place.astype(np.int32), words, n.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *raw], ["block", "part", "doc_ids", "first", "place", "words", "n"])

    def run(batches):
        now, part, held, size = None, 0, [], 0
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))), len(blocks)) if len(blocks) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                buf, offs = at.flat(batch.column("text").slice(a, b - a))
                for i, j, raw, o in at.slices(buf, offs):
                    if held and (blocks[a] != now or size > PIECE):
                        yield row(now, part, held)
                        part, held, size = part + 1, [], 0
                    if blocks[a] != now:
                        now, part = int(blocks[a]), 0
                    word, first = at.words(raw, o)
                    held.append((batch.column("doc_id").slice(a + i, j - i), word, first))
                    size += len(word)
        if held:
            yield row(now, part, held)

    return own.select("block", "doc_id", "text").mapInArrow(run, _PACKED)


_COUNTED = "block int, part int, home int, n binary, words binary, counts binary"


def counted(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Totals of all blocks' distinct words by home, and the number of homes.

    A row with a block holds n (float32: the corpus's occurrences of the block's words of that home, in their order);
    one without a block holds the home's most frequent words (uint64) and their counts (int64), and n, the sum of all.
    """
    distinct = blocks.agg(F.coalesce(F.sum(F.octet_length("words").cast("long")), F.lit(0))).first()[0] // 8
    homes = -(-distinct // HOME) or 1

    def deal(batches):
        for batch in batches:
            for block, part, words, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "words", "n"))):
                words, n = np.frombuffer(words, np.uint64), np.frombuffer(n, np.uint32)
                order, cut = at.scatter((words % np.uint64(homes)).astype(np.int64), homes)
                full = np.flatnonzero(np.diff(cut))
                cut = np.append(cut[full], cut[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), block, np.int32)), pa.array(np.full(len(full), part, np.int32)), pa.array(full.astype(np.int32)), at.binaries(words[order], cut), at.binaries(n[order], cut)], ["block", "part", "home", "words", "n"])

    def total(rows: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("n").to_pylist()])
        own, where = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.zeros(len(own), np.int64)
        np.add.at(sums, where, n.astype(np.int64))
        top = np.lexsort((own.view(np.int64), -sums))[:VOCABULARY]  # ties as Spark orders longs
        binary = lambda values: pa.array([v.tobytes() for v in values], pa.binary())
        k = rows.num_rows
        back = at.binaries(sums[where].astype(np.float32), np.cumsum([0] + [len(w) for w in words]))
        none = pa.nulls(k, pa.binary())
        answers = pa.table([rows.column("block"), rows.column("part"), rows.column("home"), back, none, none], schema)
        summary = pa.table([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), rows.column("home").slice(0, 1), binary([sums.sum(keepdims=True)]), binary([own[top]]), binary([sums[top]])], schema)
        return pa.concat_tables([answers, summary])

    schema = ["block", "part", "home", "n", "words", "counts"]
    dealt = blocks.select("block", "part", "words", "n").mapInArrow(deal, "block int, part int, home int, words binary, n binary")
    return written(dealt.groupBy("home").applyInArrow(total, _COUNTED), "counted"), homes


def _expanded(totals: DataFrame) -> DataFrame:
    """word, n of the homes' most frequent words."""

    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["word", "n"])

    return totals.filter("block is null").select("words", "counts").mapInArrow(run, "word long, n long")


def untrained(totals: DataFrame) -> Model:
    """The model of the corpus's shares, without windows. At most ``VOCABULARY`` rows come to the driver."""
    top = _expanded(totals).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    everything = totals.filter("block is null").select("n").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x, np.int64)[0]) for x in b.column("n").to_pylist()], pa.int64())], ["n"]) for b in batches), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, counts = np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    lo, rare = classes(counts), int(everything - counts.sum())
    return Model(words, counts, lo, rare, initial(counts, lo, rare))


def trained(blocks: DataFrame, m: Model, rounds: int = ROUNDS) -> Model:
    """The model after one pass over all documents, averaged ``rounds`` times."""
    shapes = {k: v.shape for k, v in m.p.items()}

    def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
        cut = np.cumsum([0] + [int(np.prod(s)) for s in shapes.values()])
        return {k: flat[a:b].reshape(s).astype(np.float32) for (k, s), a, b in zip(shapes.items(), cut[:-1], cut[1:])}

    now = np.concatenate([m.p[k].ravel() for k in shapes])
    for turn in range(rounds):
        start = now

        def run(batches):
            total, seen = np.zeros(len(start)), 0
            for batch in batches:
                for block, part, first, place, words in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "first", "place", "words"))):
                    first, place, id_of = np.frombuffer(first, np.int64), np.frombuffer(place, np.int32), m.ids(np.frombuffer(words, np.uint64))
                    mine = np.arange(len(first) - 1) % rounds == turn
                    size = np.diff(first)[mine]
                    if not size.sum():
                        continue
                    p, memory = unpack(start), {k: np.full(s, 1e-3, np.float32) for k, s in shapes.items()}
                    edges = np.concatenate(([0], np.cumsum(size)))
                    a = 0
                    while a < len(size):  # whole documents, some thousands of words at a time
                        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SLICE, "right")) - 1)
                        own = np.flatnonzero(mine)[a:b]
                        ids = id_of[at.gathered(place, first[own], size[a:b])[0]]
                        fit(m, p, memory, ids, windows(ids, edges[a : b + 1] - edges[a], len(m.words) + 1), [turn, block, part, a])
                        a = b
                    total += np.concatenate([p[k].ravel() for k in shapes]).astype(np.float64) * size.sum()
                    seen += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total, seen).tobytes()], pa.binary())], ["v"])

        total = summed(blocks.select("block", "part", "first", "place", "words").mapInArrow(run, "v binary"))
        if len(total) and total[-1]:
            now = (total[:-1] / total[-1]).astype(np.float32)
    return Model(m.words, m.counts, m.lo, m.rare, unpack(now))


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (a sum over the words), per_word of every row.

    Texts without words, empty and null ones have 0 words, 0.0 and a null mean. Ids may repeat or be null;
    repeated rows score alike. With no rounds the windows don't count.
    """
    blocks, _ = bucketed(packed(docs), "blocks", "block", dealt=True)
    totals, homes = counted(blocks)
    m = trained(blocks, untrained(totals), rounds)
    answers = totals.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "home", "n")).alias("answers"))

    def run(batches):
        for batch in batches:
            for part, ids, first, place, words, answers in zip(batch.column("part").to_pylist(), batch.column("doc_ids"), *(batch.column(c).to_pylist() for c in ("first", "place", "words", "answers"))):
                first, place, words = np.frombuffer(first, np.int64), np.frombuffer(place, np.int32), np.frombuffer(words, np.uint64)
                n = np.zeros(len(words), np.float32)
                order, cut = at.scatter((words % np.uint64(homes)).astype(np.int64), homes)
                for x in answers or ():
                    if x["part"] == part:
                        n[order[cut[x["home"]] : cut[x["home"] + 1]]] = np.frombuffer(x["n"], np.float32)
                id_of = m.ids(words)
                within = np.where(id_of == len(m.words), rare_share(n, m.rare), 0.0)
                total, a = np.zeros(len(first) - 1), 0
                while a < len(total):
                    b = max(a + 1, int(np.searchsorted(first, first[a] + 4 * SLICE, "right")) - 1)
                    at_ = place[first[a] : first[b]]
                    cuts = first[a : b + 1] - first[a]
                    lp = np.concatenate(([0.0], np.cumsum(log_probabilities(m, m.p, id_of[at_], windows(id_of[at_], cuts, len(m.words) + 1)) + within[at_])))
                    total[a:b] = lp[cuts[1:]] - lp[cuts[:-1]]
                    a = b
                size = np.diff(first)
                total[size == 0] = 0.0
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(size), pa.array(total), pa.array(total / np.maximum(size, 1), mask=size == 0)], ["doc_id", "n_words", "log_likelihood", "per_word"])

    return blocks.join(answers, "block", "left").select("part", "doc_ids", "first", "place", "words", "answers").mapInArrow(run, "doc_id long, n_words long, log_likelihood double, per_word double")
