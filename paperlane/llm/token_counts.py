"""Token counts by a linear longest-match automaton.

Greedy longest match cuts a word into the longest vocabulary piece that starts where the last one
ended; a word in which some point has no piece counts as one unknown token. The automaton is a
trie of the pieces with failure links: the link of a node says in which node matching goes on once
the longest piece that starts the node's string is taken, with the number of pieces taken on the
way. So each byte is read once and pieces are never built. Words of a batch advance in lockstep,
as arrays, and each distinct word of a slice is matched once; when fewer than ``FEW`` words are that
long, each of them goes on alone, so that a word of megabytes costs a table look-up a byte.

A word here is a maximal run of bytes other than space and TAB..CR; a ``prefix`` byte string is put
before it and what follows the first piece is matched against ``inner`` pieces (word-piece
vocabularies) or against the same pieces (byte-level ones).
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrowtext as at

_DEAD = -1
#: Fewer words than this are walked one by one: an array step costs as much as some hundred look-ups.
FEW = 256


class Automaton:
    """Trie, failure links and popped counts over byte pieces."""

    def __init__(self, first: set[bytes], inner: set[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]  # roots of first and inner pieces
        accept = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = self.children[node].get(byte)
                    if nxt is None:
                        nxt = self.children[node][byte] = len(self.children)
                        self.children.append({})
                        accept.append(False)
                    node = nxt
                if piece:
                    accept[node] = True
        n = len(self.children)
        fail, pops = [_DEAD] * n, [0] * n
        queue = deque([(0, 0), (1, 1)])
        while queue:
            node, root = queue.popleft()
            for byte, child in self.children[node].items():
                queue.append((child, root))
                if accept[child]:
                    fail[child], pops[child] = 1, 1  # the whole string is a piece: take it, go on at the inner root
                    continue
                at_, count = fail[node], pops[node]
                while at_ != _DEAD and byte not in self.children[at_]:
                    at_, count = fail[at_], count + pops[at_]
                if at_ != _DEAD:
                    fail[child], pops[child] = self.children[at_][byte], count
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        edges = [(node * 256 + byte, child) for node, kids in enumerate(self.children) for byte, child in kids.items()]
        del self.children
        self.step, self.back = dict(edges), list(zip(fail, pops))  # the same tables for single words
        size = 1 << (max(1, len(edges)) * 2 - 1).bit_length()
        self.mask = size - 1
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys, to = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(open_):  # open addressing, filled in rounds
            free = self.keys[slot[open_]] == -1
            cand = open_[free]
            self.keys[slot[cand]] = keys[cand]
            won = self.keys[slot[open_]] == keys[open_]
            self.to[slot[open_[won]]] = to[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (at.mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def goto(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child by byte, or -1."""
        key = node.astype(np.int64) * 256 + byte
        out, slot, left = np.full(len(key), _DEAD, np.int32), self._slot(key), np.arange(len(key))
        for _ in range(self.probes + 1):
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def _follow(self, node, count, byte, live):
        """Moves ``live`` entries by a byte, through failure links where there is no child; returns those that died."""
        todo = live
        dead = []
        while len(todo):
            nxt = self.goto(node[todo], byte[todo])
            ok = nxt >= 0
            node[todo[ok]] = nxt[ok]
            todo = todo[~ok]
            if not len(todo):
                break
            back = self.fail[node[todo]]
            gone = back < 0
            dead.append(todo[gone])
            todo, back = todo[~gone], back[~gone]
            count[todo] += self.pops[node[todo]]
            node[todo] = back
        return np.concatenate(dead) if dead else np.zeros(0, np.int64)

    def _alone(self, node: int, data: bytes) -> tuple[int, int]:
        """The node after ``data`` and the pieces taken on the way; a negative node where there is no way."""
        step, back, count = self.step, self.back, 0
        for byte in data:
            while (nxt := step.get(node * 256 + byte)) is None:
                node, taken = back[node]
                if node < 0:
                    return node, 0
                count += taken
            node = nxt
        return node, count

    def lengths(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: bytes = b"") -> np.ndarray:
        """Number of greedy pieces of every span; 1 for one that can't be cut."""
        n = len(start)
        count, node = np.zeros(n, np.int64), np.zeros(n, np.int32)
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        alive = np.ones(n, bool)
        byte = np.zeros(n, np.uint8)
        for k in range(-len(prefix), int(size.max()) if n else 0):
            live = np.arange(n) if k < 0 else np.arange(int(np.searchsorted(-size, -k, "left")))
            live = live[alive[live]]
            if k >= 0 and len(live) < FEW:
                for i in live.tolist():
                    node[i], more = self._alone(int(node[i]), buf[start[i] + k : start[i] + size[i]].tobytes())
                    count[i] += more
                alive[live] = node[live] >= 0
                break
            byte[live] = prefix[k + len(prefix)] if k < 0 else buf[start[live] + k]
            alive[self._follow(node, count, byte, live)] = False
        # what is left in the node must itself be cut to the end: follow failure links to the inner root
        todo = np.flatnonzero(alive & (node > 1))
        while len(todo):
            back = self.fail[node[todo]]
            gone = back < 0
            alive[todo[gone]] = False
            todo, back = todo[~gone], back[~gone]
            count[todo] += self.pops[node[todo]]
            node[todo] = back
            todo = todo[node[todo] > 1]
        out = np.empty(n, np.int64)
        out[order] = np.where(alive, count, 1)
        return out


def byte_level_pieces(path: str) -> set[bytes]:
    """The byte strings of a byte-level vocabulary file (JSON of the tokenizers library), special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in data.get("added_tokens", [])}
    return {bytes(of[c] for c in t) for t in data["model"]["vocab"] if t not in special and all(c in of for c in t)}


_automata: dict[tuple, Automaton] = {}


def _automaton(path: str) -> Automaton:
    if path not in _automata:
        pieces = byte_level_pieces(path)
        _automata[path] = Automaton(pieces, pieces)
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens: greedy longest-match pieces of " word" over all words of every whole text.

    ``vocabulary`` names a byte-level vocabulary file that every executor can open (installed with
    the tokenizers). Null and empty texts count 0; repeated rows and any ids are kept as they are.
    """

    def run(batches):
        machine = _automaton(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            buf, offs = at.flat(batch.column("text"))
            for _, _, b, o in at.slices(buf, offs):
                start, end, first = at.word_spans(b, o)
                if len(start):
                    where, back = at.distinct_spans(b, start, end)
                    total = np.concatenate(([0], np.cumsum(machine.lengths(b, start[where], end[where], b" ")[back])))
                else:
                    total = np.zeros(1, np.int64)
                n_words.append(np.diff(first))
                n_tokens.append(total[first[1:]] - total[first[:-1]])
            cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n_words, n_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, cols)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
