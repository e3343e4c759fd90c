"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that no vocabulary token holds can never be joined by a merge, so a cut between its two
bytes changes nothing, provided that the pieces of the pre-tokenizer on either side stay what they
are. They do wherever the byte before is the end of a character other than white space and the byte
after starts a character other than an apostrophe: a run of letters, digits or other marks that goes
on after the cut is then a run of its own, with no merge across; a run of white space starts whole; an
apostrophe alone could begin a contraction that it does not begin within a longer run of marks.

The fragments are encoded independently, each distinct one once a task, and concatenated. They are
known by their bytes. Decoding concatenates the tokens' bytes and reads them as UTF-8, with U+FFFD
for invalid bytes.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrowtext as at

#: Bytes of fragments and their ids that a task keeps before it starts anew, and what each entry costs besides; longer fragments are not kept.
KEEP_BYTES, ENTRY, LONGEST_KEPT = 128 << 20, 200, 256
#: Last bytes of white space characters beyond ASCII, in UTF-8; no cut is taken after them.
_WIDE_SPACE_ENDS = [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


class Codec:
    """Encoder and decoder for a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = {bytes(of[c] for c in t): i for t, i in data["model"]["vocab"].items() if all(c in of for c in t)}
        added = {t["content"].encode(): t["id"] for t in data.get("added_tokens", [])}
        if any(c.isspace() for t in added for c in t.decode()) or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in data.get("added_tokens", [])):
            raise ValueError("added tokens with white space or stripping would span forced boundaries")
        self.added = list(added)
        inside = np.zeros((256, 256), bool)
        for token in [*vocab, *added]:
            for a, b in zip(token[:-1], token[1:]):
                inside[a, b] = True
        cut = ~inside
        cut[:, [*range(0x80, 0xC0), ord("'")]] = False
        cut[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, *_WIDE_SPACE_ENDS], :] = False
        self.cut = cut.ravel()
        merges = [x.split(" ") if isinstance(x, str) else x for x in data["model"]["merges"]]
        by_rank = [data["model"]["vocab"][a + b] for a, b in merges]
        # where ids follow the merges' order, ids serve as ranks and the faster encoder gives the same ids
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for t, i in vocab.items() if t not in added}, special_tokens={}) if by_rank == sorted(by_rank) else None
        text = {i: t for t, i in (vocab | added).items()}
        size = max(text) + 1
        pieces = [text.get(i, b"") for i in range(size)]
        self.piece_at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, bytes] = {}  # fragments and their ids, of 32 bits each
        self.kept = 0

    def fragment(self, raw: bytes) -> list[int]:
        if self.fast is not None and len(raw) < 400 and max(raw) < 0xE0 and not any(a in raw for a in self.added):
            return self.fast.encode_ordinary(raw.decode())
        return self.library.encode(raw.decode(), add_special_tokens=False).ids

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a flat text buffer, and each row's offset in them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        first = np.zeros(len(buf), bool)
        first[1:] = self.cut[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        first[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(buf))
        if self.kept > KEEP_BYTES:
            self._clear()
        where, back = at.distinct_spans(buf, start, end)
        raw, known, parts = buf.tobytes(), self.known, []
        for a, b in zip(start[where].tolist(), end[where].tolist()):
            piece = raw[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.fragment(piece), np.uint32).tobytes()
                if len(piece) <= LONGEST_KEPT:
                    known[piece] = ids
                    self.kept += len(piece) + len(ids) + ENTRY
            parts.append(ids)
        size = np.array([len(p) // 4 for p in parts], np.int64)
        first_of = np.cumsum(size) - size
        ids, offset = at.gathered(np.frombuffer(b"".join(parts), np.uint32), first_of[back], size[back])
        return ids, offset[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, at_: np.ndarray) -> list[str]:
        """The text of each row of ids."""
        data, offset = at.gathered(self.piece_bytes, self.piece_at[ids], self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids])
        raw, cuts = data.tobytes(), offset[at_].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (with ``with_ids``), ids_sha256, decoded_sha256 of every row of docs (doc_id, text).

    Null and empty texts have no ids. Rows are independent: ids may repeat or be null, and texts be
    of any length. ``vocabulary`` is a path that every executor can open. The digests are of the ids
    as little-endian 32-bit integers, and of the UTF-8 of the text decoded from them.
    """

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            buf, offs = at.flat(batch.column("text"))
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for i, j, b, o in at.slices(buf, offs):
                ids, cuts = own.encode(b, o)
                raw, at4 = ids.astype("<u4").tobytes(), (cuts * 4).tolist()
                cols = [doc_ids.slice(i, j - i), pa.array(np.diff(cuts))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                cols.append(pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at4[:-1], at4[1:])]))
                cols.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in own.decode(ids, cuts)]))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none."""

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            lists = [np.array(x or [], np.uint32) for x in batch.column("ids").to_pylist()]
            cuts = np.cumsum([0] + [len(x) for x in lists])
            text = own.decode(np.concatenate(lists) if lists else np.zeros(0, np.uint32), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
