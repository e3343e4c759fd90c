"""Toxicity by weak supervision.

Terms are lower-cased words (cut at white space and ASCII punctuation) and their leading 4, 5 and 6
bytes, so inflected forms share terms. From labelled rows come the lexicons: every term that leans to toxic
rows beyond chance (G-test), in tiers by kind and strength. Voters are the lexicons' parts and a number of
patterns; each says toxic, clean, or abstains. A generative label model, a latent class with one categorical
vote per voter, is fitted by EM. EM starts from the balance of the votes, not from labels. Correlations between
voters that the class doesn't explain are estimated too; they serve to lessen the weight of voters that repeat
each other. Its posteriors, not the labels, are the targets of a logistic classifier over the lexicon terms,
which scores every text.

Only labelled rows whose crc32(doc_id as text) mod 5 is not 0 teach, and of them a bounded sample:
about ``MAX_TOXIC`` and ``MAX_CLEAN`` ids chosen by hash, one text each. Terms are counted in Spark, and all
that pass the test are used: their number is bounded by the sample alone. Language, source and id are
never features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrowtext as at
from .shared import written

#: Bounds of the sample of labelled rows, and what a term must show: rows that hold it, odds, and significance.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
MIN_ROWS, MIN_ODDS, MIN_G = 3, 12.0, 15.1
PREFIXES = (4, 5, 6)
_BREAK = at.SPACE.copy()
_BREAK[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
N_PATTERNS = 6


def _terms(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every term of every word, and the number of words a row."""
    low = at.LOWER[b]
    start, end, first = at.word_spans(low, o, _BREAK)
    row = np.repeat(np.arange(len(o) - 1), np.diff(first))
    out = [(at.spans_hash(low, start, end), row)]
    for k in PREFIXES:
        long_ = end - start > k
        out.append((at.spans_hash(low, start[long_], start[long_] + k) + np.uint64(k), row[long_]))
    return np.concatenate([h for h, _ in out]), np.concatenate([r for _, r in out]), np.diff(first)


class _Index:
    """Which of a few known terms occur; a bit table lets most terms pass without a search."""

    def __init__(self, terms: np.ndarray):
        self.order = np.argsort(terms)
        self.terms = terms[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def occurring(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, term number) pairs."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, row = h[hit], row[hit]
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        same = self.terms[place] == h
        pair = np.unique(row[same] * np.int64(len(self.terms)) + self.order[place[same]])
        return pair // len(self.terms), pair % len(self.terms)


def _patterns(b: np.ndarray, o: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Votes of pattern voters: 1 toxic, -1 clean, 0 abstains."""

    def count(chars: bytes) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[list(chars)] = 1
        total = np.concatenate(([0], np.cumsum(table[b])))
        return total[o[1:]] - total[o[:-1]]

    words, size = np.maximum(n_words, 1), np.maximum(np.diff(o), 1)
    upper = count(bytes(range(65, 91)))
    return np.stack([
        np.where(count(b"!") > 0.2 * words, 1, 0),
        np.where(count(b"?") > 0.2 * words, 1, 0),
        np.where(upper > 0.3 * size, 1, 0),
        np.where(count(b"#*$%&") > 0.05 * size, 1, 0),
        np.where(n_words < 20, 1, 0),
        np.where(count(b"|{}<>=") > 0.02 * size, -1, 0),
    ], axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """P(vote | class) of every voter, the class's prior, and the share of a voter's evidence that is its own."""

    prior: float
    table: np.ndarray  # voter, class, vote + 1
    share: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        odds = np.log(self.table[j, 1, votes + 1] / self.table[j, 0, votes + 1]) @ self.share + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, turns: int = 15) -> LabelModel:
    """EM from the starting posteriors; votes are rows by voters in {-1, 0, 1}."""
    q = np.clip(start, 0.05, 0.95)
    j = votes.shape[1]
    model = LabelModel(0.5, np.full((j, 2, 3), 1 / 3), np.ones(j), np.eye(j))
    for _ in range(turns):
        for c, w in ((1, q), (0, 1 - q)):
            for v in (-1, 0, 1):
                model.table[:, c, v + 1] = (w @ (votes == v) + 0.5) / (w.sum() + 1.5)
        model.prior = float(np.clip(q.mean(), 0.01, 0.99))
        # residuals: what of a vote the class doesn't explain
        mean = model.table @ np.array([-1.0, 0.0, 1.0])
        rest = votes - (q[:, None] * mean[:, 1] + (1 - q[:, None]) * mean[:, 0])
        cov = rest.T @ rest / max(1, len(votes))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        model.correlation = cov / np.outer(sd, sd)
        model.share = 1 / np.maximum(1, np.clip(model.correlation, 0, 1).sum(axis=1))
        q = model.posterior(votes)
    return model


def fit_linear(row: np.ndarray, col: np.ndarray, n_terms: int, target: np.ndarray, turns: int = 600, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by Adam over all rows; (row, col) are the terms that occur."""
    w, m, v, n = np.zeros(n_terms + 1), 0.0, 0.0, len(target)
    for t in range(1, turns + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + w[-1], -30, 30)))
        g = np.append(np.bincount(col, (p - target)[row], n_terms) / n + decay * w[:-1], (p - target).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False))


def _texts(batches):
    for batch in batches:
        buf, offs = at.flat(batch.column("text"))
        for i, j, b, o in at.slices(buf, offs):
            yield batch, i, j, b, o


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float
    voters: LabelModel | None


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the module's text. Without toxic or clean labelled rows it scores every text by the prior."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna().groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic")).filter(~held_out())
    n = marks.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = n[0], n[1] - n[0]
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))), None)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) + 0.5) / 1_000_003
    chosen = marks.filter(u < F.when(F.col("toxic"), MAX_TOXIC / toxic).otherwise(MAX_CLEAN / clean))
    # bounded by the two maxima, so broadcast; of several texts of an id one is taken, so the sample is bounded too
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("x.text", "toxic"), "sample")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:  # the labels are of other documents
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))), None)
    terms, lean = lexicon_terms(term_counts(sample), size[True], size[False])
    voters = tiers(lean)
    lexicon = _Index(terms)

    def vectors(batches):
        for batch, i, j, b, o in _texts(batches):
            h, row, n_words = _terms(b, o)
            r, k = lexicon.occurring(h, row, j - i)
            votes = _patterns(b, o, n_words)
            cuts = np.searchsorted(r, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), at.binaries(k.astype(np.int32), cuts), at.binaries(votes.ravel(), np.arange(j - i + 1) * N_PATTERNS)], ["toxic", "terms", "patterns"])

    got = sample.mapInArrow(vectors, "toxic boolean, terms binary, patterns binary").toPandas()  # the bounded sample
    got = got.sort_values(["toxic", "terms", "patterns"])
    held = [np.frombuffer(x, np.int32).astype(np.int64) for x in got["terms"]]
    votes = ballots(held, np.array([np.frombuffer(x, np.int8) for x in got["patterns"]]), voters)
    model = fit_label_model(votes, vote_balance(votes))
    weights, bias = fit_linear(np.repeat(np.arange(len(got)), [len(k) for k in held]), np.concatenate(held), len(terms), model.posterior(votes))
    return Model(terms, weights, bias, model)


def term_counts(sample: DataFrame) -> DataFrame:
    """term (a 64-bit hash), toxic and clean: in how many rows of each kind it occurs."""

    def seen(batches):
        for batch, i, j, b, o in _texts(batches):
            h, row, _ = _terms(b, o)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
            h, row = h[new], row[new]
            bad = batch.column("toxic").slice(i, j - i).to_numpy(zero_copy_only=False)[row]
            one, where = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.bincount(where, bad, len(one)).astype(np.int64)), pa.array(np.bincount(where, ~bad, len(one)).astype(np.int64))], ["term", "toxic", "clean"])

    return sample.mapInArrow(seen, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_terms(counts: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """All terms that lean to toxic rows beyond chance, and their log odds, strongest gain first. n1 toxic and n0 clean rows."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    lean = F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))
    both = (a + b) / (n1 + n0)
    g = 2 * (a * F.log(a / (n1 * both)) + F.when(b > 0, b * F.log(b / (n0 * both))).otherwise(0.0))
    rows = counts.filter(a >= MIN_ROWS).select("term", lean.alias("lean"), (a * lean).alias("gain"), g.alias("g"))
    rows = rows.filter((F.col("lean") > float(np.log(MIN_ODDS))) & (F.col("g") > MIN_G)).select("term", "lean", "gain").toPandas()  # of a bounded sample
    rows = rows.sort_values(["gain", "term"], ascending=[False, True])
    return rows["term"].to_numpy(np.int64).view(np.uint64), rows["lean"].to_numpy(float)


def tiers(lean: np.ndarray) -> np.ndarray:
    """The lexicon voter of each term: every sixteenth term of the strong and of the weaker half, so that each has common and rare terms."""
    return (np.argsort(np.argsort(-lean, kind="stable"), kind="stable") * 2 // max(1, len(lean))) * 16 + np.arange(len(lean)) % 16


def ballots(held: list[np.ndarray], patterns: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """Votes of the 32 lexicon voters, of one for texts without any leaning term, and of the patterns."""
    votes = np.zeros((len(held), 33 + N_PATTERNS), np.int8)
    for i, k in enumerate(held):
        votes[i, voter[k]] = 1
        votes[i, 32] = 0 if len(k) else -1
    votes[:, 33:] = patterns
    return votes


def vote_balance(votes: np.ndarray) -> np.ndarray:
    """Where EM starts: likely toxic where three of the strong terms' voters or more say so."""
    return np.where((votes[:, :16] > 0).sum(axis=1) >= 3, 0.9, 0.1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts get the model's bias."""
    terms, weights, bias = model.terms, model.weights, model.bias

    def run(batches):
        index = _Index(terms)
        for batch in batches:
            out = []
            buf, offs = at.flat(batch.column("text"))
            for i, j, b, o in at.slices(buf, offs):
                h, row, _ = _terms(b, o)
                r, k = index.occurring(h, row, j - i)
                out.append(1 / (1 + np.exp(-np.clip(np.bincount(r, weights[k], j - i) + bias, -30, 30))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))
