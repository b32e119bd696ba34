"""Document quality from weak labellers: a label model by expectation-maximisation, then a hashed linear scorer (operator 6).

Each labeller votes 1 (good), 0 (bad) or abstains (-1) on a whole text. Only the
counts of vote patterns matter to the label model, so one aggregation over all
documents is its whole input, at most 3 ** labellers rows however many documents
there are. Expectation-maximisation estimates each labeller's accuracy on good
and on bad documents and the share of good ones; every pattern then has a
posterior. A linear model over hashed words and vote-free shape features learns
the posteriors from a bounded sample (the first ``max_docs`` by a hash of doc_id, of
each the first ``max_chars`` characters; votes are of whole texts) and scores every whole text.

Nulls: a null or empty text gets the votes of an empty text and is never kept.
A null doc_id is scored, but never trained on. Rows that repeat are scored each; of
those with one doc_id the model learns from the least text. With no document at all,
or none to learn from, every score is 0.5 and posteriors are as told by the votes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# fixed values: frequent function words of the four languages
STOP = "the of and to in a is that for it as with be by on not was are this or und der die das den von zu mit ein ist le la les des et en un une que pour dans qui el los las del y de se por con una su".split()
BUCKETS = 1 << 18


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


LABELLERS = ("letters", "length", "marks", "capitals", "digits", "stop_words", "lines", "ends", "shouts", "variety")


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the vote of each of ``LABELLERS``."""
    count = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    counted = docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", "text", "t", F.split(F.lower(F.trim("t")), r"\s+").alias("words"), F.split("t", "\n").alias("rows"),
        F.greatest(F.length("t"), F.lit(1)).alias("n"), F.greatest(count(r"\p{L}+"), F.lit(1)).alias("letters_"), count(r"\p{Lu}+").alias("upper_"), count("[0-9]+").alias("digits_"),
        (F.length("t") - F.length(F.translate("t", "#$%&*|{}<>=_~^\\", ""))).alias("marks_"), (F.length("t") - F.length(F.translate("t", "!", ""))).alias("shouts_"),
    )
    sized = counted.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("different"), F.size(F.filter("words", lambda w: w.isin(*STOP))).alias("stops_"), F.size("rows").alias("n_rows"), F.size(F.array_distinct("rows")).alias("different_rows"))
    c = F.col
    per_letter, per_mark, per_digit, per_stop = c("letters_") / c("n"), c("marks_") / c("n"), c("digits_") / c("n"), c("stops_") / c("n_words")
    again, variety = 1 - c("different_rows") / c("n_rows"), c("different") / c("n_words")
    capital, last = c("upper_") / c("letters_"), F.right(F.rtrim(c("t")), F.lit(1))
    named = {
        "letters": vote(per_letter >= 0.72, per_letter < 0.6),
        "length": vote(c("n_words") >= 40, c("n_words") < 10),
        "marks": vote(per_mark < 0.01, per_mark > 0.03),
        "capitals": vote(capital < 0.12, capital > 0.3),
        "digits": vote(per_digit < 0.03, per_digit > 0.12),
        "stop_words": vote(per_stop >= 0.12, per_stop < 0.04),
        "lines": vote((again < 0.1) & (c("n_rows") > 1), again > 0.3),
        "ends": vote(last.isin(".", "!", "?", "\u2026", "\u00bb", '"'), last.isin(",", ";", "|", ":")),
        "shouts": vote(c("shouts_") / c("n_words") < 0.05, c("shouts_") / c("n_words") > 0.2),
        "variety": vote((variety > 0.3) | (c("n_words") < 40), (variety < 0.12) & (c("n_words") >= 40)),
    }
    return sized.select("doc_id", "text", *[named[k].alias(k) for k in LABELLERS])


class LabelModel:
    """Shares of good documents and each labeller's vote probabilities given good and bad."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.7, weight: float = 20.0):
        """patterns: votes (rows x labellers) of -1, 0, 1; counts: documents with each.

        A labeller seldom calls a good document bad; what it says of bad ones is open.
        That is where the estimate begins, so that the classes are told apart, and its
        prior, which weighs as much as ``weight`` documents of each class.
        """
        m = patterns.shape[1]
        p = np.zeros((2, m, 3))  # class, labeller, vote + 1
        p[1], p[0] = np.array([0.1, 0.02, 0.88]), np.array([0.2, 0.35, 0.45])
        believed = weight * p
        share = prior
        hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
        for _ in range(rounds):
            q = self._posterior(hot, p, share)
            for c, w in ((1, q * counts), (0, (1 - q) * counts)):
                seen = np.einsum("r,rmv->mv", w, hot) + believed[c]
                p[c] = seen / seen.sum(1, keepdims=True)
            new = float((q @ counts + 1) / (counts.sum() + 2))
            if abs(new - share) < 1e-9:
                break
            share = new
        self.p, self.share = p, share
        self.posterior = {tuple(r): float(x) for r, x in zip(patterns.tolist(), self._posterior(hot, p, share), strict=True)}

    @staticmethod
    def _posterior(hot: np.ndarray, p: np.ndarray, share: float) -> np.ndarray:
        log = np.einsum("rmv,mv->r", hot, np.log(p[1]) - np.log(p[0])) + np.log(share) - np.log1p(-share)
        return 1 / (1 + np.exp(-np.clip(log, -40, 40)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, how often it is right when it votes."""
        good, bad = self.p[1], self.p[0]
        right = self.share * good[:, 2] + (1 - self.share) * bad[:, 1]
        return right / np.maximum(self.share * (good[:, 1] + good[:, 2]) + (1 - self.share) * (bad[:, 1] + bad[:, 2]), 1e-9)


_SHAPE = re.compile(r"\d")


class _Words(dict):
    """The hash bucket of each word, by its shape without digits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        key = _SHAPE.sub("0", word.lower())
        self[word] = out = zlib.crc32(key.encode()) % (BUCKETS - 64)
        return out


def _vectors(texts: list[str], words: _Words):
    """Bucket ids of all texts in a row, their values, and the offsets: words by share, and shape features in the last 64 buckets."""
    ids, values, offsets = [], [], [0]
    for t in texts:
        found = np.fromiter(map(words.__getitem__, t.split()), np.int64)
        n = max(len(found), 1)
        letters = len(t) - t.count(" ")
        lines = t.split("\n")
        shape = [1.0, min(np.log1p(n) / 10, 1.5), min(letters / n / 10, 3.0), sum(map(t.count, "#$%&*|{}")) / n, 1 - len(set(lines)) / len(lines), 1 - len(np.unique(found)) / n, t.count("\n") / n]
        ids.append(np.concatenate([found, BUCKETS - 64 + np.arange(len(shape))]))
        values.append(np.concatenate([np.full(len(found), 3.0 / n), shape]))
        offsets.append(offsets[-1] + len(ids[-1]))
    return np.concatenate(ids), np.concatenate(values), np.array(offsets)


def _train(texts: list[str], target: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    """Logistic regression on soft targets by Adam."""
    ids, values, offsets = _vectors(texts, _Words())
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    used, at = np.unique(ids, return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * w[at], len(texts)), -30, 30)))
        g = np.bincount(at, values * (p - target)[row], len(used)) / len(texts) + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return out


def score_quality(docs: DataFrame, max_docs: int = 4000, max_chars: int = 20_000, limit: float = 0.5, rounds: int = 80, ridge: float = 1e-5) -> DataFrame:
    """doc_id, posterior (of the label model), score (of the linear model), kept (score >= limit) of every row of ``docs`` (doc_id long, text string)."""
    spark = docs.sparkSession
    source = small_batches(docs).select("doc_id", "text")
    names = list(LABELLERS)
    ballots = voted(source)
    patterns = ballots.groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    if not patterns:
        return spark.createDataFrame([], "doc_id long, posterior double, score double, kept boolean")
    model = LabelModel(np.array([[r[k] for k in names] for r in patterns]), np.array([r["count"] for r in patterns], float))

    ids = source.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = source.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # so that only these are voted on
    sample = voted(sample).select(F.left("text", F.lit(max_chars)).alias("text"), *names).withColumn("text", F.coalesce("text", F.lit("")))
    rows = sample.collect()  # at most max_docs rows of max_chars characters
    weights = _train([r["text"] or "" for r in rows], np.array([model.posterior[tuple(r[k] for k in names)] for r in rows]), rounds, ridge) if rows else np.zeros(BUCKETS, np.float32)
    shared = spark.sparkContext.broadcast((weights, model.posterior))

    def run(batches):
        weights, posterior = shared.value
        words = _Words()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            known = [posterior[x] for x in zip(*(batch.column(2 + k).to_pylist() for k in range(len(names))), strict=True)]
            for a, b in slices(np.array([len(t) + 1 for t in texts]), 1 << 20):
                at, values, offsets = _vectors(texts[a:b], words)
                z = np.add.reduceat(weights[at] * values, offsets[:-1])
                score = np.where([bool(t.strip()) for t in texts[a:b]], 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(known[a:b], pa.float64()), pa.array(score), pa.array(score >= limit)], names=["doc_id", "posterior", "score", "kept"])

    return ballots.mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")
