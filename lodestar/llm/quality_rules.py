"""Quality rules whose cutoffs come with a guarantee: at most ``limit`` of a stratum's good documents are rejected, with confidence 1 - ``risk`` for all strata at once (operator 12).

Fixed rules look at five counts of a whole text. Each rule has a ladder of cutoffs from lenient to strict;
a setting says how many steps of each ladder are taken, and a document goes if it fails any rule.
Labelled documents that pass the base rules are halved by a hash of doc_id. In each stratum (language) the first half
orders settings: from none, the step that rejects most bad documents for its good ones is taken
next, while any rejects more bad ones. The second half, which had no say in that order, tests the
settings in it: one is granted while the exact (Clopper-Pearson) upper bound of its false rejection
is at most ``limit``, and the first that fails ends the sequence. Within a fixed sequence no further correction is due;
over the strata the risk is shared by Holm's step-down: strata take risk / m in rounds, m being how many have not yet had
their last setting granted. A stratum whose good documents are too few for any bound keeps all that pass the base rules.

All labelled documents count, as numbers in cells (stratum, half, label, first failed step of each ladder), of which a stratum has a
bounded number; strata are worked on side by side. No text is shuffled.

Nulls: a null text has no words and fails the base rules. A null language is a stratum of its own. A null doc_id is judged but never labelled. Of repeated
rows of one doc_id each is judged, and one (the least counts) is labelled; a doc_id labelled both ways counts as good. Null labels are
ignored. Ties go to the earlier rule. Empty tables: no documents, no rows; no labels, no further rejection. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices, small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MOST_STRATA = 10_000  # rows of cutoffs that are broadcast at most

#: name, measure, whether too high (or too low) is bad, cutoffs from lenient to strict
RULES: tuple[tuple[str, str, bool, tuple[float, ...]], ...] = (
    ("repeats", "n_repeat_words / greatest(n_words, 1)", True, (0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    ("symbols", "n_symbols / greatest(word_chars, 1)", True, (0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", True, (0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("long_words", "word_chars / greatest(n_words, 1)", True, (15.0, 12.0, 10.0, 9.0, 8.0, 7.5)),
    ("short_words", "word_chars / greatest(n_words, 1)", False, (2.0, 2.5, 3.0, 3.5, 4.0, 4.5)),
    ("length", "n_words", False, (55.0, 60.0, 65.0, 70.0, 80.0, 100.0)),
)
STEPS = 6


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = text.encode().split()  # at spaces and \\x09-\\x0D, no others
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = 0
    if n > 3:
        window = ids[:-2] * len(known) + ids[1:-1]
        if len(known) > 2_000_000:  # so that three numbers fit 64 bits
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(known) + ids[2:]
        _, kind, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = times[kind] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeats, len(lines)


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, COUNTS of every row of ``docs`` (doc_id long, text string, and the stratum's column)."""
    names = ["doc_id", "stratum", *COUNTS]

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
            for a, b in slices(sizes + 1, 8 << 20):
                found = np.array([text_counts(t or "") for t in texts.slice(a, b - a).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, found.T)], names=names)

    rows = small_batches(docs).select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{k} long" for k in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed_step(rule: int) -> Column:
    """The first cutoff of a rule's ladder, from 1, that a document fails; STEPS + 1 if none."""
    _, measure, high, cuts = RULES[rule]
    value = F.expr(measure)
    return F.coalesce(*[F.when(value > c if high else value < c, i + 1) for i, c in enumerate(cuts)], F.lit(STEPS + 1)).cast("int")


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(at most x of n) by the continued fraction of the incomplete beta function."""
    if x >= n:
        return 1.0
    a, b, z = n - x, x + 1, 1 - p  # P = I_z(a, b)
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log(p)
    swap = z > (a + 1) / (a + b + 2)
    if swap:
        a, b, z = b, a, 1 - z
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * z / (a + 1) or 1e-300)
    out = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    part = math.exp(log) * out / a
    return 1 - part if swap else part


def upper_bound(x: int, n: int, risk: float) -> float:
    """The exact upper confidence bound of a share of which x of n were seen: the share that would show at most x with probability ``risk``."""
    if x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(x, n, mid) > risk else (low, mid)
    return high


def sequence(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Settings from lenient to strict, each one ladder further than the one before; steps: first failed step of each rule in each cell."""
    at, out = np.zeros(steps.shape[1], int), []
    kept = np.ones(len(steps), bool)
    while True:
        best = (0.0, 0, 0)
        for r in range(len(at)):
            for s in range(at[r] + 1, STEPS + 1):
                goes = kept & (steps[:, r] <= s)
                gain = bad[goes].sum() / (good[goes].sum() + 1)
                if gain > best[0]:
                    best = (gain, r, s)
        if not best[0]:
            return out
        at[best[1]] = best[2]
        kept &= steps[:, best[1]] > best[2]
        out.append(tuple(at.tolist()))


def rejected(steps: np.ndarray, setting: tuple[int, ...]) -> np.ndarray:
    return (steps <= np.array(setting)).any(1)


_LADDER = "stratum string, n_good long, n_bad long, settings array<array<int>>, false_rejections array<long>, caught array<long>"


def ladders(cells: DataFrame) -> DataFrame:
    """Of each stratum its sequence of settings, and how many good and bad documents of the second half each rejects."""
    names = [r[0] for r in RULES]

    def run(frame):
        import pandas as pd

        steps = frame[names].to_numpy()
        n, second, good = frame["n"].to_numpy(), frame["second"].to_numpy(bool), frame["good"].to_numpy(bool)
        fit, test = ~second, second
        found = sequence(steps[fit], (n * good)[fit], (n * ~good)[fit])
        went = [rejected(steps[test], s) for s in found]
        count = lambda of: [int((n * of)[test][w].sum()) for w in went]
        row = (frame["stratum"].iloc[0], int((n * good)[test].sum()), int((n * ~good)[test].sum()), found, count(good), count(~good))
        return pd.DataFrame([row], columns=["stratum", "n_good", "n_bad", "settings", "false_rejections", "caught"])

    return cells.groupBy("stratum").applyInPandas(run, _LADDER)


def granted(strata: list[tuple[int, list[int]]], limit: float, risk: float) -> list[tuple[int, float]]:
    """How many settings of each stratum's sequence are granted, and the level of its last test; strata: good documents, and those that each setting rejects.

    Holm: a stratum that has had its whole sequence granted hands its share on to the others.
    """
    done, levels = [0] * len(strata), [0.0] * len(strata)
    while True:
        open_ = [i for i, (_, x) in enumerate(strata) if done[i] < len(x)]
        moved = False
        for i in open_:
            n, wrong = strata[i]
            levels[i] = risk / len(open_)
            while done[i] < len(wrong) and n and binomial_cdf(wrong[done[i]], n, limit) <= levels[i]:
                done[i] += 1
                moved = True
        if not moved or not open_:
            return list(zip(done, levels, strict=True))


def cutoffs(counts: DataFrame, labels: DataFrame, limit: float = 0.02, risk: float = 0.05) -> DataFrame:
    """stratum, one column a rule (steps of its ladder), granted, n_good, false_rejections, bound, n_bad, caught: of each stratum with labels."""
    spark = counts.sparkSession
    names = [r[0] for r in RULES]
    one = counts.where(~base_failed() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("x")).select("doc_id", "x.*")
    said = labels.where("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    labelled = one.join(said, "doc_id").select("stratum", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("second"), *[failed_step(r).alias(k) for r, k in enumerate(names)])
    cells = labelled.groupBy("stratum", "good", "second", *names).agg(F.count("*").alias("n"))
    rows = ladders(cells).collect()  # a row a stratum
    given = granted([(r["n_good"], r["false_rejections"]) for r in rows], limit, risk)
    out = []
    for r, (k, level) in zip(rows, given, strict=True):
        setting = r["settings"][k - 1] if k else [0] * len(names)
        wrong = r["false_rejections"][k - 1] if k else 0
        out.append((r["stratum"], *setting, k, r["n_good"], wrong, upper_bound(wrong, r["n_good"], level) if r["n_good"] and level else 1.0, r["n_bad"], r["caught"][k - 1] if k else 0))
    return spark.createDataFrame(out, "stratum string, " + ", ".join(f"{k} int" for k in names) + ", granted int, n_good long, false_rejections long, bound double, n_bad long, caught long")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02, risk: float = 0.05) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, failed_rule (the first rule failed, null if none), kept of every row of ``docs``."""
    counts = cut_lineage(measured(docs, stratum))
    found = cutoffs(counts, labels, limit, risk).select(F.col("stratum").alias("_stratum"), *[F.col(r[0]).alias(f"_{r[0]}") for r in RULES])
    found = F.broadcast(found) if found.count() <= MOST_STRATA else found
    joined = counts.join(found, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    fails = F.coalesce(*[F.when(failed_step(i) <= F.col(f"_{r[0]}"), r[0]) for i, r in enumerate(RULES)])
    judged = joined.withColumn("base_failed", base_failed()).withColumn("failed_rule", F.when(~F.col("base_failed"), fails))
    return judged.select("doc_id", "stratum", *COUNTS, "base_failed", "failed_rule", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"))
