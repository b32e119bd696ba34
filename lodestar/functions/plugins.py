"""UDF6: embedders and scorers from outside, as Arrow UDFs.

A plug-in is a function without arguments that loads a model: an object with a ``name``, and ``embed(texts)`` (rows of
numbers) or ``score(questions, texts)`` (a number each). It is loaded once in each Python worker, is given texts in batches, and its
name has to be the tag under which its results are stored and filtered (EMB3, FLT4).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_loaded: dict[tuple, object] = {}


def _model(load: Callable[[], object], tag: str):
    """The worker's model; a model of another name is an error."""
    key = (getattr(load, "__module__", ""), getattr(load, "__qualname__", repr(load)), tag)
    if key not in _loaded:
        model = load()
        if model.name != tag:
            raise ValueError(f"the plug-in is {model.name!r}, not {tag!r}")
        _loaded[key] = model
    return _loaded[key]


def embedder(load: Callable[[], object], tag: str, dimensions: int, batch: int = 256):
    """A UDF text -> array<double>: unit vectors (a zero vector stays); a null text is the empty one; other lengths than ``dimensions`` are an error."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(load, tag)
        for texts in parts:
            out: list = []
            for at in range(0, len(texts), batch):
                x = np.asarray(model.embed(texts.iloc[at : at + batch].fillna("").tolist()), np.float64)
                if x.ndim != 2 or x.shape[1] != dimensions:
                    raise ValueError(f"{tag} gave vectors of shape {x.shape}, not of {dimensions} numbers")
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                out += list(x / np.where(norm > 0, norm, 1))
            yield pd.Series(out, dtype=object)

    return embed


def scorer(load: Callable[[], object], tag: str, batch: int = 256):
    """A UDF (question, text) -> double, for ``rerank`` (RET20); nulls are empty texts."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(load, tag)
        for questions, texts in parts:
            out: list = []
            for at in range(0, len(texts), batch):
                out += list(model.score(questions.iloc[at : at + batch].fillna("").tolist(), texts.iloc[at : at + batch].fillna("").tolist()))
            yield pd.Series(out, dtype="float64")

    return score


def with_embedding(rows: DataFrame, text: str, load: Callable[[], object], tag: str, dimensions: int, batch: int = 256) -> DataFrame:
    """EMB3: adds ``embedding`` and ``embedding_model``."""
    return rows.withColumn("embedding", embedder(load, tag, dimensions, batch)(F.col(text))).withColumn("embedding_model", F.lit(tag))


def of_model(rows: DataFrame, tag: str) -> Column:
    """FLT4: rows whose embedding is of this model."""
    return rows["embedding_model"] == tag


class TokenOverlap:
    """A scorer without weights: the share of different tokens that question and text have in common."""

    name = "token-overlap-v1"

    @staticmethod
    def tokens(text: str) -> frozenset[str]:
        return frozenset(re.findall(r"[a-z0-9_+\-]+", text.lower()))

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        pairs = [(self.tokens(q), self.tokens(t)) for q, t in zip(questions, texts, strict=True)]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in pairs]
