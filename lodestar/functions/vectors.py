"""Vector functions and hashed embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .text import tokens


def dot(a: Column, b: Column) -> Column:
    """FN3: the inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_score(a: Column, b: Column) -> Column:
    """FN4: the inner product, 0 at least."""
    return F.greatest(F.lit(0.0), dot(a, b))


def unit(v: Column) -> Column:
    """FN5: the vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


@F.pandas_udf(StructType([StructField("bucket", IntegerType()), StructField("sign", IntegerType())]))
def blake_slot(token: pd.Series, dimensions: pd.Series) -> pd.DataFrame:
    """UDF2: bucket and sign of a token from its 8-byte BLAKE2b digest."""
    digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in token]
    return pd.DataFrame({"bucket": [int.from_bytes(d[:4], "big") % n for d, n in zip(digests, dimensions, strict=True)], "sign": [1 if d[4] & 1 else -1 for d in digests]})


def md5_slot(token: Column, dimensions: int) -> Column:
    """EMB2: bucket and sign of a token from its md5 digits, the same in any engine."""
    h = F.md5(token)
    return F.struct((F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % dimensions).cast("int").alias("bucket"), F.when(F.substring(h, 8, 1).isin(*"13579bdf"), 1).otherwise(-1).alias("sign"))


def hashed_embedding(rows: DataFrame, key: str, text: str, dimensions: int = 256, portable: bool = False) -> DataFrame:
    """EMB1, EMB2: (key, bucket, weight) sparse unit vectors of signed token hashes.

    The portable hash is a built-in function, so it is summed as tokens come; with
    the other one a task hashes each different token once, and as long as no key comes twice adds up its rows where they are.
    """
    lists = rows.select(key, tokens(F.col(text)).alias("t"))
    if portable:
        return hashed_tokens(lists, [key], dimensions)
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return _hashed_where_read(lists, key, dimensions)
    terms = lists.select(key, F.explode("t").alias("token")).groupBy(key, "token").count()
    different = terms.select("token").distinct()
    slots = different.select("token", blake_slot("token", F.lit(dimensions)).alias("s")).select("token", "s.bucket", "s.sign")
    sums = terms.join(slots, "token").groupBy(key, "bucket").agg(F.sum(F.col("count") * F.col("sign")).alias("x"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double")).alias("norm"))
    return sums.join(norms, key).where("norm > 0").select(key, "bucket", (F.col("x") / F.col("norm")).alias("weight"))


KNOWN = 200_000  # tokens whose slots a task keeps
LISTS = 500  # rows whose tokens it looks at at once


def _hashed_where_read(lists: DataFrame, key: str, dimensions: int) -> DataFrame:
    """EMB1 of lists of tokens (key, t) whose keys differ; nothing is shuffled."""
    schema = StructType([lists.schema[key], StructField("bucket", IntegerType()), StructField("weight", DoubleType())])

    def run(batches):
        known: dict[str, tuple[int, int]] = {}

        def slot(token: str) -> tuple[int, int]:
            found = known.get(token)
            if found is None:
                if len(known) >= KNOWN:
                    known.clear()
                d = hashlib.blake2b(token.encode(), digest_size=8).digest()
                found = known[token] = int.from_bytes(d[:4], "big") % dimensions, 1 if d[4] & 1 else -1
            return found

        for whole in batches:
            for first in range(0, len(whole), LISTS):
                batch = whole.slice(first, LISTS)
                t = batch.column(1)
                doc = np.repeat(np.arange(len(batch)), np.diff(t.offsets.to_numpy()))
                coded = t.flatten().dictionary_encode()
                slots = np.array([slot(x) for x in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
                cell, size = doc * dimensions + slots[:, 0], len(batch) * dimensions
                x = np.bincount(cell, slots[:, 1], size).reshape(-1, dimensions)
                norm = np.sqrt((x * x).sum(1))
                at, bucket = np.nonzero((np.bincount(cell, minlength=size).reshape(-1, dimensions) > 0) & (norm > 0)[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(bucket.astype(np.int32)), pa.array(x[at, bucket] / norm[at])], names=[key, "bucket", "weight"])

    return lists.mapInArrow(run, schema)


def hashed_tokens(lists: DataFrame, by: list[str], dimensions: int = 256) -> DataFrame:
    """EMB2: (by, bucket, weight) of lists of tokens (by, t)."""
    slots = lists.select(*by, F.explode("t").alias("token")).select(*by, md5_slot(F.col("token"), dimensions).alias("s"))
    sums = slots.groupBy(*by, "s.bucket").agg(F.sum("s.sign").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by)).cast("double"))  # as many rows as dimensions
    return sums.withColumn("norm", norm).where("norm > 0").select(*by, "bucket", (F.col("x") / F.col("norm")).alias("weight"))


def dense(sparse: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """(key, embedding): sparse rows as arrays."""
    m = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    return sparse.groupBy(key).agg(m.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))
