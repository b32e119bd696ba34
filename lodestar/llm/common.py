"""Helpers that the training-data operators share: reading, lineage cuts, array packing and 64-bit hashing in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

U64 = np.uint64
NO_DOC = np.int64(2**63 - 1)  # stands for a null document id: after every real one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``, and read it back."""
    return settled(df)


BATCH = 1000  # rows of texts that go to a Python worker at once


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends rows to Python workers in batches that suit texts.

    Spark's own 10,000 rows would be tens of MB on either side. A session that sets
    another number keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH))
    return df


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column: one cheap scan, used to size shards by the input."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C55  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U64(base))
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, from a polynomial prefix sum."""

    def __init__(self, codes: np.ndarray):
        """codes: a uint64 code of each byte."""
        n = len(codes)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(codes * _power_table(_BASE, n), out=self.prefix[1:])
        self.inverse = _power_table(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(raw ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


class TokenKinds:
    """The different byte strings among ranges of one buffer: ``kind`` of each range, and where each kind first is."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray):
        """codes: a uint64 code of each byte."""
        self.key, first, self.kind = np.unique(RangeHash(codes[data]).of(start, end), return_index=True, return_inverse=True)
        self.begin, self.size = start[first], (end - start)[first]
        head = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))[self.begin]
        self.check = (head & (U64(2**64 - 1) >> (U64(8) * (8 - np.minimum(self.size, 8)).astype(U64)))) ^ (self.size.astype(U64) << U64(56))


class TokenSlots:
    """Slots, counted from 0, of byte strings that were met before: by 64-bit hash, confirmed by first bytes and length."""

    def __init__(self, limit: int):
        self.limit = limit
        self.key, self.check = np.zeros(0, U64), np.zeros(0, U64)  # by rising key
        self.slot, self.back = np.zeros(0, np.int64), np.zeros(0, bool)

    def find(self, kinds: TokenKinds) -> np.ndarray:
        """The slot of each kind, -1 if it has none."""
        if not len(self.key):
            return np.full(len(kinds.key), -1)
        at = np.minimum(np.searchsorted(self.key, kinds.key), len(self.key) - 1)
        have = (self.key[at] == kinds.key) & (self.check[at] == kinds.check)
        self.back[at[have]] = True
        return np.where(have, self.slot[at], -1)

    def trim(self) -> np.ndarray | None:
        """Beyond the limit, keep the strings that came back since the last time. Returns their slots, which are 0, 1, ... from now on."""
        if len(self.key) <= self.limit:
            return None
        kept = np.flatnonzero(self.back)
        slots = self.slot[kept]
        self.key, self.check, self.slot, self.back = self.key[kept], self.check[kept], np.arange(len(kept)), np.zeros(len(kept), bool)
        return slots

    def add(self, kinds: TokenKinds, new: np.ndarray) -> None:
        """The kinds ``new`` get the next slots."""
        key = np.concatenate([self.key, kinds.key[new]])
        order = np.argsort(key, kind="stable")
        self.key, self.check = key[order], np.concatenate([self.check, kinds.check[new]])[order]
        self.slot = np.concatenate([self.slot, len(self.slot) + np.arange(len(new))])[order]
        self.back = np.concatenate([self.back, np.zeros(len(new), bool)])[order]


def byte_codes(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=U64)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column joined, and the offsets of its rows in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(lengths: np.ndarray, limit: int):
    """(from, to) ranges of rows with about ``limit`` bytes each; a longer row is a range of its own."""
    ends = np.cumsum(lengths)
    at, n = 0, len(lengths)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Numeric arrays as one zstd frame; bytes of equal weight lie together, which compresses ids well."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(8)
        parts += [code, len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        dtype, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        at += 16
        size = n * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += size
    return out


def flat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start[i], start[i] + length[i])``."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return first + np.arange(total)
