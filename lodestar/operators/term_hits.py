"""RET8's counts where the rows are: which asked terms a row has, and how often.

The terms of all questions go to all tasks. A task looks each different word up once, adds up its rows' counts, and hands on, of rows in a scope
that asks for a term, that term's count; of all others only how many rows have each term. Rows whose words are not all in
one place, or whose key comes again, are handed on with all their terms and put together by key first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StringType, StructField, StructType

ROWS = 1_000  # rows whose words a task looks up at once
KNOWN = 300_000  # words whose terms a task remembers
WHOLE, PART, COUNTS = 0, 1, 2

_RUN = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_+-":
    _RUN[_c] = _c
_CJK = re.compile("[一-鿿]{3,}")


def run_words(low: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the word of all that ``term_index.runs`` finds in texts in lower case, none of which is null."""
    low = low.cast(pa.large_string())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_RUN[raw]))
    split = pc.ascii_split_whitespace(plain)
    words, row = pc.list_flatten(split), pc.list_parent_indices(split)
    long = pc.greater_equal(pc.binary_length(words), 3)
    words, row = words.filter(long), row.filter(long).to_numpy()
    cjk = np.flatnonzero((raw >= 0xE4) & (raw <= 0xE9))
    if len(cjk):
        threes = [(i, r[k : k + 3]) for i in np.unique(np.searchsorted(offsets - offsets[0], cjk, side="right") - 1).tolist() for r in _CJK.findall(low[i].as_py()) for k in range(len(r) - 2)]
        words = pa.concat_arrays([words, pa.array([w for _, w in threes], words.type)])
        row = np.append(row, np.array([i for i, _ in threes], row.dtype))
    return row.astype(np.int64), words


def _code(x: str) -> int:
    return int.from_bytes(x.encode(), "big")


class Terms:
    """The different terms by number, and what each scope asks for."""

    def __init__(self, asked: list[tuple]):
        """asked: (scope values, term)."""
        self.names = sorted({t for _, t in asked})
        self.number = {t: i for i, t in enumerate(self.names)}
        self.scope = {s: i for i, s in enumerate(sorted({s for s, _ in asked if None not in s}, key=str))}
        self.wanted = np.unique(np.array([self.scope[s] * len(self.names) + self.number[t] for s, t in asked if s in self.scope], np.int64))
        self.longer: dict[int, list] = {}  # by their first five characters
        self.short = {}
        plain = {t: i for t, i in self.number.items() if t.isascii()}
        for n in (3, 4):
            some = sorted((_code(t), i) for t, i in plain.items() if len(t) == n)
            self.short[n] = tuple(np.array([x[k] for x in some], np.int64) for k in (0, 1))
        for t, i in plain.items():
            if len(t) > 4:
                self.longer.setdefault(_code(t[:5]), []).append((t, i))
        self.begins = np.array(sorted(self.longer), np.int64)
        self.known: dict[str, list[int]] = {}

    def _look_up(self, words: list[str]) -> None:
        """The terms in words, one for each place."""
        self.known.update((w, [self.number[w]] if w in self.number else []) for w in words if not w.isascii())  # three characters, as such terms are
        words = [w for w in words if w.isascii()]
        found: list[list] = [[] for _ in words]
        joined = "\n".join(words) + "\n" * 5
        raw = np.frombuffer(joined.encode(), np.uint8).astype(np.int64)
        first = np.cumsum([0] + [len(w) + 1 for w in words])
        word = lambda at: np.searchsorted(first, at, side="right") - 1
        code = raw[: len(raw) - 4] << 16 | raw[1 : len(raw) - 3] << 8 | raw[2 : len(raw) - 2]
        for n in (3, 4, 5):
            if n > 3:
                code = code << 8 | raw[n - 1 : len(raw) - 5 + n]
            have = self.short[n][0] if n < 5 else self.begins
            if len(have):
                place = np.minimum(np.searchsorted(have, code), len(have) - 1)
                at = np.flatnonzero(have[place] == code)
                if n < 5:
                    for w, i in zip(word(at).tolist(), self.short[n][1][place[at]].tolist(), strict=True):
                        found[w].append(i)
                else:
                    for k, w, c in zip(at.tolist(), word(at).tolist(), code[at].tolist(), strict=True):
                        found[w] += [i for t, i in self.longer[c] if joined.startswith(t, k)]
        self.known.update(zip(words, found, strict=True))

    def counts(self, row: np.ndarray, words: pa.Array, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and its count for each row, by row and term. times: how often each word comes, once if not given."""
        if len(self.known) > KNOWN:
            self.known.clear()
        code = pc.dictionary_encode(words)
        different = code.dictionary.to_pylist()
        self._look_up([w for w in different if w not in self.known])
        found = [self.known[w] for w in different]
        size = np.fromiter(map(len, found), np.int64, len(found))
        term = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        at = code.indices.to_numpy().astype(np.int64)
        some = np.flatnonzero(size[at] > 0) if len(at) else at
        at, n = at[some], size[at[some]]
        first = np.cumsum(size) - size
        place = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = None if times is None else np.repeat(times[some], n)
        return self.sums(np.repeat(row[some], n), term[place], weight)

    def sums(self, row: np.ndarray, term: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, back, f = np.unique(row * max(1, len(self.names)) + term, return_inverse=True, return_counts=True)
        if n is not None:
            f = np.zeros(len(pair), np.int64)
            np.add.at(f, back, n)
        return pair // max(1, len(self.names)), pair % max(1, len(self.names)), f

    def asked_there(self, scopes: list[tuple], row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which of the pairs the row's scope asks for."""
        own = np.array([self.scope.get(s, -1) for s in scopes], np.int64)[row]
        code = own * len(self.names) + term
        at = np.minimum(np.searchsorted(self.wanted, code), max(0, len(self.wanted) - 1))
        return (own >= 0) & (self.wanted[at] == code) if len(self.wanted) else np.zeros(len(row), bool)


class _Out:
    """Rows of keys, kind, term and f."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def rows(self, keys: list[pa.Array], kind: int, row: np.ndarray, term: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """One for each row that has a pair."""
        there = np.unique(row)
        edges = pa.array(np.append(np.searchsorted(row, there), len(row)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, t)) for x, t in ((term, pa.int32()), (f, pa.int64()))]
        return pa.RecordBatch.from_arrays([*[k.take(pa.array(there)) for k in keys], pa.array([kind] * len(there), pa.int8()), *lists], schema=self.schema)

    def counts(self, df: np.ndarray) -> pa.RecordBatch:
        term = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, x.type) for x in list(self.schema)[:-3]], pa.array([COUNTS], pa.int8()), pa.array([term], pa.list_(pa.int32())), pa.array([df[term]], pa.list_(pa.int64()))], schema=self.schema)


def _schema(df: DataFrame, keys: list[str]) -> tuple[StructType, pa.Schema]:
    plan = StructType([*[StructField(k, df.schema[k].dataType) for k in keys], StructField("kind", ByteType()), StructField("term", ArrayType(IntegerType())), StructField("f", ArrayType(LongType()))])
    return plan, to_arrow_schema(plan)


def _counted(terms: Terms, out: _Out, keys: list[pa.Array], scopes: int, row: np.ndarray, term: np.ndarray, f: np.ndarray, df: np.ndarray, part: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What goes on of rows that are whole, all but those in ``part``; their terms are added to ``df``. Rows without a scope or key don't count."""
    columns = [k.to_pylist() for k in keys]
    known = np.ones(len(columns[0]), bool)
    for c in columns[: scopes + 1]:
        known &= np.array([v is not None for v in c], bool)
    if part is not None:
        if (open_ := part[row] & known[row]).any():
            yield out.rows(keys, PART, row[open_], term[open_], f[open_])
        known &= ~part
    row, term, f = (x[known[row]] for x in (row, term, f))
    df += np.bincount(term, minlength=len(df))
    mine = terms.asked_there(list(zip(*columns[:scopes], strict=True)) if scopes else [()] * len(known), row, term)
    if mine.any():
        yield out.rows(keys, WHOLE, row[mine], term[mine], f[mine])


def text_hits(rows: DataFrame, key: str, text: str, scope: list[str], asked: list[tuple], again: set | None) -> DataFrame:
    """scope, key, kind, term, f (lists). again: keys with their scope that more than one row has; None: all may be such."""
    keys = [*scope, key]
    plan, schema = _schema(rows, keys)
    shared = rows.sparkSession.sparkContext.broadcast((asked, again))

    def run(batches):
        asked, again = shared.value
        terms, out = Terms(asked), _Out(schema)
        df = np.zeros(len(terms.names), np.int64)
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                own = batch.columns[:-1]
                part = np.ones(len(batch), bool) if again is None else np.array([x in again for x in zip(*[c.to_pylist() for c in own], strict=True)], bool) if again else None
                yield from _counted(terms, out, own, len(scope), *terms.counts(*run_words(batch.columns[-1])), df, part)
        yield out.counts(df)

    return rows.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).mapInArrow(run, plan)


def word_hits(words: DataFrame, keys: list[str], asked: list[tuple]) -> DataFrame:
    """keys, kind, term, f of rows whose words (``word`` and ``tf``, lists) may be elsewhere too."""
    plan, schema = _schema(words, keys)
    shared = words.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        terms, out = Terms(shared.value), _Out(schema)
        for whole in batches:
            for first in range(0, len(whole), ROWS * 16):
                batch = whole.slice(first, ROWS * 16)
                words, times = batch.columns[-2:]
                row = pc.list_parent_indices(words).to_numpy().astype(np.int64)
                row, term, f = terms.counts(row, pc.list_flatten(words), pc.list_flatten(times).to_numpy().astype(np.int64))
                if len(row):
                    yield out.rows(batch.columns[:-2], PART, row, term, f)

    return words.select(*keys, "word", "tf").mapInArrow(run, plan)


def whole_hits(parts: DataFrame, keys: list[str], scope: list[str], asked: list[tuple]) -> DataFrame:
    """The parts (``word_hits``, or those of ``text_hits``) put together by ``keys``, which begin with the scope and the key."""
    plan, schema = _schema(parts, keys)
    shared = parts.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        terms, out = Terms(shared.value), _Out(schema)
        df = np.zeros(len(terms.names), np.int64)
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                each = pc.list_flatten(batch.columns[-1])  # the terms and counts of each part
                row = pc.list_parent_indices(batch.columns[-1]).to_numpy()
                term, f = each.field("term"), each.field("f")
                row = row[pc.list_parent_indices(term).to_numpy()].astype(np.int64)
                pairs = terms.sums(row, pc.list_flatten(term).to_numpy().astype(np.int64), pc.list_flatten(f).to_numpy().astype(np.int64))
                yield from _counted(terms, out, batch.columns[:-1], len(scope), *pairs, df)
        yield out.counts(df)

    return parts.groupBy(*keys).agg(F.collect_list(F.struct("term", "f")).alias("each")).mapInArrow(run, plan)


def bucketed_words(low: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """keys, bucket, word, tf (lists) of texts in lower case, the last column; words are counted where the text is."""
    plan = StructType([*[StructField(k, low.schema[k].dataType) for k in keys], StructField("bucket", IntegerType()), StructField("word", ArrayType(StringType())), StructField("tf", ArrayType(LongType()))])
    schema = to_arrow_schema(plan)

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                row, words = run_words(batch.columns[-1])
                code = pc.dictionary_encode(words)
                size = max(1, len(code.dictionary))
                home = np.array([zlib.crc32(w.encode()) % buckets for w in code.dictionary.to_pylist()], np.int64)
                pair, n = np.unique(row * size + code.indices.to_numpy(), return_counts=True)
                row, word = pair // size, pair % size
                group = row * buckets + home[word]
                order = np.argsort(group, kind="stable")
                group, begin = np.unique(group[order], return_index=True)
                edges = pa.array(np.append(begin, len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, x) for x in (code.dictionary.take(pa.array(word[order])).cast(pa.string()), pa.array(n[order], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(group // buckets)) for c in batch.columns[:-1]], pa.array(group % buckets, pa.int32()), *lists], schema=schema)

    return low.mapInArrow(run, plan)
