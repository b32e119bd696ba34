"""Sum-of-squares online packing of token sequences into fixed windows (operator 7).

Each partition packs its documents as they come. A document gives as many full
windows as it fills; the rest goes into the fill level h (0 is a new window) that
makes the sum of squares of the level counts smallest, where ``levels[h]`` is how
many open windows are filled to h. When the partition ends, or the open windows
hold ``most_open`` tokens, what is in them is laid end to end and cut into full
windows, and the last remainder is cut into windows of powers of two, which need
no padding. So no token is padded, and a partition holds a bounded number of them.

There is no shuffle: a window never spans partitions, and its id holds the
partition's number. A partition that is run again gives the same windows, since
its rows come straight from the scan.

Nulls: a null or empty text is the end token alone. A null doc_id is packed like
any other. Rows that repeat are packed once each. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import TokenKinds, TokenSlots, byte_codes, flat_ranges, slices, small_batches, string_buffer
from .shingles import word_ranges

WINDOW = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
_CODES = byte_codes(70)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in string.punctuation]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in string.ascii_letters]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class WordTokenizer:
    """Token ids of whole texts, from a store of the ids of each word.

    Exact, since the tokenizer splits at white space, and between an ASCII letter
    and a mark, before all else; and it lowers case, so ASCII letters are lowered
    first, but for those that a combining mark may follow. The store is looked up by
    64-bit hashes, confirmed by the word's first bytes and length. New words are encoded
    many at a time.
    """

    LIMIT = 400_000  # words; beyond, those that did not come back since the last time are dropped (the ids do not change)
    BLOCK = 1000  # new words that are encoded at once

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values(), default=0) + 1, bool)  # tokens that end a piece
        self.ends[[i for token, i in known.items() if token.endswith("</w>")]] = True
        self.slots = TokenSlots(self.LIMIT)
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")  # by slot; all ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def _pieces(word: str) -> int:
        """How many pieces the tokenizer makes of a word, 0 if that is not plain."""
        if word.isalpha():
            return 1
        core = word.rstrip(string.punctuation)
        return 1 if not core else 2 if core.isalpha() else len(word) if word.isascii() and word.isdigit() else 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in a row, and how many each has."""
        size = np.zeros(len(words), np.int64)
        pieces = np.fromiter(map(self._pieces, words), np.int64, len(words))
        out: list[np.ndarray] = []
        for a in range(0, len(words), self.BLOCK):
            block, n = words[a : a + self.BLOCK], pieces[a : a + self.BLOCK]
            plain = np.flatnonzero(n)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([block[i] for i in plain.tolist()])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            total = np.cumsum(n[plain])
            own = dict.fromkeys(np.flatnonzero(n == 0).tolist())
            if len(plain) and len(ends) == total[-1] and ends[-1] == len(ids):
                edges = ends[total - 1]
                size[a + plain] = np.diff(edges, prepend=0)
            else:
                own, plain, ids = dict.fromkeys(range(len(block))), plain[:0], ids[:0]
            for i in own:
                own[i] = self.whole(block[i])
                size[a + i] = len(own[i])
            if own:
                at, here = np.cumsum(size[a : a + self.BLOCK]) - size[a : a + self.BLOCK], size[a : a + self.BLOCK]
                both = np.empty(int(here.sum()), "<u4")
                both[flat_ranges(at[plain], here[plain])] = ids
                for i, x in own.items():
                    both[at[i] : at[i] + len(x)] = x
                ids = both
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, "<u4"), size

    def _store(self, kinds: TokenKinds, new: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if (kept := self.slots.trim()) is not None:
            self.pool, self.size = self.pool[flat_ranges(self.at[kept], self.size[kept])], self.size[kept]
            self.at = np.cumsum(self.size) - self.size
        self.slots.add(kinds, new)
        self.at, self.size = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other as UTF-8 bytes, and the offsets of each text in them."""
        start, end = word_ranges(data, offsets)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        special = b"<|" in data.tobytes()  # perhaps a special token, which is whole and in this case only
        if not special:
            low = _LOWER[data]
            low[:-1] = np.where(data[1:] < 128, low[:-1], data[:-1])
            data = low
        last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[end - 1]  # not a mark
        cut = (last >= start) & (last + 1 < end) & _LETTER[data[last]] & (not special)
        both = np.repeat(np.arange(len(start)), 1 + cut)
        tail = np.append(False, both[1:] == both[:-1])
        start, end = np.where(tail, last[both] + 1, start[both]), np.where(cut[both] & ~tail, last[both] + 1, end[both])
        kinds = TokenKinds(data, start, end, _CODES)
        at = self.slots.find(kinds)
        if len(new := np.flatnonzero(at < 0)):
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(kinds.begin[new].tolist(), (kinds.begin + kinds.size)[new].tolist(), strict=True)]
            self._store(kinds, new, *self.encode_words(words))
            at = self.slots.find(kinds)
            if (at < 0).any():  # two words of one hash
                return self._plain(raw, offsets)
        at = at[kinds.kind]
        ids = self.pool[flat_ranges(self.at[at], self.size[at])]
        tokens = np.concatenate([[0], np.cumsum(self.size[at])])
        return ids, tokens[np.searchsorted(start, offsets)]

    def _plain(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.whole(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


class SumOfSquares:
    """The open windows of one packer, and the level array of how many there are at each fill."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = {}  # fill -> its windows, the latest last

    def place(self, n: int) -> tuple[int, int]:
        """(fill, window) to put n tokens on, the window -1 if it is new; n must be under the size."""
        top = self.size - n
        gain = 2 * self.levels[n : self.size + 1] + 1  # of the level that grows by one
        gain[top] = 0  # a full window is closed
        gain[1:] -= 2 * self.levels[1 : top + 1] - 1  # of the level that shrinks
        gain[1:][self.levels[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = len(gain) - 1 - int(gain[::-1].argmin())  # of equally good levels the fullest
        if not h:
            return 0, -1
        self.levels[h] -= 1
        return h, self.open[h].pop()

    def put(self, window: int, fill: int) -> None:
        if fill < self.size:
            self.levels[fill] += 1
            self.open.setdefault(fill, []).append(window)


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _encoded(batch, words: WordTokenizer):
    """(doc_id, ids with the end token) of each row, some texts at a time."""
    docs = batch.column(0).to_pylist()
    data, offsets = string_buffer(batch.column(1))
    for a, b in slices(np.diff(offsets), 1 << 19):
        ids, edges = words.encode_all(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = edges[1:] + np.arange(b - a)
        out = np.full(len(ids) + b - a, END, "<u4")
        hole = np.ones(len(out), bool)
        hole[ends] = False
        out[hole] = ids
        raw, ends = out.tobytes(), [0, *(4 * ends + 4).tolist()]
        for i in range(a, b):
            yield docs[i], raw[ends[i - a] : ends[i - a + 1]]


def _pack(batches, path: str, size: int, most_open: int):
    base = TaskContext.get().partitionId() << 32
    words, packer, windows = WordTokenizer(path), SumOfSquares(size), 0
    held: dict[int, list] = {}  # open window -> its pieces (doc_id, doc_tokens, start, ids)
    waiting = 0  # tokens in them
    rows: list[tuple] = []

    def emit(pieces: list, window: int) -> None:
        at = 0
        for doc, total, start, ids in pieces:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + window, at))
            at += len(ids) // 4

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        rows.clear()
        return out

    def lay() -> list[list]:
        """What the open windows hold, the fullest first, end to end and cut into full windows and a rest of powers of two."""
        pieces = iter([piece for _, found in sorted(held.items(), key=lambda x: (-sum(len(p[3]) for p in x[1]), x[0])) for piece in found])
        held.clear()
        piece, out = next(pieces, None), []
        for n in [size] * (waiting // size) + _powers(waiting % size):
            got = []
            while n:
                doc, total, start, ids = piece
                take = min(n, len(ids) // 4)
                got.append((doc, total, start, ids[: 4 * take]))
                n -= take
                piece = (doc, total, start + take, ids[4 * take :]) if take < len(ids) // 4 else next(pieces, None)
            out.append(got)
        return out

    for batch in batches:
        for doc, ids in _encoded(batch, words):
            total = len(ids) // 4
            full = total // size * size
            for start in range(0, full, size):
                emit([(doc, total, start, ids[4 * start : 4 * (start + size)])], windows)
                windows += 1
            if rest := total - full:
                fill, window = packer.place(rest)
                if window < 0:
                    window, windows = windows, windows + 1
                    held[window] = []
                held[window].append((doc, total, full, ids[4 * full :]))
                waiting += rest
                if fill + rest == size:
                    emit(held.pop(window), window)
                    waiting -= size
                else:
                    packer.put(window, fill + rest)
            if waiting > most_open:
                for pieces in lay():
                    emit(pieces, windows)
                    windows += 1
                packer, waiting = SumOfSquares(size), 0
            if len(rows) >= 4096:
                yield flush()
    for pieces in lay():
        emit(pieces, windows)
        windows += 1
    if rows:
        yield flush()


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = WINDOW, most_open: int = 1 << 21) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id long, text string. tokenizer: the path of a tokenizers file that
    is on every machine; by default the public one of this name. most_open: tokens
    in open windows beyond which a partition lays them end to end, as at its end.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return small_batches(docs).select("doc_id", "text").mapInArrow(lambda it: _pack(it, tokenizer, size, most_open), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
