"""Removal of repeated byte strings across documents by suffix arrays (operator 3).

A byte goes when a ``width``-byte string covering it also starts in a document
with a smaller ``doc_id``.

Every ``width``-byte window has an anchor: the smallest hash among its 24-byte
grams. Equal windows have equal anchors, so windows are dealt out by anchor and
no window is compared with one of another anchor. Consecutive windows with the
same anchor form a run.

1. ``_runs``: each shard of documents sends one (anchor, hash of the run's
   bytes, smallest doc_id) per different run to the anchor's bucket.
2. ``_verdicts``: a bucket answers which runs have to be compared, for no other
   document has a run with the anchor of the rest. Hashes decide no more than
   that, and where bytes go.
3. ``_send_runs``: a shard finds its own documents' copies of a run as a bucket does,
   and sends the bytes of each different run that is to be compared to
   the bucket, once. Copies of a run that is in more than ``crowd`` shards go to
   buckets of ``crowd`` shards, each with the run of the smallest document. Runs of a hot
   anchor go by window to buckets of their own instead, each different window once
   a shard, from its smallest document there.
4. ``_compare``: a bucket takes records with the same bytes as one string, leaves out
   those that have no window by whose hash another document may have it, cuts the
   other strings into pieces, makes a suffix array of each by Larsson-Sadakane refinement,
   Kasai common prefixes over it, and merges the pieces' windows by binary search.
   Every byte that goes was compared there.
5. ``_cut``: the removed ranges meet their documents again, by shard.

Everything is linear in the input; no step holds more than a shard or a bucket.
One window of a hot anchor puts at most a record a shard into its bucket.

Nulls: a null text is empty; a null doc_id counts as larger than every other.
Rows with one doc_id never remove bytes from each other. Texts are taken whole; one
that is longer than a shard is a shard's only one. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_DOC, U64, RangeHash, byte_codes, flat_ranges, mix64, pack, shuffle_partitions, slices, small_batches, string_buffer, text_bytes, unpack

GRAM = 24  # bytes of an anchor, in words of 8
NONE, COMPARE, FOLLOW, SPREAD = 0, 1, 2, 3
PIECE = 1 << 20  # bytes of a suffix array


# ---------------------------------------------------------------- suffix arrays
def words_at(data: np.ndarray) -> np.ndarray:
    """For each position the next 8 bytes as a big-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(U64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes at least, by Larsson-Sadakane refinement.

    The first pass sorts by 8 bytes. Each further pass doubles the sorted length
    h: only suffixes in groups that are still tied are sorted again, by the rank
    of the suffix h further on. A group's rank is the position of its last member.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    key = words_at(data)
    order = np.argsort(key)
    tied = key[order]
    first = np.concatenate([[True], tied[1:] != tied[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    h = 8
    while True:
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts + size - 1, size)
        many = size > 1
        if h >= depth or not many.any():
            return order
        at = flat_ranges(starts[many], size[many])
        suffix = order[at]
        group = np.repeat(np.arange(int(many.sum())), size[many])
        after = rank[np.minimum(suffix + h, n)]
        new = np.argsort(group * (n + 1) + after)
        order[at] = suffix[new]
        after = after[new]
        first[at[1:]] |= after[1:] != after[:-1]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """Kasai: the length, at most ``cap``, that the suffix at each place of ``order`` shares with the one before it.

    The text is walked from the left; on each step to the next suffix the common
    prefix loses at most one byte. Stretches of the text are walked side by side,
    one numpy lane each, with words of eight bytes compared at once. ``order`` is
    sorted to a depth of ``cap`` or more only, so after two suffixes that agree
    that far nothing is known of the next ones, which start from 0.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    edges = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, end, h = edges[:-1].copy(), edges[1:], np.zeros(lanes, np.int64)
    word = np.concatenate([words_at(data), np.zeros(cap + 1, U64)])
    live = np.flatnonzero(at < end)
    while len(live):
        i, depth = at[live], h[live]
        j = before[i]
        room = np.minimum(cap, n - np.maximum(i, j))  # bytes that both suffixes have
        x = word[i + depth] ^ word[np.maximum(j, 0) + depth]
        same = _leading_equal(x)
        grown = np.minimum(depth + same, room)
        grown[j < 0] = 0
        done = (same < 8) | (grown >= room) | (j < 0)
        prefix[i[done]] = grown[done]
        h[live] = np.where(done, np.where(grown < cap, np.maximum(grown - 1, 0), 0), grown)
        at[live] += done
        live = live[at[live] < end[live]] if done.any() else live
    return prefix[order]


def _leading_equal(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of the 8 are zero."""
    n = np.zeros(len(x), np.int64)
    zero = x == 0
    for bits in (32, 16, 8):
        top = (x >> U64(64 - bits)) == 0
        n += np.where(top, bits // 8, 0)
        x = np.where(top, x << U64(bits), x)
    return np.where(zero, 8, n)


class SuffixShard:
    """The windows of some records: sorted, equal ones together, each with the smallest document that has it."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, valid: np.ndarray, width: int):
        """owner: the document of each position; valid: a whole window of its record starts there."""
        self.width, self.valid = width, valid
        order = suffix_array(data, width)
        shared = common_prefixes(data, order, width)
        keep = valid[order]
        breaks = np.cumsum(shared < width)[keep]  # places that are left out pass a break on
        self.order = order = order[keep]
        first = np.concatenate([[True], breaks[1:] != breaks[:-1]]) if len(order) else np.zeros(0, bool)
        self.heads = order[first]
        self.group = np.cumsum(first) - 1
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(first)) if len(order) else np.zeros(0, np.int64)
        self.owner = owner
        padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
        self.word = words_at(padded)

    def keys(self, positions: np.ndarray) -> list[np.ndarray]:
        """The windows at these positions as columns of big-endian words."""
        whole, rest = divmod(self.width, 8)
        out = [self.word[positions + 8 * k] for k in range(whole)]
        return out + ([self.word[positions + 8 * whole] >> U64(64 - 8 * rest)] if rest else [])

    def merge(self, other: SuffixShard) -> None:
        """Binary search of the other shard's different windows in this one's; both get the smaller document of a shared window."""
        wanted = other.keys(other.heads)
        mine = self.keys(self.heads)
        low, high = np.zeros(len(other.heads), np.int64), np.full(len(other.heads), len(self.heads), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less, equal = np.zeros(len(mid), bool), open_.copy()
            at = np.minimum(mid, len(self.heads) - 1)
            for have, want in zip(mine, wanted, strict=True):
                value = have[at]
                less |= equal & (value < want)
                equal &= value == want
                if not equal.any():
                    break
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        at = np.minimum(low, max(len(self.heads) - 1, 0))
        found = low < len(self.heads)
        for have, want in zip(mine, wanted, strict=True):
            found &= have[at] == want if len(have) else False
        place = at[found]
        both = np.minimum(self.least[place], other.least[found])
        self.least[place] = both
        other.least[found] = both

    def repeated(self) -> np.ndarray:
        """Positions whose window a smaller document has."""
        return self.order[self.owner[self.order] > self.least[self.group]] if len(self.order) else self.order


# ---------------------------------------------------------------- anchors and runs
class Runs:
    """The runs of windows with one anchor in a buffer of joined documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        n = len(data)
        lengths = np.diff(offsets)
        long = lengths >= width
        self.start = self.end = self.row = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, U64)
        if not long.any():
            return
        word = words_at(data)
        gram = word[: n - GRAM + 1] * U64(0x9E3779B97F4A7C15)
        for at in range(8, GRAM, 8):
            gram = mix64(gram) + word[at : n - GRAM + 1 + at]
        gram = mix64(gram)
        span, least, have = width - GRAM + 1, gram, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            shift = span - have
            least = np.minimum(least[:-shift], least[shift:])
        windows = len(least)
        begins, ends = offsets[:-1][long], offsets[1:][long] - width + 1  # the windows of each document
        first = np.zeros(windows + 1, bool)
        first[1:windows] = least[1:] != least[:-1]
        inside = np.zeros(windows + 1, np.int8)
        inside[begins] = 1
        inside[ends] -= 1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        first[begins] = True
        stop = np.zeros(windows + 1, bool)
        stop[ends] = True
        marks = np.flatnonzero((first & inside) | stop)
        nexts = np.append(marks[1:], windows)
        real = inside[marks]
        self.start, self.end = marks[real], nexts[real]  # windows [start, end)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.anchor = least[self.start]
        self.content = RangeHash(_CODES[data]).of(self.start, self.end + width - 1)


_CODES = byte_codes(50)


def _unite(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges of each row."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    base = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    first = np.concatenate([[True], (base + start)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], reach[last] - base[last]


def _different(anchor, content, doc):
    """Order by (anchor, content, doc), and where a different (anchor, content) begins in it."""
    order = np.argsort(anchor)
    key = anchor[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(order)))
    many = size > 1  # few anchors come twice: only those are sorted by the rest
    at = flat_ranges(starts[many], size[many])
    rows = order[at]
    rows = rows[np.lexsort((doc[rows], content[rows], anchor[rows]))]
    order[at] = rows
    c = content[order]
    first = new.copy()
    first[1:] |= c[1:] != c[:-1]
    return order, new, first


class _Shard:
    """The documents of one shard in a fixed order, with their runs under different (anchor, content)."""

    def __init__(self, blobs: list[bytes]):
        ids, texts = [], []
        for blob in blobs:
            doc, length, data = unpack(blob)
            ends = np.cumsum(length)
            raw = data.tobytes()
            ids += doc.tolist()
            texts += [raw[e - n : e] for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.doc = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)

    def find_runs(self, width: int, buckets: int) -> None:
        start, end, row, anchor, content = [], [], [], [], []
        for a, b in slices(np.diff(self.offsets), 1 << 20):
            base = self.offsets[a]
            runs = Runs(self.data[base : self.offsets[b]], self.offsets[a : b + 1] - base, width)
            start.append(runs.start + base)
            end.append(runs.end + base)
            row.append(runs.row + a)
            anchor.append(runs.anchor)
            content.append(runs.content)
        self.start, self.end, self.row = np.concatenate(start), np.concatenate(end), np.concatenate(row)
        self.anchor, self.content = mix64(np.concatenate(anchor)), np.concatenate(content)
        self.bucket = (((self.anchor >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
        self.order, _, first = _different(self.anchor, self.content, self.doc[self.row])
        self.kind = np.cumsum(first) - 1  # of each run in order: which different one it is
        self.heads = self.order[first]  # the smallest document's run of each


def _pack_documents(batches, width):
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        ids = batch.column(0).fill_null(int(NO_DOC)).to_numpy(zero_copy_only=False)
        shard = batch.column(2).to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        rows = [r for r in np.split(order, cuts) if len(r)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[r[0]]) for r in rows], pa.int64()), pa.array([pack(ids[r], lengths[r], data[flat_ranges(offsets[r], lengths[r])], level=3) for r in rows], pa.binary())], names=["shard", "blob"]
        )


def _blobs(part: pa.Table) -> list[bytes]:
    return part.column("blob").to_pylist()


def _runs(part: pa.Table, width: int, buckets: int) -> pa.Table:
    shard = _Shard(_blobs(part))
    shard.find_runs(width, buckets)
    head = shard.heads
    bucket = shard.bucket[head]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    groups = [g for g in np.split(head, cuts) if len(g)]
    return pa.table({
        "bucket": pa.array([int(shard.bucket[g[0]]) for g in groups], pa.int64()),
        "shard": pa.array([part.column("shard")[0].as_py()] * len(groups), pa.int64()),
        "blob": pa.array([pack((shard.anchor[g] >> U64(16)).astype(np.uint32), shard.content[g], shard.doc[shard.row[g]]) for g in groups], pa.binary()),
    })


def _verdicts(part: pa.Table, hot: int, crowd: int) -> pa.Table:
    """A code for each run, and a number: of a run that others follow how many buckets they have, of a follower which one is its own."""
    parts = [unpack(b) for b in _blobs(part)]
    sizes = [len(p[0]) for p in parts]
    anchor, content, doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order, new, first = _different(anchor, content, doc)
    d = doc[order]
    starts, heads = np.flatnonzero(new), np.flatnonzero(first)
    which = np.cumsum(new) - 1
    kinds = np.add.reduceat(first.astype(np.int64), starts)[which]
    several = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[which]
    kind = np.cumsum(first) - 1
    shards = np.diff(np.append(heads, len(order)))[kind]
    place = np.arange(len(order)) - heads[kind]
    code = np.where(several, np.where(kinds > hot, SPREAD, np.where((shards > crowd) & (place > 0), FOLLOW, COMPARE)), NONE).astype(np.uint8)
    buckets = np.where(shards > crowd, -(-shards // crowd), 0)
    number = np.where(code == FOLLOW, place % np.maximum(buckets, 1), np.where(code == COMPARE, buckets, 0))
    back, more = np.empty(len(order), np.uint8), np.empty(len(order), np.int32)
    back[order], more[order] = code, number
    cuts = np.cumsum(sizes)[:-1]
    return pa.table({
        "shard": part.column("shard"), "bucket": part.column("bucket"),
        "blob": pa.array([pack(x, y) for x, y in zip(np.split(back, cuts), np.split(more, cuts), strict=True)], pa.binary()),
    })


def _records(key, shard, doc, row, start, data, begin, length, anchor, also=None):
    """Rows of (key, shard, packed records), one for each key. also: (record, row, start) of more places that share a record's fate."""
    order = np.argsort(key, kind="stable")
    of, more_row, more_start = also or [np.zeros(0, np.int64)] * 3
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sort = np.argsort(place[of], kind="stable")
    of, more_row, more_start = place[of][sort], more_row[sort], more_start[sort]
    at = 0
    for r in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(r):
            m = slice(*np.searchsorted(of, [at, at + len(r)]))
            yield int(key[r[0]]), shard, pack(doc[r], row[r], start[r], length[r], data[flat_ranges(begin[r], length[r])], of[m] - at, more_row[m], more_start[m], anchor[r], level=3)
            at += len(r)


def _send_runs(docs: pa.Table, answers: pa.Table, width: int, buckets: int, piece: int = PIECE) -> pa.Table:
    empty = pa.table({"key": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    if not docs.num_rows:
        return empty
    shard = _Shard(_blobs(docs))
    shard.find_runs(width, buckets)
    me = docs.column("shard")[0].as_py()
    by_bucket = dict(zip(answers.column("bucket").to_pylist(), _blobs(answers), strict=True))
    told = [unpack(by_bucket[b]) for b in np.unique(shard.bucket).tolist()]
    code, number = (np.concatenate([t[k] for t in told] or [np.zeros(0, np.int64)]) for k in range(2))
    run, kind = shard.order, shard.kind
    doc, row = shard.doc[shard.row[run]], shard.row[run]
    begin, length = shard.start[run], (shard.end - shard.start)[run] + width - 1
    start = begin - shard.offsets[row]
    head = np.append(True, kind[1:] != kind[:-1])[: len(kind)]
    first = np.flatnonzero(head)[kind]
    rows = []
    gone: list[tuple] = []  # (row, start) of windows

    # copies here of a smaller document's run here
    copy = doc > doc[first]
    some = np.flatnonzero(np.bincount(kind, copy, kind[-1] + 1)[kind] > 0) if len(kind) else run
    record, place = repeated_windows(doc[some], length[some], shard.data[flat_ranges(begin[some], length[some])], shard.anchor[run[some]], width, piece)
    gone.append((row[some][record], start[some][record] + place))

    # one of each kind that is to be compared; the others of the same document share its fate
    sent = np.flatnonzero(head & np.isin(code[kind], (COMPARE, FOLLOW)))
    also = np.flatnonzero(~head & ~copy & np.isin(code[kind], (COMPARE, FOLLOW)))
    to, key = sent, np.where(code[kind[sent]] == COMPARE, shard.bucket[run[sent]], 0)
    salted = lambda content, salt: 2 * buckets + (mix64(content + salt.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(buckets)).astype(np.int64)
    follow = code[kind[sent]] == FOLLOW
    key[follow] = salted(shard.content[run[sent[follow]]], number[kind[sent[follow]]])
    lead = sent[~follow & (number[kind[sent]] > 0)]
    copies = number[kind[lead]].astype(np.int64)
    to = np.append(to, np.repeat(lead, copies))
    key = np.append(key, salted(shard.content[run[np.repeat(lead, copies)]], flat_ranges(np.zeros(len(lead), np.int64), copies)))
    if len(to):
        at = np.full(len(run), -1)
        at[sent] = np.arange(len(sent))
        rows += _records(key, me, doc[to], row[to], start[to], shard.data, begin[to], length[to], shard.anchor[run[to]], (at[first[also]], row[also], start[also]))

    if len(many := np.flatnonzero(code[kind] == SPREAD)):
        data = shard.data[flat_ranges(begin[many], length[many])]
        own: list[tuple] = []
        for array, which, place in suffix_pieces(doc[many], length[many], data, shard.anchor[run[many]], width, piece):
            gone.append((row[many][which[p := array.repeated()]], start[many][which[p]] + place[p]))
            least = np.flatnonzero(array.owner[array.order] == array.least[array.group])
            p, group = array.order[least], array.group[least]
            new = np.append(True, group[1:] != group[:-1])[: len(group)]
            own.append((many[which[p]], place[p], np.cumsum(new) - 1, new))
        for r, place, group, new in own:
            at = begin[r] + place
            hashes = RangeHash(_CODES[shard.data]).of(at[new], at[new] + width)
            key = buckets + (((hashes >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
            rows += _records(key, me, doc[r[new]], row[r[new]], (start[r] + place)[new], shard.data, at[new], np.full(len(key), width), hashes, (group[~new], row[r[~new]], (start[r] + place)[~new]))

    r, w = (np.concatenate(x) for x in zip(*gone, strict=True))
    if len(r):
        rows.append((-1 - me, me, pack(*_unite(r, w, w + width))))
    if not rows:
        return empty
    key, own_shard, blob = zip(*rows, strict=True)
    return pa.table({"key": pa.array(key, pa.int64()), "shard": pa.array(own_shard, pa.int64()), "blob": pa.array(blob, pa.binary())})


def suffix_pieces(doc: np.ndarray, length: np.ndarray, data: np.ndarray, anchor: np.ndarray, width: int, piece: int = PIECE) -> list[tuple]:
    """(array, record of each position, place of each in its record) of records cut into pieces; the arrays' windows are merged.

    The records are by rising anchor, so that only pieces that share one are merged.
    """
    pieces: list[tuple] = []
    ends = np.cumsum(length)
    for a, b in slices(length, piece):
        base = ends[a] - length[a]
        size = length[a:b]
        which = np.repeat(np.arange(a, b), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        part = SuffixShard(data[base : ends[b - 1]], doc[which], place <= length[which] - width, width)
        for earlier in pieces:
            if anchor[earlier[1][-1]] >= anchor[a]:
                earlier[0].merge(part)
        pieces.append((part, which, place))
    return pieces


def one_of_each(doc: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each record the one of the smallest document with the same bytes. Hashes say which ones to compare, the bytes decide."""
    begin = np.cumsum(length) - length
    key = RangeHash(_CODES[data]).of(begin, begin + length)
    order = np.lexsort((doc, key))
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    other = np.flatnonzero((first != np.arange(len(first))) & (length[first] == length))
    same = np.zeros(len(first), bool)
    for a, b in slices(length[other], 1 << 22):
        at = other[a:b]
        equal = data[flat_ranges(begin[at], length[at])] == data[flat_ranges(begin[first[at]], length[at])]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(length[at]) - length[at])
    return np.where(same, first, np.arange(len(first)))


def _may_share(doc: np.ndarray, length: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """Whether each record has a window whose hash a record of another document has too."""
    windows = length - width + 1
    at = flat_ranges(np.cumsum(length) - length, windows)
    record = np.repeat(np.arange(len(length)), windows)
    key = RangeHash(_CODES[data]).of(at, at + width)
    order = np.argsort(key)
    key, owner = key[order], doc[record[order]]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    starts = np.flatnonzero(new)
    out = np.zeros(len(length), bool)
    if len(key):
        shared = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        out[record[order[shared[np.cumsum(new) - 1]]]] = True
    return out


def repeated_windows(doc: np.ndarray, length: np.ndarray, data: np.ndarray, anchor: np.ndarray, width: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(record, place in it) of windows that a record of a smaller document has too: all, or as many as cover them.

    Records with the same bytes are one in the arrays, that of the smallest document.
    The windows of the others are that one's: all of them go, or, in the same
    document, those that go there. Equal windows have equal anchors and hashes, so
    that a record without one that may be another document's is in no array.
    """
    first = one_of_each(doc, length, data)
    own = np.flatnonzero(first == np.arange(len(first)))
    own = own[np.argsort(anchor[own], kind="stable")]
    again = anchor[own][1:] == anchor[own][:-1]
    own = own[np.append(again, False)[: len(own)] | np.append(False, again)[: len(own)]]
    begin = np.cumsum(length) - length
    own = own[_may_share(doc[own], length[own], data[flat_ranges(begin[own], length[own])], width)]
    found = [(own[which[p]], place[p]) for part, which, place in suffix_pieces(doc[own], length[own], data[flat_ranges(begin[own], length[own])], anchor[own], width, piece) for p in [part.repeated()]]
    record, at = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))
    later = np.flatnonzero(doc > doc[first])
    windows = -(-length[later] // width)  # enough to cover them
    twin = np.flatnonzero((first != np.arange(len(first))) & (doc == doc[first]))
    by = np.argsort(record, kind="stable")
    low, high = np.searchsorted(record[by], first[twin]), np.searchsorted(record[by], first[twin], side="right")
    return (
        np.concatenate([record, np.repeat(later, windows), np.repeat(twin, high - low)]),
        np.concatenate([at, np.minimum(width * flat_ranges(np.zeros(len(later), np.int64), windows), np.repeat(length[later] - width, windows)), at[by[flat_ranges(low, high - low)]]]),
    )


def _compare(part: pa.Table, width: int, piece: int = PIECE) -> pa.Table:
    key = part.column("key")[0].as_py()
    if key < 0:
        return part.select(["shard", "blob"])
    parts = [unpack(b) for b in _blobs(part)]
    shard = np.repeat(part.column("shard").to_numpy(), [len(p[0]) for p in parts])
    doc, row, start, length, data = (np.concatenate([p[k] for p in parts]) for k in range(5))
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    of, more_row, more_start = (np.concatenate(x) for x in ([p[5] + b for p, b in zip(parts, base, strict=False)], [p[6] for p in parts], [p[7] for p in parts]))
    anchor = np.concatenate([p[8] for p in parts])
    record, place = repeated_windows(doc, length, data, anchor, width, piece)
    # other places of the same bytes in the same document go with a record's
    by = np.argsort(of, kind="stable")
    low, high = np.searchsorted(of[by], record), np.searchsorted(of[by], record, side="right")
    hit, other = np.repeat(np.arange(len(record)), high - low), by[flat_ranges(low, high - low)]
    home, row, at = np.append(shard[record], shard[of[other]]), np.append(row[record], more_row[other]), np.append(start[record] + place, more_start[other] + place[hit])
    out = []
    order = np.argsort(home, kind="stable")
    for r in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(r):
            out.append((int(home[r[0]]), pack(*_unite(row[r], at[r], at[r] + width))))
    return pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})


def _cut(docs: pa.Table, ranges: pa.Table, with_text: bool) -> pa.Table:
    shard = _Shard(_blobs(docs)) if docs.num_rows else None
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    if shard is None:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    found = [unpack(b) for b in _blobs(ranges)]
    none = np.zeros(0, np.int64)
    row, start, end = _unite(*(np.concatenate([f[k] for f in found] or [none]) for k in range(3)))
    cut: dict[int, list] = {}
    for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
        cut.setdefault(r, []).append((s, e))
    rows = []
    for i, text in enumerate(shard.texts):
        spans, kept = cut.get(i, ()), text
        if spans:
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        doc = int(shard.doc[i])
        rows.append((None if doc == NO_DOC else doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame, width: int = 50, shard_mb: int = 4, bucket_mb: int = 8, hot: int = 2000, crowd: int = 64, piece: int = PIECE, with_text: bool = False) -> DataFrame:
    """Documents without the strings of ``width`` bytes that a smaller document has.

    docs: doc_id long, text string. Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 (and kept_text, binary, on request): one row for each row.
    width: at least 32. hot: runs with different bytes under one anchor beyond
    which its windows are dealt out by their own hash. crowd: shards with a run
    beyond which its copies are dealt out. piece: bytes of a suffix array.
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be {GRAM + 8} or more")
    spark = docs.sparkSession
    total = text_bytes(docs)
    shards, buckets = max(1, -(-total // (shard_mb << 20))), max(1, -(-total // (bucket_mb << 20)))
    parts = min(max(shuffle_partitions(spark), shards // 2), shards * 2)
    source = small_batches(docs).select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(int(NO_DOC)))), F.lit(shards)).alias("shard"))
    packed = source.mapInArrow(lambda it: _pack_documents(it, width), "shard long, blob binary").repartition(parts, "shard")
    runs = packed.groupBy("shard").applyInArrow(lambda t: _runs(t, width, buckets), "bucket long, shard long, blob binary").repartition(parts, "bucket")
    answers = runs.groupBy("bucket").applyInArrow(lambda t: _verdicts(t, hot, crowd), "shard long, bucket long, blob binary").repartition(parts, "shard")
    sent = packed.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda d, a: _send_runs(d, a, width, buckets, piece), "key long, shard long, blob binary").repartition(parts, "key")
    ranges = sent.groupBy("key").applyInArrow(lambda t: _compare(t, width, piece), "shard long, blob binary").repartition(parts, "shard")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    return packed.groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(lambda d, r: _cut(d, r, with_text), schema)
