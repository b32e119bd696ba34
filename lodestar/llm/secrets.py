"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that finds more (operator 9).

The field tags each token as the begin of a secret, inside one or outside, from
its shape, the words near it and features of the file, decoded by Viterbi. It
learns from the pattern matches in a bounded sample of documents (the first
``max_docs`` by a hash of doc_id). So that it does not merely repeat the patterns, a
match is learnt from with its own cues hidden too: with its key word replaced by
another word of the text, and with its value replaced by random characters of other
alphabets and lengths. Plain words, numbers, dates, paths and the like in the place
of values are learnt as no secrets.
Pattern matches always stay; the field adds spans that overlap none of them.

Spans count code points, the end excluded. Nulls: a null or empty text has no
spans. A null doc_id is searched, but no model learns from it. Rows that repeat
give repeated rows. Texts are searched whole, however long. An empty table gives an
empty result; with no match to learn from the field adds nothing. Extra columns are
ignored, or kept as they are by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, string_buffer
from .crf import Crf, Potentials, viterbi

# fixed values: the patterns of the three kinds, and the least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as [0-9a-f]+ of 32 and more
LEAST_VALUE, LEAST_ACCESS = 8, 16
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile("[A-Za-z0-9_+/.\\-\x80-\U0010ffff]+|[^\\x09-\\x0d\\x20]")
_CLASS = np.full(256, 2, np.uint8)  # of bytes: 1 part of a word, 2 a token of its own, 0 white space
_CLASS[[*string.ascii_letters.encode(), *string.digits.encode(), *b"_+/.-", *range(128, 256)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
OUT, BEGIN, INSIDE = 0, 1, 2
STRETCH = 12  # tokens on each side of a secret in a training chain
LONGEST = 128  # characters of a token in one
WITH_KEY = (0, 3, 6)  # variants of a chain that show its key word
# alphabets of the random values that stand for a match's own
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/", string.hexdigits.lower()[:16])


def token_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each match of ``TOKEN`` in joined texts in UTF-8; no token crosses texts."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new = (kind == 2) | edge[:-1]
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    real = kind[start] > 0
    return start[real], end[real]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of each pattern match, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def features(token: str) -> list[str]:
    n = len(token)
    lower, upper, digit = (sum(map(f, token)) for f in (str.islower, str.isupper, str.isdigit))
    mix = "".join(x for x, k in (("a", lower), ("A", upper), ("0", digit), ("-", n - lower - upper - digit)) if k)
    if n < 8:  # words, numbers and marks
        return ["bias", f"n={n}", f"mix={mix}", f"short={mix}{n}"]
    code = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in token[:LONGEST])
    turns = sum(map(str.__ne__, code, code[1:]))
    plain = code.lstrip("A").strip("-").replace("a", "") == ""  # a word, perhaps with a capital
    return ["bias", f"n={int(2 * math.log2(n))}", f"mix={mix}", f"mixn={mix}{n >= 12}{n >= 16}{n >= 24}", f"turns={min(turns, 8)}", f"often={8 * turns // n}", f"digits={8 * digit // n}", f"kinds={min(len(set(token)), 20) // 2}", f"plain={plain}", f"ascii={token.isascii()}"]


def neighbour(token: str) -> list[str]:
    return ["w=" + token.lower()] if len(token) < 16 else ["w=long"]


def file_features(text: str) -> list[str]:
    low = text.lower()
    return [f"file.n={int(math.log2(len(text) + 1))}", f"file.key={any(k in low for k in KEYS)}", f"file.code={'{' in text or ';' in text}", f"file.quote={chr(34) in text}"]


def _variants(tokens: list[str], tags: list[int], words: list[str], seed: int):
    """A training chain as it is, and with the cues of its secrets hidden."""
    r = random.Random(seed)
    value = "".join(r.choices(r.choice(ALPHABETS), k=r.randint(12, 44)))
    word = r.choice(words)
    no_key = [r.choice(words) if y == OUT and any(k in t.lower() for k in KEYS) else t for t, y in zip(tokens, tags, strict=True)]
    bare = [t for t, y in zip(no_key, tags, strict=True) if y != OUT or t not in ":=\"'"], [y for t, y in zip(no_key, tags, strict=True) if y != OUT or t not in ":=\"'"]

    def valued(chain: list[str], marks: list[int], new: str, tag: int) -> tuple[list[str], list[int]]:
        kept = [(new, tag) if y == BEGIN else (t, y) for t, y in zip(chain, marks, strict=True) if y != INSIDE]
        return [t for t, _ in kept], [y for _, y in kept]

    yield tokens, tags
    yield no_key, tags
    yield bare
    yield valued(tokens, tags, value, BEGIN)
    yield valued(*bare, value, BEGIN)
    yield valued(no_key, tags, value, BEGIN)
    yield valued(tokens, tags, word, OUT)
    number = lambda n: "".join(r.choices(string.digits, k=n))
    some = lambda: "".join(r.choices(words, k=r.randint(1, 2)))[:24]
    plain = [f"{number(4)}-{number(2)}-{number(2)}", f"{number(3)}-{number(7)}", number(r.randint(1, 14)), f"{number(1)}.{number(2)}.{number(1)}", f"www.{some()}.com/{some()}-{some()}", f"/{some()}/{some()}/{some()}.html", f"{some()}_{some()}_{some()}", f"{some()}-{some()}-{some()}".upper(), f"{some().title()}{some().title()}{some().title()}{number(1)}"]
    for chain in (bare, (no_key, tags), bare):
        yield valued(*chain, r.choice(plain), OUT)


def _training(batches, hidden: int):
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            marks = list(TOKEN.finditer(text or ""))
            if not marks:
                continue
            tokens, tags = [m.group()[:LONGEST] for m in marks], [OUT] * len(marks)
            starts = np.array([m.start() for m in marks])
            centres, unknown = [], []
            for _, kind, end, value in base_spans(text):
                a, b = np.searchsorted(starts, [value, end])
                if b > a and kind == hidden:
                    unknown.append(int(a))
                elif b > a:
                    tags[a:b] = [BEGIN] + [INSIDE] * (b - a - 1)
                    centres.append(int(a))
            unknown = [a for a in unknown if tags[a] == OUT]
            words = [t for t in tokens if t.isalpha()][:1000] or ["it"]
            names, last = file_features(text), -1
            for c in centres or [zlib.crc32(text.encode()) % len(tokens)]:
                if c > last:
                    a, last = max(last, c - STRETCH, 0), c + STRETCH
                    if any(a <= x < last for x in unknown):
                        continue
                    chain = tokens[a:last], tags[a:last]
                    variants = enumerate(_variants(*chain, words, zlib.crc32(f"{doc} {a}".encode())) if centres else [chain])
                    rows += [(doc, a, k, *x, names) for k, x in variants if not (centres and k in WITH_KEY and KINDS[hidden] == "assign")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())))], names=["doc_id", "start", "variant", "tokens", "tags", "file"])


def fit(docs: DataFrame, max_docs: int = 5000, max_chains: int = 4000, hidden: str | None = None) -> Crf:
    """The field, learnt from at most ``max_chains`` stretches with and half as many without matches of at most ``max_docs`` documents.

    hidden: a kind of pattern of which the field learns nothing, to measure how many of its matches it finds by itself.
    """
    ids = small_batches(docs).where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    without = KINDS.index(hidden or "crf")
    chains = sample.mapInArrow(lambda it: _training(it, without), "doc_id long, start long, variant int, tokens array<string>, tags array<int>, file array<string>")
    chains = chains.withColumn("hit", F.exists("tags", lambda x: x > 0) | (F.col("variant") > 0))
    order = [F.xxhash64("doc_id", "start"), "doc_id", "start", "variant", "tokens"]
    taken = [r for hit, n in ((True, max_chains), (False, max_chains // 2)) for r in chains.where(F.col("hit") == hit).orderBy(*order).limit(n).collect()]
    crf = Crf(3, features, neighbour, (-3, -2, -1, 1))
    if any(any(r["tags"]) for r in taken):
        crf.fit([(r["tokens"], r["tags"], r["file"]) for r in taken], rounds=60)
        crf.moves[OUT, INSIDE] -= 8.0  # a secret begins with its begin
    return crf


def _find(texts: list[str], store: Potentials) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text."""
    found = [[(s, k, e) for s, k, e, _ in base_spans(t)] for t in texts]
    crf = store.model
    if not len(crf.index):
        return found
    data, offsets = string_buffer(pa.array(texts, pa.large_string()))
    start, end = token_ranges(data, offsets)
    at = np.searchsorted(start, offsets)
    path = viterbi(store.unary(data, start, end, at, [file_features(t) for t in texts]), at, crf.moves, OUT)
    new: dict[int, list] = {}
    for k in np.flatnonzero(path).tolist():
        i = int(np.searchsorted(at, k, side="right")) - 1
        spans = new.setdefault(i, [])
        if path[k] == INSIDE and spans and spans[-1][2] == k - 1:
            spans[-1][1:] = [end[k], k]
        else:
            spans.append([start[k], end[k], k])
    for i, spans in new.items():
        whole, base = data[offsets[i] : offsets[i + 1]].tobytes(), found[i]
        places = np.array([x for s, e, _ in spans for x in (s, e)]) - offsets[i]
        if not texts[i].isascii():
            places = np.cumsum([len(whole[a:b].decode()) for a, b in zip([0, *places[:-1].tolist()], places.tolist(), strict=True)])
        pairs = places.reshape(-1, 2).tolist()
        found[i] = sorted(base + [(s, 3, e) for s, e in pairs if not any(s < y and x < e for x, _, y in base)])
    return found


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _parts(batch, column: int):
    own = batch.column(column)
    for a, b in slices(np.diff(string_buffer(own)[1]), 1 << 19):
        yield a, b, [x or "" for x in own.slice(a, b - a).to_pylist()]


def find_secrets(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, the number of matches of each pattern, spans (kind, start, end) and the digest of the pattern matches, of every row of ``docs`` (doc_id long, text string)."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        store = Potentials(shared.value)
        for batch in batches:
            for a, b, texts in _parts(batch, 1):
                found = _find(texts, store)
                base = [[x for x in f if x[1] < 3] for f in found]
                counts = [[sum(x[1] == k for x in f) for f in base] for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(_named(f).encode()).hexdigest() for f in base]),
                        pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, model: Crf, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by ``mask`` and, if there is such a column, ``n_chars`` counted anew; all else as it is."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    column, length = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        store = Potentials(shared.value)
        for batch in batches:
            texts, sizes = batch.column(column).to_pylist(), batch.column(length).to_pylist() if length >= 0 else []
            for a, b, part in _parts(batch, column):
                for i, spans in enumerate(_find(part, store)):
                    if spans:
                        out, at = [], 0
                        for s, _, e in spans:
                            if s >= at:
                                out += [part[i][at:s], mask]
                            at = max(at, e)
                        texts[a + i] = "".join([*out, part[i][at:]])
                        if length >= 0:
                            sizes[a + i] = len(texts[a + i])
            arrays = list(batch.columns)
            arrays[column] = pa.array(texts, arrays[column].type)
            if length >= 0:
                arrays[length] = pa.array(sizes, arrays[length].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
