"""Near-duplicate documents by fast similarity sketches, banding and exact verification (operator 10).

Documents are sets of word shingles; two are linked when their Jaccard
similarity is at least ``percent`` / 100. Components of links are returned, one
row a document.

1. Every text gets its set, a fast similarity sketch of it and the band keys of
   the sketch. Equal sets are one class from here on, named by its least doc_id.
2. In each bucket of a band the class with the least id is the leader. Pairs of
   leader and member are verified on their full sets, and the links give
   first components.
3. A bucket whose members are in one component by now is settled: whatever other
   links it holds join nothing new. Members of the others are compared by their
   sets of 32-bit hashes, within the bucket's task, if they are in different
   components. Of pairs that are similar enough beyond doubt one is kept for each two
   components that it joins, of pairs in doubt each; those are verified on the full sets.

So a group of n near copies costs verifications in proportion to n and to the number of
bands with leaders of their own (some 24 a member on 4,000 near copies of one text), not n * n, and no link
between components that any band has seen is left out. With 40 bands of 5 bins a
pair at 0.8 is missed by all bands with probability 1e-7. A bucket with more
members than a task should hold is dealt out as pairs of blocks; its rows are then
sent once a block, the only step that is not linear in the members.

Nulls: a document with a null or empty text, or with no words, is linked with
nothing and has n_shingles 0. A null doc_id is linked with nothing and has a
null component_id; it is kept. Rows that repeat a doc_id share its component.
Texts are read whole, however long. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, flat_ranges, slices, small_batches, string_buffer
from .graph import components
from .shingles import band_keys, overlap, shingle_sets, sketches

FEW = 200_000  # ids that may be broadcast
BLOCK = 1024  # members of a bucket that one task compares with as many others
BLOCK_HASHES = 1 << 21  # and hashes in their sets


def _features(batches, shingle: int, bins: int, bands: int):
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        for a, b in slices(np.diff(offsets), 1 << 20):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
            sketch = sketches(sets, bins)
            keys = band_keys(sketch, bands).view(np.int64)
            some = np.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if ok else None for k, ok in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "keys"],
            )


def _squeeze(batches):
    pressed = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pressed.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])


def _verify(batches, shingle: int, percent: int):
    plain = zstandard.ZstdDecompressor()

    def sets_of(blobs: list[bytes]) -> list[np.ndarray]:
        texts = [plain.decompress(z) for z in blobs]
        out = []
        for a, b in slices(np.array([len(t) for t in texts]), 1 << 20):
            joined = b"".join(texts[a:b])
            out += shingle_sets(np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64), shingle)
        return out

    last, last_set = None, None
    for batch in batches:
        for from_ in range(0, batch.num_rows, 500):
            part = batch.slice(from_, 500)
            left, right = part.column(0).to_pylist(), part.column(1).to_pylist()
            fresh = [i for i in range(len(left)) if left[i] != (left[i - 1] if i else last)]
            z = part.column(2)
            firsts = dict(zip(fresh, sets_of([z[i].as_py() for i in fresh]), strict=True))
            hits = []
            for i, other in enumerate(sets_of(part.column(3).to_pylist())):
                if i in firsts:
                    last, last_set = left[i], firsts[i]
                both = overlap(last_set, other)
                if both and 100 * both >= percent * (len(last_set) + len(other) - both):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in hits], pa.int64()), pa.array([right[i] for i in hits], pa.int64())], names=["a", "b"])


def _of(source: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``source`` whose ``key`` is in ``ids``. Up to FEW ids are broadcast, so that no text is shuffled for a few."""
    few = ids.limit(FEW + 1).count() <= FEW
    return source.join(F.broadcast(ids) if few else ids, source[key] == ids["id"], "left_semi")


def _verified(pairs: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = cut_lineage(pairs)
    texts = _of(source, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()).mapInArrow(_squeeze, "id long, z binary")
    a, b = texts.select(F.col("id").alias("a"), F.col("z").alias("za")), texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(b, "b").join(a.hint("merge"), "a").select("a", "b", "za", "zb")
    return both.mapInArrow(lambda it: _verify(it, shingle, percent), "a long, b long")


def _small_sets(batches, shingle: int):
    """The set of each text as 32-bit hashes."""
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        for a, b in slices(np.diff(offsets), 1 << 20):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in sets], pa.binary())], names=["doc", "small"])


def _cross_pairs(part: pa.Table, percent: int) -> pa.Table:
    """Pairs of a bucket's members, one of either block, in different components, that may be similar enough; see the module.

    A pair is looked at in the first band that both share only. What hashes fall
    together can add or hide is allowed for, and pairs within that are in doubt.
    """
    doc, comp, n, side = (part.column(c).to_numpy() for c in ("doc", "component", "n", "side"))
    keys = np.array(part.column("keys").to_pylist(), np.int32)
    band = int((keys == np.int32(part.column("key")[0].as_py() >> 32)).all(axis=0).argmax())
    small = [np.frombuffer(x, np.uint32) for x in part.column("small").to_pylist()]
    size = np.array([len(x) for x in small])
    start = np.cumsum(size) - size
    _, token = np.unique(np.concatenate(small), return_inverse=True)
    have = np.zeros(int(token.max(initial=0)) + 1, bool)
    _, comp = np.unique(comp, return_inverse=True)
    alone = (side == 2).any()  # a block against itself
    right = np.flatnonzero(side != 0)
    a, b = [], []
    for i in np.flatnonzero(side != 1).tolist():
        other = right[right > i] if alone else right
        other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
        if len(other):
            other = other[(keys[other] == keys[i]).argmax(axis=1) == band]
        if not len(other):
            continue
        mine = token[start[i] : start[i] + size[i]]
        have[mine] = True
        shared = np.zeros(len(other), np.int64)
        for x, y in slices(size[other], 1 << 20):
            hit = have[token[flat_ranges(start[other[x:y]], size[other[x:y]])]]
            shared[x:y] = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[other[x:y]]) - size[other[x:y]])
        have[mine] = False
        odd = n[other] * (n[i] / 2.0**32)  # hashes that fall together, in the mean
        odd = np.ceil(odd + 6 * np.sqrt(odd) + 1).astype(np.int64)
        likely = 100 * (shared + odd) >= percent * (n[other] + n[i] - shared - odd)
        sure = 100 * (shared - odd) >= percent * (n[other] + n[i] - shared + odd)
        pick = other[likely & ~sure]
        if sure.any():
            found = other[sure]
            _, first = np.unique(comp[found], return_index=True)
            pick = np.append(pick, found[first])
            comp[np.isin(comp, comp[found[first]])] = comp[i]
        a.append(np.full(len(pick), doc[i]))
        b.append(doc[pick])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _unsettled(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components, dealt to pairs of blocks: key, i, j, side, doc, n, component."""
    member = shared.join(placed.select(F.col("id").alias("doc"), "component"), "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
    open_ = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n").alias("hashes")).where("low < high")
    open_ = open_.select("key", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int").alias("blocks"))
    # block i meets block j for all i <= j; a bucket of one block is the case i = j = 0
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), F.when(j == F.col("block"), 2).when(F.col("block") < j, 0).otherwise(1).alias("side")))
    dealt = member.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    return dealt.select("key", "doc", "n", "component", F.explode(meets).alias("m")).select("key", "m.*", "doc", "n", "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bins: int = 200, bands: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate component of each row of ``docs`` (doc_id long, text string)."""
    if bins % bands:
        raise ValueError("bands must divide bins")
    source = small_batches(docs).select("doc_id", "text")
    features = cut_lineage(source.mapInArrow(lambda it: _features(it, shingle, bins, bands), "doc_id long, n_shingles long, set_key binary, keys array<long>"))
    sets = features.where("set_key is not null and doc_id is not null")
    reps = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x")).select("set_key", F.col("x.doc_id").alias("doc"), F.col("x.n_shingles").alias("n"), "x.keys")
    reps = cut_lineage(reps)
    texts = source.where("doc_id is not null")

    # most buckets have one member; the rest is all that later steps read
    rows = reps.select("doc", "n", F.explode("keys").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("doc").alias("a"), F.count("*").alias("members")).where("members > 1").select("key", "a")
    shared = cut_lineage(rows.join(leaders, "key").select("key", "doc", "n", "a"))
    stars = shared.where("doc > a").select("a", F.col("doc").alias("b")).distinct()
    first = components(cut_lineage(_verified(stars, texts, shingle, percent)))

    open_ = cut_lineage(_unsettled(shared, first))
    ids = open_.select(F.col("doc").alias("id")).distinct()
    keys = _of(reps.select("doc", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys")), ids, "doc")
    compared = _of(texts, ids).mapInArrow(lambda it: _small_sets(it, shingle), "doc long, small binary").join(keys, "doc")
    crossing = open_.join(compared, "doc").groupBy("key", "i", "j").applyInArrow(lambda t: _cross_pairs(t, percent), "a long, b long").distinct()
    more = cut_lineage(_verified(crossing, texts, shingle, percent))
    # what these links join are the first components
    at = lambda side: first.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    second = components(more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    named = reps.join(first, reps["doc"] == first["id"], "left").select("set_key", F.coalesce("component", "doc").alias("one"))
    classes = named.join(second, named["one"] == second["id"], "left").select("set_key", F.coalesce("component", "one").alias("component"))
    out = features.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
