"""Benchmark decontamination by spaced seeds, in DataFrame functions only (operator 5).

Texts are words of letters and digits in lower case. A mask such as 1101 at a
word position hashes the words under its ones and skips those under its zeros, so
a substituted word under a zero changes nothing. Test and training hashes are
joined; each hit gives a diagonal (position in the document minus position in the
item), and along every diagonal hit the two texts are compared word by word. A
document is contaminated by an item if some ``window`` words in a row, or the
whole item if it is shorter, agree in at least ``percent`` of the words.

With the default masks every window of 12 words with up to 2 substitutions is hit
by one of them at least, wherever those fall. An item shorter than ``window`` is
cut into one piece more than the substitutions it may have; one piece at least is
then free of them, and pieces are seeds too, down to the whole item. Documents
have seeds of those lengths only that the items' pieces have.

The seeds of the items are broadcast only if they number ``broadcast_rows`` or
fewer; beyond that the join is shuffled. The documents' seeds are never shuffled
in the first case, and in both only hits go on.

Nulls and edges: rows with a null id and texts without words match nothing (``clean``
judges rows with a null id by their texts). Texts are read whole, however long; an
empty table on either side gives an empty result. An item that hangs over an edge of the document lacks those words. Rows that repeat
an id give one result a pair, the best. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MASKS = ("11010011", "11000111", "1110011")


def words(text: Column) -> Column:
    """The words of a text: runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(table: DataFrame, key: str) -> DataFrame:
    """(key, h): the hashes of each text's words."""
    return table.where(F.col(key).isNotNull()).select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def seeds(h: Column, masks: tuple[str, ...]) -> Column:
    """An array of (p, seed) of each mask at each word position p where it fits."""

    def of(number: int, mask: str) -> Column:
        at = [i for i, c in enumerate(mask) if c == "1"]
        places = F.when(F.size(h) >= len(mask), F.sequence(F.lit(0), F.size(h) - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(p.alias("p"), F.xxhash64(F.lit(number), *[F.get(h, p + i) for i in at]).alias("seed")))

    return F.concat(*[of(n, m) for n, m in enumerate(masks)])


def stretch(h: Column, p: Column, length: Column) -> Column:
    """(p, seed) of ``length`` words in a row."""
    return F.struct(p.alias("p"), F.xxhash64(-length, F.slice(h, p + 1, length)).alias("seed"))


def pieces(h: Column, percent: int) -> Column:
    """An array of (p, length): the words of a short item in one piece more than may be substituted."""
    n = F.size(h)
    count = F.least(n, n - F.ceil(n * percent / F.lit(100)).cast("int") + 1)
    cut = lambda k: F.floor(k * n / count).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(cut(k).alias("p"), (cut(k + 1) - cut(k)).alias("length")))


def grams(h: Column, lengths: list[int]) -> list[Column]:
    """For each length an array of (p, seed) at each word position p where it fits."""

    def of(length: int) -> Column:
        places = F.when(F.size(h) >= length, F.sequence(F.lit(0), F.size(h) - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: stretch(h, p, F.lit(length)))

    return [of(n) for n in lengths]


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 12, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, matched (agreeing words on the best diagonal), best (most agreeing words in a window of it).

    docs: doc_id, text; benchmark: item_id, text. One row for each pair that is contaminated.
    """
    items = hashed(benchmark, "item_id")
    short = items.where(F.size("h") < window).select("item_id", "h", pieces(F.col("h"), percent).alias("pieces"))
    lengths = sorted(r[0] for r in short.select(F.explode("pieces.length")).distinct().collect())  # fewer than window
    item_seeds = items.where(F.size("h") >= window).select("item_id", F.explode(seeds(F.col("h"), masks)).alias("s"))
    if lengths:
        item_seeds = item_seeds.unionByName(short.select("item_id", F.explode(F.transform("pieces", lambda x: stretch(F.col("h"), x["p"], x["length"]))).alias("s")))
    item_seeds = item_seeds.select("item_id", F.col("s.p").alias("ip"), F.col("s.seed").alias("seed"))
    few = item_seeds.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = hashed(docs, "doc_id")
    doc_seeds = texts.select("doc_id", F.explode(F.concat(seeds(F.col("h"), masks), *grams(F.col("h"), lengths))).alias("s")).select("doc_id", F.col("s.p").alias("dp"), F.col("s.seed").alias("seed"))
    hits = doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    lines = cut_lineage(hits.select("doc_id", "item_id", (F.col("dp") - F.col("ip")).alias("shift")).distinct())

    # only texts with a hit are hashed again and shuffled
    ids = lines.select("doc_id").distinct()
    known = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = hashed(docs.join(F.broadcast(ids) if known else ids, "doc_id", "left_semi"), "doc_id")
    both = lines.join(texts.withColumnRenamed("h", "dh"), "doc_id").join(items.withColumnRenamed("h", "ih"), "item_id")
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("ih"), F.size("dh") - F.col("shift"))
    same = F.transform(F.sequence(low, high - 1), lambda i: (F.get("ih", i) == F.get("dh", i + F.col("shift"))).cast("int"))
    aligned = both.where(high > low).select("doc_id", "item_id", F.size("ih").alias("n"), same.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(1), F.greatest(F.size("same") - window + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda p: total(F.slice("same", p, window))))
    judged = aligned.select("doc_id", "item_id", "n", total(F.col("same")).alias("matched"), best.alias("best"))
    wanted = F.least(F.col("n"), F.lit(window)) * percent
    found = judged.where(F.col("best") * 100 >= wanted)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("best").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they are. Rows without a doc_id are judged by their texts."""
    named = docs.join(contaminated(docs, benchmark, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return named
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = contaminated(nameless.select(digest.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("digest")).distinct()
    return named.where("doc_id is not null").unionByName(nameless.join(bad, digest == bad["digest"], "left_anti").select(*docs.columns))


def sql(masks: tuple[str, ...] = MASKS, window: int = 12, percent: int = 80) -> str:
    """DuckDB SQL for ``contaminated`` over tables documents and benchmark."""

    def side(name: str, key: str) -> str:
        parts = []
        for number, mask in enumerate(masks):
            at = [i for i, c in enumerate(mask) if c == "1"]
            key_ = ", ".join(f"h[p + {i + 1}]" for i in at)
            parts.append(f"SELECT {key}, p, {number} AS m, [{key_}] AS seed FROM (SELECT {key}, h, unnest(range(len(h) - {len(mask) - 1})) AS p FROM {name})")
        return " UNION ALL ".join(parts)

    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {split} AS h FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, {split} AS h FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({side("d", "doc_id")}), bs AS ({side("i", "item_id")}),
lines AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
aligned AS (SELECT doc_id, item_id, len(i.h) AS n,
  [CASE WHEN i.h[k + 1] = d.h[k + shift + 1] THEN 1 ELSE 0 END FOR k IN range(greatest(0, -shift), least(len(i.h), len(d.h) - shift))] AS same
  FROM lines JOIN d USING (doc_id) JOIN i USING (item_id)),
judged AS (SELECT doc_id, item_id, n, list_sum(same) AS matched,
  list_max([list_sum(same[p:p + {window - 1}]) FOR p IN range(1, greatest(len(same) - {window - 1}, 1) + 1)]) AS best FROM aligned WHERE len(same) > 0)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(best) AS INTEGER) AS best
FROM judged WHERE best * 100 >= least(n, {window}) * {percent} GROUP BY doc_id, item_id"""
