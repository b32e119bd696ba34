"""Repair of conversation structure: the cheapest edits that give turns a legal order, found by bidirectional Dijkstra (operator 11).

A conversation is legal if its role initials are ``(s?(ua)+)?``. Edits go row by row:
Keep (0), Rerole to user or assistant (3), Delete (4; blank and repeated rows must go),
and an empty user or assistant turn may be Inserted anywhere (3); a truncated row
that stays adds 3. Nodes of the lattice are (rows read, state of the legal order).
Forward and reverse heaps meet; all crossings of equal cost are finished, and of the cheapest
audits (initials of the edits in order) the least is taken. A prefix of an audit never costs as
much as the whole with the same rows read, so the least audit is made of least parts: blocks
of ``BLOCK`` rows are solved from each state to each state, wherever they are, and joined.

Numbers of rows come from ranges, so no conversation is sorted or held by one task. One task does
hash a conversation's repaired text, since the digest of a whole is one; it reads it row by row,
with the audit (a byte a row) in memory.

Nulls: a null role or text counts as one space, a null conv_id is a conversation of its own
(written as one space where its number goes into a digest), a null turn stands first. Rows that share a turn go
by role, then text, then the copy's number. A role without s, u or a as its first letter, the empty one included,
can't be kept as it is. Repeated rows are duplicates. Extra columns are ignored. An empty table gives an empty result; an original
conversation without rows gives zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers

BLOCK = 256
SPACES = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, REPLY = range(4)  # nothing yet, system, user asked, answered
END = (EMPTY, REPLY)
_INTO = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}}
_INSERT = _INTO["u"] | _INTO["a"]  # from each state at most one kind of turn can follow
RESULT = "conv string, illegal long, cost long, audit string"


@lru_cache(None)
def _row_edges(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, edit) of a row; code: class of the role and kind of fault."""
    kind, fault = code
    out = [(q, q, 4, "D") for q in range(4)]
    if fault in "nt":
        more = 3 * (fault == "t")
        out += [(q, z, more, "K") for q, z in _INTO.get(kind, {}).items()]
        out += [(q, z, 3 + more, "R") for q, z in _INSERT.items()]
    return out


@lru_cache(None)
def _edges(code: str, back: bool) -> list[list[tuple[int, int, str]]]:
    """By state: (other state, cost, edit), read forward or back."""
    out: list = [[], [], [], []]
    for q, z, c, e in _row_edges(code):
        out[z if back else q].append((q if back else z, c, e))
    return out


_FORWARD = [[(z, 3, "I")] if (z := _INSERT.get(q)) is not None else [] for q in range(4)]
_BACK = [[(q, 3, "I") for q, z in _INSERT.items() if z == at] for at in range(4)]


def cheapest(rows: list[str], entry: int, exits: tuple[int, ...], tail: bool = True) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from ``entry`` to one of ``exits``; ``tail``: turns may be added after the last row."""
    m = len(rows)

    def steps(i: int, q: int, back: bool):
        if tail or i < m:
            for z, c, e in (_BACK if back else _FORWARD)[q]:
                yield (i, z), c, e
        if (i > 0) if back else (i < m):
            for z, c, e in _edges(rows[i - 1 if back else i], back)[q]:
                yield (i - 1 if back else i + 1, z), c, e

    label: tuple[dict, dict] = ({(0, entry): (0, "")}, {(m, q): (0, "") for q in exits})
    # by cost, then by rows read: what costs nothing reads a row, so a node is final when it is taken
    heaps: tuple[list, list] = ([(0, 0, (0, entry))], [(0, 0, (m, q)) for q in exits])
    done: tuple[set, set] = (set(), set())
    best = min((c for n, (c, _) in label[0].items() if n in label[1]), default=None)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        back = heaps[1][0] < heaps[0][0]
        cost, _, node = heappop(heaps[back])
        if node in done[back]:
            continue
        done[back].add(node)
        mine, other = label[back], label[not back]
        audit = mine[node][1]
        for to, c, e in steps(*node, back):
            new = (cost + c, e + audit if back else audit + e)
            if to in other and (best is None or new[0] + other[to][0] < best):
                best = new[0] + other[to][0]
            if to not in mine or new < mine[to]:
                if to not in mine or new[0] < mine[to][0]:
                    heappush(heaps[back], (new[0], m - to[0] if back else to[0], to))
                mine[to] = new
    if best is None:
        return None
    # every label is a real way; of the least one each node is final on one side at least
    found = []
    for node, (cost, audit) in label[0].items():
        if node in label[1] and cost + label[1][node][0] == best:
            found.append(audit + label[1][node][1])
        for to, c, e in steps(*node, False):
            if to in label[1] and cost + c + label[1][to][0] == best:
                found.append(audit + e + label[1][to][1])
    return best, min(found)


_TAIL = {EMPTY: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), REPLY: (0, "")}


@lru_cache(20_000)
def _solve(block: int, codes: str, size: int) -> tuple[list[int | None], list[str | None]]:
    """A conversation that is one short block: one cost and audit; any other block: those from each state to each state, without turns added at its end."""
    rows = [codes[i : i + 2] for i in range(0, len(codes), 2)]
    if block == 0 and len(rows) < size:
        found = [cheapest(rows, EMPTY, END)]
    else:
        found = [cheapest(rows, p, (q,), False) for p in range(4) for q in range(4)]
    return [x and x[0] for x in found], [x and x[1] for x in found]


def _join(blocks: list[tuple[list, list]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from those of its blocks in order."""
    if len(blocks[0][0]) == 1:
        return blocks[0][0][0], blocks[0][1][0]
    at: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
    for costs, audits in blocks:
        ways: dict[int, tuple[int, str]] = {}
        for p, (c, a) in at.items():
            for q in range(4):
                if costs[4 * p + q] is not None:
                    new = (c + costs[4 * p + q], a + audits[4 * p + q])
                    ways[q] = min(ways.get(q, new), new)
        at = ways
    return min((c + _TAIL[q][0], a + _TAIL[q][1]) for q, (c, a) in at.items())


def _illegal(kinds: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(kinds, kinds[1:], strict=False)))


def apply_audit(audit: str, turns):
    """The repaired turns (role, text); ``turns`` is any iterator of (role, text)."""
    last = ""
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def prepared(rows: DataFrame) -> DataFrame:
    """conv (a key that is never null), conv_id, turn, role, text; null roles and texts are one space."""
    one = F.lit(" ")
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), one).alias("conv"), "conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``prepared`` with faults by a checksum of conversation and turn: 0 drops a row, 1 empties its text, 2 takes its final marks, 3 repeats it, 4 makes it the user's. Adds ``copy``."""
    fate = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    out = rows.withColumn("fate", fate).where("fate <> 0").withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv", "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "copy")


def _coded(rows: DataFrame) -> DataFrame:
    """conv, turn, seq, role, text, code: the class of the role (s, u, a, x) and the first fault (b, d, t, n)."""
    bare, letter = F.rtrim(F.col("text"), F.lit(SPACES)), F.left("role", F.lit(1))
    state = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("n")
    # all that is asked of a text, before it is numbered: only what hashes the repaired texts carries them on
    marked = rows.select("*", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("kind"), state.alias("state"), F.sha2("text", 256).alias("digest"))
    numbered = row_numbers(marked, ["conv"], [F.asc_nulls_first("turn"), "role", "text", "copy"], "seq")
    first = numbered.groupBy("conv", "role", "digest").agg(F.min("seq").alias("seq")).select("conv", "seq", F.lit(True).alias("new"))
    fault = F.when((F.col("state") != "b") & F.col("new").isNull(), "d").otherwise(F.col("state"))
    return numbered.join(first, ["conv", "seq"], "left").select("conv", "turn", "seq", "role", "text", F.concat("kind", fault).alias("code"))


def _audits(coded: DataFrame, size: int) -> DataFrame:
    """RESULT of each conversation."""
    blocks = coded.groupBy("conv", F.floor((F.col("seq") - 1) / size).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), "").alias("codes"))  # at most ``size`` rows each

    def solved_block(conv, block, codes):
        kinds = codes[::2]
        return conv, block, *_solve(block, codes, size), _illegal(kinds), kinds[0] + kinds[-1]

    def solve(batches):
        rows = (solved_block(*r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(rows, 1000, ("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("illegal", pa.int64()), ("ends", pa.string()))

    def whole(conv, parts):
        cost, audit = _join([(p["costs"], p["audits"]) for p in parts])
        between = sum(_illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(parts, parts[1:], strict=False))
        return conv, sum(p["illegal"] for p in parts) + between, cost, audit

    def join(batches):
        rows = (whole(*r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(rows, 1000, ("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()))

    solved = blocks.mapInArrow(solve, "conv string, block long, costs array<long>, audits array<string>, illegal long, ends string")
    parts = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "audits", "illegal", "ends"))).alias("parts"))
    return parts.mapInArrow(join, RESULT)


def _ordered(coded: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, seq, role, text: of each conversation its audit (as the text of number 0), then its rows by number."""
    first = audits.select("conv", F.lit(0).cast("long").alias("seq"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return coded.select("conv", "seq", "role", "text").unionByName(first).repartition("conv").sortWithinPartitions("conv", "seq")


def _mended(batches):
    """(conv, iterator of its repaired turns) of rows of ``_ordered``, which are read once and never held."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)

    def turns():
        nonlocal row
        while (row := next(rows, None)) is not None and row[1]:
            yield row[2], row[3]

    while row is not None:
        conv, left = row[0], turns()
        yield conv, apply_audit(row[3], left)
        for _ in left:  # what no edit has read
            pass


def _batches(rows, size: int, *types: tuple[str, pa.DataType]):
    """Arrow batches of at most ``size`` rows of an iterator of tuples."""
    schema = pa.schema(types)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _digests(coded: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256."""

    def digest(turns) -> str:
        out, between = hashlib.sha256(), b""
        for role, text in turns:
            out.update(between + f"{role}:{text}".encode())
            between = b"\n"
        return out.hexdigest()

    def run(batches):
        yield from _batches(((conv, digest(turns)) for conv, turns in _mended(batches)), 1000, ("conv", pa.string()), ("repaired_sha256", pa.string()))

    return _ordered(coded, audits).mapInArrow(run, "conv string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv, position (from 0), role, text of each repaired conversation; rows as of ``damage``."""
    coded = _coded(rows)

    def run(batches):
        found = ((conv, i, *turn) for conv, turns in _mended(batches) for i, turn in enumerate(turns))
        yield from _batches(found, 1000, ("conv", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()))

    return _ordered(coded, _audits(coded, size)).mapInArrow(run, "conv string, position long, role string, text string")


def repair(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal, gaps, cost, audit, repaired_sha256 of each conversation; rows as of ``damage``."""
    coded = _coded(rows)
    fault = F.right("code", F.lit(1))
    counts = coded.groupBy("conv").agg(
        *[F.count_if(fault == k[0]).alias(k) for k in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    audits = _audits(coded, size)
    return counts.join(audits, "conv").join(_digests(coded, audits), "conv")


def repair_damaged(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of op11: each original conversation after ``damage`` and ``repair``."""
    rows = prepared(conversations)
    found = repair(damage(rows), size)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return rows.select("conv", "conv_id").distinct().join(found, "conv", "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


def sql() -> str:
    """DuckDB: the same by recursion over the rows from the last; v holds cost and audit from each state to the end."""
    one = lambda c, a, v: f"{{'c': {v}.c + {c}, 'a': '{a}' || {v}.a}}"
    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    start = "{'c': 0::BIGINT, 'a': ''}"
    low = lambda *xs: f"list_min([{', '.join(xs)}])"
    names = ("e", "s", "u", "r")
    into = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "r"}, "r": {"u": "u"}}

    def row(q: str) -> str:
        ways = [one(4, "D", f"v.{q}")]
        for kind, z in into[q].items():
            ways.append(f"CASE WHEN k = '{kind}' AND f IN ('n', 't') THEN {one('t', 'K', f'v.{z}')} ELSE {none} END")
            if kind != "s":
                ways.append(f"CASE WHEN f IN ('n', 't') THEN {one('(3 + t)', 'R', f'v.{z}')} ELSE {none} END")
        return low(*ways)

    def closed(e: str, s: str, u: str, r: str) -> str:
        """With turns inserted before the next row."""
        cu = low(u, one(3, "I", f"({r})"))
        return f"{{'e': {low(e, one(3, 'I', f'({cu})'))}, 's': {low(s, one(3, 'I', f'({cu})'))}, 'u': {cu}, 'r': {low(r, one(3, 'I', f'({u})'))}}}"

    step = "{" + ", ".join(f"'{q}': {row(q)}" for q in names) + "}"
    bits = "flatten([[ascii(b), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] FOR b IN string_split(key, '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
k AS (SELECT *, conv || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM c), h AS (SELECT *, {crc} % 20 AS fate FROM k),
g AS (SELECT conv, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fate <> 0),
n AS (SELECT *, rtrim(text, {ws}) AS bare, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS seq FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY seq) AS again, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY seq) AS before, count(*) OVER (PARTITION BY conv) AS size FROM n),
x AS (SELECT conv, turn, seq, size, role, text, left(role, 1) AS k, before || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS f FROM o),
y AS (SELECT *, CASE f WHEN 't' THEN 3 ELSE 0 END AS t FROM x),
walk AS (SELECT DISTINCT conv, size AS i, {closed(start, none, none, start)} AS v FROM y
 UNION ALL SELECT conv, i - 1, {closed('w.e', 'w.s', 'w.u', 'w.r')} FROM (SELECT conv, i, {step} AS w FROM walk JOIN y USING (conv) WHERE y.seq = walk.i)),
best AS (SELECT conv, v.e.c AS cost, v.e.a AS audit FROM walk WHERE i = 0),
ed AS (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS spot FROM best),
el AS (SELECT conv, spot, audit[spot] AS edit, spot - length(replace(left(audit, spot), 'I', '')) AS added FROM ed),
em AS (SELECT el.conv, spot, edit, role, text FROM el LEFT JOIN y ON edit <> 'I' AND y.conv = el.conv AND y.seq = spot - added WHERE edit <> 'D'),
ep AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY spot) - 1 - max((edit = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY conv) AS place FROM em),
er AS (SELECT conv, spot, CASE WHEN edit = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM ep),
eh AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY spot)) AS digest FROM er GROUP BY conv),
z AS (SELECT conv, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (odd) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM y GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) LEFT JOIN z USING (conv) LEFT JOIN best USING (conv) LEFT JOIN eh USING (conv)"""
