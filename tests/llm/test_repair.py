"""Operator 11 against a plain recursion and its SQL, and its edge cases."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, copy int"  # the last two clash with names used within


def plain(codes):
    """Cost and least audit by recursion over all edits, from the last row."""
    into = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    at = {0: (0, ""), 3: (0, "")}
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            k, f = codes[i]
            new = {}
            for q in range(4):
                ways = [(4 + at[q][0], "D" + at[q][1])] if q in at else []
                if f in "nt":
                    more = 3 * (f == "t")
                    for role in "sua":
                        z = into.get((q, role))
                        if z in at and role == k:
                            ways.append((more + at[z][0], "K" + at[z][1]))
                        if z in at and role != "s":
                            ways.append((more + 3 + at[z][0], "R" + at[z][1]))
                if ways:
                    new[q] = min(ways)
            at = new
        for _ in range(4):
            for (q, role), z in into.items():
                if role != "s" and z in at:
                    way = (at[z][0] + 3, "I" + at[z][1])
                    at[q] = min(at.get(q, way), way)
    return at[0]


@pytest.mark.parametrize("size", [2, 5, 256])
def test_cheapest_edits_against_recursion(size):
    r = random.Random(size)
    for n in [0, 1, 2, 3, *(r.randint(1, 14) for _ in range(500))]:
        codes = [r.choice("suuaaax") + r.choice("nnnnbdt") for _ in range(n)]
        want = plain(codes)
        assert repair.cheapest(codes, repair.EMPTY, repair.END) == want
        if n:
            blocks = [repair._solve(b, "".join(codes[a : a + size]), size) for b, a in enumerate(range(0, n, size))]
            assert repair._join(blocks) == want


def conversations(spark, seed, n, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No", " ", "", None, "Why? \n", "é中文。", "a b.\x0b", "x" * r.randint(1, 3000) + "!"])
            rows += [(c if c else None, r.choice([t, t, t, 1, None]), role, text, "x", 3)] * r.choice([1, 1, 1, 2])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [3, 256])
def test_repair_against_sql(spark, tmp_path, size):
    given = conversations(spark, 5, 40, 12).union(conversations(spark, 6, 2, 300).withColumn("conv_id", F.lit(77).cast("long")))
    given.coalesce(1).write.parquet(f"{tmp_path}/c")
    found = repair.repair_damaged(spark.read.parquet(f"{tmp_path}/c"), size)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({repair.sql()})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_repaired_turns_are_legal_and_hash_as_told(spark):
    given = repair.damage(repair.prepared(conversations(spark, 9, 30, 9)))
    turns = {}
    for x in repair.repaired_turns(given, 4).collect():
        turns.setdefault(x.conv, {})[x.position] = (x.role, x.text)
    found = repair.repair(given, 4).collect()
    for x in found:
        said = [turns.get(x.conv, {})[i] for i in range(len(turns.get(x.conv, {})))]
        initials = "".join(role[0] for role, _ in said)
        assert not initials or initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert x.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
    assert {x.conv for x in found} >= set(turns)


def test_conversations_without_rows(spark):
    lost = next(i for i in range(1, 10_000) if __import__("zlib").crc32(f"{i}:1".encode()) % 20 == 0)
    x = repair.repair_damaged(spark.createDataFrame([(lost, 1, "user", "Hi.", "", 0)], SCHEMA)).first()
    assert (x.conv_id, x.gaps, x.blank, x.cost, x.audit, x.repaired_sha256) == (lost, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
