"""The prefix trie against a plain dictionary of prefixes, with buckets of every size."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmatch.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, seq long, bucket string, n long"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - int(c / 20) * 20 if c < 0 else c % 20
        built[c] = own.get(c - leader, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids.get(path, [])) or 1
        saved[path] = (len(nodes[path]) - 1) * words + sum(saved[k] for k in kids.get(path, []))
    sha = lambda own: hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
    return sorted(
        str((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha([c for c in m if len(built[c]) == len(p)]))) for p, m in nodes.items()
    )


def got(spark, rows, **how):
    return sorted(str(tuple(r)) for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect())


def made(seed, n=120, words=("a b", "c", "d e f", "")):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c * 3, t * 400, r.choice(["user", "user", "assistant", None]), r.choice(words) if r.random() < 0.7 else f"own {c} {t}", 1, "b", 2))
    return rows


@pytest.mark.parametrize("local", [0, 3, 40, 50_000])
def test_random_forests(spark, local):
    rows = made(local, words=("a b", "c"))
    assert got(spark, rows, local=local) == plain(rows)


def test_copies_snapshots_and_long_logs(spark):
    """Many copies of one conversation, a log stored again after every turn, one very long conversation, one hot first turn."""
    turn = lambda c, t, text, role="user": (c, t, role, text, 1, "x", 1)
    rows = [turn(1000 + c, t, f"copy {t}") for c in range(60) for t in range(6)]
    rows += [turn(2000 + c, t, f"log {t}") for c in range(25) for t in range(c + 1)]
    rows += [turn(5000, t, f"long {t}") for t in range(2500)] + [turn(5001, t, f"long {t}") for t in range(1300)]
    rows += [turn(7000 + c, t, "hello" if t == 0 else f"{c} {t}") for c in range(40) for t in range(3)]
    want = plain(rows)
    for local in (30, 50_000):
        assert got(spark, rows, local=local) == want


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated rows, negative ids, conversations that lose all their turns."""
    rows = [(None, 1, "user", "lost", 1, "", 1), (5, None, None, None, 1, "", 1), (5, 1, "user", "x y", 1, "", 1), (5, 1, "user", "x y", 1, "", 1), (5, 2, "", "z", 1, "", 1)]
    rows += [(c, 0, "user", "only one word\vtwo", 1, "", 1) for c in range(-45, 60)] + [(77, 0, "user", "long " * 50_000, 1, "", 1)]
    assert got(spark, rows) == plain(rows) == got(spark, rows, local=1)
    assert got(spark, []) == got(spark, [(None, 1, "user", "lost", 1, "", 1)]) == []
    alone = [(41, 0, "user", "a", 1, "", 1)]
    assert got(spark, alone) == plain(alone)


def test_rows_without_a_turn(spark):
    """They come in one order, whatever their place in the table, before all others."""
    rows = [(7, None, "user", f"t {i}", 1, "", 1) for i in range(40)] + [(7, -5, "user", "after", 1, "", 1)]
    first = got(spark, rows)
    assert first == got(spark, rows[::-1]) and len(first) == len(plain(rows))


def test_ids_in_many_pieces(spark):
    members = spark.range(0, 5000).select(F.lit(1).cast("bigint").alias("len"), (F.col("id") % 3).alias("x1"), F.when(F.col("id") % 3 == 2, F.col("id")).otherwise(0).alias("x2"), F.col("id").alias("conv"))
    sha = lambda own: hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    want = {(0, 0): sha(range(0, 5000, 3)), (1, 0): sha(range(1, 5000, 3))} | {(2, i): sha([i]) for i in range(2, 5000, 3)}
    rows = pt.id_hashes(members.repartition(7), most=64).collect()
    assert len(rows) == len(want) and {(r["x1"], r["x2"]): r["sha"] for r in rows} == want
