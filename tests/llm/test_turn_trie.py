"""The trie of conversations against a plain one."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, origin string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], set()).add(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for c in range(0, 330):
        if c == 200:
            continue  # conversations of this hundred have no origin
        for t in range(int(rng.integers(1, 8))):
            out.append((c, t, ["user", "assistant"][t % 2], f"text {int(rng.integers(2))} é"))
    out += [(400, t, "user", "the same again") for t in range(150)] + [(401, t, "user", "the same again") for t in range(140)]
    out += [(None, 0, "user", "lost"), (402, None, "system", "first"), (402, 0, None, None), (402, 1, "", ""), (403, 1, "user", "x" * 50_000),
            (404, 3, "a", "b"), (404, 3, "a", "b"), (404, 9, "", "a"), (405, 0, "", "a")]
    return out


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                               "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_against_a_plain_trie(spark, rows, most):
    """Small batches cut conversations into pieces."""
    table = spark.createDataFrame([(*r, "k", 1, "o") for r in rows], SCHEMA).repartition(4)
    assert result(turn_trie.forked_trie(table, most)) == plain(rows)


def test_no_conversations(spark):
    assert result(turn_trie.forked_trie(spark.createDataFrame([], SCHEMA))) == []


def test_ids_of_a_crowded_end_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "IDS_PER_PART", 7)
    ids = spark.range(100, 200).selectExpr("CAST(id % 2 AS STRING) AS key", "id AS conv_id").selectExpr("encode(key, 'UTF-8') AS key", "conv_id")
    found = {bytes(r["key"]): r["sha"] for r in turn_trie.id_digests(ids, ["key"], "conv_id", "sha").collect()}
    assert found == {k: hashlib.sha256(",".join(str(i) for i in range(s, 200, 2)).encode()).hexdigest() for k, s in ((b"0", 100), (b"1", 101))}
