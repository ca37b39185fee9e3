"""Line deduplication against a plain version, and its index after inserts and deletes in any order."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_index
from tidemark.llm.cuckoo import Cuckoo

SCHEMA = "doc_id long, text string, keys string, n_dropped int"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    bare = line.strip(WHITE)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def plain(rows):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or first[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    common = ["A line that many documents share", "été à la plage", "kürzer", "  Padded \t common line \x0b"]
    rows = []
    for i in range(120):
        lines = [f"line {int(rng.integers(60))} of a small stock" for _ in range(int(rng.integers(1, 6)))]
        if i % 3 == 0:
            lines.insert(0, common[i % 4].upper() if i % 2 else common[i % 4])
        rows.append((int(i), "\n".join(lines)))
    long_text = "\n".join(f"line number {i % 3000} of a long text" for i in range(20_000))
    rows += [(500, long_text), (501, long_text), (502, ""), (503, None), (504, "\n\n"), (505, "été à la plage"), (505, "été à la plage"),
             (None, "A line that many documents share\nother"), (506, "123456789\n123456789"), (507, "1234567890\n1234567890"),
             (508, " 1234567890\r\nÉÉÉÉÉÉÉÉÉÉ"), (509, "éééééééééé"), (-4, "1234567890")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_a_plain_version(spark, texts):
    found = line_index.dedup(frame(spark, texts).repartition(5))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert result(found) == plain(texts)


@pytest.mark.parametrize("bits", [32, 6])
def test_inserts_and_deletes_are_reversible(spark, texts, bits):
    """With 6 bits most alarms of the filters are false."""
    named = [r for r in texts if r[0] is not None]
    one, two, three = named[::3], named[1::3], named[2::3]
    index = line_index.insert(line_index.empty(spark, bits, shards=3), frame(spark, one))
    before = index
    index = line_index.insert(line_index.insert(index, frame(spark, two)), frame(spark, three))
    assert result(line_index.kept_digests(index, frame(spark, named))) == plain(named)
    index = line_index.delete(index, spark.createDataFrame([(r[0],) for r in two + three] + [(None,), (98765,)], "doc_id long"))
    left = [r for r in one if r[0] not in {x[0] for x in two + three}]
    assert result(line_index.kept_digests(index, frame(spark, left))) == plain(left)
    # the state is that of an index that never held the others
    again = line_index.insert(line_index.empty(spark, bits, shards=3), frame(spark, left))
    for name in ("holders", "counts"):
        assert (sorted(map(str, getattr(index, name).select(sorted(getattr(index, name).columns)).collect()))
                == sorted(map(str, getattr(again, name).select(sorted(getattr(again, name).columns)).collect())))
    totals = [{r[0]: r[1:] for r in x.refs.groupBy("key").agg(F.sum("n"), F.min("first_doc"), F.count_if("fresh")).collect()}
              for x in (index, again)]
    assert totals[0] == totals[1] and all(t[2] == 1 for t in totals[0].values())
    assert fingerprints(index, bits) == fingerprints(again, bits) == len(totals[0])
    # one shard's filters know exactly what is left
    index = line_index.insert(index, frame(spark, [r for r in two + three if r not in left]))
    assert result(line_index.kept_digests(index, frame(spark, named))) == plain(named)
    assert before.counts.count() >= 0


def fingerprints(index, bits):
    shards = {}
    for r in index.filters.orderBy("shard", "piece").collect():
        shards.setdefault(r["shard"], []).append(bytes(r["data"]))
    known = [Cuckoo.load(b"".join(p), bits) for p in shards.values()]
    return sum(int(np.count_nonzero(c.table)) + len(c.stash) for c in known)


def test_whole_texts_and_empty_tables(spark):
    docs = frame(spark, [(2, "One shared line here\nmine"), (1, "one SHARED line here"), (3, "own text")])
    index = line_index.insert(line_index.empty(spark), docs)
    assert result(line_index.kept_texts(index, docs)) == [(1, 1, 0, "one SHARED line here"), (2, 2, 1, "mine"), (3, 1, 0, "own text")]
    none = docs.where("false")
    assert line_index.dedup(none).count() == 0
    assert result(line_index.kept_texts(line_index.delete(index, none), docs))[1] == (2, 2, 1, "mine")


@pytest.mark.parametrize("bits,base,n", [(32, 4, 30_000), (6, 2, 500), (12, 6, 8000)])
def test_a_cuckoo_filter_forgets_what_is_taken_out_and_nothing_else(bits, base, n):
    keys = np.random.default_rng(bits).integers(0, 2**63, (n, 2), dtype=np.uint64)
    known = Cuckoo(bits, base)
    for at in range(0, n, 997):
        known.insert(keys[at:at + 997])
    assert known.contains(keys).all()
    known = Cuckoo.load(known.dump(), bits, base)
    known.remove(keys[: n // 2])
    assert known.contains(keys[n // 2:]).all()
    known.remove(keys[n // 2:])
    assert not known.table.any() and not len(known.stash)
    if bits == 32:
        assert not known.contains(keys).any()
