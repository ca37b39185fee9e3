"""SimHash classes against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string, bucket int"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles)
        bits |= (2 * ones > len(shingles)) << b
    return bits


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for (i, _), x in zip(rows, label):
        groups.setdefault(x, []).append(i)
    least = {x: min((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    return sorted(((i, f"{f:016x}", least[x]) for (i, _), f, x in zip(rows, fps, label)), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 300))
        rows.append((10 * i, " ".join(base)))
        for k in range(int(rng.integers(0, 3))):
            near = base.copy()
            near[int(rng.integers(300))] = "other"
            rows.append((10 * i + k + 1, " ".join(near)))
    very_long = " ".join(rng.choice(words, 60_000))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, rows[0][1]), (None, "solitary words here"), (3, rows[0][1]), (3, rows[0][1]),
             (2003, very_long), (2004, very_long + " end"), (2005, "É È"), (2006, "one two"), (2007, "ONE two")]
    return rows


def test_against_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in texts], SCHEMA)
    found = simhash.near_copies(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_classes(texts)


def test_one_row_of_each_class_stays(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in texts], SCHEMA)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, _, c in plain_classes(texts) if c is not None})
    assert kept.where("doc_id IS NULL").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) * (rng.random(150) < 0.6).astype(np.uint64)
    fps = np.concatenate([base, near])
    rng.shuffle(fps)
    ends = np.where(np.arange(300) < 130, 130, 300)
    left, right = simhash.near_pairs_in_block(fps, ends, radius)
    want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(left.tolist(), right.tolist())) == want


def test_large_buckets_are_cut(spark, monkeypatch):
    """A bucket far beyond one block gives the same classes."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    fps = sorted({int(rng.integers(0, 4)) << 62 | int(rng.integers(0, 1 << 10)) << 30 | 5 for _ in range(400)})
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    roots = {r.node: r.root for r in simhash.connected(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    label = {f: f for f in fps}
    for _ in range(40):
        for a in fps:
            label[a] = min(label[b] for b in fps if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2)
    assert {f: roots.get(f, f) for f in fps} == label
