"""SimHash near copies: 64-bit fingerprints of word shingles, compared bit plane by bit plane.

Fingerprints that differ in at most ``radius`` bits must agree in one of ``radius + 1`` pieces (pigeonhole), so only
fingerprints with an equal piece are compared. They are compared 64 at a time: a word holds one bit of 64
fingerprints, two carry-save counters and a sticky overflow count the differing bits, and words in which every
lane has passed the radius are abandoned. Each block of compared rows sends on a spanning forest of its links, never
the pairs; the classes are then joined over the blocks.

Nulls and texts without a word have fingerprint zero and are linked like any other. Rows with a null id get a
fingerprint and the class of their fingerprint; a class that has only null ids has a null component. Repeated rows
stay as they are. An empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_text
from tidemark.session import written

SEED = 42
LANES = 64
#: rows of one bucket that are compared in one go; larger buckets are cut into pairs of such blocks
BLOCK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one whole text: A-Z lowered, words between ASCII white space, ``width``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    def make(texts):
        return [pa.array(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))]

    return per_text(docs, id_col, text_col, "fp long", make)


def near_pairs_in_block(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < ends[i] whose fingerprints differ in at most ``radius`` (1 to 3) bits.

    ``fps`` are uint64, rows of one bucket next to each other, ``ends[i]`` the end of row i's bucket."""
    n = len(fps)
    words = -(-n // LANES)
    padded = np.zeros(words * LANES, dtype=np.uint64)
    padded[:n] = fps
    lanes = padded.reshape(words, LANES)
    first = np.arange(n) // LANES
    spans = (ends - 1) // LANES - first + 1
    row = np.repeat(np.arange(n), spans)
    word = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
    low = np.zeros(len(row), dtype=np.uint64)
    high = np.zeros(len(row), dtype=np.uint64)
    # lanes outside the bucket, and the row itself and those before it, are over from the start
    full, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    lo = np.clip(row + 1 - word * LANES, 0, LANES)
    hi = np.clip(ends[row] - word * LANES, 0, LANES)

    def below(k):  # the k lowest bits
        return np.where(k >= LANES, full, (one << np.minimum(k, LANES - 1).astype(np.uint64)) - one)

    over = ~(below(hi) & ~below(lo))
    weights = one << np.arange(LANES, dtype=np.uint64)
    for bit in range(64):
        plane = (((lanes >> np.uint64(bit)) & one) * weights).sum(axis=1, dtype=np.uint64)
        mine = np.where((fps >> np.uint64(bit)) & one, full, np.uint64(0))
        differs = plane[word] ^ mine[row]
        carry = low & differs
        low ^= differs
        over |= high & carry
        high ^= carry
        if radius < 3:  # counts above the radius that the two counters can still hold
            over |= high if radius == 1 else high & low
        if bit % 4 == 3:
            alive = over != full
            if not alive.all():
                row, word, low, high, over = row[alive], word[alive], low[alive], high[alive], over[alive]
            if not len(row):
                break
    hit = ~over
    if not len(hit):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return row[at], word[at] * LANES + lane


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(rest) < 2 * BLOCK:
                continue
            keys = rest[["bucket", "a", "b"]].to_numpy()
            cut = len(rest) - int((keys[::-1] == keys[-1]).all(axis=1).cumprod().sum())
            if cut:
                yield _block(rest.iloc[:cut], radius)
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _block(rest, radius)
    return run


def _block(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    keys = rows[["bucket", "a", "b"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(rows)])
    ends = np.repeat(starts + sizes, sizes)
    fps = rows["fp"].to_numpy().view(np.uint64)
    label = forest(len(fps), *near_pairs_in_block(fps, ends, radius))
    other = np.flatnonzero(label != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return pd.DataFrame({"u": signed[other], "v": signed[label[other]]})


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between the fingerprints of ``distinct`` (column fp, no repeats) that connect exactly those
    that chains of steps of at most ``radius`` bits connect. At most one row per fingerprint and bucket block."""
    if not 1 <= radius <= 3:
        raise ValueError("radius 1 to 3")
    pieces = radius + 1
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    buckets = F.array(*[
        F.lit(i << 40) + F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1)
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    keyed = distinct.select("fp", F.explode(buckets).alias("bucket"))
    # buckets of one hold no pair; the others are cut into blocks of bounded size
    sizes = (keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
             .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cut = keyed.join(sizes, "bucket").withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cut = (cut.select("fp", "bucket", "part", other.alias("other"))
           .select("fp", "bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))
    blocks = cut.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "fp")
    return blocks.mapInPandas(_links(radius), "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the undirected ``edges`` (u, v) with the smallest node of its component.

    Each round takes the smallest root among the neighbours, then the root's root; every round is written, so lost
    executors redo one round at most."""
    edges = written(edges, "links")
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
    roots = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "roots")
    while True:
        near = (both.join(roots.select(F.col("node").alias("v"), F.col("root").alias("near")), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near")))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        step = written(step, "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        after = written(step.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("root"), "was"), "roots")
        roots = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over
    links of at most ``radius`` differing bits)."""
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = connected(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(rooted.join(least, "root").select("fp", "component_id", "n"), "components")
    # a fingerprint with over a thousandth of all rows: at most a thousand of them, so they can be broadcast
    total = fps.count()
    crowded = F.broadcast(known.where(F.col("n") * 1000 > total).select("fp", "component_id"))
    rest = known.where(F.col("n") * 1000 <= total).select("fp", "component_id")
    found = fps.join(crowded, "fp").unionByName(fps.join(crowded.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                     radius: int = 2) -> DataFrame:
    """``docs`` with one row per class: the one with the smallest id. All columns stay. Of rows that repeat an id,
    one stays; rows with a null id stay, since they can't be told apart."""
    keep = (near_copies(docs, id_col, text_col, width, radius)
            .where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct())
    named = docs.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi")
    return named.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
