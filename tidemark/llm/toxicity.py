"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

At most ``limit`` labelled documents are the examples, equal texts as one. Their terms are all their words (runs of letters, lower case)
and the beginnings of longer words. A vector holds (1 + ln tf) * idf * gain over all terms that any example has and has length one; the
gain, between ``least_gain`` and 1 + ``least_gain``, grows with the chi-squared statistic of term and label, so that words that tell the
labels apart weigh most and no word is left out. The index keeps, per term, the examples' weights and the largest weight in each block of
``block`` examples that holds the term. A document's blocks are visited by their upper bound (the sum over its terms of weight times
block maximum) until no block left can reach the k-th best cosine, so the k nearest are exact. Their votes, weighted by distance, are
mapped to chances by isotonic regression on the examples themselves, each left out of its own vote.

A document that is an example itself meets itself at cosine 1; only documents held out of the fit measure the method.
Documents without a term (null and empty texts too) get the share of label 1 among examples without one. Equal cosines go to
the smaller example position. Without both labels every score is the examples' share of label 1, or 0 without examples.
Null ids pass through, repeated rows are scored each. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample, per_text

WORD = re.compile(r"[^\W\d_]+")
#: the first so many letters of a longer word are terms too, for inflected and compound words
HEADS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in HEADS if len(word) > n)]


def all_terms(text: str | None) -> Counter:
    """Term to frequency in the whole text."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in terms_of(word):
            found[term] += n
    return found


def least_shingle(text: str | None) -> int:
    """The least hash of five words in a row: near copies share it, other texts hardly ever do."""
    words = (text or "").lower().split()
    return min((zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def _described(texts: list) -> list[pa.Array]:
    counts = [all_terms(t) for t in texts]
    return [pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
            pa.array([least_shingle(t) for t in texts], pa.int64())]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and how many each range has."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


@dataclass
class Index:
    """Examples by position. Terms that many examples hold have a row in ``common`` with every example's weight (``row_of`` the term, -1
    for others); many documents meet it by one matrix product. The entries of any other term t are ``first[t]`` to ``first[t + 1]``, one per block that holds t, with the block, the
    largest weight there (``most``) and the place of its postings: ``start[e]`` to ``start[e + 1]`` in ``where`` and ``weight``."""
    vocabulary: dict[str, int]
    gain: np.ndarray        # by term: idf times the gain by the labels
    ids: list
    toxic: np.ndarray
    first: np.ndarray
    at_block: np.ndarray
    most: np.ndarray
    start: np.ndarray
    where: np.ndarray
    weight: np.ndarray
    row_of: np.ndarray
    common: np.ndarray
    block: int
    k: int
    steps: np.ndarray       # isotonic: votes up to steps[i] have the chance levels[i]
    levels: np.ndarray
    without: float          # the chance without any term
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        """What travels to the workers: of ``common`` only its weights above 0."""
        flat = np.flatnonzero(self.common)
        return self.__dict__ | {"common": (self.common.shape, flat.astype(np.int32 if self.common.size < 2**31 else np.int64), self.common.reshape(-1)[flat]), "_known": {}}

    def __setstate__(self, state):
        shape, flat, weights = state["common"]
        self.__dict__.update(state, common=np.zeros(shape))
        self.common.reshape(-1)[flat] = weights

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and frequencies of the terms of the whole text."""
        words = WORD.findall((text or "").lower())
        if len(self._known) > 200_000:
            self._known.clear()
        for word in set(words):
            if word not in self._known:
                self._known[word] = [self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary]
        numbers = np.array(list(chain.from_iterable(map(self._known.__getitem__, words))), dtype=np.int64)
        return np.unique(numbers, return_counts=True)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, dtype=np.int64, count=len(counts))
        return terms, weigh(terms, np.fromiter(counts.values(), dtype=float, count=len(counts)), self.gain)

    def nearest(self, counts: dict[int, int], leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples that share a term, nearest first."""
        return next(self.near_all([self.vector(counts)], [leave_out]))

    def near_all(self, vectors: list[tuple], leave_out: list[int] | None = None, together: int = 64):
        """The same for each vector; ``together`` of them meet the common terms at once."""
        for low in range(0, len(vectors), together):
            part = vectors[low:low + together]
            mine = np.zeros((len(part), len(self.common)))
            for i, (terms, weights) in enumerate(part):
                row = self.row_of[terms]
                mine[i, row[row >= 0]] = weights[row >= 0]
            for i, (base, (terms, weights)) in enumerate(zip(mine @ self.common, part)):
                yield self._near(terms, weights, base, leave_out[low + i] if leave_out else -1)

    def _near(self, terms: np.ndarray, weights: np.ndarray, base: np.ndarray, leave_out: int) -> tuple[np.ndarray, np.ndarray]:
        """``base``: every example's share of the cosine by common terms."""
        if not len(base):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        entries, n = _ranges(self.first[terms], self.first[terms + 1])
        mine, blocks = np.repeat(weights, n), self.at_block[entries]
        edges = np.arange(0, len(base), self.block)
        bound = np.maximum.reduceat(base, edges) + np.bincount(blocks, mine * self.most[entries], minlength=len(edges))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, score = np.zeros(0, dtype=np.int64), np.zeros(0)
        seen, step = 0, 6
        while seen < len(order):
            # a rounding error may lift a cosine above its bound
            least = np.partition(score, -self.k)[-self.k] if len(score) >= self.k else 0.0
            left = order[seen:]
            left = left[bound[left] >= least - 1e-9][:step]
            if not len(left):
                break
            chosen = np.zeros(len(bound), dtype=bool)
            chosen[left] = True
            inside = chosen[blocks]
            postings, n = _ranges(self.start[entries[inside]], self.start[entries[inside] + 1])
            total = base + np.bincount(self.where[postings], np.repeat(mine[inside], n) * self.weight[postings], minlength=len(base))
            if leave_out >= 0:
                total[leave_out] = 0
            more = np.flatnonzero((total > 0) & np.repeat(chosen, self.block)[:len(base)])
            at, score = np.concatenate([at, more]), np.concatenate([score, total[more]])
            if len(score) > self.k:
                high = score >= np.partition(score, -self.k)[-self.k] - 1e-9
                at, score = at[high], score[high]
            best = np.lexsort((at, -np.round(score, 12)))[:self.k]
            at, score = at[best], score[best]
            seen, step = seen + len(left), step * 16
        return at, score

    def vote(self, at: np.ndarray, score: np.ndarray) -> float:
        closeness = 1 / (1.02 - np.minimum(score, 1.0))
        return float((closeness * self.toxic[at]).sum() / closeness.sum())

    def chance(self, vote: float) -> float:
        return float(self.levels[min(np.searchsorted(self.steps, vote), len(self.levels) - 1)])

    def scores(self, texts: list) -> list[tuple[float, tuple]]:
        """For each text the calibrated chance and the three nearest examples as (id, cosine, label)."""
        counts = [self.counts(t) for t in texts]
        near = self.near_all([(terms, weigh(terms, n, self.gain)) for terms, n in counts if len(terms)])
        found = []
        for terms, _ in counts:
            if not len(terms):
                found.append((self.without, ()))
                continue
            at, cosine = next(near)
            evidence = tuple((self.ids[a], round(float(x), 6), int(self.toxic[a])) for a, x in zip(at[:3], cosine))
            found.append((self.chance(self.vote(at, cosine)), evidence))
        return found


def weigh(terms: np.ndarray, freqs: np.ndarray, gain: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(freqs)) * gain[terms]
    return weights / max(math.sqrt((weights * weights).sum()), 1e-12)


def isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing levels of y over x by pooling adjacent violators; each pool leans to ``prior`` by one example."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        if pools and pools[-1][0] == v:
            pools[-1][1] += t
            pools[-1][2] += 1
        else:
            pools.append([v, t, 1])
    merged: list[list[float]] = []
    for pool in pools:
        merged.append(pool)
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            v, t, n = merged.pop()
            merged[-1] = [v, merged[-1][1] + t, merged[-1][2] + n]
    levels = np.array([(t + prior) / (n + 1) for _, t, n in merged])
    return np.array([v for v, _, _ in merged]), np.maximum.accumulate(levels)


def build_index(examples: list[tuple], vocabulary: dict[str, int], block: int = 64, k: int = 25) -> Index:
    """``examples``: (id, label, {term number: frequency})."""
    rows = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
    terms = np.fromiter((t for e in examples for t in e[2]), dtype=np.int64, count=len(rows))
    freqs = np.fromiter((n for e in examples for n in e[2].values()), dtype=float, count=len(rows))
    return _index([e[0] for e in examples], np.array([e[1] for e in examples], dtype=float), rows, terms, freqs,
                  np.arange(len(examples)), vocabulary, block, k)


def _index(ids: list, toxic: np.ndarray, rows: np.ndarray, terms: np.ndarray, freqs: np.ndarray, kin: np.ndarray,
           vocabulary: dict[str, int], block: int, k: int, least_gain: float = 0.05, half_gain: float = 3.0) -> Index:
    """The index over postings (example, term, frequency) in the examples' order. Examples of one ``kin`` count as one in the statistics
    of words: near copies would make all their words look like signs of their label."""
    size = len(vocabulary)
    share = float(toxic.mean()) if len(ids) else 0.0
    held = np.bincount(rows, minlength=len(ids)) > 0
    without = float((toxic[~held].sum() + share) / ((~held).sum() + 1)) if len(ids) else 0.0
    _, group, members = np.unique(kin, return_inverse=True, return_counts=True)
    part = 1 / members[group]
    n1, n0 = float((part * toxic).sum()), float((part * (1 - toxic)).sum())
    a = np.bincount(terms, (part * toxic)[rows], minlength=size)
    b = np.bincount(terms, (part * (1 - toxic))[rows], minlength=size)
    n, df = n1 + n0, a + b
    # chi-squared with Yates' correction, as |z|
    apart = np.maximum(np.abs(a * (n0 - b) - b * (n1 - a)) - n / 2, 0) * math.sqrt(n / max(n1 * n0, 1e-9))
    z = apart / np.sqrt(np.maximum(df * (n - df), 1e-9)) if n1 and n0 else np.zeros(size)
    gain = (np.log((1 + n) / (1 + df)) + 1) * (least_gain + z / (z + half_gain))

    # neighbours share their commonest term (a language's) and the one that tells most, so that block maxima are tight
    ends = np.searchsorted(rows, np.arange(len(ids) + 1))
    keys = {}
    for i in np.flatnonzero(held):
        mine = terms[ends[i]:ends[i + 1]]
        keys[int(i)] = int(mine[np.argmax(df[mine])]), int(mine[np.argmax(z[mine])]), str(ids[i])
    order = np.array(sorted(keys, key=keys.get), dtype=np.int64)
    vectors = [(terms[ends[i]:ends[i + 1]], weigh(terms[ends[i]:ends[i + 1]], freqs[ends[i]:ends[i + 1]], gain)) for i in order]
    term = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in vectors)])
    weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
    where = np.repeat(np.arange(len(order)), [len(t) for t, _ in vectors])
    sort = np.lexsort((where, term))
    term, weight, where = term[sort], weight[sort], where[sort]
    held_by = np.bincount(term, minlength=size)
    many = np.flatnonzero(held_by * 30 > len(order))  # for these a row of all weights takes less work than postings
    row_of = np.full(size, -1, dtype=np.int64)
    row_of[many] = np.arange(len(many))
    common = np.zeros((len(many), len(order)))
    inside = row_of[term] >= 0
    common[row_of[term[inside]], where[inside]] = weight[inside]
    term, weight, where = term[~inside], weight[~inside], where[~inside]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (where[1:] // block != where[:-1] // block)
    start = np.flatnonzero(new)
    index = Index(vocabulary, gain, [ids[i] for i in order], toxic[order], np.searchsorted(term[start], np.arange(size + 1)),
                  (where[start] // block).astype(np.int32), np.maximum.reduceat(weight, start) if len(start) else np.zeros(0),
                  np.append(start, len(term)), where.astype(np.int32), weight, row_of, common, block, k, np.array([1.0]), np.array([share]), without)
    if 0 < share < 1:
        votes = []
        for i, (at, cosine) in enumerate(index.near_all(vectors, list(range(len(vectors))))):
            if len(at):
                votes.append((index.vote(at, cosine), index.toxic[i]))
        if votes:
            x, y = map(np.array, zip(*votes))
            index.steps, index.levels = isotonic(x, y, share)
    return index


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = 3_000, keep=None,
        id_col: str = "doc_id", text_col: str = "text", block: int = 64, k: int = 25) -> Index:
    """The index over at most ``limit`` labelled documents for which ``keep`` (a condition on doc_id) holds. Their whole texts are taken
    apart on the executors; the driver gets the terms and frequencies of the examples."""
    sample = labelled_sample(docs, labels, label_col, limit, id_col, text_col, keep)
    # equal texts are one example
    single = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.round(F.avg("label")).cast("int").alias("label"))
    keyed = single.select(F.struct("doc_id", "label").alias("key"), "text")
    found = (per_text(keyed, "key", "text", "terms array<string>, freqs array<int>, kin long", _described).limit(limit)
             .select("doc_id.doc_id", "doc_id.label", "terms", "freqs", "kin").toArrow().combine_chunks())
    ids = found["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), found["kin"][i].as_py()))
    found = found.take(pa.array(order, pa.int64())).combine_chunks()
    rows = np.repeat(np.arange(len(ids)), pc.list_value_length(found["terms"]).to_numpy().astype(np.int64))
    terms, freqs = pc.list_flatten(found["terms"]).combine_chunks(), pc.list_flatten(found["freqs"]).to_numpy().astype(float)
    vocabulary = {term: i for i, term in enumerate(sorted(pc.unique(terms).to_pylist()))}
    numbers = pc.index_in(terms, pa.array(list(vocabulary), terms.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    toxic, kin = found["label"].to_numpy().astype(float), found["kin"].to_numpy().copy()
    del found, terms  # the driver needs the strings only once
    sort = np.lexsort((numbers, rows))
    numbers, freqs = numbers[sort], freqs[sort]
    del sort
    return _index([ids[i] for i in order], toxic, rows, numbers, freqs, kin, vocabulary, block, k)


def score(docs: DataFrame, index: Index, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (the chance of label 1), predicted (1 from ``threshold`` on) and evidence, the
    nearest examples with their cosines and labels."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make(texts):
        held = shared.value
        single = list(dict.fromkeys(texts))
        scored = dict(zip(single, held.scores(single)))
        found = [scored[t] for t in texts]
        evidence = [[{"example_id": str(i), "cosine": c, "label": y} for i, c, y in e] for _, e in found]
        kind = pa.list_(pa.struct([("example_id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
        scores = [s for s, _ in found]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, kind)]

    return per_text(docs, id_col, text_col, "score double, predicted int, evidence array<struct<example_id: string, "
                                            "cosine: double, label: int>>", make)


def drop_toxic(docs: DataFrame, index: Index, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, with all their columns and without a shuffle."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return score(whole, index, threshold, "doc").where("predicted = 0").select("doc_id.*")
