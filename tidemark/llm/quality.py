"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted in numpy on at most ``limit`` labelled documents, with monotonic constraints on chosen
statistics, and flattened into node arrays that score a batch of documents at once. The statistics of every document
are counted over its whole text where it lies, without a shuffle.

A null text counts as empty; it has no words, so it fails the base rule. Null ids pass through, repeated rows are scored
each. Without labelled documents of both kinds the verdict is that of the base rule alone. Only the id and text columns
are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample, per_text

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:!?"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
              "n_upper", "n_digits", "n_marks", "n_chars")
#: the trees' inputs, each with the sign that the chance of good quality must follow (0: free)
FEATURES = (("log_words", 1), ("chars_per_word", 0), ("symbols_per_word", -1), ("dup_lines_share", -1),
            ("repeat_share", -1), ("upper_share", -1), ("digit_share", 0), ("marks_per_word", 0),
            ("words_per_line", 0))
#: below this, or with over half of the words in repeated windows, a document fails whatever the trees say
LEAST_WORDS, REPEAT_PERCENT = 50, 50


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found at least twice, the first finding included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total = end = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """``STATISTICS`` of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    bare = data.translate(None, SPACE)

    def count(kind):
        return len(data) - len(data.translate(None, kind))

    return (len(words), len(bare.decode("utf-8", "surrogatepass")), count(SYMBOLS), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), len(set(words)), count(UPPER), count(DIGITS), count(MARKS), len(text or ""))


def features(stats: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``STATISTICS``."""
    s = {name: stats[:, i].astype(float) for i, name in enumerate(STATISTICS)}
    words, lines, chars = (np.maximum(s[k], 1) for k in ("n_words", "n_lines", "n_chars"))
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars,
        s["n_marks"] / words, s["n_words"] / lines])


@dataclass
class Trees:
    """Node arrays of all trees, one after another: a leaf has feature -1 and points at itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        for _ in range(self.depth):
            feature = self.feature[at]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
              penalty: float = 1.0, least_weight: float = 5.0) -> Trees:
    """Newton boosting of the log loss over histograms. A split on a feature with a sign is taken only if its two leaf
    values are ordered that way, and its middle bounds all values below it, so the whole model is monotonic."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes, roots = [], []

    def grow(rows, level, low, high):
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + penalty), low, high))
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, rate * value])
        best = (1e-6, None)
        for j, edge in enumerate(edges) if level < depth else ():
            if not len(edge):
                continue
            gl = np.bincount(binned[rows, j], grad[rows], len(edge) + 1).cumsum()[:-1]
            hl = np.bincount(binned[rows, j], hess[rows], len(edge) + 1).cumsum()[:-1]
            gr, hr = g - gl, h - hl
            left, right = (np.clip(-a / (b + penalty), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = (gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - g * g / (h + penalty))
            gain[(hl < least_weight) | (hr < least_weight) | (signs[j] * (right - left) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, left[k], right[k]))
        if best[1]:
            j, k, left, right = best[1]
            middle = (left + right) / 2
            go = binned[rows, j] <= k
            first = len(nodes)
            bounds = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
            if not signs[j]:
                bounds = ((low, high), (low, high))
            grow(rows[go], level + 1, *bounds[0])
            second = len(nodes)
            grow(rows[~go], level + 1, *bounds[1])
            nodes[at] = [j, float(edges[j][k]), first, second, 0.0]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(grow(np.arange(len(y)), 0, -8.0, 8.0))
        columns = [np.array(c) for c in zip(*nodes)]
        tree = Trees(*columns, roots=np.array(roots[-1:]), depth=depth, base=0.0)
        margin = margin + tree.margin(x)
    columns = [np.array(c) for c in zip(*nodes)]
    return Trees(*columns, roots=np.array(roots), depth=depth, base=base)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = 20_000, id_col: str = "doc_id",
        text_col: str = "text") -> Trees | None:
    """Trees for the chance of label 1, from at most ``limit`` labelled documents: their statistics, never their
    texts, come to the driver. None if there are not both labels."""
    sample = labelled_sample(docs, labels, label_col, limit, id_col, text_col)
    keyed = sample.select(F.struct("doc_id", "label").alias("key"), "text")
    stats = statistics_of(keyed, "key").select("doc_id.doc_id", "doc_id.label", *STATISTICS)
    rows = stats.orderBy("doc_id", *STATISTICS).limit(limit).toPandas()
    y = rows["label"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(features(rows[list(STATISTICS)].to_numpy()), y, [sign for _, sign in FEATURES])


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(texts):
        stats = np.array([statistics(t) for t in texts], dtype=np.int64)
        return [pa.array(stats[:, i]) for i in range(len(STATISTICS))]

    return per_text(docs, id_col, text_col, ", ".join(f"{n} long" for n in STATISTICS), make)


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``STATISTICS``, base_failed, p_good (the trees' chance) and kept: the base rule
    holds and p_good is at least ``threshold``."""
    def make(texts):
        stats = np.array([statistics(t) for t in texts], dtype=np.int64)
        column = {n: stats[:, i] for i, n in enumerate(STATISTICS)}
        failed = ((column["n_words"] < LEAST_WORDS)
                  | (100 * column["n_repeat_words"] > REPEAT_PERCENT * column["n_words"]))
        p = trees.probability(features(stats)) if trees else np.ones(len(stats))
        return [*(pa.array(column[n]) for n in STATISTICS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]

    fields = ", ".join(f"{n} long" for n in STATISTICS)
    return per_text(docs, id_col, text_col, f"{fields}, base_failed boolean, p_good double, kept boolean", make)


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, with all their columns and without a shuffle."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    return judge(whole, trees, threshold, "doc").where("kept").select("doc_id.*")
