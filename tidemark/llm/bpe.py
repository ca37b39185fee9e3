"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens; its paths are exactly the right token sequences. It starts with one state in which every byte
token loops. Each merge u v -> w, in order, adds its gadget: a copy of the state that u leads to, without the arc v (nor w, if u
and v are the same token), takes over as the target of every arc u, and every state that has the arc u gets an arc w to where v led.
All arcs with the same label keep the same target through this, so a merge adds one state at most, and an arc, once there or
not, stays so. The state after a token x descends from the gadgets of x, before them from those of its right half as they were when
x was made, and so on; an arc w was copied from the arc of its left half. So an arc t after x is there unless some gadget on the first
line took away t or, as it was when t was made, one of its left halves (``has_arc``). These few look-ups fill the table of transitions
as its entries are first asked for.

A pre-split word is encoded from left to right: every prefix has one path, found from the paths of shorter prefixes by one
trie and transition step per token that ends there. Many words take their steps together. Decoding emits the arcs' labels.

Null and empty texts have no tokens. Null ids pass through, repeated rows are encoded each; one long word is handled like short
ones, in time linear in its length. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import per_text
from tidemark.llm.presplit import Splitter
from tidemark.llm.wordcache import Remembered

#: words up to this many bytes are encoded together
SHORT = 32
TOGETHER = 256
#: the table of transitions holds 2 to this power
SLOTS = 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        size = max([*vocabulary.values(), *special.values()]) + 1
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.label: list[bytes] = [b""] * size
        for word, i in vocabulary.items():
            if word not in special:
                self.label[i] = bytes(byte_of[c] for c in word)
        for word, i in special.items():
            self.label[i] = word.encode()
        self._compile(vocabulary, merges, byte_of, size)
        self._index(size)

    def _compile(self, vocabulary, merges, byte_of, size) -> None:
        """Successive merge gadgets."""
        self.time = [-1] * size         # when a token was made; 0: a byte, -1: never
        self.left, self.right = [-1] * size, [-1] * size
        self.twin = [False] * size      # made of two equal halves
        self.gadget: dict[tuple[int, int], int] = {}  # (u, v): when the state after u lost the arc v
        for c in byte_of:
            self.time[vocabulary[c]] = 0
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.time[w] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            if self.time[u] < 0 or self.time[v] < 0 or not self.has_arc(u, v):
                continue  # v never follows u, so nothing is merged
            self.gadget[u, v] = k
            self.time[w], self.left[w], self.right[w], self.twin[w] = k, u, v, u == v

    def has_arc(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow in the state after ``last`` (-1: at the start)."""
        time, left, right, gadget = self.time, self.left, self.right, self.gadget
        before = len(self.gadget) + len(time)
        while last >= 0:
            at, bound = last, before
            made, u = time[token], left[token] if self.twin[token] else -1
            while True:
                k = gadget.get((at, token))
                if k is not None and k < bound or at == u and made < bound:
                    return False
                if not time[at]:
                    break
                bound = min(bound, time[at])
                at = right[at]
            if not made:
                break
            before = min(before, made + 1)
            token = left[token]
        return True

    def _index(self, size: int) -> None:
        """The trie of reachable tokens and the arrays for many words at once."""
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, label in enumerate(self.label):
            if label and self.time[token] >= 0:
                at = 0
                for byte in label:
                    step = nodes[at].get(byte)
                    if step is None:
                        step = nodes[at][byte] = len(nodes)
                        nodes.append({})
                        ends.append(-1)
                    at = step
                ends[at] = token
        self.nodes, self.ends = nodes, ends
        self.next = np.full((len(nodes), 256), -1, dtype=np.int32)
        for at, step in enumerate(nodes):
            if step:
                self.next[at, list(step)] = list(step.values())
        self.ends_array = np.array(ends, dtype=np.int32)
        self.decimal = [str(i) for i in range(size)]
        self.size = size
        self.time_, self.left_, self.right_ = (np.array(x, dtype=np.int64) for x in (self.time, self.left, self.right))
        self.twin_left = np.where(np.array(self.twin), self.left_, -2)
        keys = np.array([u * size + v for u, v in self.gadget], dtype=np.int64)
        order = np.argsort(keys)
        self.gadget_keys = np.r_[keys[order], np.int64(size) * size]
        self.gadget_times = np.r_[np.array(list(self.gadget.values()), dtype=np.int64)[order], 0]
        # transitions as far as asked for: slot -> pair, and whether the arc is there
        self.pairs = np.full(1 << SLOTS, -1, dtype=np.int64)
        self.arcs = np.zeros(1 << SLOTS, dtype=bool)

    def have_arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``has_arc`` for many pairs, from the table of transitions where it has them."""
        pair = (last + 1).astype(np.int64) * self.size + token
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        found = self.arcs[slot]
        new = np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            found[new] = self._derive(last[new].astype(np.int64), token[new].astype(np.int64))
            self.pairs[slot[new]] = pair[new]
            self.arcs[slot[new]] = found[new]
        return found

    def _derive(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        there = np.ones(len(last), dtype=bool)
        row = np.flatnonzero(last >= 0)
        last, token = last[row], token[row]
        before = np.full(len(row), 1 << 40)
        while len(row):
            made, twin = self.time_[token], self.twin_left[token]
            some, at, bound = np.arange(len(row)), last, before
            lost = np.zeros(len(row), dtype=bool)
            while len(some):
                key = at * self.size + token[some]
                place = np.searchsorted(self.gadget_keys, key)
                gone = (self.gadget_keys[place] == key) & (self.gadget_times[place] < bound)
                gone |= (at == twin[some]) & (made[some] < bound)
                lost[some[gone]] = True
                go = ~gone & (self.time_[at] > 0)
                some, at, bound = some[go], at[go], bound[go]
                bound = np.minimum(bound, self.time_[at])
                at = self.right_[at]
            there[row[lost]] = False
            go = ~lost & (made > 0)
            row, last, before, token = row[go], last[go], np.minimum(before[go], made[go] + 1), self.left_[token[go]]
        return there

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._encode_long(w)
            elif w:
                by_length.setdefault(-(-len(w) // 4), []).append(i)
        for rows in by_length.values():
            for i, ids in zip(rows, self._encode_short([words[i] for i in rows])):
                out[i] = ids
        return out

    def _encode_short(self, words: list[bytes]) -> list[bytes]:
        n, width = len(words), max(map(len, words))
        length = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        last = np.full((n, width + 1), -1, dtype=np.int32)
        back = np.zeros((n, width + 1), dtype=np.int32)
        for j in range(width):
            row = np.flatnonzero(length > j)
            node = np.zeros(len(row), dtype=np.int32)
            for end in range(j + 1, width + 1):
                node = self.next[node, text[row, end - 1]]
                go = (node >= 0) & (length[row] >= end)
                row, node = row[go], node[go]
                if not len(row):
                    break
                token = self.ends_array[node]
                some = np.flatnonzero(token >= 0)
                some = some[self.have_arcs(last[row[some], j], token[some])]
                r = row[some]
                last[r, end], back[r, end] = token[some], j
        rows, at, steps = np.arange(n), length.copy(), []
        while (at > 0).any():
            steps.append(np.where(at > 0, last[rows, at], -1))
            at = back[rows, at]
        ids = np.stack(steps[::-1], axis=1)
        count = (ids >= 0).sum(axis=1)
        flat = ids[ids >= 0].astype("<u4").tobytes()
        cuts = np.r_[0, np.cumsum(count)] * 4
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _encode_long(self, word: bytes) -> bytes:
        n, known = len(word), {}
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            node, before = 0, last[j]
            for end in range(j, n):
                node = self.nodes[node].get(word[end])
                if node is None:
                    break
                token = self.ends[node]
                if token >= 0:
                    arc = known.get((before, token))
                    if arc is None:
                        arc = known[before, token] = self.has_arc(before, token)
                    if arc:
                        last[end + 1], back[end + 1] = token, j
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return array("I", ids[::-1]).tobytes()

    def decode(self, ids) -> str:
        """The labels of the ids' arcs, one after another."""
        label = self.label
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.split = Splitter(Tokenizer.from_file(path))
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, self.split.special)
        self.words = Remembered(self._words)
        self.chunks = Remembered(self._chunks, 500_000)

    def _words(self, words: list[str]) -> list[bytes]:
        special = self.split.special
        ids = self.automaton.encode_words([b"" if w in special else w.encode("utf-8", "replace") for w in words])
        return [array("I", [special[w]]).tobytes() if w in special else i for w, i in zip(words, ids)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self.split.pretokens(c) for c in chunks]
        self.words.learn(parts)
        get = self.words.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str | None]):
        """The ids of each whole text, as little-endian 32-bit numbers."""
        for at in range(0, len(texts), TOGETHER):
            split = [self.split.chunks(t or "") for t in texts[at:at + TOGETHER]]
            self.chunks.learn(split)
            get = self.chunks.known.__getitem__
            for chunks in split:
                yield b"".join(map(get, chunks))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the text that they decode to."""
    def make(texts):
        held = encoder(tokenizer)
        ids = [np.frombuffer(i, dtype="<u4") for i in held.encode(texts)]
        return [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                pa.array([held.automaton.decode(i.tolist()) for i in ids], pa.string())]

    return per_text(docs, id_col, text_col, "ids array<int>, decoded string", make)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, in one pass and without sending ids on."""
    def make(texts):
        held = encoder(tokenizer)
        decimal, automaton = held.automaton.decimal, held.automaton
        first: dict[str, int] = {}
        for t in texts:
            first.setdefault(t or "", len(first))
        found = []
        for data in held.encode(list(first)):
            ids = array("I", data).tolist()
            joined = ",".join([decimal[i] for i in ids])
            found.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                          hashlib.sha256(automaton.decode(ids).encode("utf-8", "replace")).hexdigest()))
        rows = [found[first[t or ""]] for t in texts]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string())]

    return per_text(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
