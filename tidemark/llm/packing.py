"""Packing documents into sequences of at most ``size`` tokens, by best fit and swap-based local search.

Every document is tokenized where it lies; only documents longer than a sequence are cut. Pieces of exactly ``size`` tokens are
sequences of their own. The others are dealt by hash to groups of bounded size. In each group, best fit in decreasing order
fills the bins; then underfull bins move documents or exchange one for one or two for one, each time raising the sum of squared
fills, until bins empty or no exchange helps. The bins of the groups that are left less than fifteen sixteenths full are emptied into
new groups, each time far fewer, until one group holds them all; what one task sees never grows with the input.

A null text is an empty one: its document is the closing token alone. Null ids pass through; repeated rows are packed each.
An empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import byte_characters
from tidemark.llm.common import bounded_batches
from tidemark.session import written

SIZE = 2048
GROUP = 20_000

_encoders: dict[str, "WordEncoder"] = {}


#: letters, and then ASCII signs that never join them in one pre-token or begin a special string
_ASCII_WORD = re.compile(rb"([A-Za-z]+)([!-&(-/:;=>?@\[-^`{-~]*)")
#: more letters that have one lower-case form and no other composition
_LATIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+)([!-&(-/:;=>?@\[-^`{-~]*)")
#: stands for the end of a word; no UTF-8 text has this byte
_END = b"\xff"


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space: as the library gives them, because none of its
    normalizing, splitting or merging steps looks across white space. Ids are little-endian 32-bit numbers.

    Each word is encoded once while it is remembered. A word of plain letters goes straight to the merges, which a rank table can
    express if ids rise in the order of the merges and word ends are a suffix; other words, and other tokenizers, go to the library."""

    #: texts whose new words are encoded in one call
    together = 256

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {b"": b""}
        self.merged = self._merges(json.loads(self.library.to_str()))

    @staticmethod
    def _merges(spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        special = {t["content"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or not suffix or sorted(steps) != ["Lowercase", "NFC", "Replace"] or any(c.isalpha() for t in special for c in t[:1]):
            return None
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in special:
                end = token.endswith(suffix)
                ranks[bytes(byte_of[c] for c in (token[:-len(suffix)] if end else token)) + _END * end] = i
        parts = [m if not isinstance(m, str) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in parts]
        if sorted(ranks.values()) != list(range(len(ranks))) or made != list(range(2 * len(byte_of), len(ranks))):
            return None
        import tiktoken
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out, left = [], []
        for word in words:
            found = self.merged and _ASCII_WORD.fullmatch(word)
            if found:
                letters, signs = found[1].lower(), found[2]
            else:
                text = word.decode("utf-8", "replace")
                found = self.merged and _LATIN_WORD.fullmatch(text)
                if not found:
                    left.append((len(out), text))
                    out.append(b"")
                    continue
                letters, signs = found[1].lower().encode(), found[2].encode()
            if signs not in self.signs:
                if len(self.signs) > 50_000:
                    self.signs = {b"": b""}
                self.signs[signs] = array("I", self.library.encode(signs.decode(), add_special_tokens=False).ids).tobytes()
            out.append(array("I", self.merged(letters + _END)).tobytes() + self.signs[signs])
        if left:
            for (i, _), e in zip(left, self.library.encode_batch_fast([t for _, t in left], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of each whole text in UTF-8."""
        for at in range(0, len(texts), self.together):
            split = [t.split() for t in texts[at:at + self.together]]  # ASCII white space alone
            found = [list(map(self.words.get, words)) for words in split]
            new = {w for words, ids in zip(split, found) if None in ids for w, i in zip(words, ids) if i is None}
            if len(self.words) + len(new) > self.limit:  # forgetting costs time only
                self.words.clear()
                new = set(chain.from_iterable(split))
            if new:
                new = list(new)
                self.words.update(zip(new, self._encode(new)))
            get = self.words.__getitem__
            for words, ids in zip(split, found):
                yield b"".join(map(get, words) if None in ids else ids)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                 end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids and the closing ``end_id``: doc_id, piece, start, length, ids_crc32, and
    the ids themselves if asked for."""
    id_type = docs.schema[id_col].dataType
    fields = T.StructType.fromDDL(PIECE + (", ids array<long>" if with_ids else "")).fields
    schema = T.StructType([T.StructField("doc_id", id_type), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            first: dict[bytes, int] = {}
            kept: dict[bytes, list] = {}
            for i, t in enumerate(texts):
                first.setdefault(t, i)
            for t, ids in zip(first, encode.ids(list(first))):
                ids += end
                kept[t] = [(p, at // 4, ids[at:at + 4 * size]) for p, at in enumerate(range(0, len(ids), 4 * size))]
                kept[t] = [(p, at, len(part) // 4, zlib.crc32(part), part if with_ids else b"") for p, at, part in kept[t]]
            for i, t in enumerate(texts):
                for p, at, n, check, part in kept[t]:
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(check)
                    if with_ids:
                        held.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that still takes it."""
    room = defaultdict(list)
    open_rooms = 0  # bit r is set if a bin with room r exists
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = open_rooms >> n
        if fitting:
            r = n + ((fitting & -fitting).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = size, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, size: int, looks: int = 200_000) -> list[list[int]]:
    """Local search: documents of the emptiest bin go to fuller ones by moves, one-for-one and two-for-one exchanges. Every step
    gives the fuller bin more and so raises the sum of squared fills; it ends when the bins are as few as their fill allows, when
    no step helps the emptiest bin, or after ``looks`` pairs of bins (a bound on time, not on what is packed)."""
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-sum(fill) // size)
    live = sorted((b for b in range(len(bins)) if fill[b] < size), key=lambda b: (fill[b], b))
    count = len(bins)
    while count > least and len(live) > 1 and looks > 0:
        giver, moved = live[0], False
        for taker in reversed(live[1:]):
            looks -= 1
            room = size - fill[taker]
            if not room:
                continue
            step = _step(bins[giver], bins[taker], lengths, room, fill[taker] - fill[giver])
            if step:
                out, back, gain = step
                bins[giver] = [x for x in bins[giver] if x not in out] + back
                bins[taker] = [x for x in bins[taker] if x not in back] + list(out)
                fill[giver] -= gain
                fill[taker] += gain
                moved = True
                if not bins[giver]:
                    break
        if not bins[giver]:
            count -= 1
        elif not moved:
            break
        live = sorted((b for b in live if bins[b] and fill[b] < size), key=lambda b: (fill[b], b))
    return [b for b in bins if b]


def _step(giver: list[int], taker: list[int], lengths: np.ndarray, room: int, lead: int):
    """The exchange that fills ``taker`` most: (positions out of the giver, positions back, tokens gained)."""
    best, step = 0, None
    back = sorted((int(lengths[t]), t) for t in taker)
    sizes = [n for n, _ in back]
    offers = [(int(lengths[x]), (x,)) for x in giver]
    offers += [(int(lengths[x] + lengths[y]), (x, y)) for i, x in enumerate(giver) for y in giver[i + 1:]]
    for n, out in offers:
        if len(out) == 1 and best < n <= room:
            best, step = n, (out, [], n)
        # the smallest document that, taken back, leaves at most the room
        at = bisect_left(sizes, n - room)
        if at < len(sizes) and best < n - sizes[at] <= room:
            best, step = n - sizes[at], (out, [back[at][1]], n - sizes[at])
        if best == room:
            break
    return step if step and best + lead > 0 else None


def pack_group(lengths: np.ndarray, size: int) -> list[list[int]]:
    return improve(best_fit(lengths, size), lengths, size)


def pack(items: DataFrame, length_col: str = "length", size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``items`` (a key column ``item`` that tells rows apart, and their lengths from 1 to ``size``) with sequence_id and offset.

    Levels of groups: each level packs bounded groups, keeps the full bins and hands the pieces of the underfull ones on."""
    items = items.select("item", F.col(length_col).cast("int").alias("n"))
    schema = T.StructType([items.schema["item"], *T.StructType.fromDDL("n int, bin string, offset int, open boolean").fields])

    def packed(level: int, last: bool):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["n", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
            lengths = frame["n"].to_numpy()
            bins = pack_group(lengths, size)
            name = np.empty(len(frame), dtype=object)
            offset = np.zeros(len(frame), dtype=np.int32)
            open_ = np.zeros(len(frame), dtype=bool)
            for b, members in enumerate(bins):
                n = lengths[members]
                name[members] = f"{level}-{int(key[0])}-{b}"
                offset[members] = np.cumsum(n) - n
                open_[members] = not last and int(n.sum()) < size - size // 16
            return pd.DataFrame({"item": frame["item"], "n": frame["n"], "bin": name, "offset": offset, "open": open_})
        return run

    done, level = None, 0
    left, count = items, items.count()
    while True:
        groups = max(1, -(-count // group))
        last = groups == 1
        dealt = left.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).cast("int"))
        out = written(dealt.groupBy("group").applyInPandas(packed(level, last), schema), f"packed-{level}")
        closed = out.where(~F.col("open")).select("item", "bin", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = out.where("open").select("item", "n")
        before, count, level = count, left.count(), level + 1
        if not count:
            break
        if count > before // 2:  # bins that no document can fill: a further level would not help
            rest = out.where("open").select("item", "bin", "offset")
            done = done.unionByName(rest)
            break
    return done.select("item", F.xxhash64("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                   end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, size, end_id)
    # a row's own number tells repeated rows apart; written, so that it stays what it is
    pieces = written(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size)
    places = pack(short, "length", size, group)
    found = short.join(places, "item").drop("item")
    full = (pieces.where(F.col("length") == size)
            .withColumn("sequence_id", F.xxhash64(F.lit("full"), "item")).withColumn("offset", F.lit(0).cast("long")).drop("item"))
    return found.unionByName(full)
