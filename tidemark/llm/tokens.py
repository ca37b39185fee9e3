"""Token counts without token ids: pieces are counted once per distinct pre-token, joined to the documents' pre-token frequencies
and summed.

Documents are taken in blocks of bounded text where they lie. A block lists its distinct pre-tokens once, dealt by a hash into
packs, and holds each document's frequencies by position in that list; all of this as compressed bytes, and a frequent word
travels once per block. The packs of equal number meet in one task, which counts each distinct pre-token of theirs once by the tokenizer's own
library; the counts go back to the blocks, and each block sums frequency times count per document.

A null text counts as empty: no bytes, no tokens. Null ids pass through, repeated rows are counted each. An empty table gives an
empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches
from tidemark.llm.presplit import Splitter
from tidemark.session import written

#: characters of text in a block; a longer document is a block of its own
BLOCK_CHARS = 8_000_000

_held: dict[str, tuple] = {}


def _library(path: str) -> tuple:
    """The tokenizer and its splitter, once per worker."""
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        _held[path] = library, Splitter(library)
    return _held[path]


def _cut(texts: list[str], block_chars: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > block_chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def frequency_blocks(docs: DataFrame, tokenizer: str, packs: int, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its number, ids and n_bytes by document, words (its distinct pre-tokens by pack), held (pre-tokens by
    document), and packed word/times: positions in the list of all packs and frequencies, document after document."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL(
        "n_bytes array<long>, words array<struct<pack: int, words: binary>>, held array<int>, word binary, times binary").fields])
    lists = pa.list_(pa.struct([("pack", pa.int32()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, part, number = _library(tokenizer)[1], TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _cut(texts, block_chars):
                place: dict[str, int] = {}
                held, word, times = [], [], []
                for at in range(a, b, 64):
                    counted = [Counter(splitter.chunks(t)) for t in texts[at:min(at + 64, b)]]
                    splitter.pieces.learn(counted)
                    known = splitter.pieces.known
                    for chunks in counted:
                        found: dict[str, int] = {}
                        for chunk, n in chunks.items():
                            for p in known[chunk]:
                                found[p] = found.get(p, 0) + n
                        held.append(len(found))
                        word.extend([place.setdefault(p, len(place)) for p in found])
                        times.extend(found.values())
                words, moved = _dealt([w.encode("utf-8", "replace") for w in place], packs)
                n_bytes = [len(t.encode("utf-8", "replace")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part << 32 | number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a)),
                    pa.array([n_bytes], pa.list_(pa.int64())), pa.array([words], lists), pa.array([held], pa.list_(pa.int32())),
                    *(pa.array([x], pa.binary()) for x in _packed(held, moved[word] if word else [], times))], names=schema.names)
                number += 1

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


#: parts the words of a pack; no UTF-8 text has this byte
_BETWEEN = b"\xff"


def _dealt(words: list[bytes], packs: int) -> tuple[list[dict], np.ndarray]:
    """The words by pack, compressed, and each word's position in the list of all packs."""
    pack = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % packs
    order = np.argsort(pack, kind="stable")
    moved = np.empty(len(words), dtype=np.int64)
    moved[order] = np.arange(len(words))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    numbers, starts = np.unique(pack[order], return_index=True)
    ends = [*starts[1:].tolist(), len(words)]
    order = order.tolist()
    return [{"pack": n, "words": squeeze(_BETWEEN.join([words[i] for i in order[a:b]]))}
            for n, a, b in zip(numbers.tolist(), starts.tolist(), ends)], moved


def _packed(held: list[int], word, times: list[int]) -> tuple[bytes, bytes]:
    """Positions in rising order by document as steps, and their frequencies, compressed."""
    held, word = np.array(held, dtype=np.int64), np.array(word, dtype=np.int64)
    order = np.lexsort((word, np.repeat(np.arange(len(held)), held)))
    word = word[order]
    step = np.diff(word, prepend=0)
    starts = (np.cumsum(held) - held)[held > 0]
    step[starts] = word[starts]
    pack = zstandard.ZstdCompressor(level=1).compress
    return pack(step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()), pack(np.array(times, dtype="<u4")[order].tobytes())


def _unpacked(held: np.ndarray, word: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    step = np.frombuffer(unpack(word), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    starts = (np.cumsum(held) - held)[held > 0]
    total = np.cumsum(step)
    return total - np.repeat(total[starts] - step[starts], held[held > 0]), np.frombuffer(unpack(times), dtype="<u4").astype(np.int64)


def piece_counts(packs: DataFrame, tokenizer: str, tasks: int) -> DataFrame:
    """(block, pack, pieces) of (block, pack, words): the counts of a pack's words as 32-bit numbers, compressed. Packs of one
    number lie in one task, which counts each distinct word of theirs once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, counts = _library(tokenizer)[0], {}
        squeeze, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                words = unpack(data).split(_BETWEEN)
                new = [w for w in set(words) if w not in counts]
                if new:
                    found = library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                    counts.update(zip(new, [len(e.ids) for e in found]))
                out.append(squeeze(np.array([counts[w] for w in words], dtype="<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "pack", "pieces"])

    return packs.select("block", "pack", "words").repartition(tasks, "pack").mapInArrow(run, "block long, pack int, pieces binary")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    # several packs to a task, so that tasks are alike
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(frequency_blocks(docs, tokenizer, 8 * tasks, id_col, text_col, block_chars), "frequency-blocks")
    packs = blocks.select("block", F.inline("words"))
    lists = (piece_counts(packs, tokenizer, tasks).groupBy("block")
             .agg(F.array_sort(F.collect_list(F.struct("pack", "pieces"))).alias("pieces"))
             .select("block", F.col("pieces.pieces").alias("pieces")))
    joined = blocks.drop("words").join(lists, "block", "left")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n_bytes long, n_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                held, word, times, pieces = (batch.column(batch.schema.get_field_index(c))[i] for c in ("held", "word", "times", "pieces"))
                held = np.array(held.as_py(), dtype=np.int64)
                pieces = np.frombuffer(b"".join([unpack(x) for x in pieces.as_py() or []]), dtype="<u4").astype(np.int64)
                word, times = _unpacked(held, word.as_py(), times.as_py())
                product = times * pieces[word]
                total = np.r_[0, np.cumsum(product)]
                ends = np.cumsum(held)
                ids, n_bytes = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("ids", "n_bytes"))
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array((total[ends] - total[ends - held]).astype(np.int64))], names=schema.names)

    return joined.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
