"""Documents to chunks: by paragraph, by heading structure, from tables and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import chunk_id, heading_level, keep_image, keywords, sentences, strip, usable_description
from tidemark.operators.folds import filling, joining, numbered_groups
from tidemark.session import written
from tidemark.tables import Ordered, first_per_key, top_per_group


def _tail(text: Column, n: int) -> Column:
    return F.substring(text, -n, n) if n > 0 else F.lit("")


def _pack(pieces: Column, size: int, overlap: int, glue: str, empty_first: bool) -> Column:
    """Greedy packing of an array of strings into an array of chunks, inside the JVM.

    A chunk closes when the next piece would not fit; the next one starts with its last
    ``overlap`` characters and that piece. ``glue`` joins pieces within a chunk."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, piece):
        full = (acc.now != "") & (F.length(acc.now) + F.length(piece) > size)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done).alias("done"),
            F.when(full, F.concat(_tail(acc.now, overlap), piece))
            .when(acc.now == "", piece)
            .otherwise(F.concat(acc.now, F.lit(glue), piece)).alias("now"))

    return F.aggregate(pieces, state, step, lambda acc: F.when(
        acc.now != "", F.concat(acc.done, F.array(acc.now))).otherwise(acc.done))


def packed_paragraphs(text, size: int = 700, overlap: int = 80) -> Column:
    """Lines packed up to ``size`` characters; a longer line stays whole."""
    text = F.col(text) if isinstance(text, str) else text
    paragraphs = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    return _pack(paragraphs, size, overlap, "\n", True)


def packed_sentences(text, size: int = 700, overlap: int = 80, marks: str = vocab.SENTENCE_MARKS) -> Column:
    """Text cut between sentences into pieces of about ``size``; no sentence is broken."""
    text = F.col(text) if isinstance(text, str) else text
    packed = F.filter(F.transform(_pack(sentences(text, marks), size, overlap, "", True), strip), lambda p: p != "")
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def chunk_text(docs: DataFrame, size: int = 700, overlap: int = 80, source: str = "source", text: str = "text",
               page: Column | None = None) -> DataFrame:
    """(…other columns, id, content, keywords, source, page, chunk_index, chunk_type) per
    document row. Each row is packed on its own: no shuffle."""
    keep = [c for c in docs.columns if c not in (source, text, "page")]
    cut = docs.select(*keep, F.col(source).cast("string").alias("source"),
                      (F.lit(1) if page is None else page).alias("page"),
                      F.posexplode(packed_paragraphs(text, size, overlap)).alias("chunk_index", "content"))
    return cut.select(*keep, chunk_id("source", "page", "chunk_index", "content").alias("id"), "content",
                      keywords("content").alias("keywords"), "source", "page", "chunk_index",
                      F.lit("text").alias("chunk_type"))


def font_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size, font_reliable). Body size is the upper median of the positive
    sizes: the lower median of their negatives, counted per distinct size map-side."""
    body = lines.groupBy("doc_id").agg(F.coalesce(
        -F.expr("percentile_disc(0.5) within group (order by -size) filter (where size > 0)"),
        F.lit(0.0)).alias("body_size"))
    heading = (F.col("chars") <= 40) & ((F.col("size") >= F.col("body_size") * 1.4)
                                        | (F.col("bold") & (F.col("chars") <= 30)))
    # the lengths of lines go to the sizes of their document, their texts stay
    slim = lines.select("doc_id", "size", "bold", F.length("text").alias("chars"))
    share = (slim.join(body, "doc_id").groupBy("doc_id", "body_size")
             .agg(F.count_if(heading).alias("heads"), F.count("*").alias("n")))
    return share.select("doc_id", "body_size",
                        ((F.col("body_size") > 0) & (F.col("heads") <= F.col("n") * 0.30)).alias("font_reliable"))


def heading_paths(lines: DataFrame, **options) -> DataFrame:
    """Lines with ``level``, ``section`` (line number of the last heading, -1 before the
    first) and ``heading_path``. Needs (doc_id, line_no, text, level).

    A heading of level k is on the path if no heading of a lower level came after it: the
    last heading per level is a running maximum, so the stack needs no row loop."""
    levels = range(1, 1 + max(level for _, level in vocab.HEADING_PATTERNS))
    ordered = Ordered(lines, ["doc_id"], ["line_no"], **options)
    for k in levels:
        here = F.when(F.col("level") == k, F.struct(F.col("line_no").alias("at"), F.col("text").alias("title")))
        ordered.running_max(f"_h{k}", here)
    result = ordered.result()
    path = F.array().cast("array<string>")
    last = F.lit(-1).cast("long")
    for k in levels:
        at = F.col(f"_h{k}.at")
        path = F.when(at.isNotNull() & (at > last), F.concat(path, F.array(F.col(f"_h{k}.title")))).otherwise(path)
        last = F.greatest(last, F.coalesce(at, F.lit(-1)))
    return (result.withColumn("heading_path", path).withColumn("section", last)
            .drop(*[f"_h{k}" for k in levels]))


def merge_tiny(chunks: DataFrame, min_chars: int = 60, size: int = 700, **options) -> DataFrame:
    """Fold chunks under ``min_chars`` into their predecessor with the same heading path.
    Needs (doc_id, source, page, chunk_index, content, heading_path)."""
    ordered = Ordered(chunks, ["doc_id"], ["chunk_index"], **options)
    ordered.lag("_previous", F.col("heading_path"))
    ordered.running_sum("run", F.when(F.col("heading_path").eqNullSafe(F.col("_previous")), 0).otherwise(1))
    runs = ordered.result().drop("_previous").select(
        "doc_id", F.col("run").cast("long").alias("run"), F.col("source"), F.col("page").cast("int").alias("page"),
        F.col("chunk_index").cast("int").alias("chunk_index"), "heading_path", "content")
    short = F.coalesce(F.length("content") < min_chars, F.lit(True))
    ahead = Ordered(runs.withColumn("_back", -F.col("chunk_index")), ["doc_id"], ["_back"], **options)
    ahead.lag("_next", F.struct("run", short.alias("short")))
    follows = F.coalesce((F.col("_next.run") == F.col("run")) & F.col("_next.short"), F.lit(False))
    # a long chunk without a short one behind it is a group of its own, as what follows opens the next: only the others meet
    rows = written(ahead.result().select(*runs.columns, (~short & ~follows).alias("alone")), "runs", "zstd")
    alone, rows = rows.where("alone").drop("run", "alone"), rows.where("not alone").drop("alone")
    sizes = rows.select("doc_id", "run", "chunk_index", F.length("content").alias("chars"))
    numbered = numbered_groups(sizes, ["doc_id", "run"], ["chunk_index"], "chars", joining(min_chars, size), "group")
    # a group is its first chunk and what fits behind it
    rest = F.struct(*[c for c in rows.columns if c not in ("doc_id", "run", "chunk_index", "content")], "chunk_index")
    merged = rows.join(numbered, ["doc_id", "run", "chunk_index"]).groupBy("doc_id", "run", "group").agg(
        F.min_by(rest, "chunk_index").alias("first"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c.content), "\n")).alias("content"))
    merged = merged.select("doc_id", "first.source", "first.page", "first.chunk_index", "first.heading_path", "content")
    return merged.unionByName(alone.withColumn("content", strip("content")))


def chunk_structured(lines: DataFrame, size: int = 700, overlap: int = 80, min_chars: int = 60,
                     **options) -> DataFrame:
    """Styled lines (doc_id, source, line_no, text, size, bold, page) to chunks with their
    heading path. Text is cut at headings and when a buffer reaches ``size``, then between
    sentences; short chunks are merged last."""
    stats = font_stats(lines)
    leveled = lines.join(stats, "doc_id").withColumn(
        "level", heading_level("text", "size", "bold", "body_size", "font_reliable"))
    leveled = leveled.select("doc_id", "source", "line_no", "text", "page", "level")
    body = heading_paths(leveled, **options).where("level = 0").withColumn("chars", F.length("text"))
    body = body.select("doc_id", "source", "section", "line_no", "text", "page", "heading_path", "chars")
    body = written(body, "body-lines", "zstd")
    buffers = numbered_groups(body.select("doc_id", "section", "line_no", "chars"), ["doc_id", "section"], ["line_no"], "chars",
                              filling(size), "buffer")
    buffered = body.join(buffers, ["doc_id", "section", "line_no"])
    # a buffer holds at most size characters plus one line
    line = F.struct("line_no", "text")
    texts = buffered.groupBy("doc_id", "source", "section", "heading_path", "buffer").agg(
        F.min_by("page", "line_no").alias("page"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s.text), "\n")).alias("content"))
    pieces = texts.where("content <> ''").select(
        "doc_id", "source", "section", "heading_path", "buffer", "page",
        F.posexplode(packed_sentences("content", size, overlap)).alias("piece", "content"))
    # numbered and merged in several passes: keep the pieces instead of cutting them again
    pieces = written(pieces, "pieces", "zstd")
    numbered = Ordered(pieces, ["doc_id"], ["section", "buffer", "piece"], **options).row_number("_n").result()
    merged = merge_tiny(numbered.withColumn("chunk_index", F.col("_n") - 1), min_chars, size, **options)
    return merged.select("doc_id", chunk_id("source", "page", "chunk_index", "content").alias("id"), "content",
                         keywords("content").alias("keywords"), "source", "page", "chunk_index",
                         F.lit("text").alias("chunk_type"), "heading_path",
                         F.size("heading_path").alias("heading_level"))


def table_markdown(cells: DataFrame, cap: int = 30) -> DataFrame:
    """Cells (source, page, table_no, row_no, col_no, text) to one markdown chunk per table;
    tables with fewer than two rows are left out, rows beyond ``cap`` are not shown."""
    keys = ["source", "page", "table_no"]
    cell = strip(F.replace(F.coalesce("text", F.lit("None")), F.lit("\n"), F.lit(" ")))
    rows = (cells.groupBy(*keys, "row_no")
            .agg(F.array_sort(F.collect_list(F.struct("col_no", cell.alias("cell")))).alias("_cells")))
    values = F.transform("_cells", lambda c: c.cell)
    line = F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("_cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    rows = top_per_group(rows.select(*keys, "row_no", line.alias("line"), rule.alias("rule")),
                         keys, [F.col("row_no")], cap)
    rows = rows.withColumn("line", F.when(F.col("rank") == 1, F.concat_ws("\n", "line", "rule")).otherwise(F.col("line")))
    tables = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r.line), "\n")
        .alias("content"))
    index = F.lit(9000) + F.col("table_no")
    return tables.where("n >= 2").select(
        chunk_id(F.col("source"), F.col("page"), index, F.col("content")).alias("id"), "content",
        keywords("content").alias("keywords"), "source", "page", index.alias("chunk_index"),
        F.lit("table").alias("chunk_type"))


def image_chunks(images: DataFrame, captions: DataFrame, words=vocab.CAPTION_WORDS,
                 rejects=vocab.CAPTION_REJECTS) -> DataFrame:
    """Image metadata (source, page, idx, hash, width, height, y0, y1, page_height) with
    captions (hash, caption), one caption per hash, to chunks; unusable ones drop out."""
    known = first_per_key(captions.select("hash", "caption"), ["hash"], [F.col("caption")])
    kept = (images.where(keep_image()).join(known, "hash")
            .where(usable_description("caption", words, rejects))
            .withColumn("content", F.concat(F.lit(vocab.IMAGE_PREFIX), "caption")))
    name = F.concat(F.col("source"), F.format_string("_p%d_img%d_", "page", "idx"), F.substring("hash", 1, 8))
    return kept.select(name.alias("id"), "content", keywords("content").alias("keywords"), "source", "page",
                       (F.lit(1000) + F.col("idx")).alias("chunk_index"), F.lit("image").alias("chunk_type"))


def all_chunks(*kinds: DataFrame) -> DataFrame:
    """Text, table and image chunks in one table."""
    first, *rest = kinds
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first
