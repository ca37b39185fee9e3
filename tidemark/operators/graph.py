"""Graph tables: lookups, subgraphs, degrees, merging.

``nodes(name, entity_type, description, source_id)`` and
``edges(src, tgt, keywords, description, weight, source_id)``; the first keyword of an
edge is its predicate. Edges stay directed; ``undirected`` gives the collapsed view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import predicate_of
from tidemark.session import written
from tidemark.tables import Ordered, first_per_key, in_batches, matrix_join, semi_join


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair: of its rows the first by all columns, so that every run keeps the same."""
    paired = edges.withColumn("_a", F.least("src", "tgt")).withColumn("_b", F.greatest("src", "tgt"))
    return first_per_key(paired, ["_a", "_b"], [F.col(c) for c in edges.columns]).drop("_a", "_b")


def of_predicate(edges: DataFrame, *predicates: str) -> DataFrame:
    """Edges of these predicates. Stored edges have them as partition column, so that the others are not read."""
    kind = F.col("predicate") if "predicate" in edges.columns else predicate_of("keywords")
    return edges.where(kind.isin(*predicates))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, predicate): every edge seen from both ends; a loop once."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")),
                   F.struct(F.col("tgt").alias("node"), F.col("src").alias("other")))
    ends = F.when(F.col("src") == F.col("tgt"), F.slice(ends, 1, 1)).otherwise(ends)
    kind = F.col("predicate") if "predicate" in edges.columns else predicate_of("keywords")
    return edges.select(F.inline(ends), kind.alias("predicate"))


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends in ``names(name)``. The edges of a hub are looked up in their map tasks. Each step reads its
    tables several times, so the names and the edges between the steps are written."""
    names, columns = written(names.select("name").distinct(), "names"), edges.columns
    edges = written(semi_join(edges, names.withColumnRenamed("name", "src"), ["src"]).select(*columns), "from-names")
    return semi_join(edges, names.withColumnRenamed("name", "tgt"), ["tgt"]).select(*columns)


def filter_by_type(nodes: DataFrame, edges: DataFrame, entity_type: str) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("entity_type") == entity_type)
    return kept, induced(edges, kept)


def search_subgraph(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose name or description has the text (any case), their neighbours over all
    edges, and the edges inside that selection."""
    needle = text.lower()
    hits = nodes.where(F.contains(F.lower("name"), F.lit(needle))
                       | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(needle))).select("name")
    # read several times below
    hits, edges = written(hits.distinct(), "hits"), written(edges, "edges")
    near = semi_join(both_ways(edges), hits.withColumnRenamed("name", "node"), ["node"]).select(F.col("other").alias("name"))
    selected = written(hits.union(near.distinct()).distinct(), "selected")
    return nodes.join(selected, "name", "left_semi").select(*nodes.columns), induced(edges, selected)


def project_graph(nodes: DataFrame, edges: DataFrame, node_chars: int = 300,
                  edge_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """Display columns: cut descriptions, predicate as type, defaults filled in."""
    def cut(chars):
        return F.substring(F.coalesce("description", F.lit("")), 1, chars).alias("description")
    shown_nodes = nodes.select(F.col("name").alias("id"),
                               F.coalesce("entity_type", F.lit("Unknown")).alias("type"), cut(node_chars))
    shown_edges = edges.select(F.col("src").alias("source"), F.col("tgt").alias("target"),
                               F.coalesce(F.nullif(predicate_of("keywords"), F.lit("")), F.lit("related")).alias("type"),
                               cut(edge_chars), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return shown_nodes, shown_edges


def degrees(edges: DataFrame) -> DataFrame:
    """Edges touching each node; a loop counts once. Counted map-side, so a hub is cheap."""
    return both_ways(edges).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("degree"))


def limit_by_degree(nodes: DataFrame, edges: DataFrame, n: int,
                    position: str = "name") -> tuple[DataFrame, DataFrame]:
    """The ``n`` best-connected nodes (ties by ``position``) and the edges among them."""
    scored = nodes.join(degrees(edges), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = scored.orderBy(F.desc("degree"), position).limit(n)
    names = kept.select("name")
    return kept, induced(edges, names)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type")).agg(
        F.count("*").alias("n"))


def predicate_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(predicate_of("keywords").alias("predicate")).agg(F.count("*").alias("n"))


def graph_sizes(**graphs: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per named graph: (graph, node_count, edge_count)."""
    rows = None
    for label, (nodes, edges) in graphs.items():
        part = (nodes.select(F.lit(1).alias("is_node")).unionByName(edges.select(F.lit(0).alias("is_node")))
                .agg(F.count_if(F.col("is_node") == 1).alias("node_count"),
                     F.count_if(F.col("is_node") == 0).alias("edge_count"))
                .select(F.lit(label).alias("graph"), "node_count", "edge_count"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def list_entities(nodes: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` names in order, each with the overall count."""
    total = nodes.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    first = nodes.select("name").orderBy("name").limit(n).withColumn("_k", F.lit(1))
    return first.join(F.broadcast(total), "_k").drop("_k")


def entity_info(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def relation_info(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges between two nodes, in either direction."""
    return edges.where(((F.col("src") == a) & (F.col("tgt") == b)) | ((F.col("src") == b) & (F.col("tgt") == a)))


def points_of_event(nodes: DataFrame, edges: DataFrame, event: str | None = None) -> DataFrame:
    """(event, point) along INVOLVES_POINT, for one event or for all."""
    kinds = nodes.select("name", "entity_type")
    links = both_ways(of_predicate(edges, "INVOLVES_POINT"))
    if event is not None:
        links = links.where(F.col("node") == event)
    else:
        events = kinds.where(F.col("entity_type") == vocab.EVENT_TYPE).select(F.col("name").alias("node"))
        links = semi_join(links, events, ["node"])
    points = kinds.where("entity_type = 'Point'").select(F.col("name").alias("other"))
    return semi_join(links, points, ["other"]).select(F.col("node").alias("event"), F.col("other").alias("point"))


def point_cards(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, neighbours_per_line: int = 1000) -> DataFrame:
    """Evidence cards (point, line_no, line) for the points in ``wanted(name)``.

    First the description, then each distinct event by name, then the sorted neighbours.
    A point with more neighbours than fit one line gets several, so a hub stays whole."""
    wanted = wanted.select("name").distinct()
    card = (wanted.join(nodes.select("name", "entity_type", "description"), "name", "left")
            .select("name", F.when(F.col("entity_type").isNull(), 0)
                    .when(F.col("entity_type") != "Point", 1).otherwise(2).alias("state"),
                    "entity_type", "description"))
    missing = card.where("state < 2").select(
        F.col("name").alias("point"), F.lit(0).alias("line_no"),
        F.when(F.col("state") == 0, F.concat(F.lit("未在 GIS 图谱找到点位「"), "name", F.lit("」")))
        .otherwise(F.concat(F.lit("「"), "name", F.lit("」存在但不是 Point 类型 (实际: "), "entity_type", F.lit(")")))
        .alias("line"))
    found = card.where("state = 2")
    own = found.select(F.col("name").alias("point"), F.lit(0).alias("kind"), F.lit("").alias("sort_key"),
                       F.lit(0).alias("part"),
                       F.concat(F.lit("(Entity:Point) "), "name", F.lit(" — "),
                                F.coalesce("description", F.lit(vocab.NO_DESCRIPTION))).alias("text"))
    links = both_ways(of_predicate(edges, "INVOLVES_POINT", "ADJACENT_TO"))
    links = links.join(found.select(F.col("name").alias("node")), "node", "left_semi")
    events = (links.where("predicate = 'INVOLVES_POINT'").select("node", "other").distinct()
              .join(nodes.where(F.col("entity_type") == vocab.EVENT_TYPE)
                    .select(F.col("name").alias("other"), "description"), "other")
              .select(F.col("node").alias("point"), F.lit(1).alias("kind"), F.col("other").alias("sort_key"),
                      F.lit(0).alias("part"),
                      F.concat(F.lit("(STTE_Event) "), "other", F.lit(" — "),
                               F.coalesce("description", F.lit(""))).alias("text")))
    adjacent = links.where("predicate = 'ADJACENT_TO'").select("node", "other").distinct()
    adjacent = (in_batches(adjacent, ["node"], "other", neighbours_per_line, "names")
                .select(F.col("node").alias("point"), F.lit(2).alias("kind"), F.lit("").alias("sort_key"), "part",
                        F.concat(F.lit("(Adjacent:"), F.col("total").cast("string"), F.lit("个邻居) "),
                                 F.array_join("names", ", ")).alias("text")))
    lines = Ordered(own.unionByName(events).unionByName(adjacent), ["point"], ["kind", "sort_key", "part"])
    numbered = lines.row_number("line_no").result().select(
        "point", "line_no", F.concat(F.lit("[E"), F.col("line_no").cast("string"), F.lit("] "), "text").alias("line"))
    return numbered.unionByName(missing)


def point_detail(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    wanted = nodes.sparkSession.createDataFrame([(name,)], "name string")
    mine = edges.where((F.col("src") == name) | (F.col("tgt") == name))
    return point_cards(nodes, mine, wanted)


def path(nodes: DataFrame, edges: DataFrame, steps: list[tuple[str, str]], types: list[str] | None = None) -> DataFrame:
    """Distinct chains n0..nk along ``steps`` of (predicate, 'out' | 'in' | 'any'); ``types`` may
    fix the entity type at every position.

    The steps are reduced before they are joined: forward to the edges that a chain from the start reaches, then backward to
    those that go on to the end. Only edges of whole chains are left; they alone are made distinct and meet in joins, which
    spread the edges of a hub over tasks."""
    kinds = nodes.select("name", "entity_type")

    def typed(at: int) -> DataFrame | None:
        if types is None or types[at] is None:
            return None
        return kinds.where(F.col("entity_type") == types[at]).select(F.col("name").alias(f"n{at}"))

    def reduced(pairs: DataFrame, at: int, *names: DataFrame | None) -> DataFrame:
        for keys in names:
            pairs = pairs if keys is None else semi_join(pairs, keys, [f"n{at}"])
        return pairs

    chain = []
    for at, (predicate, direction) in enumerate(steps):
        step = of_predicate(edges, predicate)
        pairs = {"out": step.select("src", "tgt"),
                 "in": step.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")),
                 "any": both_ways(step).select(F.col("node").alias("src"), F.col("other").alias("tgt"))}[direction]
        pairs = pairs.select(F.col("src").alias(f"n{at}"), F.col("tgt").alias(f"n{at + 1}"))
        reached = chain[-1].select(f"n{at}") if chain else typed(0)
        pairs = reduced(reduced(pairs, at, reached), at + 1, typed(at + 1))
        # of an untyped first step nothing is known yet: it waits for the way back
        chain.append(written(pairs.distinct(), "chain-step") if at or types else pairs)
    if len(chain) == 1:
        return chain[0].distinct()
    for at in range(len(chain) - 2, -1, -1):
        chain[at] = written(reduced(chain[at], at + 1, chain[at + 1].select(f"n{at + 1}")).distinct(), "chain-step")
    found = chain[0]
    for at, pairs in enumerate(chain[1:], 1):
        found = matrix_join(found if at == 1 else written(found, "chains"), pairs, [f"n{at}"])
    return found.select(*[f"n{i}" for i in range(len(steps) + 1)])


def two_hop(nodes: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """Point - event - boundary: against the first predicate, along the second."""
    return path(nodes, edges, [(first, "in"), (second, "out")])


def source_id(source: Column, page: Column) -> Column:
    """The provenance key of a chunk: ``{source}_p{page}``, or the bare source on page 0."""
    return F.when(F.coalesce(page, F.lit(0)) == 0, source).otherwise(
        F.concat(source, F.lit("_p"), page.cast("string")))


def import_source_id(source: Column, page: Column, index: Column) -> Column:
    """The provenance key of the file importer: ``{source}#p{page}-c{index}``."""
    return F.concat(source, F.lit("#p"), page.cast("string"), F.lit("-c"), index.cast("string"))


def chunks_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entity or edge rows with the chunks they came from. A place with very many rows and chunks is joined in parts of both."""
    keyed = chunks.withColumn("source_id", source_id(F.col("source"), F.col("page")))
    return matrix_join(rows, keyed.select("source_id", F.col("id").alias("chunk_id"), "content"), ["source_id"])


def merge_nodes(base: DataFrame, new: DataFrame, on_conflict: str = "last",
                priority: dict[str, int] = vocab.TYPE_PRIORITY) -> DataFrame:
    """Nodes of both tables, one per name. ``last``: the later batch wins; ``priority``:
    the type of higher priority wins and a tie stays with the earlier batch."""
    both = (base.withColumn("_batch", F.lit(0))
            .unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in ("name", "_batch")]
    if on_conflict == "last":
        order = [-F.col("_batch")]
    else:
        rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in priority.items() for x in p]),
                                           F.col("entity_type")), F.lit(0))
        order = [-rank, F.col("_batch")]
    tie = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]
    merged = both.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct(*order, *tie)).alias("_n"))
    return merged.select("name", "_n.*").select(*base.columns)


def merge_edges(base: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both tables, one per (src, tgt, predicate); the later batch wins."""
    both = (base.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
            .withColumn("_p", predicate_of("keywords")))
    tie = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in base.columns]
    return first_per_key(both, ["src", "tgt", "_p"], [-F.col("_batch"), *tie]).select(*base.columns)


def merge_graph(base: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame],
                on_conflict: str = "last") -> tuple[DataFrame, DataFrame]:
    return merge_nodes(base[0], new[0], on_conflict), merge_edges(base[1], new[1])


def rebuild(gis: tuple[DataFrame, DataFrame], documents: tuple[DataFrame, DataFrame],
            on_conflict: str = "last") -> tuple[DataFrame, DataFrame]:
    """A fresh full graph: the change graph is laid down first, then the documents."""
    return merge_graph(gis, documents, on_conflict)


def missing_after_write(written_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that should be in the written table and are not; all are checked."""
    return nodes.select("name").distinct().join(written_nodes.select("name"), "name", "left_anti")


def missing_years(years: DataFrame, first: int, last: int) -> DataFrame:
    """Requested years without a boundary."""
    wanted = years.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(years.select(F.col("year").cast("int").alias("year")), "year", "left_anti")
