"""Text functions, chunking and extraction on small inputs with known answers."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scan, text as tx
from tidemark.operators import chunking as ch, extract as ex
from tidemark.plans import texts


def values(spark, texts, *columns):
    """One list of results per column, in input order."""
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = df.select("n", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("n").collect()
    out = [[r[f"c{k}"] for r in rows] for k in range(len(columns))]
    return out[0] if len(columns) == 1 else out


def test_scalars(spark):
    assert values(spark, [" “a”　b。", None, "'x ；"], tx.clean_text("t")) == ["“a” b", "", "x"]
    assert values(spark, ["City ", "规划文件", "", "Odd"], tx.normalize_entity_type("t")) == ["District", "Policy", "Unknown", "Odd"]
    assert values(spark, ["has-goal", "影响", "", "part of!"], tx.normalize_relation_type("t")) == ["HAS_GOAL", "AFFECTS", "RELATED", "PART_OF"]
    assert values(spark, ["功能:x | 用地:R2 | y", "none"], tx.land_use_code("t")) == ["R2", "unknown"]
    assert values(spark, ["A,b", " x ", None], tx.predicate_of("t")) == ["A", "x", ""]
    assert values(spark, ["a b-c/d", "///"], tx.safe_name("t")) == ["a_b-c_d", "document"]
    assert values(spark, ["/x/y.tar.pdf", "plan"], tx.safe_stem("t")) == ["y_tar", "plan"]
    assert values(spark, ["城市规划 plan 2"], tx.keywords("t")) == [["plan", "城市", "市规", "规划"]]


def test_topics(spark):
    text = ["杭州,上海,边界趋势,下沙区"]
    assert values(spark, text, tx.extract_topics("t")) == [["杭", "州", "上", "海", "边界", "趋势"]]
    assert values(spark, text, tx.extract_topics("t", whole_names=True)) == [["杭州", "上海", "下沙区", "边界", "趋势"]]


def test_heading_levels(spark):
    texts = ["第一章 总则", "第二节 目标", "一、范围", "（一）规模", "1.2.3 x", "1.2 x", "1 x", "正文" * 30, "正文"]
    assert values(spark, texts, tx.heading_level("t")) == [1, 2, 2, 3, 3, 2, 1, 0, 0]
    assert values(spark, ["标题"], tx.heading_level("t", F.lit(20.0), F.lit(False), F.lit(11.0), F.lit(True))) == [1]
    assert values(spark, ["标题"], tx.heading_level("t", F.lit(11.0), F.lit(True), F.lit(11.0), F.lit(True))) == [2]
    assert values(spark, ["标题"], tx.heading_level("t", F.lit(20.0), F.lit(True), F.lit(11.0), F.lit(False))) == [0]


def test_answer_status(spark):
    long = "该问题的分析如下：" * 40
    texts = [None, "", "太短", "Waiting for tool calls " + long, "未检索到 相关的内容，请换一个问题再试试看吧谢谢", long + "未检索到 X"]
    assert values(spark, texts, tx.answer_status("t")) == ["degraded"] * 5 + ["done"]
    assert values(spark, ["HTTP 429", "ValueError: x", "Connection reset"], tx.error_class("t")) == ["transient", "permanent", "transient"]


def test_image_and_caption_rules(spark):
    images = spark.createDataFrame([(200, 200, 300.0, 500.0, 1000.0, True), (50, 50, 300.0, 500.0, 1000.0, False), (4000, 100, 300.0, 400.0, 1000.0, False),
                                    (200, 200, 10.0, 79.0, 1000.0, False), (200, 200, 930.0, 990.0, 1000.0, False), (200, 200, None, None, 1000.0, True)],
                                   "width int, height int, y0 double, y1 double, page_height double, want boolean")
    assert all(r.keep == r.want for r in images.select(tx.keep_image().alias("keep"), "want").collect())
    good = "图中显示城市规划的用地结构与空间布局，包含轨道交通线路和主要的枢纽站点分布情况"
    assert values(spark, [good, "规划用地", good + "，实景", "x" * 60], tx.usable_description("t")) == [True, False, False, False]


@pytest.mark.parametrize("raw, fixed, count", [
    ('{"content": "line1\nline2"}', '{"content": "line1\\nline2"}', 1),
    ('{"content": "a\r\nb"}', '{"content": "a\\r\\nb"}', 2),
    ('{\n  "k": "v"\n}', '{\n  "k": "v"\n}', 0),
    (r'{"k": "a\nb"}', r'{"k": "a\nb"}', 0),
    ('{\n  "k": "v1\nv2",\n  "x": 1\n}', '{\n  "k": "v1\\nv2",\n  "x": 1\n}', 1),
])
def test_escape_controls(spark, raw, fixed, count):
    got = values(spark, [raw], scan.escape_controls("t"))[0]
    assert (got.text, got.repairs) == (fixed, count)


def test_quarantine(spark):
    from tidemark.sources.files import repair_json_rows
    df = spark.createDataFrame([('{"a":1}',), ('{"a":"x\ty"}',), ('{"a":"x\n"',)], "text string")
    good, bad = repair_json_rows(df)
    assert {(r.text, r.repairs) for r in good.collect()} == {('{"a":1}', 0), ('{"a":"x\\ty"}', 1)}
    assert [r.text for r in bad.collect()] == ['{"a":"x\n"']


def test_json_candidate(spark):
    texts = ['ok ```json\n{"a": [1, 2,], }\n``` bye', 'x {"s": "}{", "b": {"c": 1}} y {', 'no json', '[{"a": "\\"]"}] tail', '{"open": 1']
    assert values(spark, texts, scan.json_candidate("t")) == ['{"a": [1, 2]}', '{"s": "}{", "b": {"c": 1}}', "", '[{"a": "\\"]"}]', '{"open": 1']


def test_sufficiency(spark):
    block = '{"sufficient": false, "missing": ["x"], "follow_up": "y"}'
    texts = [f"answer\n【信息充分性评估】\n```json\n{block}```", f"a {block} b", 'q {"sufficient": "yes"}', "plain", None]
    flags, rest = values(spark, texts, scan.sufficiency("t")["sufficient"], scan.strip_sufficiency("t"))
    assert flags == [False, False, None, None, None]
    assert rest == ["answer", "a  b", "q", "plain", None]


def test_split_answer_evidence(spark):
    got = values(spark, ["[answer]\nhi\n[evidence]\n[E1] (x) one\nnoise\n[D2] two", "see [E2] and [D1] [E2]", "[evidence]\n"], tx.split_answer_evidence("t"))
    assert got[0].answer == "hi" and [(e.id, e.text) for e in got[0].evidence] == [("E1", "(x) one"), ("D2", "two")]
    assert [e.id for e in got[1].evidence] == ["D1", "E2"] and got[1].evidence[0].text == "(SubAgent 引用 D1)"
    assert got[2].evidence == []


# -- chunks ---------------------------------------------------------------------------

def packed(paragraphs, size, overlap):
    """The packing rule, one step at a time."""
    out, now = [], ""
    for p in paragraphs:
        if now and len(now) + len(p) > size:
            out.append(now)
            now = (now[-overlap:] if overlap else "") + p
        else:
            now = f"{now}\n{p}" if now else p
    return out + ([now] if now else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet="ab 规。", max_size=30), max_size=12), min_size=1, max_size=4), st.sampled_from([(20, 5), (20, 0), (8, 3)]))
def test_packed_paragraphs(spark, docs, limits):
    got = values(spark, ["\n".join(d) for d in docs], ch.packed_paragraphs("t", *limits))
    assert got == [packed([p.strip() for p in d if p.strip()], *limits) for d in docs]


def test_no_sentence_is_cut(spark):
    text = "这是第一句话。这是第二句话，稍微长一点点！第三句？最后一句没有标点"
    pieces = values(spark, [text], ch.packed_sentences("t", 15, 0))[0]
    assert "".join(pieces) == text and all(p[-1] in "。！？" for p in pieces[:-1])
    assert values(spark, ["短。句"], ch.packed_sentences("t", 15, 5)) == [["短。句"]]


def structured(lines, size, overlap, min_chars):
    """Sections, buffers, sentences and short chunks, line by line (body lines have level 0)."""
    def split(text):
        if len(text) <= size:
            return [text]
        out, now = [], ""
        for s in filter(None, re.split(r"(?<=[。！？；!?;])", text)):
            if now and len(now) + len(s) > size:
                out.append(now.strip())
                now = (now[-overlap:] if overlap else "") + s
            else:
                now += s
        return [p for p in out + [now.strip()] if p]

    chunks, stack, buffer, page = [], [], [], None

    def flush():
        nonlocal buffer, page
        text = "\n".join(buffer).strip()
        if text:
            chunks.extend([p, page, [t for _, t in stack]] for p in split(text))
        buffer, page = [], None
    for level, text, at in lines:
        if level:
            flush()
            stack[:] = [s for s in stack if s[0] < level] + [(level, text)]
        else:
            page = at if page is None else page
            buffer.append(text)
            if sum(map(len, buffer)) >= size:
                flush()
    flush()
    merged = []
    for n, (text, at, path) in enumerate(chunks):
        if merged and len(text) < min_chars and merged[-1][3] == path and len(merged[-1][0]) + len(text) <= size:
            merged[-1][0] = f"{merged[-1][0]}\n{text}".strip()
        else:
            merged.append([text, at, n, path])
    return merged


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_chunk_structured_equals_the_line_by_line_rule(spark, hot_rows):
    import random
    rng = random.Random(3)
    heads = ["第一章 甲", "第二节 乙", "（一）丙", "2 丁", "第一章 甲"]
    docs, rows = {}, []
    for doc in range(6):
        lines = []
        for n in range(rng.randint(1, 60)):
            if rng.random() < 0.2:
                lines.append(rng.choice(heads))
            else:
                lines.append("".join(rng.choice("句子。文字！ab ") for _ in range(rng.randint(1, 45))).strip() or "空")
        docs[doc] = lines
        rows += [(doc, f"s{doc}", n, t, 11.0, False, n // 5 + 1) for n, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id int, source string, line_no int, text string, size double, bold boolean, page int")
    got = ch.chunk_structured(df, 40, 6, 12, hot_rows=hot_rows).orderBy("doc_id", "chunk_index").collect()
    levels = {"第一章 甲": 1, "第二节 乙": 2, "（一）丙": 3, "2 丁": 1}
    for doc, lines in docs.items():
        want = structured([(levels.get(t, 0), t, n // 5 + 1) for n, t in enumerate(lines)], 40, 6, 12)
        assert [[r.content, r.page, r.chunk_index, r.heading_path] for r in got if r.doc_id == doc] == want


def test_table_markdown(spark):
    cells = [("f", 1, t, r, c, v) for t, rows in enumerate([[["a", "b"], ["1", None], ["2", "x\ny"]], [["only"]]])
             for r, row in enumerate(rows) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, "source string, page int, table_no int, row_no int, col_no int, text string")
    rows = ch.table_markdown(df).collect()
    assert [(r.chunk_index, r.content) for r in rows] == [(9000, "| a | b |\n| --- | --- |\n| 1 | None |\n| 2 | x y |")]


# -- extraction -------------------------------------------------------------------------

def chunk(spark, *texts):
    rows = [(f"c{n}", n, t, "policy.pdf", 1, n) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, chunk_no int, content string, source string, page int, chunk_index int")


def test_fenced_reply_with_aliases(spark):
    reply = """```json
    {"nodes": [{"name": "城市总体规划", "type": "规划文件", "desc": "d"}, {"label": "中心城区", "type": "片区"}, {"name": "中心城区", "type": "x"}],
     "relations": [{"source": "城市总体规划", "target": "中心城区", "type": "影响"}, {"from": "a", "to": "a"}, {"src_id": "中心城区", "tgt_id": "新区"}],}
    ```"""
    responses = spark.createDataFrame([("c0", reply)], "chunk_id string, response string")
    entities, relations = ex.import_extract(chunk(spark, "text"), responses)
    assert {(r.name, r.entity_type) for r in entities.collect()} == {("城市总体规划", "Policy"), ("中心城区", "District"), ("新区", "Unknown")}
    rows = relations.collect()
    assert {(r.src, r.tgt, r.predicate) for r in rows} == {("城市总体规划", "中心城区", "AFFECTS"), ("中心城区", "新区", "RELATED")}
    assert {r.source_id for r in rows} == {"policy.pdf#p1-c0"}


@pytest.mark.parametrize("wrapped", ["```json\n{}\n```", "```json\n{}", "```\n{}\n  ```  ", "{}", "```json\n{}```x"])
def test_fences_need_no_partner(spark, wrapped):
    reply = json.dumps({"entities": [{"entity_name": "上城区", "entity_type": "District"}], "relationships": []}, ensure_ascii=False)
    responses = spark.createDataFrame([("c0", wrapped.replace("{}", reply))], "chunk_id string, response string")
    nodes, _ = ex.build_document_graph(chunk(spark, "上城区《城市更新条例》"), responses)
    # a reply that still is no JSON sends the chunk to the rules, which find the policy as well
    assert len(nodes.collect()) == (2 if wrapped.endswith("x") else 1)


def test_rules_step_in_for_a_reply_without_json(spark):
    text = "《未来城市总体规划》提出建设滨江新区和轨道交通，优化工业用地。打造高品质的生态空间体系。"
    responses = spark.createDataFrame([("c0", "sorry")], "chunk_id string, response string")
    entities, relations = ex.import_extract(chunk(spark, text), responses)
    kinds = {r.entity_type for r in entities.collect()}
    assert {"Policy", "District", "Infrastructure", "LandUse", "PolicyGoal"} <= kinds
    assert {r.predicate for r in relations.collect()} == {"AFFECTS", "HAS_GOAL"}


def test_document_graph(spark):
    first = json.dumps({"entities": [{"entity_name": "上城区", "entity_type": "District", "description": ""}, {"entity_name": "撤销上城区", "entity_type": "District"},
                                     {"entity_name": "推进更新", "entity_type": "PolicyMeasure"}, {"entity_name": "公园", "entity_type": "Park"}],
                        "relationships": [{"src": "推进更新", "tgt": "上城区", "type": "TARGETS"}, {"src": "推进更新", "tgt": "别处", "type": "TARGETS"},
                                          {"src": "推进更新", "tgt": "上城区", "type": "LIKES"}]}, ensure_ascii=False)
    second = json.dumps({"entities": [{"entity_name": "上城区", "entity_type": "SpatialConcept"}], "relationships": []}, ensure_ascii=False)
    responses = spark.createDataFrame([("c0", f"```json\n{first}\n```"), ("c1", second), ("c2", "broken {")], "chunk_id string, response string")
    nodes, edges = ex.build_document_graph(chunk(spark, "撤销上城区的公园", "上城区", "西湖区《城市更新条例》杭州东站"), responses)
    got = {(r.name, r.entity_type, r.source_id) for r in nodes.collect()}
    where = "policy.pdf_p1"
    assert got == {("上城区", "District", where), ("推进更新", "PolicyMeasure", where), ("西湖区", "District", where),
                   ("城市更新条例", "Policy", where), ("杭州东站", "Infrastructure", where)}
    assert [(r.src, r.keywords, r.tgt, r.description) for r in edges.collect()] == [("推进更新", "TARGETS", "上城区", "推进更新 TARGETS 上城区")]


def test_names_are_looked_up_once_per_text(spark):
    rows = spark.createDataFrame([(1, "ab cd", ["ab", "b c", "x", ""]), (2, None, ["a"]), (3, "", [])], "id int, content string, names array<string>")
    found = {r.id: r.found for r in rows.select("id", ex.names_in_text("content", "names").alias("found")).collect()}
    assert found == {1: [True, True, False, True], 2: None, 3: []}


def test_no_word_is_shuffled_to_its_document(spark):
    plan = texts.QUERIES["validate_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_relations_need_both_names_of_their_own_chunk(spark):
    accepted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "a"), (None, "b"), (1, None)], "chunk_id int, name string")
    raw = spark.createDataFrame(
        [(c, n, s, t, k, "", None) for n, (c, s, t, k) in enumerate([
            (1, "a", "b", "PART_OF"), (1, " b ", "a", "TARGETS"), (1, "a", "c", "PART_OF"), (2, "a", "b", "PART_OF"), (2, "c", "c", "PART_OF"),
            (None, "a", "b", "PART_OF"), (1, "a", None, "PART_OF"), (1, "a", "b", "ELSE")])],
        "chunk_id int, position int, src string, tgt string, type string, description string, weight double")
    found = ex.validate_relations(raw, accepted)
    assert sorted((r.chunk_id, r.position, r.src, r.tgt, r.weight) for r in found.collect()) == [(1, 0, "a", "b", 1.0), (1, 1, "b", "a", 1.0), (2, 4, "c", "c", 1.0)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_only_short_chunks_and_those_before_them_are_folded(spark, monkeypatch, hot_rows):
    import random
    rng, folded, numbered = random.Random(5), [], ch.numbered_groups
    monkeypatch.setattr(ch, "numbered_groups", lambda rows, *a: folded.append(rows.count()) or numbered(rows, *a))
    rows = [(doc, "s", n // 9, n, "x" * rng.choice([2, 5, 8, 30, 40, 41, 55]), ["h"] if n % 17 < 12 else ["h", "i"]) for doc in range(4) for n in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id int, source string, page int, chunk_index int, content string, heading_path array<string>")
    got = ch.merge_tiny(chunks, 10, 60, hot_rows=hot_rows)
    want = []
    for before, row in zip([None, *rows], rows):
        if before and before[0] == row[0] and before[5] == row[5] and len(row[4]) < 10 and len(want[-1][4]) + len(row[4]) <= 60:
            want[-1][4] += "\n" + row[4]
        else:
            want.append(list(row))
    assert sorted(map(list, got.select("doc_id", "source", "page", "chunk_index", "content", "heading_path").collect())) == sorted(want)
    assert folded[0] < len(rows)


def test_font_sizes_meet_lengths_not_texts(spark):
    lines = spark.createDataFrame([(1, "s", n, "text" * n, 11.0 + n % 2, n % 3 == 0, 1) for n in range(9)],
                                  "doc_id int, source string, line_no int, text string, size double, bold boolean, page int")
    plan = ch.font_stats(lines)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "length(text" in joined  # below the join


def test_relations_that_lie_by_chunk_are_not_shuffled_again(spark):
    from pyspark.sql import Window, functions as F
    from tidemark.operators import extract as ex
    words = [(c, n, f"w{n % 4}") for c in (1, 2) for n in range(8)] + [(None, n, f"w{n}") for n in range(4)]
    rows = spark.createDataFrame(words + words[:3], "chunk_id int, position int, src string")
    following = F.lead("src").over(Window.partitionBy("chunk_id").orderBy("position"))
    raw = rows.select("chunk_id", "position", "src", following.alias("tgt"), F.when(F.col("position") != 5, "TARGETS").alias("type"),
                      F.when(F.col("position") == 0, " ").otherwise("d").alias("description"), F.lit(None).cast("double").alias("weight"))
    accepted = spark.createDataFrame([(1, "w0"), (1, "w1"), (1, "w1"), (2, "w2"), (2, "w3"), (3, "w0"), (1, None), (None, "w0"), (None, "w1")], "chunk_id int, name string")
    found = ex.validate_relations(raw, accepted)
    got = sorted((r.chunk_id, r.position, r.src, r.tgt, r.predicate, r.description, r.weight) for r in found.collect())
    # chunk 1 has its first three words twice
    assert got == [(1, 0, "w0", "w0", "TARGETS", "w0 TARGETS w0", 1.0), (1, 0, "w0", "w1", "TARGETS", "w0 TARGETS w1", 1.0),
                   (1, 1, "w1", "w1", "TARGETS", "d", 1.0), (1, 4, "w0", "w1", "TARGETS", "d", 1.0),
                   (2, 2, "w2", "w3", "TARGETS", "d", 1.0), (2, 6, "w2", "w3", "TARGETS", "d", 1.0)]
    plan = ex.validate_relations(raw, accepted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk_id") == 2 and "REPARTITION" not in plan
