"""Text helpers as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocab


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text, words) -> Column:
    return any_of(_c(text).contains(w) for w in words)


def hit_count(text, words) -> Column:
    """How many of ``words`` occur in the text."""
    return reduce(lambda a, b: a + b,
                  (F.when(_c(text).contains(w), 1).otherwise(0) for w in words), F.lit(0))


def strip(text) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+\z", "")


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def clean_text(text) -> Column:
    """Null to '', whitespace runs to one blank, quotes and CJK marks off both ends."""
    collapsed = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", " ")
    return F.btrim(collapsed, F.lit(" \t\r\n\"'`，。；;：:"))


def _alias_key(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))


def normalize_entity_type(text, aliases: dict[str, str] = vocab.ENTITY_TYPE_ALIASES) -> Column:
    cleaned, table = clean_text(text), literal_map(aliases)
    return F.coalesce(F.try_element_at(table, _alias_key(cleaned)),
                      F.try_element_at(table, cleaned),
                      F.nullif(cleaned, F.lit("")), F.lit("Unknown"))


def normalize_relation_type(text, aliases: dict[str, str] = vocab.RELATION_TYPE_ALIASES) -> Column:
    cleaned, table = clean_text(text), literal_map(aliases)
    fallback = F.upper(F.btrim(F.regexp_replace(cleaned, r"[^A-Za-z0-9_一-鿿]+", "_"), F.lit("_")))
    return F.coalesce(F.try_element_at(table, _alias_key(cleaned)),
                      F.try_element_at(table, cleaned),
                      F.when(cleaned == "", F.lit("RELATED")).otherwise(fallback))


def predicate_of(keywords) -> Column:
    """The first comma token of an edge's keywords."""
    return F.trim(F.substring_index(F.coalesce(_c(keywords), F.lit("")), ",", 1))


def land_use_code(description) -> Column:
    code = F.regexp_extract(_c(description), r"(?U)用地:([A-Za-z]\w*)", 1)
    return F.when(code == "", F.lit("unknown")).otherwise(code)


def point_description() -> Column:
    """One line of ``label:value`` fields, in fixed order, empty ones left out."""
    def labelled(pairs):
        return [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}:"), F.col(c)))
                for c, label in pairs]

    parts = labelled(vocab.POINT_PLACE_FIELDS)
    parts.append(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(),
                        F.format_string("经纬度:(%.4f,%.4f)", "lon", "lat")))
    parts += labelled(vocab.POINT_USE_FIELDS)
    parts += labelled((("development_stage", "阶段"),))
    parts.append(F.when(F.col("population_served") != 0,
                        F.format_string("服务人口:%d", "population_served")))
    parts.append(F.when(F.col("entry_year") != 0, F.format_string("首次出现:%d年", "entry_year")))
    parts += labelled((("change_reason", "变化原因"),))
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", F.lit(vocab.DEFAULT_POINT_TEXT)).otherwise(joined)


def extract_topics(text, city_pattern: str = vocab.CITY_PATTERN, domain=vocab.DOMAIN_TOPICS,
                   whole_names: bool = False) -> Column:
    """City hits in text order, then domain words in list order, each once.

    By default a listed city counts as its single characters and a region hit as nothing:
    that is what the original behaviour comes down to. ``whole_names`` gives whole hits."""
    text = F.coalesce(_c(text), F.lit(""))
    if whole_names:
        hits = F.regexp_extract_all(text, F.lit(city_pattern), F.lit(0))
    else:
        hits = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(city_pattern), F.lit(1)),
                                     lambda h: F.split(h, "")))
    words = F.filter(F.array(*[F.lit(w) for w in domain]), lambda w: F.contains(text, w))
    return F.array_distinct(F.filter(F.concat(hits, words), lambda t: t != ""))


def normalize_question(text) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"(?U)\s+", ""))


def question_hash(text) -> Column:
    return F.substring(F.md5(F.encode(_c(text), "UTF-8")), 1, 12)


def chunk_id(source, page, index, content) -> Column:
    return F.concat_ws("_", _c(source), _c(page).cast("string"), _c(index).cast("string"),
                       F.substring(F.md5(F.encode(_c(content), "UTF-8")), 1, 8))


def keywords(text) -> Column:
    """Words longer than one character: runs of letters and digits, and CJK bigrams."""
    text = _c(text)
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_&&[^一-鿿]]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda run: F.transform(
        F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))))
    return F.concat(words, pairs)


def heading_level(text, size=None, bold=None, body=None, use_font=None) -> Column:
    """0 for body text; numbering first, then (where trusted) font size and bold."""
    text = _c(text)
    level = F.when(F.length(text) > 40, F.lit(0))
    for pattern, value in vocab.HEADING_PATTERNS:
        level = level.when(text.rlike("(?U)" + pattern), F.lit(value))
    if size is not None:
        trusted = F.lit(True) if use_font is None else _c(use_font)
        level = level.when(trusted & (_c(body) > 0) & (_c(size) >= _c(body) * 1.4), F.lit(1))
        level = level.when(trusted & _c(bold) & (F.length(text) <= 30), F.lit(2))
    return level.otherwise(F.lit(0))


def safe_name(text, default: str = "document") -> Column:
    """Letters, digits, '-' and '_' stay; the rest becomes '_', trimmed off the ends."""
    kept = F.btrim(F.regexp_replace(_c(text), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit(default)).otherwise(kept)


def safe_stem(path, default: str = "document") -> Column:
    """``safe_name`` of a file name without folder and last suffix."""
    name = F.regexp_replace(_c(path), r"^.*/", "")
    return safe_name(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""), default)


def safe_tenant(text) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\p{L}\p{N}_-]", "")


def duration_years(start, end) -> Column:
    return F.datediff(_c(end), _c(start)) / F.lit(365.25)


def change_rate(change, previous) -> Column:
    return F.when(_c(previous) == 0, F.lit(0.0)).otherwise(_c(change) / F.nullif(_c(previous), F.lit(0.0)))


def split_answer_evidence(raw) -> Column:
    """struct<answer, evidence array<struct<id,text>>>.

    With an ``[evidence]`` section its lines are the evidence; without one (or with an
    empty one) the sorted distinct ids cited in the text stand in."""
    raw = F.coalesce(_c(raw), F.lit(""))
    position = F.instr(raw, "[evidence]")
    head = F.substring_index(raw, "[evidence]", 1)
    tail = F.when(position > 0, F.substr(raw, position + 10)).otherwise(F.lit(""))
    lines = F.filter(F.transform(F.split(tail, r"\r\n|\n|\r"), strip),
                     lambda s: (s.startswith("[E") | s.startswith("[D")) & s.contains("]"))
    listed = F.filter(F.transform(lines, lambda s: F.struct(
        F.substr(F.substring_index(s, "]", 1), F.lit(2)).alias("id"),
        strip(F.substr(s, F.instr(s, "]") + 1)).alias("text"))), lambda e: e.text != "")
    cited = F.array_sort(F.array_distinct(
        F.regexp_extract_all(raw, F.lit(r"\[([ED]\d+)\]"), F.lit(1))))
    cited = F.transform(cited, lambda i: F.struct(
        i.alias("id"), F.concat(F.lit("(SubAgent 引用 "), i, F.lit(")")).alias("text")))

    def answer(part):
        return strip(F.replace(part, F.lit("[answer]"), F.lit("")))
    return (F.when(F.size(listed) > 0, F.struct(answer(head).alias("answer"), listed.alias("evidence")))
            .otherwise(F.struct(answer(raw).alias("answer"), cited.alias("evidence"))))


def sentences(text, marks: str = vocab.SENTENCE_MARKS) -> Column:
    """Cut behind each closing mark; the mark stays with its sentence."""
    return F.filter(F.split(_c(text), f"(?<=[{marks}])"), lambda s: s != "")


# -- predicates -------------------------------------------------------------------

def reject_reason(name, content, verbs=vocab.VERB_PREFIXES, connectives=vocab.CONNECTIVES, in_text=None) -> Column:
    """'' for a usable entity name, else the first reason against it. ``in_text`` says whether the content has the name, if
    that is known."""
    name = F.coalesce(_c(name), F.lit(""))
    found = F.contains(_c(content), name) if in_text is None else _c(in_text)
    return (F.when(F.length(name) < 2, "too short")
            .when(F.length(name) > 50, "too long")
            .when(~found, "not in source text")
            .when(any_of(name.startswith(v) for v in verbs), "starts with verb")
            .when(contains_any(name, connectives), "contains connective")
            .otherwise(""))


def valid_entity(name, content, **vocabulary) -> Column:
    return reject_reason(name, content, **vocabulary) == ""


def usable_description(text, words=vocab.CAPTION_WORDS, rejects=vocab.CAPTION_REJECTS,
                       min_length: int = 30, min_hits: int = 2) -> Column:
    text = strip(F.coalesce(_c(text), F.lit("")))
    return ((F.length(text) >= min_length) & ~contains_any(text, rejects)
            & (hit_count(text, words) >= min_hits))


def keep_image(width="width", height="height", y0="y0", y1="y1", page_height="page_height",
               min_area: int = 10000, max_ratio: float = 30, margin: float = 0.08) -> Column:
    """False for specks, lines and pictures wholly inside the top or bottom margin."""
    w, h, top, bottom, page = _c(width), _c(height), _c(y0), _c(y1), _c(page_height)
    too_small = w * h < min_area
    too_long = ((h > 0) & (w > h * max_ratio)) | ((w > 0) & (h > w * max_ratio))
    in_margin = F.coalesce((page > 0) & top.isNotNull() & bottom.isNotNull()
                           & ((bottom < page * margin) | (top > page * (1 - margin))), F.lit(False))
    return ~(too_small | too_long | in_margin)


def answer_status(text, hard=vocab.HARD_FAIL_PHRASES, soft=vocab.SOFT_FAIL_PHRASES) -> Column:
    text = strip(F.coalesce(_c(text), F.lit("")))
    bad = ((F.length(text) < 20) | contains_any(text, hard)
           | ((F.length(text) < 200) & contains_any(text, soft)))
    return F.when(bad, "degraded").otherwise("done")


def error_class(error, is_timeout=None, words=vocab.TRANSIENT_ERROR_WORDS) -> Column:
    kind = F.when(F.lit(False) if is_timeout is None else _c(is_timeout), "timeout")
    return kind.when(contains_any(F.lower(_c(error)), words), "transient").otherwise("permanent")


def is_report_request(question, phrases=vocab.REPORT_PHRASES) -> Column:
    return contains_any(question, phrases)


def is_entry(event_type="event_type") -> Column:
    return _c(event_type) == "entry"


def is_exit(event_type="event_type") -> Column:
    return _c(event_type) == "exit"


def involves_expansion(event_type="event_type") -> Column:
    return _c(event_type).isin("entry", "expansion", "merger")
