"""Groups of greedy folds, numbered block by block, against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators.folds import filling, joining, numbered_groups
from tidemark.session import written

SETTING = "spark.sql.shuffle.partitions"


def loop(values, kind, size, least=0):
    numbers, number, held = [], -1, None
    for v in values:
        if kind == "filling":
            if held is None or held >= size:
                number, held = number + 1, 0
            held += v
        elif held is None or v >= least or held + v > size:
            number, held = number + 1, v
        else:
            held += 1 + v
        numbers.append(number)
    return numbers


@pytest.mark.parametrize("kind", ["filling", "joining"])
@pytest.mark.parametrize("parts", [1, 13])
def test_numbers_equal_a_loop(spark, kind, parts, monkeypatch):
    """One key goes through many blocks, others begin and end within one."""
    rng = random.Random(parts)
    keys = {("a", 1): 5, ("a", 2): 3000, ("b", 0): 1, ("c", 7): 40, ("d", 1): 900}
    values = {k: [rng.choice((0, 1, 3, 12, 25, 70)) for _ in range(n)] for k, n in keys.items()}
    rows = [(*k, n, v) for k, vs in values.items() for n, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, section long, line int, chars int")
    fold = filling(60) if kind == "filling" else joining(20, 60)
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, str(parts))
    try:
        # few bytes: keep the optimizer from putting all in one block
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = numbered_groups(df, ["doc", "section"], ["line"], "chars", fold, "number")
        got = {(r.doc, r.section, r.line): r.number for r in found.collect()}
    finally:
        spark.conf.set(SETTING, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(*k, n): x for k, vs in values.items() for n, x in enumerate(loop(vs, kind, 60, 20))}


def test_a_long_section_is_spread_over_blocks(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(folds, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    lines = spark.range(200_000).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("line"), (F.col("id") % 7).cast("int").alias("chars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered_groups(lines, ["doc"], ["line"], "chars", filling(50), "number")
        want = loop([n % 7 for n in range(200_000)], "filling", 50)
        assert [r.number for r in found.orderBy("line").select("number").collect()] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept["fold-blocks"].groupBy("_block").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 200_000 / len(sizes) * 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc int, line int, chars int")
    assert numbered_groups(none, ["doc"], ["line"], "chars", filling(5), "number").isEmpty()
