"""Pseudonyms and licences: exact round trips, known cases, plans without Python."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licences, pii
from tidemark.llm.common import table

TEXTS = [
    "Write to ab.34@mail7.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 and 5927243074273351!! ip 233.254.104.120.",
    "born 1985-03-07, 07.03.1985 03/07/1985 1985/02/28 ssn 123-45-6789", "not: 1985/02/30 000-12-1234 999.1.1.1 1.2.3.4.5 12 4.0 2020", None, "",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ab.34@mail7.example.com 4111111111111111', "+44 (020) 123-4567 then x.y@z.org",
    "a" * 200_000 + " 233.254.104.120 " + "1" * 100_000, "AB@CD.EF ab@cd.ef"]
SCHEMA = "doc_id long, text string, kinds string, n_chars long"


def rows(spark, texts):
    return spark.createDataFrame([(None if i == 6 else i // 2, t, "k", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_round_trip_and_links(spark):
    docs = rows(spark, TEXTS)
    done = pii.pseudonymise(docs)
    back = pii.pseudonymise(done, decrypt=True)
    assert sorted((r.text for r in back.collect()), key=str) == sorted(TEXTS, key=str)
    texts = [r.text for r in done.collect() if r.text]
    mails = [m for t in texts for m in re.findall(r"\S+\.\d\d@\S+\.com", t)]
    assert len(mails) == 2 and len(set(mails)) == 1 and "ab.34@mail7.example.com" not in mails
    cards = [m for t in texts for m in re.findall(r"(?<!\d)(?:\d{4} ){3}\d{4}|(?<![\d])\d{16}(?!\d)", t)]
    assert sorted(luhn(c) for c in cards) == [False, True, True]
    other = pii.pseudonymise(docs, key="another")
    assert {r.text for r in other.collect()} != {r.text for r in done.collect()}


def test_formats_stay(spark):
    done = {r.doc_id: r for r in pii.pseudonymise(rows(spark, TEXTS[:2] + TEXTS[1:2])).collect() if r.text.startswith("born")}
    text = next(iter(done.values())).text
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4} \d\d/\d\d/\d{4} \d{4}/\d\d/\d\d ssn \d{3}-\d\d-\d{4}", text)
    assert text != TEXTS[1]
    assert [r.text for r in pii.pseudonymise(rows(spark, TEXTS[2:3])).collect()] == TEXTS[2:3]


def test_permutations_have_no_collisions(spark):
    numbers = spark.range(3000).select("id", F.format_string("1990-01-%02d %03d-55-%04d 10.0.%d.%d", F.col("id") % 28 + 1, F.col("id") % 600 + 1,
                                                             F.col("id") + 1, F.floor(F.col("id") / 256), F.col("id") % 256).alias("text"))
    found = [r.text.split() for r in pii.pseudonymise(numbers, "id").collect()]
    assert len({f[0] for f in found}) == 28
    assert len({f[1] for f in found}) == 3000 and len({f[2] for f in found}) == 3000


def test_whole_table_keeps_no_value(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pattern = re.compile(r"[a-z]+\.\d+@\S+\.com|(?<!\d)\d{16}(?!\d)|\d+\.\d+\.\d+\.\d+|\+1 \(\d{3}\) \d{3}-\d{4}")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = pii.replace_personal(docs)
    assert kept.columns == docs.columns
    found = 0
    for r in kept.collect():
        values = pattern.findall(before[r.doc_id])
        found += len(values)
        assert not [v for v in values if v in r.text]
        assert r.n_chars == len(r.text)
        if not re.search(r"[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert found > 30


def test_pii_has_no_python_and_no_shuffle(spark, capsys):
    pii.pseudonymise(table(spark, "/root/testdata/sf0.001", "documents")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_licence_lines(spark, model):
    texts = ["Some text.\nReleased under the MIT License.\nMore text here.", "x licensed under CC BY-NC 4.0. y", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.",
             "The driving license was issued in May.", None, "", "Licensed under the Apache License, Version 2.0.\n\nReleased under the BSD 3-Clause License.",
             "word " * 60_000 + "\nLicensed under the MIT License."]
    docs = spark.createDataFrame([(None if i == 1 else i, t, "g", 1) for i, t in enumerate(texts)], "doc_id long, text string, grams string, row int")
    found = {r.doc_id: (r.n_licence, r.families) for r in licences.scan(docs, model).collect()}
    assert found == {0: (1, "MIT"), None: (1, "CC-BY-NC-4.0"), 2: (1, "GPL-3.0"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (2, "Apache-2.0,BSD"), 7: (1, "MIT")}
    twice = docs.union(docs.where("doc_id = 0"))
    assert licences.scan(twice, model).count() == len(texts) + 1
    assert licences.scan(docs.where("false"), model).count() == 0


def test_scores_equal_plain_scoring(spark, model):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = set()
    for r in docs.collect():
        for n, line in enumerate(r.text.split("\n")):
            chances = model.chances(line)[:-1]
            if chances.max() >= 0.5:
                want.add((r.doc_id, n, licences.FAMILIES[int(chances.argmax())], round(float(chances.max()), 6)))
    found = licences.licence_paragraphs(docs, model).collect()
    assert {(r.doc_id, r.paragraph, r.family, round(r.chance, 6)) for r in found} == want and want


def test_all_lines_with_notices_are_found(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: r.families for r in licences.scan(docs, model).collect()}
    signs = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General Public License": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    for r in docs.collect():
        assert found[r.doc_id] == ",".join(sorted(f for s, f in signs.items() if s.lower() in r.text.lower()))


def test_held_out_variants():
    model = licences.fit_model(["plain words of a text about nothing", "one more line with the and of"], seed=3)
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            chances = model.chances(f"see below {text} and so on")
            assert licences.FAMILIES[int(chances[:-1].argmax())] == family and chances[:-1].max() > 0.5
    for text in licences.STRANGERS:
        assert model.chances("well " + text)[-1] > 0.5


def test_licence_plan_has_no_python(spark, model, capsys):
    licences.scan(table(spark, "/root/testdata/sf0.001", "documents"), model).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
