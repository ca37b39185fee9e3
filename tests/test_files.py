"""Documents of a bounded number of items, whatever the size of a nation."""

import hashlib
import json
from pathlib import Path
from urllib.parse import urlparse

import pytest

from tests.oracle import compare, connect
from tidemark.plans import files

FOLDER = "/root/testdata/sf0.001"
FORMS = ["year_points_files", "geojson_files", "separated_files", "membership_files", "policy_files"]


@pytest.mark.parametrize("name", FORMS)
def test_documents_are_bounded(spark, monkeypatch, name):
    paths, folder = [], files._folder
    monkeypatch.setattr(files, "ITEMS", 3, raising=False)
    monkeypatch.setattr(files, "_folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    assert not compare(spark, connect(FOLDER), FOLDER, files.QUERIES[name], files.ORACLES[name])
    sizes = []
    for path in paths:
        for file in Path(urlparse(path).path).rglob("part-*"):
            docs = json.loads(file.read_text())
            docs = docs if isinstance(docs, list) else [docs]
            assert len(docs) <= 10
            sizes += [sum(len(d.get(k) or ()) for k in ("point_info", "features", "points", "goals", "measures")) for d in docs]
    assert sizes and max(sizes) == 3


def test_texts_lie_in_hashed_folders(spark, monkeypatch):
    paths, folder = [], files._folder
    monkeypatch.setattr(files, "_folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    assert not compare(spark, connect(FOLDER), FOLDER, files.QUERIES["text_files"], files.ORACLES["text_files"])
    top = [p for p in Path(urlparse(paths[0]).path).iterdir() if p.is_dir()]
    assert 1 < len(top) <= files.FOLDERS


def test_texts_share_files(spark, monkeypatch, tmp_path):
    """Texts with any line ends, empty ones and pieces of the boundary come back whole from at most one file per folder."""
    paths, folder = [], files._folder
    monkeypatch.setattr(files, "_folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    texts = ["a\n", "", "\n\nb\r\nc\r", "\x1e", "7\n8\x1e\n", "x" * 200_000] * 100
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in files.QUERIES["text_files"](spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.md5(t.rstrip("\n").encode()).hexdigest() for n, t in enumerate(texts)}
    assert len(list(Path(urlparse(paths[0]).path).rglob("part-*.txt"))) <= files.FOLDERS


def test_sessions_share_files(spark, monkeypatch):
    paths, folder = [], files._folder
    monkeypatch.setattr(files, "_folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    assert not compare(spark, connect(FOLDER), FOLDER, files.QUERIES["session_files"], files.ORACLES["session_files"])
    parts = list(Path(urlparse(paths[0]).path).rglob("part-*.json"))
    sessions = sum(1 for file in parts for line in file.open())
    assert sessions > len(parts)


def test_points_of_geojson_are_read_as_numbers(spark, tmp_path, monkeypatch):
    """Shapes that are no points lie between them; JSON as text is read for the few boundaries alone."""
    from tidemark.sources import files as readers
    schemas, read = [], readers._json
    monkeypatch.setattr(readers, "_json", lambda spark, path, schema: schemas.append(schema) or read(spark, path, schema))
    ring = [[[0, 0], [4.5, 0], [4, 4], [0, 0]]]
    shapes = [("Point", [1, 2.5]), ("Polygon", ring), ("Point", [3e-1, -4, 9]), ("LineString", ring[0]), ("Point", [5]), ("Point", None), ("Point", [7, 8])]
    doc = {"type": "FeatureCollection", "years": [2001], "year_boundaries": {"2001": {"type": "Polygon", "coordinates": ring}},
           "features": [{"geometry": {"type": kind, "coordinates": at}, "properties": {"id": f"p{n}", "name": "x"}} for n, (kind, at) in enumerate(shapes)]}
    (tmp_path / "city.json").write_text(json.dumps(doc, indent=1))
    points, boundaries = readers.read_geojson(spark, str(tmp_path / "city.json"))
    assert [(r.point_id, r.lon, r.lat) for r in points.collect()] == [("p0", 1.0, 2.5), ("p2", 0.3, -4.0), ("p4", 5.0, None), ("p5", None, None), ("p6", 7.0, 8.0)]
    assert [(r.year, r.rings) for r in boundaries.collect()] == [(2001, [[[float(v) for v in at] for at in ring[0]]])]
    assert not any("coordinates:string" in s for s in schemas if "features" in s)
