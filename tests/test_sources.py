"""Readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from seriesloom.plans.extract import extract_features
from seriesloom.session import scratch_path
from seriesloom.sources import inventory, nested_json, tables, tags


def write(path, text):
    path.write_text(text)
    return str(path)


def test_delimited_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'echo time,b\n 1 ,""\n,"x ""y"", z"\n3,4,5\n6\n')
    df = tables.scan_delimited(spark, path)
    assert df.columns == ["echo_time", "b"]
    found = sorted((r.echo_time or "~", r.b) for r in df.collect())
    assert found == sorted([(" 1 ", ""), ("~", 'x "y", z'), ("3", "4"), ("6", None)], key=lambda t: t[0])


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.xlsx")
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), "x.xlsx")


def test_read_any_refuses_other_schemas(spark, tmp_path):
    a = write(tmp_path / "a.csv", "study_uid,x\n1,2\n")
    b = write(tmp_path / "b.csv", "study_uid,y\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_any(spark, [a, b], keys=None)


def test_nested_json_whole_file(spark, tmp_path):
    document = {"p": {"st": {"s": {"te": [1, None, "x"], "path": "/a", "study_uid": ["no"]}, "empty": {"te": []}}}}
    path = write(tmp_path / "a.json", json.dumps(document, indent=1))
    df = nested_json.scan_nested_json(spark, path, whole_file=True)
    assert df.columns == ["patient_id", "study_uid", "series_uid", "path", "te"]
    assert [(r.series_uid, r.path, r.te) for r in df.collect()] == [("s", "/a", v) for v in ("1", None, "x")]


def test_hot_series_is_written_in_several_documents(spark):
    rows = spark.range(500).select(
        F.lit("p").alias("patient_id"),
        F.lit("st").alias("study_uid"),
        F.lit("s").alias("series_uid"),
        F.col("id").cast("string").alias("te"),
        F.col("id"),
    )
    documents = nested_json.to_documents(rows, ["te"], "id", instances_per_document=100)
    assert documents.count() == 5
    back = nested_json.explode_documents(documents, "document")
    assert sorted(int(r.te) for r in back.collect()) == list(range(500))


def test_parts_of_a_series_keep_its_order(spark):
    rows = spark.range(500).select(
        F.lit("p").alias("patient_id"),
        F.lit("st").alias("study_uid"),
        F.when(F.col("id") < 450, "hot").otherwise("small").alias("series_uid"),
        F.col("id").cast("string").alias("te"),
        F.col("id"),
    )
    documents = nested_json.to_documents(rows.repartition(7), ["te"], "id", instances_per_document=100)
    values, places, sizes = {}, {}, []
    for r in documents.collect():
        for series, cells in json.loads(r.document)["p"]["st"].items():
            assert all(isinstance(v, list) for v in cells.values())  # a reader may append any of them
            sizes.append(len(cells["te"]))
            values.setdefault(series, []).extend(cells["te"])
            places.setdefault(series, []).extend(cells["#at"])
    assert sorted(sizes) == [50, 90, 90, 90, 90, 90]
    joined = {s: [v for _, v in sorted(zip(places[s], values[s]))] for s in values}
    assert joined == {"hot": [str(i) for i in range(450)], "small": [str(i) for i in range(450, 500)]}
    back = nested_json.explode_documents(documents, "document", position="at")
    assert back.columns == ["patient_id", "study_uid", "series_uid", "te", "at"]
    assert all(int(r.te) == r["at"] + (450 if r.series_uid == "small" else 0) for r in back.collect())


def test_tag_documents(spark):
    web = json.dumps(
        {"00080008": {"vr": "CS", "Value": ["ORIGINAL", "PRIMARY", 0.5]}, "00180081": {"vr": "DS"}, "zz": {"Value": [{}]}}
    )
    archive = json.dumps({"0008,103e": {"Value": "a\\b"}, "0019,100C": {"Value": "50"}, "0018,0081": {"Value": None}})
    df = spark.createDataFrame([(web, archive)], "web string, archive string")
    row = tags.flatten_tags_web(df, "web").first()
    assert (row.image_type, row.echo_time, row.modality) == ("ORIGINAL PRIMARY 0.5", "-", "-")
    row = tags.flatten_tags_archive(df, "archive").first()
    assert (row.series_description, row.diffusion_bvalue_siemens, row.echo_time) == ("a b", "50", "-")


def test_group_map(spark, tmp_path):
    path = write(tmp_path / "g.json", json.dumps({"a": "site1", "b": "site2"}, indent=1))
    assert sorted(tuple(r) for r in nested_json.scan_group_map(spark, path).collect()) == [("a", "site1"), ("b", "site2")]


def test_inventory(spark, tmp_path):
    for study, series, name in [("st", "s1", "a.dcm"), ("st", "s1", "b.dcm"), ("st", "s2", "c.dcm"), ("st", "s2", "d.txt")]:
        folder = tmp_path / study / series
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("x")
    files = inventory.scan_series_inventory(spark, str(tmp_path), "*dcm").collect()
    found = sorted((r.study_uid, r.series_uid, r.file_name, r.number_of_images) for r in files)
    assert found == [("st", "s1", "a.dcm", 2), ("st", "s1", "b.dcm", 2), ("st", "s2", "c.dcm", 1)]


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    if base:
        assert path.startswith(base.rstrip("/"))


def test_extraction_takes_ge_bvalue_and_drops_segmentations(spark):
    body = {"00431039": {"Value": [1000000050, 8, 0]}, "0008103E": {"Value": ["t2 1/2/2020"]}}
    image = json.dumps({**body, "00080016": {"Value": ["1.2.3"]}})
    seg = json.dumps({**body, "00080016": {"Value": ["1.2.840.10008.5.1.4.1.1.66.4"]}})
    df = spark.createDataFrame([(1, image), (2, seg), (3, json.dumps(body))], "i int, tags string")
    rows = extract_features(df, keep=("i",)).collect()
    assert [(r.i, r.diffusion_bvalue_final, r.series_description) for r in rows] == [(1, "50", "t2 ")]


def test_documents_take_only_their_columns_through_the_shuffle(spark, monkeypatch):
    written = []
    plain = nested_json.materialise
    monkeypatch.setattr(nested_json, "materialise", lambda df, name: written.append(df.columns) or plain(df, name))
    rows = spark.createDataFrame([("p", "s", "e", 1, "x", "y")], "patient_id string, study_uid string, series_uid string, id int, TE string, other string")
    (row,) = nested_json.to_documents(rows, ["te"], "id").collect()
    assert json.loads(row.document) == {"p": {"s": {"e": {"#at": [0], "te": ["x"]}}}}
    assert written == [["patient_id", "study_uid", "series_uid", "id", "TE", "_range"]]
