"""Rows with NULL keys and unreadable cells keep their place."""

import json

import pytest

from seriesloom import session
from seriesloom.operators.summarise import count_instances, summarise
from seriesloom.sources.nested_json import to_documents

ROWS = [(None, "st", "se", 1, "24.0", "-"), (None, "st", "se", 2, "26", "2.5"), ("p", "st", None, 3, "x", ""), ("p", "st", "se", 4, None, "nan")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        ROWS, "patient_id string, study_uid string, series_uid string, nr int, number_of_images string, image_mean string"
    )


def test_counts_keep_rows_with_null_keys(table):
    counted = count_instances(table.drop("number_of_images"), ("patient_id", "study_uid", "series_uid"))
    assert sorted((r.nr, r.number_of_images) for r in counted.collect()) == [(1, 2), (2, 2), (3, 1), (4, 1)]


def test_unreadable_numbers_are_missing(table):
    got = {(r.patient_id, r.series_uid): (r.number_of_images, r.image_mean) for r in summarise(table).collect()}
    assert got[(None, "se")] == (25.0, 2.5)
    assert got[("p", None)] == (None, None)


def test_documents_keep_rows_with_null_keys(table):
    found = [json.loads(r.document) for r in to_documents(table, ["number_of_images"], "nr").collect()]
    cells = [v for d in found for p in d.values() for s in p.values() for e in s.values() for v in e["number_of_images"]]
    assert sorted(map(str, cells)) == ["24.0", "26", "None", "x"]


def test_scratch_scope_deletes_its_tables(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(session, "scratch_base", lambda _: str(tmp_path))
    with session.scratch_scope(spark):
        assert session.materialise(spark.range(5)).count() == 5
        assert len(os.listdir(tmp_path / "seriesloom")) == 1
    assert os.listdir(tmp_path / "seriesloom") == []


def test_scratch_folder_of_a_cluster_must_be_shared():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="share"):
        session.scratch_base(Bare)
    Bare.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs:///check/")
    assert session.scratch_base(Bare) == "hdfs:///check"
