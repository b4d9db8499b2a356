import json

import pytest

from quirework.operators import nested

CANVAS = {"id": "c", "label": {"en": ["a", None, ""], "none": "b"}, "items": [None, {"items": [None, {"body": [{"id": "i0"}, "i1", {"@id": "i2"}]}, {"body": {"type": "Choice", "items": [{"id": "j", "service": [{"id": "no"}]}]}}, {"body": {"type": "TextualBody", "id": "t"}}]}], "thumbnail": [{"id": "no"}], "annotations": [{"items": [{"body": {"id": "no"}}]}]}
WHOLE = {"type": "Manifest", "items": [None, CANVAS, {"@id": "d", "label": "x"}, {"id": 5, "label": ["p", "q"]}, "word", {}]}
ROWS = {
    (1, "canvas", -1, -1, -1, "", "c"), (1, "label", -1, 0, -1, "en", "a"), (1, "label", -1, 0, -1, "none", "b"),
    (1, "body", 1, 1, 0, "", "i0"), (1, "body", 1, 1, 1, "", "i1"), (1, "body", 1, 1, 2, "", "i2"), (1, "body", 1, 2, 0, "", "j"),
    (2, "canvas", -1, -1, -1, "", "d"), (2, "label", -1, 0, -1, "", "x"), (3, "label", -1, 0, -1, "", "p"), (3, "label", -1, 1, -1, "", "q"),
}
TEXT = json.dumps(WHOLE)


@pytest.mark.parametrize("text", [TEXT, f" \n{TEXT} ", f"[{TEXT}]", json.dumps(TEXT), json.dumps(f"[{TEXT}]"), json.dumps([TEXT])])
def test_every_form_gives_the_rows(spark, text):
    got = nested.manifest_rows(spark.createDataFrame([(7, text)], "raw_id long, manifest string")).collect()
    assert {tuple(r)[1:] for r in got} == ROWS and len(got) == len(ROWS)


@pytest.mark.parametrize("text", [None, "", "  ", "null", "5", '"x"', "[]", TEXT[:-1], TEXT + " x", TEXT + TEXT, TEXT + "]", TEXT + "}", f"[{TEXT}, {TEXT}]", '{"items": null}', '{"items": {}}', "<html>", "'a'"])
def test_other_texts_give_none(spark, text):
    assert nested.manifest_rows(spark.createDataFrame([(7, text)], "raw_id long, manifest string")).collect() == []


def test_tables_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(7, TEXT, "a", 1), (7, TEXT, "b", 2), (None, TEXT, "c", 3)], "raw_id long, manifest string, items string, val int")
    assert {(r["canvas_index"], r["canvas_id"]) for r in nested.canvases(rows).where("raw_id = 7").collect()} == {(1, "c"), (2, "d")}
    assert nested.labels(rows).where("raw_id = 7").count() == 5 and nested.bodies(rows).where("raw_id = 7").count() == 4
    assert nested.canvases(rows).count() == 4
    assert nested.manifest_rows(rows.limit(0)).collect() == []


def test_repeated_keys_and_refused_records(spark):
    twice = '{"items": [], "items": [{"id": "c1", "id": "c2", "label": {"en": "a", "en": ["b"]}}]}'
    rows = spark.createDataFrame([(1, twice), (2, None), (2, " \n"), (2, ""), (3, "{"), (3, TEXT + " x"), (4, "5"), (4, json.dumps("{")), (5, TEXT), (None, "[1]")], "raw_id long, manifest string")
    assert {tuple(r)[1:] for r in nested.manifest_rows(rows.where("raw_id = 1")).collect()} == {(0, "canvas", -1, -1, -1, "", "c2"), (0, "label", -1, 0, -1, "en", "b")}
    assert {tuple(r) for r in nested.refused(rows).collect()} == {(2, "empty", 3), (3, "unreadable", 2), (4, "no manifest", 2), (None, "no manifest", 1)}
    assert nested.refused(rows.limit(0)).collect() == []


def test_long_manifest(spark):
    many = json.dumps({"items": [{"id": f"c{i}", "label": "x" * 1000} for i in range(2000)]})
    assert nested.manifest_rows(spark.createDataFrame([(1, many)], "raw_id long, manifest string")).count() == 4000
