import json
import zlib

import pytest
from pyspark.sql import functions as F

from quirework.operators import imaging
from quirework.sources import readers, sinks
from quirework.streaming import windows


def test_manifest_canvases(spark):
    body = {"id": "https://h/i/full/full/0/default.jpg"}
    doc = {"items": [{"id": "c0", "label": {"en": ["a", "b"]}, "items": [{"items": [{"body": body}]}]}, {"id": "c1"}, {"items": [{"items": [{"body": body}]}], "width": 7}]}
    rows = readers.manifest_canvases(spark.createDataFrame([(1, json.dumps(doc))], "raw_id long, manifest string")).orderBy("index").collect()
    assert [(r["index"], r["label"], r["canvas_id"], r["width"]) for r in rows] == [(0, "a b", "c0", 0), (2, "", "", 7)]
    assert rows[0]["derivative_url"] == "https://h/i/full/1800,/0/default.jpg"


def test_inventory(spark):
    html = '<div id="f1r" class="r-y a"></div><div class="r-y"></div><div id="x" class="q"></div><div id="f2v" class="b r-y"/><div id="f1r" class="r-y c">'
    found = readers.inventory_entries(spark.createDataFrame([(html,), (None,)], "html string"))
    assert [(r["folio"], r["site_class"], r["ord"]) for r in found.orderBy("ord").collect()] == [("f1r", "r-y a", 0), ("f2v", "b r-y", 1), ("f1r", "r-y c", 2)]
    assert {r["folio"]: r["site_class"] for r in readers.inventory_classes(found).collect()} == {"f1r": "r-y c", "f2v": "b r-y"}


def test_runtime(spark):
    text = json.dumps([[["dol", 1], ["qo"]], [[0, 1, 2, 3, 4], [5, 1.5, 2, 3, 4]]])
    labels, boxes = readers.runtime_boxes(spark.createDataFrame([("f1r", text)], "folio string, text string"))
    assert [(r["word_index"], r["eva"]) for r in labels.orderBy("word_index").collect()] == [(0, "dol"), (1, "qo")]
    assert [tuple(r) for r in boxes.orderBy("source_index").collect()] == [("f1r", 0, 0, 1.0, 2.0, 3.0, 4.0), ("f1r", 1, 5, 1.5, 2.0, 3.0, 4.0)]
    with pytest.raises(Exception, match="unexpected runtime structure"):
        readers.runtime_boxes(spark.createDataFrame([("f1r", "[1]")], "folio string, text string"))[0].collect()


def test_fetch_tries_again():
    calls, pauses = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        return b"x"

    assert readers.fetch("u", opener, 5, pauses.append, lambda: 0.0) == b"x" and pauses == [1.0, 1.5]
    with pytest.raises(OSError):
        readers.fetch("u", lambda u: (_ for _ in ()).throw(OSError()), 2, pauses.append)


def test_fetch_source(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"hello")
    spark.dataSource.register(readers.FetchSource)
    urls = [f"file://{tmp_path}/a", f"file://{tmp_path}/none"]
    got = {r["url"]: (r["content"], r["error"]) for r in spark.read.format("fetch").option("urls", json.dumps(urls)).option("attempts", 1).load().collect()}
    assert bytes(got[urls[0]][0]) == b"hello" and got[urls[1]][1]


def test_landing_fetches_what_is_missing(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name * 3)
    wanted = spark.createDataFrame([(x, f"file://{tmp_path}/{x}") for x in "aab"] + [(None, "file:///x")], "folio string, url string")
    folder = str(tmp_path / "landed")
    first = readers.land(wanted, folder, "folio")
    assert {r["folio"]: bytes(r["content"]) for r in first.collect()} == {"a": b"aaa", "b": b"bbb"}
    (tmp_path / "a").unlink()  # what has landed isn't asked for again
    more = wanted.unionByName(spark.createDataFrame([("c", f"file://{tmp_path}/c"), ("none", f"file://{tmp_path}/none")], wanted.schema))
    with pytest.raises(RuntimeError, match="none"):
        readers.land(more, folder, "folio", attempts=1)
    assert {r["folio"] for r in readers.land(more, folder, "folio", attempts=1, strict=False).collect()} == {"a", "b", "c"}


def test_images_to_vectors(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(60, 30, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    graphics = image.createGraphics()
    graphics.setColor(jvm.java.awt.Color.WHITE)
    graphics.fillRect(0, 0, 60, 30)
    graphics.setColor(jvm.java.awt.Color.BLACK)
    graphics.fillRect(5, 5, 10, 10)
    graphics.dispose()
    jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(f"{tmp_path}/f1r.png"))
    (tmp_path / "broken.png").write_bytes(b"no image")
    pages = readers.images(spark, str(tmp_path)).withColumnRenamed("key", "folio")
    assert {r["folio"]: (r["image"] is None, r["error"] is None) for r in pages.collect()} == {"f1r": (False, True), "broken": (True, False)}
    with pytest.raises(Exception, match="image decode failure"):
        readers.images(spark, str(tmp_path), strict=True).collect()
    boxes = spark.createDataFrame([("f1r", 0, (0, 0, 30, 30)), ("f1r", 1, (50, 0, 50, 50)), ("f1r", 2, (99, 99, 5, 5))], "folio string, item int, box struct<x:int,y:int,w:int,h:int>")
    crops = imaging.crops(pages, boxes, "folio")
    got = {r["item"]: r for r in crops.collect()}
    assert (got[0]["width"], got[1]["width"], got[2]["width"], got[2]["ink"]) == (30, 10, 0, 0.0) and len(got[0]["components"]) >= 1
    vectors = imaging.embedded(crops.where("width > 0"), ["folio", "item"]).collect()
    assert all(len(r["vec"]) == 64 and abs(sum(v * v for v in r["vec"]) - 1) < 1e-3 for r in vectors if any(r["vec"]))


def test_sinks(spark):
    rows = spark.createDataFrame([(1, b"x" * 100), (2, None), (3, b"")], "k int, d binary")
    parts = sinks.base64_chunks(rows, "k", "d", 50).orderBy("chunk").collect()
    assert [len(r["part"]) for r in parts] == [50, 50, 36] and parts[0]["chunks"] == 3
    doc = sinks.json_documents(spark.createDataFrame([(1, float("nan"), [float("inf"), 1.0])], "k int, a double, b array<double>"), "k").first()["document"]
    assert json.loads(doc) == {"k": 1, "a": None, "b": [None, 1.0]}
    deep = spark.sql("SELECT 1 AS k, array(array(double('NaN'), 1.0D)) AS m, map('a', double('inf')) AS p, named_struct('z', double('NaN'), 'l', array(named_struct('y', float('inf')))) AS q, CAST(NULL AS STRUCT<z: DOUBLE>) AS n, 'NaN' AS s")
    assert json.loads(sinks.json_documents(deep, "k").first()["document"]) == {"k": 1, "m": [[None, 1.0]], "p": {"a": None}, "q": {"z": None, "l": [{"y": None}]}, "n": None, "s": "NaN"}
    assert zlib.decompress(bytes(spark.range(1).select(sinks.deflated(F.lit("abc")).alias("z")).first()["z"])) == b"abc"
    line = sinks.event_lines(spark.createDataFrame([("go", 5)], "name string, n int").withColumn("at", F.lit("2025-01-01 00:00:00.5").cast("timestamp")), "name", "at").first()["value"]
    assert json.loads(line) == {"event": "go", "n": 5, "t": 1735689600.5} and line.startswith('{"event"')
    assert sinks.summary_line(spark.createDataFrame([(1,)], "a int")).first()["value"].startswith("FINAL_SUMMARY_JSON={")


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 5:02d} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(50)], "event_id int, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(windows.event_stream(spark, str(tmp_path / "in"), rows.schema), late="30 days")
    running = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in spark.table("windowed").collect()} == {tuple(r) for r in windows.windowed(rows).collect()}
