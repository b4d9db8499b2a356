import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quirework.functions import geometry as G
from quirework.functions import text as T
from quirework.functions import vectors as V
from quirework.functions.folio import folio_form, leaf_number
from quirework.functions.hashing import position


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "key, form, leaf",
    [("f1r", "f1r", 1), (" F0012V ", "f12v", 12), ("f67r2", "f67r2", 67), ("f0r", "f0r", 0), ("f00r", "f0r", 0), ("fRos", None, None), ("f12", None, None), ("12r?", None, None), ("", None, None), (None, None, None), ("f1r\n", None, None), ("f99999999999r", "f99999999999r", None)],
)
def test_folio_form(spark, key, form, leaf):
    row = spark.createDataFrame([(key,)], "k string").select(folio_form(F.col("k")).alias("f")).withColumn("n", leaf_number(F.col("f"))).first()
    assert (row["f"], row["n"]) == (form, leaf)


def test_position_is_null_for_null_and_bounded(spark):
    assert one(spark, position(F.lit(None).cast("string"))) is None
    assert 0 <= one(spark, position(F.lit("a"), F.lit(3))) < 2**32


def test_leaf_base(spark):
    assert tuple(one(spark, T.leaf_base(F.lit("f67r2")))) == (67, "r", "67r")
    assert one(spark, T.leaf_base(F.lit("fRos"))) is None
    with pytest.raises(Exception, match="no folio key"):
        one(spark, T.leaf_base(F.concat(F.lit("fRos"), F.col("id")), strict=True))


@pytest.mark.parametrize("label, found", [("Folio 67r (part)", True), ("167r", False), ("67r2", False), ("66v and 67R", True), ("", False)])
def test_whole_token(spark, label, found):
    assert one(spark, T.whole_token(F.lit(label), F.lit("67r"))) is found


def test_derivative_url(spark):
    assert one(spark, T.derivative_url(F.lit("https://h/i/full/full/0/default.jpg?x=1"), 1800)) == "https://h/i/full/1800,/0/default.jpg"
    assert one(spark, T.derivative_url(F.lit("https://h/i.png"), 1800)) == "https://h/i.png"


def test_json_safe(spark):
    row = spark.createDataFrame([(float("nan"), [float("inf"), 1.0])], "a double, b array<double>").select(T.json_safe(F.col("a")).alias("a"), T.json_safe_as(F.col("b"), ArrayType(DoubleType())).alias("b")).first()
    assert (row["a"], row["b"]) == (None, [None, 1.0])


def test_boxes(spark):
    box = one(spark, G.clamped_box(*(F.lit(v) for v in (-3, 5, 10, 4, 20, 8)), 2))
    assert tuple(box) == (0, 3, 9, 5)
    h = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in ((2, 0, 1), (0, 2, -1), (0, 0, 1))))
    assert tuple(one(spark, G.bounding_box(G.mapped_rect(h, *(F.lit(float(v)) for v in (0, 0, 10, 5)))))) == (1, -1, 20, 10)


def test_areas(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    rows = spark.createDataFrame([(1, square, 5, 5), (2, square, 20, 20), (3, [[0.0, 0.0], [1.0, 1.0]], 5, 5), (4, None, 5, 5)], "id int, q array<array<double>>, w int, h int")
    got = {r["id"]: (r["a"], r["overlap"]) for r in G.overlap_shares(rows, "q", "w", "h").select("id", G.polygon_area(F.col("q")).alias("a"), "overlap").collect()}
    assert got[1] == (100.0, 0.25) and got[2] == (100.0, 1.0) and got[3] == (0.0, None) and got[4][1] is None


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.dot(a, a)) == 25.0
    assert one(spark, V.renormalised(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.renormalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
