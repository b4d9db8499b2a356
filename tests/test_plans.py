from pathlib import Path

from pyspark.sql import functions as F

from quirework.plans import lineage


def test_cut_forgets_the_plan_and_keeps_rows_and_types(spark):
    df = spark.range(50).selectExpr("id", "CAST(id AS DECIMAL(9, 2)) AS d", "array(id) AS a", "CAST(NULL AS STRING) AS s").where("id > 3")
    got = lineage.cut(df)
    assert got.dtypes == df.dtypes and {tuple(map(str, r)) for r in got.collect()} == {tuple(map(str, r)) for r in df.collect()}
    assert "Range" not in got._jdf.queryExecution().logical().toString()
    assert lineage.cut(df.where("id < 0")).collect() == []


def test_scratch_tables_are_deleted_and_results_kept(spark):
    def tables():
        return set(Path(lineage.shared_folder(spark).removeprefix("file:")).iterdir())

    lineage.cut(spark.range(1))
    before = tables()
    with lineage.scratch(spark) as keep:
        a, told = lineage.cut_told(spark.range(9), F.count_if(F.col("id") > 5).alias("n"))
        with lineage.scratch(spark) as inner:
            b = inner(lineage.cut(a.where("id > 2")))
        assert told == {"n": 3} and b.count() == 6
        c = keep(b.where("id > 7"))
    assert c.collect()[0]["id"] == 8 and len(tables() - before) == 1
    empty, told = lineage.cut_told(spark.range(0), F.count("*").alias("n"))
    assert told == {"n": 0} and empty.collect() == []


def test_joins_of_cut_tables_keep_their_true_size(spark):
    df = lineage.cut(spark.range(20))
    for _ in range(6):
        df = lineage.cut(df.join(df.select("id"), "id").distinct())
    assert df.count() == 20 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6
