"""Samples that stay as data grows: fixed hash thresholds for each stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.hashing import SPAN, position
from quirework.plans.lineage import cut

NO_STRATUM = ""


def first_delivery(df: DataFrame, key: str, stratum: Column, arrived: str) -> DataFrame:
    """(key, stratum), one row for each key that isn't null, the stratum of the row that arrived first.

    Rows that arrive later so can't move a key to another stratum. Rows without time of arrival count as last; ties go to
    the smaller stratum; a null stratum is ''.
    """
    when = F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit(2**63 - 1))
    named = F.coalesce(stratum, F.lit(NO_STRATUM))
    return (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.struct(when.alias("at"), named.alias("stratum")).alias("first"))
        .groupBy("key")
        .agg(F.min("first").alias("first"))
        .select("key", F.col("first.stratum").alias("stratum"))
    )


def raised(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stratum, rate): the rates of a new run, never below those of an old one."""
    return old.unionByName(new).groupBy("stratum").agg(F.max("rate").alias("rate"))


ANY = "*"  # the stratum whose rate is the default


def kept_rates(spark: SparkSession, folder: str, default_rate: float, rates: DataFrame | None = None) -> DataFrame:
    """(stratum, rate) of this run, never below those of the runs before, which the folder keeps; ANY has the default.

    A stratum without a rate of its own had the default, so a rate given for it later counts from there. Each run adds its
    own table, so a run that fails halfway takes nothing back.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.schema("stratum string, rate double").parquet(folder) if there else spark.createDataFrame([], "stratum string, rate double")
    new = spark.createDataFrame([(ANY, float(default_rate))], "stratum string, rate double")
    if rates is not None:
        new = new.unionByName(rates.where("rate IS NOT NULL AND NOT isnan(rate)").select("stratum", "rate"))
    before = old.where(F.col("stratum") == ANY).agg(F.max("rate")).first()[0] or 0.0
    whole = cut(raised(old, new).withColumn("rate", F.greatest("rate", F.lit(before))))
    whole.write.mode("append").parquet(folder)
    return whole


def hash_sample(keyed: DataFrame, default_rate: float, rates: DataFrame | None = None, salt: str = "408") -> DataFrame:
    """The rows of (key, stratum) whose salted key hash is under the threshold of their stratum.

    A row's fate hangs on its key, its stratum's rate and the salt alone: not on other rows, order or partitions. A
    higher rate keeps all that a lower one kept. rates gives (stratum, rate) where it differs from default_rate, or under
    ANY another default; those of kept_rates() never fall, so nothing once drawn drops out. Rates
    of null, NaN or under 0 count as 0 and over 1 as 1. Null keys are never drawn; repeated keys are drawn together.
    No shuffle beyond the join with rates.
    """
    spot = position("key", salt=salt)
    if rates is None:
        return keyed.where(spot < F.lit(int(default_rate * SPAN)))
    given = rates.groupBy("stratum").agg(F.max(F.when(F.isnan("rate"), None).otherwise(F.col("rate"))).alias("rate"))
    if not given.where(F.col("stratum") == ANY).isEmpty():
        default_rate = min(1.0, max(0.0, given.where(F.col("stratum") == ANY).first()["rate"] or 0.0))
    limit = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rate", F.lit(0.0)))) * SPAN).cast("bigint")
    given = given.select("stratum", limit.alias("__limit"))
    return keyed.join(given, "stratum", "left").where(spot < F.coalesce("__limit", F.lit(int(default_rate * SPAN)))).select(*keyed.columns)

