"""Readers of what the pipeline lands: manifests, inventories, runtime files, images; and fetching with retries."""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirework.functions.text import derivative_url
from quirework.plans.lineage import cut
from quirework.plans.workers import shipped


def manifest_canvases(records: DataFrame, json_column: str = "manifest", width: int = 1800) -> DataFrame:
    """(index, label, canvas_id, width, height, body_id, derivative_url): the canvases of manifests in the plain form that have an image.

    All strings of the label are joined by spaces; the image is the first body of the first annotation of the first
    page. Canvases without one are left out but still counted by index. Other columns stay.
    """
    from quirework.operators.nested import manifest_objects

    kept = [c for c in records.columns if c != json_column]
    rows = manifest_objects(records, json_column).select(*kept, F.posexplode("items").alias("index", "c"))

    def at(path: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(c, '{path}', '{kind}')")

    label = F.array_join(F.flatten(F.map_values(at("$.label", "map<string,array<string>>"))), " ")
    body = at("$.items[0].items[0].body.id", "string")
    shown = rows.select(*kept, "index", F.coalesce(label, F.lit("")).alias("label"), F.coalesce(at("$.id", "string"), F.lit("")).alias("canvas_id"), F.coalesce(at("$.width", "int"), F.lit(0)).alias("width"), F.coalesce(at("$.height", "int"), F.lit(0)).alias("height"), body.alias("body_id"))
    return shown.where("body_id IS NOT NULL AND body_id <> ''").withColumn("derivative_url", derivative_url(F.col("body_id"), width))


class _Entries(HTMLParser):
    def __init__(self, tag: str, mark: str) -> None:
        super().__init__()
        self.tag, self.mark, self.found = tag, mark, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = dict(attrs)
        classes = (has.get("class") or "").split()
        if tag == self.tag and self.mark in classes and has.get("id"):
            self.found.append({"folio": has["id"], "site_class": " ".join(classes)})


def inventory_entries(pages: DataFrame, html: str = "html", tag: str = "div", mark: str = "r-y") -> DataFrame:
    """(folio, site_class, ord, ...): the marked elements with an id of HTML pages, in order; repeated ids repeat."""

    @F.pandas_udf("array<struct<folio: string, site_class: string>>")
    def entries(texts: pd.Series) -> pd.Series:
        def read(text: str | None) -> list[dict[str, str]]:
            parser = _Entries(tag, mark)
            parser.feed(text or "")
            return parser.found

        return texts.map(read)

    kept = [c for c in pages.columns if c != html]
    return shipped(pages).select(*kept, F.posexplode(entries(html)).alias("ord", "e")).select(*kept, "e.folio", "e.site_class", "ord")


def inventory_classes(entries: DataFrame) -> DataFrame:
    """(folio, site_class, ord): each id once, by its last entry."""
    return entries.where("folio IS NOT NULL").groupBy("folio").agg(F.max_by(F.struct("site_class", "ord"), F.col("ord")).alias("e")).select("folio", "e.site_class", "e.ord")


RUNTIME = "array<variant>"


def runtime_boxes(files: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """labels (folio, word_index, eva) and boxes (folio, source_index, word_index, x, y, w, h) of runtime files (folio, text).

    A file is a JSON list of two lists; anything else is an error when it is read.
    """
    both = files.select("folio", F.expr(f"try_variant_get(try_parse_json({text}), '$', '{RUNTIME}')").alias("v"))
    wrong = F.expr("raise_error(concat('unexpected runtime structure: ', coalesce(folio, 'null')))").cast(RUNTIME)
    checked = both.select("folio", F.when(F.size("v") == 2, F.col("v")).otherwise(wrong).alias("v"))
    labels = checked.select("folio", F.posexplode(F.expr("try_variant_get(v[0], '$', 'array<variant>')")).alias("word_index", "u")).select("folio", "word_index", F.expr("try_variant_get(u, '$[0]', 'string')").alias("eva"))
    boxes = checked.select("folio", F.posexplode(F.expr("try_variant_get(v[1], '$', 'array<array<double>>')")).alias("source_index", "b"))
    return labels, boxes.select("folio", "source_index", F.get("b", F.lit(0)).cast("int").alias("word_index"), *(F.get("b", F.lit(i + 1)).alias(c) for i, c in enumerate("xywh")))


def images(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(key, image, error) of the JPEG and PNG files in a folder, decoded in the JVM; the key is the file's name without ending.

    A file that can't be decoded has a null image and an error; where `strict`, it fails the query when it is read.
    """
    read = spark.read.format("image").option("dropInvalid", False).load(folder)
    key = F.regexp_extract("image.origin", r"([^/]+)\.[^./]+$", 1)
    told = F.concat(F.lit("image decode failure: "), "image.origin")
    bad = F.coalesce(F.col("image.height") < 0, F.lit(True))
    image = F.when(~bad, F.col("image"))
    if strict:
        kind = read.schema["image"].dataType.simpleString()
        image = F.when(bad, F.raise_error(told).cast(kind)).otherwise(F.col("image"))
    return read.select(key.alias("key"), image.alias("image"), F.when(bad, told).alias("error"))


def missing(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted, each once, and hasn't been landed."""
    return wanted.select(*keys).distinct().join(landed, keys, "left_anti")


def fetch(url: str, opener: Callable[[str], bytes], attempts: int = 5, pause: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> bytes:
    """The content at url; failures are tried again after growing pauses with some chance in them, the last is raised."""
    for k in range(attempts):
        try:
            return opener(url)
        except Exception:
            if k == attempts - 1:
                raise
            pause(min(20.0, 1.5**k + jitter()))
    raise ValueError("attempts must be at least 1")


def open_url(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=90) as answer:
        return answer.read()


LANDED = "url string, content binary, error string"


def fetched(addresses: DataFrame, attempts: int = 5, opener: Callable[[str], bytes] | None = None) -> DataFrame:
    """addresses (url, ...) with content and error, fetched where the rows lie: null content and an error where all attempts failed."""
    others = [c for c in addresses.columns if c not in ("content", "error")]
    kinds = dict(addresses.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(url: str | None) -> tuple[bytes | None, str | None]:
            try:
                return (fetch(url, opener or open_url, attempts), None) if url else (None, "no address")
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for batch in batches:
            got = [one(u) for u in batch["url"]]
            yield batch.assign(content=[c for c, _ in got], error=[e for _, e in got])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", content binary, error string"
    return shipped(addresses).select(*others).mapInPandas(run, schema)


def land(wanted: DataFrame, folder: str, key: str, attempts: int = 5, tasks: int = 8, strict: bool = True) -> DataFrame:
    """The landed table in a folder (key, url, content), with what of wanted (key, url) it lacked fetched and added.

    A key that has landed isn't fetched again, so a run can be repeated. Failures land nothing; where `strict` they raise
    when all others have landed.
    """
    spark = wanted.sparkSession
    kind = dict(wanted.dtypes)[key]
    schema = f"`{key}` {kind}, url string, content binary"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    landed = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    asked = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("url").alias("url"))
    got = cut(fetched(missing(asked, landed.select(key), [key]).join(asked, key).repartition(tasks), attempts))
    got.where("error IS NULL").select(key, "url", "content").write.mode("append").parquet(folder)
    failed = got.where("error IS NOT NULL").select(key, "error").limit(5).collect()
    if failed and strict:
        raise RuntimeError("not landed: " + "; ".join(f"{r[0]}: {r[1]}" for r in failed))
    return spark.read.schema(schema).parquet(folder)


class FetchSource(DataSource):
    """spark.read.format("fetch").option("urls", <JSON list>): (url, content, error), a task for each address."""

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(json.loads(self.options.get("urls", "[]")), int(self.options.get("attempts", "5")))


class FetchReader(DataSourceReader):
    def __init__(self, urls: list[str], attempts: int) -> None:
        self.urls, self.attempts = urls, attempts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            try:
                yield partition.value, fetch(partition.value, open_url, self.attempts), None
            except Exception as e:
                yield partition.value, None, f"{type(e).__name__}: {e}"
