"""Writers: event lines, summaries, chunks of base64, compressed artefacts."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import json_safe_as


def event_lines(events: DataFrame, name: str, at: str) -> DataFrame:
    """(value): one JSON line an event, keys in order, the time in seconds to three decimals."""
    fields = sorted([c for c in events.columns if c not in (name, at)] + ["event", "t"])
    columns = {"event": F.col(name), "t": F.round(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6), 3)}
    return events.select(F.to_json(F.struct(*(columns.get(f, F.col(f)).alias(f) for f in fields))).alias("value"))


def base64_chunks(rows: DataFrame, key: str, data: str, size: int = 70_000) -> DataFrame:
    """(key, chunk, chunks, part): the bytes in base64, cut into numbered parts."""
    plain = F.regexp_replace(F.base64(F.col(data)), "[\r\n]", "")
    count = F.ceil(F.length("b") / F.lit(size)).cast("int")
    rows = rows.where(F.col(data).isNotNull()).select(key, plain.alias("b")).withColumn("chunks", count).where("chunks > 0")
    return rows.select(key, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", "b").select(key, "chunk", "chunks", F.substr("b", F.col("chunk") * size + 1, F.lit(size)).alias("part"))


def json_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, document): each row as JSON, numbers that aren't finite as null, however deep they lie."""
    safe = [json_safe_as(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.col(key), F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("document"))


def deflated_parts(rows: DataFrame, key: str, name: str, each: int = 10_000) -> DataFrame:
    """(name, no, data): the rows' JSON documents, by key, as deflated JSON lists of about `each` rows: a large table has many."""
    documents = json_documents(rows.withColumn("__key", F.col(key)), "__key")
    groups = max(1, -(-documents.count() // each))
    parts = documents.groupBy(F.pmod(F.xxhash64("__key"), F.lit(groups)).alias("no")).agg(F.array_sort(F.collect_list(F.struct("__key", "document"))).alias("d"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("d", lambda d: d["document"]), ","), F.lit("]"))
    return parts.select(F.lit(name).alias("name"), "no", deflated(whole).alias("data"))


def deflated(text: Column) -> Column:
    """Text as zlib bytes of the highest level."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else zlib.compress(t.encode(), 9))

    return run(text)


def summary_line(one_row: DataFrame, prefix: str = "FINAL_SUMMARY_JSON=") -> DataFrame:
    """(value): the summary of a run as one line."""
    return json_documents(one_row.withColumn("__k", F.lit(0)), "__k").select(F.concat(F.lit(prefix), F.get_json_object("document", "$")).alias("value"))


def png(grey) -> bytes:
    """A grey picture (rows of uint8) as PNG bytes."""
    height, width = grey.shape
    lines = b"".join(b"\0" + bytes(row) for row in grey)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 9)) + part(b"IEND", b"")


def contact_sheet(picks: DataFrame, rows: int = 24, columns: int = 6, cell: tuple[int, int] = (170, 105)) -> bytes:
    """A PNG of at most rows x columns crops (cluster, pick, width, height, data), a line for each cluster: a report for the eye."""
    shown = picks.where(F.col("pick") < columns).orderBy("cluster", "pick").limit(rows * columns).collect()
    clusters = sorted({r["cluster"] for r in shown})[:rows]
    sheet = np.full((max(1, len(clusters)) * cell[1], columns * cell[0]), 255, np.uint8)
    for r in shown:
        if r["cluster"] in clusters and r["width"] and r["height"]:
            grey = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])
            step = max(1, -(-r["width"] // (cell[0] - 8)), -(-r["height"] // (cell[1] - 8)))
            small = grey[::step, ::step]
            y, x = clusters.index(r["cluster"]) * cell[1], r["pick"] * cell[0]
            sheet[y : y + small.shape[0], x : x + small.shape[1]] = small
    return png(sheet)
