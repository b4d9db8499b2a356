"""The corpus as ids of public tokenizers.

Vocabulary files are read where they lie (their folder is a parameter); each Python worker loads one once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.plans.workers import shipped

FOLDER = os.environ.get("QUIREWORK_TOKENIZERS", "/opt/tokenizers")
CHUNK, OVERLAP = 4096, 512
# Near the end of a chunk a longer match may have been cut off: a contraction has three characters, white space looks one ahead.
UNSURE = 8
# Fixed value: how the byte-level tokenizers split a text before merging bytes.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")


@lru_cache(maxsize=8)
def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=8)
def encoder(name: str, folder: str = FOLDER) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts to ids without special tokens; strings of special tokens are ordinary text."""
    if name in BYTE_LEVEL:
        import tiktoken

        own = tiktoken.Encoding(name, pat_str=PRETOKENS, mergeable_ranks=_ranks(name, folder), special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    if name == "word_bpe_49k":
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = Tokenizer.from_file(f"{folder}/{name}.json")
        words.encode_special_tokens = True
        return lambda texts: [e.ids for e in words.encode_batch(texts, add_special_tokens=False)]
    if name == "piece_bpe_32k":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
        return lambda texts: pieces.encode(texts, num_threads=1)
    raise ValueError(f"no tokenizer {name}")


@lru_cache(maxsize=8)
def _bytes_of(name: str, folder: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(name, folder).items()}


def _encode_rows(name: str, folder: str, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(name, folder)
        for batch in batches:
            out = batch[keys].copy()
            out["ids"] = encode(batch["text"].tolist())
            yield out

    return run


def _starts(chunk: int, overlap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds head and tail: where pre-tokens begin in the chunk's first and last `overlap` characters, counted in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(PRETOKENS)
        for batch in batches:
            heads, tails = [], []
            for at, text, last in zip(batch["at"], batch["text"], batch["last"]):
                starts = [m.start() for m in pattern.finditer(text)]
                heads.append([at + s for s in starts if s < overlap] if at else [0])
                tails.append([] if last else [at + s for s in starts if chunk <= s < len(text) - UNSURE and not text[s - 1].isspace()])
            yield batch.drop(columns="text").assign(head=heads, tail=tails)

    return run


def byte_pieces(texts: DataFrame, key: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, text): the texts cut where pre-tokens begin, so that encoding the pieces gives the ids of the whole.

    The chunks of a text overlap and are pre-tokenised apart, each from its own start. Behind a place at which both of
    two neighbours begin a pre-token they agree for good, as matches look only ahead; the first such place in the
    overlap is the cut; not one behind white space, which is split by what follows. Where there is none (a pre-token longer than the overlap) the two chunks stay one piece.
    """
    schema = f"key {dict(texts.dtypes)[key]}, no int, at int, last boolean, head array<int>, tail array<int>"
    count = F.greatest(F.ceil(F.length("text") / F.lit(chunk)).cast("int"), F.lit(1))
    numbered = shipped(texts).select(F.col(key).alias("key"), "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("no"), count.alias("n"))
    chunks = numbered.select("key", "no", (F.col("no") * chunk).alias("at"), (F.col("no") == F.col("n") - 1).alias("last"), F.substr("text", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    read = chunks.repartition("key", "no").mapInPandas(_starts(chunk, overlap), schema)  # without the texts from here on
    order = Window.partitionBy("key").orderBy("no")
    both = F.array_intersect(F.lag("tail").over(order), F.col("head"))
    cut = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(both))
    known = read.select("key", "no", "at", "last", cut.alias("cut"))
    known = known.withColumn("piece", F.count("cut").over(order)).withColumn("ends", F.lead("cut").over(order).isNotNull() | F.col("last"))
    known = known.select("key", "no", "piece", "cut", "at", "ends").join(chunks.select("key", "no", "text"), ["key", "no"])
    # chunks of one piece side by side: their own characters, and of the last also the overlap
    own = F.struct("no", F.when(F.col("ends"), F.col("text")).otherwise(F.substr("text", F.lit(1), F.lit(chunk))).alias("text"))
    known = known.select("key", "piece", "cut", "at", own.alias("own"))
    pieces = known.groupBy("key", "piece").agg(F.min("at").alias("at"), F.max("cut").alias("cut"), F.array_sort(F.collect_list("own")).alias("own"))
    upto = F.lead("cut").over(Window.partitionBy("key").orderBy("piece"))
    whole = F.array_join(F.transform("own", lambda o: o["text"]), "")
    length = F.coalesce(upto, F.lit(2**31 - 1)) - F.col("cut")
    return pieces.select(F.col("key").alias(key), "piece", F.substr(whole, F.col("cut") - F.col("at") + 1, length).alias("text"))


def encode(documents: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): each text as the ids of a public tokenizer, without special tokens.

    Empty and null texts have the empty list. Byte-level tokenizers cut texts longer than a chunk into overlapping
    chunks, which are spread over tasks (see byte_pieces); shorter texts, which are one chunk with nothing to stitch, and
    all texts of the other tokenizers, which look at whole texts, are encoded where they lie. Rows with a null key come out once each under a null key; keys are
    taken to be unique. Extra columns don't matter.
    """
    rows = shipped(documents).select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    if name not in BYTE_LEVEL:
        return rows.mapInPandas(_encode_rows(name, folder, ["doc"]), f"doc {kind}, ids array<int>").withColumnRenamed("doc", key)
    long = (F.length("text") > chunk) & F.col("doc").isNotNull()
    short = rows.where(~long).mapInPandas(_encode_rows(name, folder, ["doc"]), f"doc {kind}, ids array<int>")
    pieces = byte_pieces(rows.where(long), "doc", chunk, overlap)
    parts = pieces.mapInPandas(_encode_rows(name, folder, ["doc", "piece"]), f"doc {kind}, piece bigint, ids array<int>")
    joined = parts.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("doc", key)


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """(key, text): the texts of ids of a byte-level tokenizer: the tokens' raw bytes side by side, read as UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = _bytes_of(name, folder)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "text": [b"".join(raw[i] for i in ids).decode("utf-8", "replace") for ids in batch["ids"]]})

    return shipped(encoded).select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInPandas(run, f"{key} {dict(encoded.dtypes)[key]}, text string")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """(key, tokens): the length of each text in tokens; 0 for empty and null texts."""
    return encode(documents, name, key, folder=folder).select(key, F.size("ids").cast("bigint").alias("tokens"))
