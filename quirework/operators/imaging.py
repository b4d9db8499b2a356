"""Pixels, in NumPy, for use in Arrow-batched functions: grey, contrast, ink, thresholds, components, variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.workers import shipped

# The weights of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)
VARIANTS = ("same", "contrast", "thicker", "thinner", "shifted")


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The pixels of Spark's image source (rows of blue, green, red) as grey."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, 2] * GREY[0] + pixels[:, :, 1] * GREY[1] + pixels[:, :, 0] * GREY[2]).astype(np.uint8)


def equalised(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each tile's clipped histogram gives a curve; pixels blend those of the tiles around."""
    h, w = grey.shape
    if not grey.size:
        return grey
    th, tw = -(-h // tiles), -(-w // tiles)
    whole = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th * tiles - h, tw * tiles - w) else "edge")
    curves = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for r in range(tiles):
        for c in range(tiles):
            counts = np.bincount(whole[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel(), minlength=256)
            above = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + above / 256
            curves[r, c] = np.cumsum(counts) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    edge = lambda v: np.clip(v, 0, tiles - 1)
    at = lambda r, c: curves[edge(r)[:, None], edge(c)[None, :], grey]
    blended = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(blended), 0, 255).astype(np.uint8)


def blurred(grey: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(4 * sigma + 0.5))
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    bell /= bell.sum()
    out = grey.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > reach else "edge")
        out = np.apply_along_axis(lambda line: np.convolve(line, bell, "valid"), axis, wide)
    return out


def normalised_ink(grey: np.ndarray) -> np.ndarray:
    """Ink against an even ground: the picture over its blur, equalised; tiny pictures as they are."""
    if min(grey.shape) < 3:
        return grey
    ground = np.rint(blurred(grey, max(3.0, min(grey.shape) / 8)))
    even = np.where(ground > 0, np.rint(grey * 255.0 / np.maximum(ground, 1)), 0)
    return equalised(np.clip(even, 0, 255).astype(np.uint8))


def ink_fraction(grey: np.ndarray) -> float:
    """The share of pixels darker than the 35th percentile, or than 220 if that is less; 0 for no pixels."""
    return float((grey < min(220, int(np.quantile(grey, 0.35)))).mean()) if grey.size else 0.0


def ink_mask(grey: np.ndarray, below: int = 12) -> np.ndarray:
    """Pixels darker by more than `below` than the Gaussian mean around them, over an odd window that fits the picture."""
    side = max(7, min(31, min(grey.shape) // 2 * 2 + 1) // 2 * 2 + 1)
    return grey <= np.rint(blurred(grey, 0.3 * ((side - 1) * 0.5 - 1) + 0.8)) - below


def mask_components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, ink) of the parts of a mask that hang together, corners included: runs of rows joined by union-find."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def top(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            own = len(parent)
            parent.append(own)
            boxes.append([a, y, b, y + 1, b - a])
            for c, d, other in above:
                if c <= b and d >= a:
                    one, two = sorted((top(own), top(other)))
                    if one != two:
                        parent[two] = one
                        p, q = boxes[one], boxes[two]
                        boxes[one] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
            runs.append((a, b, own))
        above = runs
    return sorted((x0, y0, x1 - x0, y1 - y0, n) for i, (x0, y0, x1, y1, n) in enumerate(boxes) if parent[i] == i)


def variant(grey: np.ndarray, kind: int) -> np.ndarray:
    """A picture changed a little: 1 more contrast, 2 darkest and 3 lightest of 2 x 2 pixels, 4 shifted on white; others as they are."""
    if kind == 1:
        mean = np.rint(grey.mean())
        return np.clip(np.rint(mean + 1.18 * (grey - mean)), 0, 255).astype(np.uint8)
    if kind in (2, 3):
        wide = np.pad(grey, ((1, 0), (1, 0)), mode="edge")
        views = np.stack([wide[1:, 1:], wide[:-1, 1:], wide[1:, :-1], wide[:-1, :-1]])
        return views.min(0) if kind == 2 else views.max(0)
    if kind == 4:
        h, w = grey.shape
        dx, dy = max(1, int(0.03 * w)), max(1, int(0.05 * h))
        out = np.full_like(grey, 255)
        out[: max(0, h - dy), : max(0, w - dx)] = grey[dy:, dx:]
        return out
    return grey


def padded(grey: np.ndarray, least: int = 16) -> np.ndarray:
    """A small picture in the middle of a white one of at least `least` pixels a side."""
    h, w = grey.shape
    if min(h, w) >= least:
        return grey
    out = np.full((max(h, least), max(w, least)), 255, np.uint8)
    y, x = (out.shape[0] - h) // 2, (out.shape[1] - w) // 2
    out[y : y + h, x : x + w] = grey
    return out


def crops(images: DataFrame, boxes: DataFrame, key: str, normalise: bool = True) -> DataFrame:
    """(key, item, width, height, ink, components, data): the crops of images (key, image) at boxes (key, item, box), normalised or as they are.

    image is Spark's image struct. Crops are cut and read in Arrow batches; boxes outside the image give empty crops, and
    images that couldn't be decoded (null) give none.
    """
    kinds = dict(boxes.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, item, box, image in zip(batch[key], batch["item"], batch["box"], batch["image"]):
                grey = decoded(image["height"], image["width"], image["nChannels"], image["data"])
                x, y, w, h = (max(0, box[c]) for c in ("x", "y", "w", "h"))
                cut = grey[y : y + h, x : x + w]
                even = normalised_ink(cut) if normalise and cut.size else cut
                parts = mask_components(ink_mask(even)) if min(even.shape, default=0) >= 3 else []
                rows.append((k, item, cut.shape[1], cut.shape[0], ink_fraction(even), [dict(zip(("x", "y", "w", "h", "ink"), p)) for p in parts], even.tobytes()))
            yield pd.DataFrame(rows, columns=[key, "item", "width", "height", "ink", "components", "data"])

    schema = f"{key} {kinds[key]}, item {kinds['item']}, width int, height int, ink double, components array<struct<x:int,y:int,w:int,h:int,ink:int>>, data binary"
    return shipped(boxes).join(images.where("image IS NOT NULL").select(key, "image"), key).select(key, "item", "box", "image").mapInPandas(run, schema)


def varied(crops_: DataFrame, kinds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """The crops with a column kind, each once for every kind of variant, with the variant's pixels."""

    @F.pandas_udf("binary")
    def changed(width: pd.Series, height: pd.Series, data: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([variant(np.frombuffer(raw, np.uint8).reshape(h, w), k).tobytes() if raw else raw for w, h, raw, k in zip(width, height, data, kind)])

    every = shipped(crops_).withColumn("kind", F.explode(F.array(*(F.lit(k) for k in kinds))))
    return every.withColumn("data", changed("width", "height", "data", "kind"))


@dataclass(frozen=True)
class Embedder:
    """A model for crops. load is called once in each Python task and gives a function of a batch of grey pictures.

    That returns an array (pictures, dim), or with dense=True one array (patches, dim) a picture. Rows need no unit length.
    """

    load: Callable[[], Callable[..., np.ndarray | list[np.ndarray]]]
    batch: int = 64
    revision: str = ""
    least_side: int = 16


def _cells(grey: np.ndarray, side: int) -> np.ndarray:
    rows = np.stack([part.mean(0) for part in np.array_split(grey.astype(np.float32), side, 0)])
    return 255 - np.stack([part.mean(1) for part in np.array_split(rows, side, 1)], 1)


def small_pictures(dim: int = 64, patches: int = 4) -> Embedder:
    """A stand-in that needs no weights: a crop is its own small picture, averaged to dim cells; its patches are squares of that."""
    side = int(round(dim**0.5))

    def load() -> Callable[..., np.ndarray | list[np.ndarray]]:
        def run(pictures: list[np.ndarray], dense: bool = False) -> np.ndarray | list[np.ndarray]:
            cells = [_cells(p, side) for p in pictures]
            if not dense:
                return np.stack([c.ravel() for c in cells])
            return [np.stack([part.ravel() for row in np.array_split(c, patches, 0) for part in np.array_split(row, patches, 1)]) for c in cells]

        return run

    return Embedder(load, revision=f"small pictures of {dim}")


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def embedded(crops_: DataFrame, keys: list[str], model: Column | Embedder | None = None, dim: int = 64, dense: bool = False) -> DataFrame:
    """(keys, vec): crops as vectors of unit length, or with dense=True (keys, patches): each patch's vector.

    model is an Embedder, small pictures if none is given, or for plain vectors a column over (width, height, data). Empty
    crops are embedded as white ones. Batches never hold more than the model's batch.
    """
    if isinstance(model, Column):
        return crops_.select(*keys, model.alias("vec"))
    own = model or small_pictures(dim)
    kinds = dict(crops_.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = own.load()
        for batch in batches:
            for at in range(0, len(batch), own.batch):
                some = batch.iloc[at : at + own.batch]
                pictures = [padded(np.frombuffer(raw, np.uint8).reshape(h, w), own.least_side) for w, h, raw in zip(some["width"], some["height"], some["data"])]
                found = embed(pictures, dense=True) if dense else embed(pictures)
                out = some[keys].copy()
                out["patches" if dense else "vec"] = [_unit(f).tolist() for f in found]
                yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", patches array<array<float>>" if dense else ", vec array<float>")
    return shipped(crops_).select(*keys, "width", "height", "data").mapInPandas(run, schema)
