"""Linear machines that tell languages apart, on hashed character n-grams of words: family against the rest, then one against one.

Everything works on arrays of code points, so that neither words nor their n-grams are Python objects.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

# The languages by family. "zxx" is text that belongs to no language.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "la", "pt"), "slavic": ("ru",), "none": ("zxx",)}

LANGUAGES = tuple(x for family in FAMILIES.values() for x in family)
FAMILY_OF = np.array([n for n, family in enumerate(FAMILIES.values()) for _ in family])
PAIRS = tuple(p for family in FAMILIES.values() for p in combinations(family, 2))
N_FAMILIES, MACHINES = len(FAMILIES), len(FAMILIES) + len(PAIRS)
NO_LANGUAGE = LANGUAGES.index("zxx")
# SIGNED[p, l]: +1 if machine p speaks for language l when positive, -1 if against it
SIGNED = np.array([[1 if language == a else -1 if language == b else 0 for language in LANGUAGES] for a, b in PAIRS], np.float32)
RIVALS = np.abs(SIGNED).sum(0)

BITS = 17
FACTOR, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
LONGEST_GRAM = 5
AT_ONCE = 20_000  # words scored at once


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(29))) * SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)


def word_hashes(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words lie side by side in codes."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lens) - lens
    power = np.cumprod(np.full(int(lens.max()), FACTOR, np.uint64))
    return np.add.reduceat((codes.astype(np.uint64) + np.uint64(7)) * power[np.arange(len(codes)) - np.repeat(begin, lens)], begin)


def grams(codes: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, words): the features of words, the n-grams of one to five characters with ends marked, then the words themselves."""
    size = lens + 2
    ends = np.cumsum(size)
    begin = ends - size
    marked = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(marked), bool)
    inner[begin] = inner[ends - 1] = False
    marked[begin], marked[ends - 1] = 94, 36
    marked[inner] = codes
    owner, left = np.repeat(np.arange(len(lens)), size), np.repeat(ends, size) - np.arange(len(marked))
    hashes = np.zeros(len(marked), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        upto = max(0, len(marked) - n + 1)
        hashes[:upto] = hashes[:upto] * FACTOR + marked[n - 1 :]
        whole = inner if n == 1 else left >= n
        yield _buckets(hashes[whole] + np.uint64(n)), owner[whole]
    yield _buckets(word_hashes(codes, lens)), np.arange(len(lens))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def as_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


@dataclass
class Model:
    """The machines' weights, and the margins of typical words: between families, and between languages of one family."""

    weights: np.ndarray
    family_margin: float = 1.0
    pair_margin: float = 1.0

    def of_words(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The machines' values for each word."""
        out, ends = np.zeros((len(lens), MACHINES), np.float32), np.cumsum(lens)
        for at in range(0, len(lens), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            here = codes[int(ends[at] - lens[at]) : int(ends[min(len(lens), at + AT_ONCE) - 1])]
            for buckets, words in grams(here, lens[some]):
                if len(words):
                    starts = _runs(words)
                    out[some][words[starts]] += np.add.reduceat(self.weights[buckets], starts, axis=0)
        return out

    def of_sentences(self, sentences: list[list[str]]) -> np.ndarray:
        """The mean of the machines' values over the words of each sentence, none of which is empty."""
        place: dict[str, int] = {}
        words = np.array([place.setdefault(w, len(place)) for s in sentences for w in s], np.int64)
        sizes = np.array([len(s) for s in sentences])
        return np.add.reduceat(self.of_words(*as_codes(list(place)))[words], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def decided(means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, family margin, pair margin) from the machines' mean values: the family first, then a vote of its pairs.

    Ties of votes go to the larger sum of the pairs' values. The pair margin is that to the closest relative, infinite
    for a language without relatives.
    """
    families, pairs = means[:, :N_FAMILIES], means[:, N_FAMILIES:]
    family = families.argmax(1)
    ordered = np.sort(families, axis=1)
    votes = ((pairs > 0).astype(np.float32) @ np.maximum(SIGNED, 0)) + ((pairs <= 0).astype(np.float32) @ np.maximum(-SIGNED, 0))
    strength = votes * 1e3 + pairs @ SIGNED
    strength[FAMILY_OF[None, :] != family[:, None]] = -np.inf
    language = strength.argmax(1)
    sides = SIGNED.T[language]
    closest = np.where(sides != 0, pairs * sides, np.inf).min(1) if len(PAIRS) else np.full(len(means), np.inf)
    return language, ordered[:, -1] - ordered[:, -2], closest


def confidence(model: Model, family_gap: np.ndarray, pair_gap: np.ndarray) -> np.ndarray:
    """The logistic of the smaller margin, in typical margins."""
    return 1 / (1 + np.exp(-2 * np.minimum(np.minimum(family_gap / model.family_margin, pair_gap / model.pair_margin), 30)))


def best_paths(scores: np.ndarray, lens: np.ndarray, switch: float) -> np.ndarray:
    """The state of each word on the best path over each sequence, of which every change costs `switch`.

    Sequences lie side by side in scores (words x states), lens long; all step at once.
    """
    order = np.argsort(-lens, kind="stable")
    begin = (np.cumsum(lens) - lens)[order]
    active = np.searchsorted(-lens[order], -np.arange(1, int(lens.max(initial=0)) + 1), side="right")
    best, came = np.empty((len(lens), scores.shape[1]), np.float32), []
    every = np.arange(scores.shape[1], dtype=np.int8)
    for t, n in enumerate(active):
        here = scores[begin[:n] + t]
        if t:
            top = best[:n].argmax(1)
            jump = best[np.arange(n), top] - switch
            stay = best[:n] >= jump[:, None]
            came.append(np.where(stay, every, top[:, None]).astype(np.int8))
            here = np.where(stay, best[:n], jump[:, None]) + here
        best[:n] = here
    path, state = np.zeros(len(scores), np.int8), best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        path[begin[:n] + t] = state[:n]
        if t:
            state[:n] = came[t - 1][np.arange(n), state[:n]]
    return path


def bare(words: list[str]) -> list[str]:
    """Words as they are when accents are lost."""
    return ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) or w for w in words]


def misread(words: list[str], rng: np.random.Generator, rate: float = 0.08) -> list[str]:
    """Words as a bad scan has them: letters lost or taken for others."""

    def one(w: str) -> str:
        return "".join("" if x < rate / 2 else "015lceofnu"[int(x * 1e6) % 10] if x < rate else c for c, x in zip(w, rng.random(len(w)))) or w

    return [one(w) for w in words]


@lru_cache(maxsize=16)
def targets_of(language: str) -> np.ndarray:
    """+1, -1 or 0 (not its matter) for each machine."""
    at = LANGUAGES.index(language)
    return np.r_[np.where(np.arange(N_FAMILIES) == FAMILY_OF[at], 1, -1), SIGNED[:, at]].astype(np.float32)


def fit(examples: list[tuple[str, list[str], float]], epochs: int = 8, rate: float = 0.15, batch: int = 96, seed: int = 408) -> Model:
    """Linear support vector machines for (language, words, weight): hinge loss, adaptive steps, averaged over the later epochs.

    Each example is also learnt without accents and as a bad scan has it.
    """
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    rows, wanted, weight = [], [], []
    for language, words, w in examples:
        for variant in (words, bare(words), misread(words, rng)) if words else ():
            rows.append(np.array([place.setdefault(x, len(place)) for x in variant], np.int32))
            wanted.append(targets_of(language)), weight.append(w)
    weights, squares = (np.zeros((2**BITS, MACHINES), np.float32) for _ in range(2))
    if not rows:
        return Model(weights)
    wanted, weight = np.stack(wanted), np.array(weight, np.float32)
    parts = list(grams(*as_codes(list(place))))
    owner = np.concatenate([w for _, w in parts])
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate([b for b, _ in parts])[order]
    counts = np.bincount(owner, minlength=len(place))
    first = np.cumsum(counts) - counts
    norm = np.array([np.sqrt(counts[r].sum()) for r in rows], np.float32)
    total, taken = np.zeros_like(weights), 0
    for epoch in range(epochs):
        mixed = rng.permutation(len(rows))
        for at in range(0, len(mixed), batch):
            some = mixed[at : at + batch]
            sizes = np.array([len(rows[r]) for r in some])
            words, inverse = np.unique(np.concatenate([rows[r] for r in some]), return_inverse=True)
            n = counts[words]
            ends = np.cumsum(n)
            buckets = flat[np.arange(ends[-1]) + np.repeat(first[words] - (ends - n), n)]
            said = np.add.reduceat(weights[buckets], ends - n, axis=0)
            value = np.add.reduceat(said[inverse], np.cumsum(sizes) - sizes, axis=0) / norm[some][:, None]
            push = np.where(value * wanted[some] < 1, wanted[some] * (weight[some] / norm[some])[:, None], 0).astype(np.float32)
            if not push.any():
                continue
            by_word = np.zeros((len(words), MACHINES), np.float32)
            np.add.at(by_word, inverse, np.repeat(push, sizes, axis=0))
            turn = np.argsort(buckets, kind="stable")
            starts = _runs(buckets[turn])
            step = np.add.reduceat(np.repeat(by_word, n, axis=0)[turn], starts, axis=0)
            touched = buckets[turn][starts]
            squares[touched] += step * step
            weights[touched] += rate * step / np.sqrt(squares[touched] + 1e-6)
        if epoch >= epochs // 2:
            total += weights
            taken += 1
    return Model(total / taken)


def measured(model: Model, clean: list[tuple[str, list[str]]]) -> Model:
    """The model with the typical margins of the samples."""
    if clean:
        _, family, pair = decided(model.of_sentences([words for _, words in clean]))
        model.family_margin = max(float(np.median(family)), 1e-6)
        related = pair[np.isfinite(pair)]
        model.pair_margin = max(float(np.median(np.abs(related))), 1e-6) if len(related) else 1.0
    return model
