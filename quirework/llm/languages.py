"""The languages of documents and of stretches in them: family first, then one-versus-one machines within the family.

Texts are read in arrays: their words, the best paths over families and then over a family's languages, and the votes of
the stretches are worked out for many texts at once. The machines (machines.py) are fitted on the driver, on samples and
a bounded number of labelled documents, and sent to all tasks: 2 ** BITS times the number of machines, under 10 MB.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.hashing import SPAN, position
from quirework.llm.machines import FAMILY_OF, LANGUAGES, N_FAMILIES, NO_LANGUAGE, RIVALS, SIGNED, Model, best_paths, confidence, decided, fit, measured, word_hashes
from quirework.plans.workers import shipped

# The names that a label may have.
LONG_NAMES = {"deu": "de", "eng": "en", "fra": "fr", "ita": "it", "lat": "la", "nld": "nl", "por": "pt", "rus": "ru", "spa": "es"}
ENGLISH_NAMES = {"German": "de", "English": "en", "French": "fr", "Italian": "it", "Latin": "la", "Dutch": "nl", "Portuguese": "pt", "Russian": "ru", "Spanish": "es"}

SKIP, BREAK = "", ""  # put in place of characters that don't count, and where a sentence can't go on
MARKUP = re.compile(r"</?[a-z][a-z0-9]{0,9}/?>|<\|[^<>|]{0,40}\|>|&[a-z]{2,8};|https?://\S+", re.I)
TRANSLITERATED = re.compile(r"<\s*f\s*[0-9]+\s*[rv][^<>\n]{0,24}>|^\W*f[0-9]+[rv][0-9]*p[0-9]+x\b", re.I)
LOGGED = re.compile(r"\bidx\W{0,3}[0-9]+|\bmed_?px\b|\bmd5\W{0,3}[0-9a-f]{8}|\binliers\W{0,3}[0-9]", re.I)
HEADER = re.compile(r"^\W*f[0-9]+[rv][0-9]*\W+[0-9]+\s*[x×]\s*[0-9]+\s*mm\b[^!?]{0,40}$", re.I)
QUOTED = re.compile(rf"«[^«»\n{BREAK}]{{0,80}}»|“[^“”\n{BREAK}]{{0,80}}”|„[^„“”\n{BREAK}]{{0,80}}[“”]|\"[^\"\n{BREAK}]{{0,80}}\"|\[[^\[\]\n{BREAK}]{{0,60}}\]|\([^()\n{BREAK}]{{0,80}}\)")
HYPHENED = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
LINES = re.compile(r"([\r\n]+)")

LAST = 0x33480  # no letters are assigned from here on
OTHER, LETTER, DIGIT, APOSTROPHE, STOP, SPACE, DROPPED, BROKEN = range(8)
CHARACTERS = 1_500_000  # read at once, about

LEAST_WORDS, SWITCH, SURE = 5, 6.0, 0.58


def _spaces(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def no_prose(line: str) -> bool:
    """Whether a line is blank, transliteration, a log or a header."""
    return bool(not line.strip() or TRANSLITERATED.search(line) or LOGGED.search(line) or HEADER.search(line))


def masked(text: str) -> str:
    """The text at the same length with markup and quotations blank, lines joined, and breaks for lines that aren't prose."""
    joined = HYPHENED.sub(lambda m: SKIP * (m.end() - m.start()), MARKUP.sub(_spaces, text))
    parts = LINES.split(joined)
    parts[::2] = [BREAK * len(x) if no_prose(x) else x for x in parts[::2]]
    parts[1::2] = [" " * len(x) for x in parts[1::2]]
    return QUOTED.sub(_spaces, "".join(parts))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The kind of every character, and its lower case where that is one character."""
    kind, low = np.zeros(LAST + 1, np.uint8), np.arange(LAST + 1, dtype=np.uint32)
    for n in range(LAST):
        c = chr(n)
        kind[n] = LETTER if c.isalpha() else DIGIT if c.isalnum() else SPACE if c.isspace() else DROPPED if n > 0xAC and unicodedata.category(c) in ("Mn", "Cf") else OTHER
        small = c.lower()
        if len(small) == 1:
            low[n] = ord(small)
    for marks, what in (("'’", APOSTROPHE), (".!?;:…", STOP), (SKIP, DROPPED), (BREAK, BROKEN)):
        kind[[ord(c) for c in marks]] = what
    return kind, low


@dataclass
class Words:
    """The words of texts, in order: characters side by side, lengths, where they begin and end in the masked texts, units (sentences so far as stops show them)."""

    codes: np.ndarray
    lens: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    unit: np.ndarray
    letters: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, lengths) of the distinct words, and the place of each word among them."""
        _, first, inverse = np.unique(word_hashes(self.codes, self.lens), return_index=True, return_inverse=True)
        lens = self.lens[first]
        starts = (np.cumsum(self.lens) - self.lens)[first]
        ends = np.cumsum(lens)
        return self.codes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)], lens, inverse


def words_of(text: str) -> Words:
    """The words of a masked text, without those of digits alone."""
    kinds, low = _characters()
    raw = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), LAST)
    kind = kinds[raw]
    at = np.flatnonzero(kind != DROPPED)
    kind, raw = kind[at], raw[at]
    letter = (kind == LETTER) | (kind == DIGIT)
    inside = letter.copy()
    if len(kind) > 2:
        inside[1:-1] |= (kind[1:-1] == APOSTROPHE) & letter[:-2] & letter[2:]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    start, stop = edges[::2], edges[1::2]
    following = np.r_[kind[1:], BROKEN]
    broken = (kind == BROKEN) | ((kind == STOP) & ((following == SPACE) | (following == BROKEN)))
    alphas = np.r_[0, np.cumsum(kind == LETTER)]
    letters = alphas[stop] - alphas[start]
    kept = letters > 0
    chosen = np.repeat(kept, stop - start)
    unit = np.cumsum(broken)[start[kept]]
    return Words(low[raw[inside]][chosen], (stop - start)[kept], at[start[kept]], at[stop[kept] - 1] + 1, unit, letters[kept])


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A masked text in parts that can be read at once, cut behind a stop or, for want of one, a space."""
    at = 0
    while len(text) - at > CHARACTERS:
        upto = max(text.rfind(mark, at + 1, at + CHARACTERS) for mark in (". ", BREAK))
        upto = upto if upto > at else text.rfind(" ", at + 1, at + CHARACTERS)
        upto = upto + 1 if upto > at else at + CHARACTERS
        yield at, text[at:upto]
        at = upto
    yield at, text[at:]


def stretches(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """Every stretch of the texts: text (its number), begin, end, words, language (its number), confidence, sentence, and the machines' sums.

    A unit is cut where the best path over the families changes, then within a family where that over its languages
    does; a change costs SWITCH words' typical margins. The stretch's language is that of the family with the largest
    sum that wins most of its pairs. A stretch is a sentence if it has LEAST_WORDS words of two characters or more in a
    language told with a confidence of SURE.
    """
    found, waiting, size = [], [], 0

    def read() -> None:
        if waiting:
            found.append(_read(model, waiting))
            waiting.clear()

    for n, text in enumerate(texts):
        for at, part in _pieces(masked(text)) if text else ():
            if size + len(part) > CHARACTERS:
                read()
                size = 0
            waiting.append((n, at, part))
            size += len(part)
    read()
    return pd.concat(found, ignore_index=True) if found else _read(model, [(0, 0, "")])


def _read(model: Model, parts: list[tuple[int, int, str]]) -> pd.DataFrame:
    words = words_of(BREAK.join(p for *_, p in parts))
    codes, lens, inverse = words.distinct()
    machines = model.of_words(codes, lens)[inverse]
    # families, then languages within the stretches of a family
    unit = _numbered(words.unit)
    family = best_paths(machines[:, :N_FAMILIES] / model.family_margin, np.bincount(unit), SWITCH)
    stretch = _numbered(unit, family)
    scores = machines[:, N_FAMILIES:] @ (SIGNED / np.maximum(RIVALS, 1)) / model.pair_margin
    scores[FAMILY_OF[None, :] != family[:, None]] = -1e6
    path = best_paths(scores, np.bincount(stretch), SWITCH)
    stretch = _numbered(unit, family, path)
    sums, n = _sums(machines, stretch)
    language, *_ = decided(sums / np.maximum(n, 1)[:, None])
    # neighbours that the votes give one language are one stretch
    first = np.cumsum(n) - n
    joined = _numbered(unit[first], language)
    sums, _ = _sums(sums, joined)
    stretch = joined[stretch]
    n = np.bincount(stretch)
    language, family_gap, pair_gap = decided(sums / np.maximum(n, 1)[:, None])
    sure = confidence(model, family_gap, pair_gap)
    first = np.cumsum(n) - n
    long, plain = (np.bincount(stretch, weights=w, minlength=len(n)) for w in (words.lens > 1, (words.lens > 1) & (words.letters == words.lens)))
    sentence = (long >= LEAST_WORDS) & (plain >= LEAST_WORDS - 1) & (sure >= SURE) & (language != NO_LANGUAGE)
    # whose: the part that a stretch lies in, by the place of its first word in the joined parts
    sizes = np.array([len(p) + 1 for *_, p in parts])
    begins = np.cumsum(sizes) - sizes
    whose = np.searchsorted(begins, words.begin[first], side="right") - 1
    shift = np.array([at for _, at, _ in parts]) - begins
    out = pd.DataFrame({"text": np.array([t for t, *_ in parts])[whose], "begin": words.begin[first] + shift[whose], "end": words.end[first + n - 1] + shift[whose], "words": n, "language": language, "confidence": sure, "sentence": sentence})
    out["sums"] = list(sums)
    return out


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Runs of rows alike in all keys, numbered from 0."""
    changes = np.zeros(len(keys[0]), bool)
    for key in keys:
        changes[1:] |= key[1:] != key[:-1]
    return np.cumsum(changes)


def _sums(rows: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(run)
    return (np.add.reduceat(rows, np.cumsum(n) - n, axis=0) if len(n) else rows), n


def segments(model: Model, texts: list[str | None]) -> tuple[list[list[dict]], list[tuple[str, float]]]:
    """For each text its segments (lang, words, confidence, sentences, begin, end, text), and its language with a confidence.

    Neighbouring stretches in one language are one segment, whose text runs from the first word to the last. All
    stretches are told, short and doubtful ones with their low confidence; text of no language is "zxx". sentences
    counts the whole sentences. The text's language is decided as a stretch's, from all that is of a language; without
    any it is "zxx", with a confidence of 0 where there is no word.
    """
    every = stretches(model, texts)
    run = _numbered(every["text"].to_numpy(), every["language"].to_numpy())
    out: list[list[dict]] = [[] for _ in texts]
    whole: list[tuple[str, float]] = [("zxx", 0.0)] * len(texts)
    if not len(every):
        return out, whole
    sizes = np.bincount(run)
    first = np.cumsum(sizes) - sizes
    counted, weights = every["words"].to_numpy(), every["confidence"].to_numpy()
    n = np.add.reduceat(counted, first)
    sure = np.add.reduceat(counted * weights, first) / n
    sentences = np.add.reduceat(every["sentence"].to_numpy().astype(np.int64), first)
    begin, end = every["begin"].to_numpy()[first], every["end"].to_numpy()[first + sizes - 1]
    for t, b, e, k, lang, c, s in zip(every["text"].to_numpy()[first].tolist(), begin.tolist(), end.tolist(), n.tolist(), every["language"].to_numpy()[first].tolist(), sure.tolist(), sentences.tolist()):
        out[t].append({"lang": LANGUAGES[lang], "words": k, "confidence": round(c, 6), "sentences": s, "begin": b, "end": e, "text": texts[t][b:e]})
    # one decision a text, over what is of a language, or over all where nothing is
    text, said = every["text"].to_numpy(), every["language"].to_numpy() != NO_LANGUAGE
    spoken = np.bincount(text, weights=said, minlength=len(texts)) > 0
    counts = said | ~spoken[text]
    run = _numbered(text[counts])
    sums, _ = _sums(np.stack(every["sums"].to_numpy()[counts]), run)
    words, _ = _sums(counted[counts][:, None], run)
    language, *gaps = decided(sums / words)
    for t, lang, c in zip(text[counts][np.r_[True, run[1:] != run[:-1]]].tolist(), language.tolist(), confidence(model, *gaps).tolist()):
        whole[t] = (LANGUAGES[lang], round(c, 6))
    return out, whole


def named_language(label: Column) -> Column:
    """The language that a label names: two-letter code, in capitals or with a region, three-letter code or English name; else null."""
    codes = "|".join(x for x in LANGUAGES if x != "zxx")
    names = F.create_map(*(F.lit(x) for pair in (LONG_NAMES | ENGLISH_NAMES).items() for x in pair))
    return F.when(label.rlike(rf"^({codes})(-[A-Za-z]{{2}})?\z"), F.substring(label, 1, 2)).when(label.rlike(rf"^({codes.upper()})\z"), F.lower(label)).otherwise(F.try_element_at(names, label))


def _sentences(text: str, longest: int) -> list[list[str]]:
    """The words of each sentence, so far as stops show them, in parts of at most `longest` words."""
    out = []
    for _, part in _pieces(masked(text)):
        words = words_of(part)
        flat, ends = "".join(map(chr, words.codes)), np.cumsum(words.lens)
        said = [flat[e - n : e] for e, n in zip(ends.tolist(), words.lens.tolist())]
        cuts = [*np.flatnonzero(np.r_[True, words.unit[1:] != words.unit[:-1]]).tolist(), len(said)] if said else []
        out += [said[at : min(b, at + longest)] for a, b in zip(cuts, cuts[1:]) for at in range(a, b, longest)]
    return out


def _no_language(text: str, longest: int) -> list[list[str]]:
    """The words of the lines that are transliteration or logs."""
    lines = [TRANSLITERATED.sub(" ", x) for x in re.split(r"[\r\n]+", MARKUP.sub(" ", text)) if TRANSLITERATED.search(x) or LOGGED.search(x)]
    return [s for line in lines for s in _sentences(re.sub(LOGGED, lambda m: m.group().replace("_", " ").replace("=", " "), f"- {line}"), longest)] or [re.findall(r"[^\W\d_]+", line.lower())[:longest] for line in lines]


def examples(rows: DataFrame, key: str, label: Column, each: int, longest: int) -> DataFrame:
    """(key, named, said, nothing): of each text at most `each` sentences, and as many lines of no language, of up to `longest` words; by hash, not by place."""
    kind = dict(rows.dtypes)[key]

    def some(sentences: list[list[str]]) -> list[list[str]]:
        if len(sentences) <= each:
            return sentences
        order = pd.util.hash_array(np.array([" ".join(s) for s in sentences], object)).argsort(kind="stable")
        return [sentences[n] for n in sorted(order[:each])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["said"] = [some(_sentences(t, longest)) for t in batch["text"]]
            batch["nothing"] = [some(_no_language(t, longest)) for t in batch["text"]]
            yield batch.drop(columns="text")

    ready = shipped(rows).where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), label.alias("named"), "text")
    return ready.mapInPandas(run, f"key {kind}, named string, said array<array<string>>, nothing array<array<string>>")


def drawn(rows: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """The `most` rows of the smallest key hashes; only hashes come to the driver."""
    spot = position(key, salt=salt)
    last = rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(spot.alias("spot")).orderBy("spot").limit(most).agg(F.count("*").alias("n"), F.max("spot").alias("last")).first()
    return rows.where(spot <= F.lit(last["last"] if last["n"] == most else SPAN))


def train(samples: DataFrame, documents: DataFrame, labelled: int = 1500, most_samples: int = 5000, each: int = 24, longest: int = 40) -> Model:
    """Machines fitted on samples (sample_id, lang, text) and labelled documents (doc_id, text, lang).

    The bounds of the fit: hash samples of at most `most_samples` samples and `labelled` documents, and of each text at
    most `each` sentences, of at most `longest` words, by hash. Labels of documents may be wrong: the first model, of
    the samples alone, must agree with them for most of the sentences. Transliteration and log lines are the examples
    of no language.
    """
    known = examples(drawn(samples, "sample_id", most_samples, "samples"), "sample_id", F.col("lang"), each, longest).collect()
    known.sort(key=lambda r: r["key"])
    clean = [(r["named"], words) for r in known if r["named"] in LANGUAGES for words in r["said"]]
    read = examples(drawn(documents, "doc_id", labelled, "languages"), "doc_id", named_language(F.col("lang")), each, longest).collect()
    read.sort(key=lambda r: r["key"])
    nothing = [("zxx", words) for r in read for words in r["nothing"] if words]
    model = measured(fit([(lang, words, 1.0) for lang, words in clean] + [(lang, words, min(1.0, len(clean) / len(nothing))) for lang, words in nothing]), clean)
    told = [(r["named"], [s for s in r["said"] if len(s) >= LEAST_WORDS]) for r in read if r["named"]]
    for epochs, whole in ((3, False), (5, True)):
        found = [(lang, words, 1.0) for lang, words in agreed(model, told, whole)]
        model = measured(fit([(lang, words, 3.0) for lang, words in clean] + [(lang, words, 1.0) for lang, words in nothing] + found, epochs), clean)
    return model


def agreed(model: Model, documents: list[tuple[str, list[list[str]]]], whole: bool, doubt: float = 0.75) -> list[tuple[str, list[str]]]:
    """The sentences of labelled documents to learn from, if the model finds most of a document's in the label's language.

    That takes in those it gives another language by no more than `doubt` typical margins: they hold what the samples
    lack. A document with a sentence beyond that may be mixed; where `whole`, nothing of it is taken.
    """
    flat = [s for _, sentences in documents for s in sentences]
    if not flat:
        return []
    means = model.of_sentences(flat)
    language, *_ = decided(means)
    own = np.array([LANGUAGES.index(named) for named, sentences in documents for _ in sentences])
    every = np.arange(len(flat))
    families = means[:, :N_FAMILIES]
    against_own = np.where(SIGNED.T[own] != 0, SIGNED.T[language] * means[:, N_FAMILIES:], 0).max(1)
    behind = np.maximum((families.max(1) - families[every, FAMILY_OF[own]]) / model.family_margin, against_own / model.pair_margin)
    out, at = [], 0
    for named, sentences in documents:
        here = slice(at, at + len(sentences))
        right = language[here] == LANGUAGES.index(named)
        near = right | (behind[here] <= doubt)
        if sentences and 2 * right.sum() > len(sentences) and (near.all() or not whole):
            out += [(named, s) for s, n in zip(sentences, near) if n]
        at += len(sentences)
    return out


SEGMENT = "struct<lang: string, words: int, confidence: double, sentences: int, begin: int, end: int, text: string>"


def document_segments(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of documents without the text, with language, confidence and segments, an array of (lang, words, confidence, sentences, begin, end, text).

    begin and end count the text's characters, so that a segment is found in its text. Null and empty texts have no
    segments and the language "zxx", with a confidence of 0. No shuffle: every text is read where it lies, whole. Columns
    named language, confidence or segments are replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kinds = dict(documents.dtypes)
    others = [c for c in documents.columns if c not in (text, "language", "confidence", "segments")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[others].copy()
            found, whole = segments(sent.value, batch[text].tolist())
            out["language"], out["confidence"], out["segments"] = [w for w, _ in whole], [c for _, c in whole], found
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + f", language string, confidence double, segments array<{SEGMENT}>"
    return shipped(documents).mapInPandas(run, schema)


def sentence_languages(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, named, said): what the label names, and the languages in which the text holds a whole sentence, in order."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = stretches(sent.value, batch.pop("text").tolist())
            every = every[every["sentence"]].drop_duplicates(["text", "language"])
            said: list[list[str]] = [[] for _ in range(len(batch))]
            for t, lang in zip(every["text"].tolist(), every["language"].tolist()):
                said[t].append(LANGUAGES[lang])
            yield batch.assign(said=said)

    ready = shipped(documents).where("doc_id IS NOT NULL").select("doc_id", named_language(F.col("lang")).alias("named"), "text")
    return ready.mapInPandas(run, f"doc_id {kind}, named string, said array<string>")


def wrong_labels(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang): the languages of the documents whose label doesn't name exactly these; texts without a sentence are no cases."""
    found = sentence_languages(documents, model)
    right = F.col("named").eqNullSafe(F.get("said", F.lit(0))) & (F.size("said") == 1)
    return found.where((F.size("said") > 0) & ~right).select("doc_id", F.explode("said").alias("lang"))
