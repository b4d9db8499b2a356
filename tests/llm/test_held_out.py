"""Languages of sentences that the model hasn't seen."""

import os
import random

import numpy as np
import pytest

from quirework.llm import languages, machines

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def held(spark):
    if not os.path.exists(f"{DATA}/lang_samples.parquet"):
        pytest.skip("no test data here")
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = languages.train(samples.where("sample_id % 2 = 0"), documents, labelled=500)
    return model, [(r["lang"], r["text"]) for r in samples.where("sample_id % 2 = 1").orderBy("sample_id").collect()]


def said(model, text):
    return {s["lang"] for s in languages.segments(model, [text])[0][0] if s["sentences"]}


def test_single_sentences(held):
    model, rows = held
    assert np.mean([said(model, t) == {lang} for lang, t in rows]) >= 0.98


def test_damaged_sentences(held):
    model, rows = held
    rng = np.random.default_rng(1)
    damaged = [(lang, " ".join(machines.misread(machines.bare(t.split()), rng, 0.05))) for lang, t in rows]
    assert np.mean([said(model, t) == {lang} for lang, t in damaged]) >= 0.93


def test_mixed_texts(held):
    model, rows = held
    random.seed(2)
    cases = [random.sample(rows, 4) for _ in range(150)]
    assert np.mean([said(model, " ".join(t for _, t in case)) == {lang for lang, _ in case} for case in cases]) >= 0.95
    bare = [" ".join(t.lower().replace(".", "").replace(",", "") for _, t in case) for case in cases]
    assert np.mean([said(model, t) == {lang for lang, _ in case} for t, case in zip(bare, cases)]) >= 0.85
