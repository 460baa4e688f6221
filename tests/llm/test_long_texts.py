"""Every operator and pipeline stage on texts of two megabytes that tempt a scan to start again at each character."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import secrets
from helixframe.llm.exact_dedup import exact_dedup
from helixframe.llm.filter_audit import filter_audit
from helixframe.llm.fingerprints import document_fingerprints
from helixframe.llm.license_scan import license_scan
from helixframe.llm.mixing import first_words, mix
from helixframe.llm.packing import pack
from helixframe.llm.simhash import near_dedup
from helixframe.llm.token_counts import encoded_lengths
from helixframe.llm.toxicity import score_toxicity, train

SIZE = 2_000_000
LONG = {
    "letter": "a" * SIZE, "dots": "." * SIZE + "x", "mixed punctuation": ".!;:?" * (SIZE // 5) + "x", "blanks": " " * SIZE, "lines": "\n" * SIZE + "x", "tail": "word" + "\t " * (SIZE // 2),
    "empty lines": "\n \n#" * (SIZE // 4), "sensitive": "token of the day. " * (SIZE // 18), "assigned": "token:  " * (SIZE // 8), "keys": "AKIA" * (SIZE // 4), "long key": "token " + "aB3" * (SIZE // 3),
    "digits": ("0" * 23 + "x") * (SIZE // 24), "licences": "spdx-license-identifier: " * (SIZE // 25), "urls": "://a.b/" * (SIZE // 7), "capitals": "A" * SIZE,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    words = [(i, f"short text number {i} with words of its own w{i}", "en", "s", 40) for i in range(100, 130)]
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(LONG.values())] + words


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(8, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(100, 130)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact_dedup": lambda d, labels: exact_dedup(d),
    "license_scan": lambda d, labels: license_scan(d),
    "near_dedup": lambda d, labels: near_dedup(d),
    "secret_scan": lambda d, labels: secrets.secret_scan(d),
    "encoded_lengths": lambda d, labels: encoded_lengths(d),
    "toxicity": lambda d, labels: score_toxicity(d, train(d, labels)),
    "mix": lambda d, labels: mix(d),
    "fingerprints": lambda d, labels: document_fingerprints(d),
    "filter_audit": lambda d, labels: filter_audit(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, labels, name):
    began = time.perf_counter()
    found = OPERATORS[name](docs, labels).count()
    assert time.perf_counter() - began < 90
    assert found == (docs.count() if name != "filter_audit" else 4 * 600)


def test_packing(docs):
    began = time.perf_counter()
    assert pack(docs).select("doc_id").distinct().count() >= len(LONG)
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    began = time.perf_counter()
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).count() > 0
    assert time.perf_counter() - began < 120


def test_secrets_are_linear():
    for text in LONG.values():
        began = time.perf_counter()
        secrets.candidates(text, secrets.base_spans(text))
        assert time.perf_counter() - began < 3


def candidates_by_word(text, base):
    found, after = [], 0
    for word in secrets.SENSITIVE.finditer(text):
        at = max(word.end(), after)
        while at < word.end() + secrets.REACH and (m := secrets.CANDIDATE.search(text, at)) and m.start() < word.end() + secrets.REACH:
            at = after = m.end()
            if secrets.mixed(m.group()) and not any(a < m.end() and m.start() < b for a, b, _ in base):
                found.append((m.start(), m.end()))
    return found


def test_candidates_as_by_each_word():
    rng = random.Random(8)
    parts = ["token", "api_key", "Bearer ", " ", "  ", "é", "=", ": ", "a1" * 8, "Ab3" * 9, "0f" * 14, "x" * 20, "AKIA" + "Z9" * 10, "word ", "\n", "session_id", "Q7" * 30, " " * 40, "z" * 15 + "9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        base = secrets.base_spans(text)
        assert secrets.candidates(text, base) == candidates_by_word(text, base)


def test_first_words(spark):
    texts = ["a b", "  a\t b  c ", "a", "\n\x0b a  ", "😀 é\x85x  y", "a" + " " * 500_000 + "b" + " " * 500_000, " " * 1_000_000 + "a b"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(1, len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1)], "t string, n int")
    began = time.perf_counter()
    for r in df.select("t", "n", first_words(F.col("t"), F.col("n")).alias("head")).collect():
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["t"])]
        assert r["head"] == r["t"][: ends[r["n"] - 1]]
    assert time.perf_counter() - began < 20
