"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text. In training, identity terms of labelled
sentences are swapped for other terms of their kind, and the squared change of the score
is added to the loss: a weight that a group mention gained from the company it keeps in
the labelled rows costs more than it brings, so neutral mentions stay neutral. Neutral
sentences about every identity term are swapped as well, so that the penalty also holds
down word openings that such terms share with other words, whatever the labelled rows say.
Training fits a bounded, hash-chosen sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import settle, text_of

#: The most labelled rows a model is fitted on; those with the smallest hash of their id.
MAX_LABELLED = 8_000
#: The most swapped versions of one labelled row.
MAX_SWAPS = 4
THRESHOLD = 0.5
#: Lengths of word openings that are features.
PREFIXES = (4, 5, 6, 7, 8)

# Identity terms by kind, in English, German, Spanish and French.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"),
    ("muslime", "juden", "christen"),
    ("mujeres", "hombres"),
    ("musulmanes", "judíos", "cristianos"),
    ("femmes", "hommes"),
    ("musulmans", "juifs", "chrétiens"),
)

# Neutral sentences about an identity term, in the same languages.
NEUTRAL = ("We met {} people at the market today.", "My neighbours are {}.", "Unsere Nachbarn sind {}.", "Nuestros vecinos son {}.", "Nos voisins sont {}.")
#: Words whose weights a scoring process remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and the openings of longer ones: languages that compound or inflect need them.

    An opening is marked by ^, and by ^^ or ^^^ as well where two or three different words have it.
    """
    found = set(words)
    for n in PREFIXES:
        for opening, times in Counter([w[:n] for w in words if len(w) > n]).items():
            found.update("^" * i + opening for i in range(1, min(times, 3) + 1))
    return found


def swapped(text: str, kinds=IDENTITY_TERMS, most: int = MAX_SWAPS) -> list[set[str]]:
    """Word sets of the text with the identity terms of its sentences moved on by 1, 2, ... places in their kind."""
    place = {term: (kind, i) for kind in kinds for i, term in enumerate(kind)}
    lowered = (text or "").lower()
    sentences = [_WORD.findall(s) for s in _SENTENCE.findall(lowered)]
    named = [i for i, s in enumerate(sentences) if any(w in place for w in s)]
    if not named:
        return []
    steps = min(most, max(len(place[w][0]) - 1 for i in named for w in sentences[i] if w in place))
    out = []
    for step in range(1, steps + 1):
        found: set[str] = set()
        for sentence in sentences:
            for w in sentence:
                kind, i = place.get(w, ((w,), 0))
                found.add(kind[(i + step) % len(kind)])
        out.append(found)
    return out


@dataclass
class ToxicityModel:
    """Weights by feature; words and openings without one weigh nothing."""

    bias: float = 0.0
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.openings = {f.lstrip("^") for f in self.words if f.startswith("^")}
        self.lengths = sorted({len(o) for o in self.openings})
        self.known: dict[str, tuple[float, tuple[str, ...]]] = {}

    def parts(self, word: str) -> tuple[float, tuple[str, ...]]:
        """The word's own weight, and its openings that have one."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            openings = tuple(word[:n] for n in self.lengths if len(word) > n and word[:n] in self.openings)
            found = self.known[word] = (self.words.get(word, 0.0), openings)
        return found

    def margin(self, words: set[str]) -> float:
        """The bias and the weights of features_of(words), summed exactly, so in any order."""
        weights, times = [], {}
        for word in words:
            own, openings = self.parts(word)
            if own:
                weights.append(own)
            for opening in openings:
                times[opening] = times.get(opening, 0) + 1
        for opening, n in times.items():
            weights += [self.words.get("^" * i + opening, 0.0) for i in range(1, min(n, 3) + 1)]
        return self.bias + math.fsum(weights)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(words_of(text)), -500, 500))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for f in features_of(words_of(text)):
                seen.setdefault(f, [0, 0])[label > 0] += 1
        clean, toxic = (pa.array([n[i] for n in seen.values()], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), clean, toxic], names=["feature", "clean", "toxic"])


def choose_features(sample: DataFrame, clean: int, toxic: int, min_rows: int, min_share: float, min_chi2: float) -> list[str]:
    """Features of (toxic, text) rows that tell the labels apart, in order of code points.

    Those in fewer than min_rows rows, in less than min_share of either label's rows, or
    with a smaller chi-square against the label are left out. How many there can be is
    bounded by the features of the sample's rows divided by min_share.
    """
    counts = sample.mapInArrow(_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    a, b, c, d = (x.cast("double") for x in (F.col("a"), F.col("b"), F.lit(toxic) - F.col("a"), F.lit(clean) - F.col("b")))
    chi2 = (clean + toxic) * (a * d - b * c) * (a * d - b * c) / ((a + b) * F.greatest(c + d, F.lit(1e-9)) * clean * toxic)
    kept = counts.filter((a + b >= min_rows) & (F.greatest(a / toxic, b / clean) >= min_share) & (chi2 >= min_chi2) & (c + d > 0))
    return sorted(r["feature"] for r in kept.select("feature").collect())


def _known(features: list[str]):
    index = {f: i for i, f in enumerate(features)}
    return lambda words: sorted(index[f] for f in features_of(words) if f in index)


def _places(kinds, features: list[str]):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(features)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = pa.array([known(words_of(t)) for t in texts], pa.list_(pa.int32()))
            swaps = pa.array([[known(s) for s in swapped(t, kinds)] for t in texts], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), found, swaps], names=["toxic", "found", "swaps"])

    return places


def _ones(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and column numbers."""
    sizes = [len(r) for r in rows]
    columns = np.fromiter((c for r in rows for c in r), np.int64, sum(sizes))
    return np.repeat(np.arange(len(rows)), sizes), columns


class Objective:
    """The smooth part of the loss: balanced logistic loss of rows, l2, and the mean squared score change of swaps.

    rows are (toxic, places in features, the same of each swapped version); neutral ones
    (places, swapped versions) have no label and count in the last part only.
    """

    def __init__(self, rows, neutral, features: int, l2: float, counterfactual: float):
        self.y = np.array([r[0] for r in rows] + [0] * len(neutral), np.float64)
        n, positive = len(rows), float(self.y.sum())
        self.m, self.n, self.l2, self.counterfactual = features, n, l2, counterfactual
        self.weight = np.where(self.y > 0, n / (2 * positive), n / (2 * (n - positive))) / n
        self.weight[n:] = 0
        every = [(r[1], r[2]) for r in rows] + list(neutral)
        self.ri, self.ci = _ones([found for found, _ in every])
        origin = [(i, s) for i, (found, swaps) in enumerate(every) for s in swaps if s != found]
        self.si, self.sc = _ones([s for _, s in origin])
        self.of = np.array([i for i, _ in origin], np.int64)
        changed = [len(set(s) ^ set(every[i][0])) for i, s in origin]
        longest = max(np.bincount(self.ri, minlength=len(every)).max(), 1)
        #  a swap's curvature is the number of features it changes; the mean bounds that of all of them
        self.curvature = 0.05 * self.weight.max() * n * (longest + 1) + l2 + (2 * counterfactual * float(np.mean(changed)) if changed else 0)

    def at(self, v: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """The loss, its gradient by the weights and by the bias."""
        count = len(self.y)
        margin = np.bincount(self.ri, weights=v[self.ci], minlength=count)
        z = np.clip(margin + bias, -500, 500)
        g = self.weight * (1 / (1 + np.exp(-z)) - self.y)
        loss = float(self.weight @ (np.logaddexp(0, z) - self.y * z)) + self.l2 / 2 * float(v @ v)
        grad = np.bincount(self.ci, weights=g[self.ri], minlength=self.m) + self.l2 * v
        if len(self.of):
            change = np.bincount(self.si, weights=v[self.sc], minlength=len(self.of)) - margin[self.of]
            loss += self.counterfactual * float(np.mean(change**2))
            h = 2 * self.counterfactual * change / len(self.of)
            back = np.bincount(self.of, weights=h, minlength=count)
            grad += np.bincount(self.sc, weights=h[self.si], minlength=self.m) - np.bincount(self.ci, weights=back[self.ri], minlength=self.m)
        return loss, grad, float(g.sum())


def fit(
    rows: list[tuple[int, list[int], list[list[int]]]],
    features: list[str],
    neutral: list[tuple[list[int], list[list[int]]]] = (),
    l1: float = 1e-3,
    l2: float = 1e-5,
    counterfactual: float = 1.0,
    rounds: int = 400,
) -> ToxicityModel:
    """Fit Objective's loss and l1 by accelerated proximal gradient.

    Without rows of both labels, or without features, the model scores everything alike.
    """
    n, positive = len(rows), float(sum(r[0] for r in rows))
    if not n or positive in (0, n):
        return ToxicityModel(bias=-5.0 if not positive else 5.0)
    if not features:
        return ToxicityModel(bias=float(np.log(positive / (n - positive))))
    objective = Objective(rows, neutral, len(features), l2, counterfactual)
    step = 1 / objective.curvature
    w, v, bias, vb, t = np.zeros(len(features)), np.zeros(len(features)), 0.0, 0.0, 1.0
    for _ in range(rounds):
        _, grad, grad_b = objective.at(v, vb)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b, new_t = vb - step * grad_b, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - bias)
        w, bias, t = new, new_b, new_t
    return ToxicityModel(float(bias), {f: float(x) for f, x in zip(features, w, strict=True) if x})


def neutral_texts(kinds=IDENTITY_TERMS) -> list[str]:
    return [frame.format(term) for kind in kinds for term in kind for frame in NEUTRAL]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    identity_terms=IDENTITY_TERMS,
    max_labelled: int = MAX_LABELLED,
    min_rows: int = 5,
    min_share: float = 0.03,
    min_chi2: float = 20.0,
    **fitting,
) -> ToxicityModel:
    """A model from the labelled rows whose id isn't held out.

    labels with a null id or label are left out; of several for an id the largest counts.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    sample = settle(texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("toxic", "text").distinct())
    clean, toxic = (r or 0 for r in sample.agg(F.sum(F.expr("int(toxic = 0)")), F.sum(F.expr("int(toxic > 0)"))).first())
    features = choose_features(sample, clean, toxic, min_rows, min_share, min_chi2) if clean and toxic else []
    found = sample.mapInArrow(_places(identity_terms, features), "toxic int, found array<int>, swaps array<array<int>>")
    rows = sorted((int(r["toxic"] > 0), r["found"], r["swaps"]) for r in found.collect())
    known = _known(features)
    neutral = [(known(words_of(t)), [known(s) for s in swapped(t, identity_terms)]) for t in neutral_texts(identity_terms)]
    return fit(rows, features, neutral, **fitting)


def held_out(id_col: str):
    """Rows that no model learns from: crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: (id, held_out, score, predicted).

    A null text scores as an empty one, by the model's bias alone. predicted is 1 from
    threshold on. Repeated rows are scored each for itself; an empty table gives no rows;
    other columns are not read.
    """
    scoring = F.pandas_udf(lambda texts: texts.map(model.score), "double")
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scoring(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with their columns."""
    scoring = F.pandas_udf(lambda texts: texts.map(model.score), "double")
    return docs.filter(scoring(text_of(text_col)) < threshold)
