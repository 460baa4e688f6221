"""Toxicity, mixing, fingerprints, packing, the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import fingerprints as fp
from helixframe.llm.mixing import first_words, mix, mixed_documents
from helixframe.llm.packing import pack
from helixframe.llm.queries import ORACLE_SQL, QUERIES
from helixframe.llm.toxicity import Objective, ToxicityModel, accepted, features_of, fit, neutral_texts, score_toxicity, swapped, train, words_of
from tests.llm.fixtures import SCHEMA, documents
from tests.oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = rows_of(df)
    assert rows
    if name in ORACLE_SQL:
        names, expected = oracle_rows(ORACLE_SQL[name], sf_dir)
        assert sorted(df.columns) == names
        assert rows == expected


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in scored)
    caught = [r["predicted"] for r in scored if r["toxic"]]
    wrong = [r["predicted"] for r in scored if not r["toxic"]]
    assert np.mean(caught) > 0.85
    assert np.mean(wrong) < 0.01


def test_counterfactual_penalty():
    random.seed(2)
    rows = []
    for i in range(400):
        toxic = i % 2
        words = {f"w{random.randrange(40)}" for _ in range(10)}
        if toxic:
            words |= {"vile"} if random.random() < 0.7 else set()
            words |= {"muslims"} if random.random() < 0.6 else set()
        rows.append((toxic, " ".join(sorted(words))))
    features = ["muslims", "jews", "christians", "vile", *[f"w{i}" for i in range(40)]]
    places = {f: i for i, f in enumerate(features)}

    def coded(words):
        return sorted(places[w] for w in words if w in places)

    data = [(y, coded(words_of(t)), [coded(s) for s in swapped(t)]) for y, t in rows]
    plain, fair = fit(data, features, counterfactual=0.0), fit(data, features, counterfactual=5.0)
    assert swapped("Muslims are here.")[0] == {"jews", "are", "here"}
    assert plain.score("muslims live here") > 0.5 > fair.score("muslims live here")
    assert fair.score("a vile thing") > 0.5

    def gap(m):
        return abs(m.words.get("muslims", 0) - m.words.get("jews", 0))

    assert gap(fair) < gap(plain) / 3


def brute_loss(rows, neutral, w, bias, l2, counterfactual):
    n, positive = len(rows), sum(y for y, _, _ in rows)
    total = l2 / 2 * sum(x * x for x in w)
    for y, found, _ in rows:
        p = 1 / (1 + math.exp(-(bias + sum(w[i] for i in found))))
        total -= (y * math.log(p) + (1 - y) * math.log(1 - p)) / (2 * (positive if y else n - positive))
    changes = [sum(w[i] for i in s) - sum(w[i] for i in found) for found, swaps in [r[1:] for r in rows] + neutral for s in swaps if s != found]
    return total + counterfactual * sum(c * c for c in changes) / len(changes)


def test_loss_and_gradient():
    random.seed(3)
    some = lambda k: sorted(random.sample(range(12), k))
    rows = [(i % 3 == 0, some(random.randrange(6)), [some(4) for _ in range(random.randrange(3))]) for i in range(30)]
    rows = [(int(y), a, b) for y, a, b in rows]
    neutral = [(a := some(3), [a, some(2), some(3)]) for _ in range(5)]
    objective, w, bias = Objective(rows, neutral, 12, 0.1, 0.7), np.array([random.gauss(0, 1) for _ in range(12)]), 0.3
    loss, grad, grad_b = objective.at(w, bias)
    assert math.isclose(loss, brute_loss(rows, neutral, w, bias, 0.1, 0.7), rel_tol=1e-9)
    for i in range(12):
        step = np.eye(12)[i] * 1e-5
        slope = (brute_loss(rows, neutral, w + step, bias, 0.1, 0.7) - brute_loss(rows, neutral, w - step, bias, 0.1, 0.7)) / 2e-5
        assert math.isclose(grad[i], slope, rel_tol=1e-4, abs_tol=1e-7)
    slope = (brute_loss(rows, neutral, w, bias + 1e-5, 0.1, 0.7) - brute_loss(rows, neutral, w, bias - 1e-5, 0.1, 0.7)) / 2e-5
    assert math.isclose(grad_b, slope, rel_tol=1e-4, abs_tol=1e-7)


def test_neutral_mentions(spark):
    """Toxic words that open like an identity term, in rows that name no identity: neutral mentions stay under the threshold."""
    random.seed(5)
    rows, labels = [], []
    for i in range(1000):
        toxic = int(i % 2)
        words = [f"{a}{b}" for a, b in (random.sample("bdgklmnprst", 2) for _ in range(8))]
        words += random.sample(["buddhistische", "buddhistling", "immigrantly", "transgenderous", "vile", "scum"], 3) if toxic else []
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = train(docs, labels, counterfactual=0.0), train(docs, labels, counterfactual=20.0)
    wrong = [sum(m.score(t) >= 0.5 for t in neutral_texts()) for m in (plain, fair)]
    caught = [np.mean([m.score(t) >= 0.5 for i, t in rows if i % 2]) for m in (plain, fair)]
    assert wrong[1] < wrong[0] and caught[1] > 0.9, (wrong, caught)


def test_margin_is_that_of_features():
    random.seed(9)
    words = {"".join(random.choice("abc") for _ in range(random.randrange(1, 10))) for _ in range(300)}
    features = sorted(features_of(words))
    model = ToxicityModel(0.25, {f: random.gauss(0, 1) for f in random.sample(features, len(features) // 2)})
    for _ in range(50):
        some = set(random.sample(sorted(words), 40))
        assert math.isclose(model.margin(some), 0.25 + math.fsum(model.words.get(f, 0.0) for f in features_of(some)), abs_tol=1e-9)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    model = ToxicityModel(-1.0, {"alpha": 3.0})
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert accepted(docs, model).columns == docs.columns
    assert accepted(docs, model).count() == sum(not r["predicted"] for r in rows)
    labels = spark.createDataFrame([(None, 1), (3, None), (6, 0)], "doc_id long, toxic int")
    assert train(docs, labels).score("anything") < 0.5
    assert train(docs, labels.limit(0)).score(None) < 0.5
    assert features_of({"abcdef"}) == {"abcdef", "^abcd", "^abcde"}


def water_level(sizes, weights):
    capped, target = {}, {}
    total = sum(sizes.values()) * 1.5
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in sizes if s not in capped]
        target = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if target[s] >= 2 * sizes[s]}
        if not over:
            return target | capped
        capped |= over


def test_mix(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mix(docs, rows_per_range=7).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    level = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - level[r["source"]]) < 1e-6 * (1 + r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - level[s]) < 1
    again = mix(docs.repartition(3), rows_per_range=7).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_documents(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").encode().split())
    want = defaultdict(int)
    for r in mix(docs).collect():
        want[r["source"]] += r["taken"]
    assert words == want
    one = spark.createDataFrame([("  a b\tc ",)], "t string")
    assert one.select(first_words(one["t"], one["t"].isNull().cast("int") + 2)).first()[0] == "  a b"


def test_fingerprints(spark):
    rows = [r for r in documents()]
    found = {}
    for r in fp.document_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(r[1] or "")
    for i, texts in ids.items():
        assert sorted(r["n_chars"] for r in found[i]) == sorted(map(len, texts))
    order = sorted(ids, key=lambda i: (i is not None, i))
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        if len(ids[i]) == len(ids[j]) == 1:
            text, after, r = ids[i][0], ids[j][0], found[i][0]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["edited_fingerprint"] == fp.Document(0, edited).fingerprint
            assert r["fingerprint"] == fp.Document(0, text).fingerprint
            assert 0 <= r["near_edited"] <= 1
            assert r["near_next"] == fp.likeness(r["fingerprint"], found[j][0]["fingerprint"])
            if text == edited:
                assert r["near_edited"] == 1
    alone = fp.document_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert (alone["near_next"], alone["edited_sha256"]) == (1.0, hashlib.sha256(b"abcabc").hexdigest())


def brute_digests(rows):
    """(id, n_chars, edited_sha256, near_next) by the order of ids, null first, equal ids by any order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = fp.likeness(*(fp.Document(0, t).fingerprint for t in (text, after)))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near))
    return sorted(out)


@pytest.mark.parametrize("kind", ["high", "negative", "strings"])
def test_fingerprints_of_any_ids(spark, kind):
    random.seed(8)
    make = {"high": lambda i: (1 << 60) + i, "negative": lambda i: 3 * i - (1 << 62), "strings": lambda i: f"é{i % 7},{i:04}"}[kind]
    rows = [(make(i), "".join(random.choice("abc d") for _ in range(random.randrange(80)))) for i in range(500)]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'strings' else 'long'}, text string")
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in fp.document_fingerprints(docs, ranges=37).collect()]
    assert sorted(got) == brute_digests(rows)


def test_a_hot_id_is_mixed_over_ranges(spark):
    """Rows without ids get keys of their own from their texts, so that they fall into all ranges."""
    rows = [(None, f"word {i}", "s") for i in range(20_000)] + [(i, "w", "t") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(docs, rows_per_range=1000)
    assert found.agg(F.sum("taken")).first()[0] == found.select("source", "target").distinct().agg(F.sum(F.floor("target"))).first()[0]
    keys = [hashlib.md5(f":{hashlib.md5(t.encode()).hexdigest()}:mix".encode()).hexdigest()[:8] for i, t, _ in rows if i is None]
    per_range = np.bincount([int(k, 16) * 20 >> 32 for k in keys], minlength=20)
    assert per_range.min() > 800 and per_range.max() < 1200


def test_fingerprints_of_a_hot_id(spark):
    """Null and repeated ids are divided over ranges; every row comes out once."""
    rows = [(None, f"text {i}") for i in range(1000)] + [(7, f"other {i % 300}") for i in range(1000)] + [(i, "same") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = fp.range_bounds(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")), 40, len(rows)).collect()
    assert len(bounds) > 20 and sum(i is None for i, _ in bounds) > 5
    found = fp.document_fingerprints(docs, ranges=40).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in found) == sorted((str(i), len(t)) for i, t in rows)


def test_prefix_hashes():
    random.seed(7)
    for _ in range(30):
        a, b = ("".join(random.choice("ab😀é") for _ in range(random.randrange(120))) for _ in range(2))
        x, y = fp.PrefixHash(fp.code_points(a)), fp.PrefixHash(fp.code_points(b))
        for _ in range(20):
            i, j, n = random.randrange(len(a) + 1), random.randrange(len(b) + 1), random.randrange(5)
            if i + n <= len(a) and j + n <= len(b):
                assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.common_extension(i, y, j) == k
    joined = "".join(chr(random.randrange(97, 123)) for _ in range(3000))
    near = fp.likeness(*(fp.Document(0, t).fingerprint for t in (joined, joined[:1500] + joined[1510:])))
    assert near > 0.9


def brute_pack(pieces, capacity):
    bins = []
    for size, source, cluster in pieces:
        fits = [b for b in bins if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        chosen = min(fits, key=lambda b: b["room"]) if fits else {"room": capacity, "sources": set(), "clusters": set()}
        if not fits:
            bins.append(chosen)
        chosen["room"] -= size
        chosen["sources"].add(source)
        chosen["clusters"].add(cluster)
    return len(bins), sorted(b["room"] for b in bins)


def test_bins_are_tightest():
    from helixframe.llm.packing import Bins

    random.seed(4)
    for _ in range(20):
        pieces = sorted(((random.randrange(0, 30), random.randrange(6), random.randrange(40)) for _ in range(200)), reverse=True)
        bins = Bins(40)
        for p in pieces:
            bins.place(*p)
        assert (len(bins.used), sorted(40 - u for u in bins.used)) == brute_pack(pieces, 40)


@pytest.mark.parametrize("rows_per_shard", [8_000, 9])
def test_pack(spark, rows_per_shard):
    rows = documents()
    found = pack(spark.createDataFrame(rows, SCHEMA), bin_words=64, rows_per_shard=rows_per_shard).collect()
    words = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        words[r["doc_id"]] += r["size"]
        bins[r["shard"], r["bin"]].append(r)
    expected = defaultdict(int)
    for r in rows:
        expected[r[0]] += len((r[1] or "").encode().split())
    assert words == expected
    assert len({(r["doc_id"], r["piece"]) for r in found}) >= len({r[0] for r in rows})
    for pieces in bins.values():
        assert sum(r["size"] for r in pieces) <= 64
        sources = [r["source"] for r in pieces if r["source"] is not None]
        assert len(sources) == len(set(sources))
        spans = sorted((r["offset"], r["offset"] + r["size"]) for r in pieces)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name in ("toxicity", "exact_dedup", "simhash_near_dedup"):
            before = {(r["doc_id"], r["text"]) for r in seen.collect()}
            left = [(r["doc_id"], r["text"]) for r in after.collect()]
            assert set(left) <= before
            assert len(left) == len(set(left))
        if name == "exact_dedup":
            texts = [" ".join(t.split()) for _, t in left]
            assert len(texts) == len(set(texts))
        seen = after
    assert seen.count() == corpus_pipeline.run(spark, sf_dir).count()


CLASHING = ("_id", "_key", "_rows", "_part", "_size", "_taken", "_first", "_kept", "_rid", "doc", "part", "cut", "node", "root", "fp", "h", "bin")


def test_stages_take_odd_rows(spark, sf_dir):
    odd = spark.createDataFrame(documents(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    odd = odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        rows = out.collect()
        assert rows
        if name != "best_fit_packing":
            assert out.columns == odd.columns
            assert {tuple(r[c] for c in CLASHING) for r in rows} == {tuple(f"own {c}" for c in CLASHING)}
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(docs).count() == fp.document_fingerprints(docs).count() == pack(docs).count() == mixed_documents(docs).count() == 0
    assert score_toxicity(docs, ToxicityModel()).count() == 0


