"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm.exact_dedup import drop_copies, exact_dedup
from helixframe.llm.simhash import BKTree, block_tasks, components, drop_near_copies, fingerprint, fingerprint_links, near_dedup, shards, shingle_hashes, similar_components
from tests.llm.fixtures import SCHEMA, documents

WS = re.compile(r"[\x20\x09-\x0D]+")


def expected_exact(rows):
    norm = [WS.sub(" ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm, strict=True):
        groups[t].append(r[0])
    out = []
    for r, t in zip(rows, norm, strict=True):
        ids = [i for i in groups[t] if i is not None]
        out.append((r[0], min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_chars", "hash_bits"), [(4096, 64), (7, 64), (3, 2)])
def test_exact_dedup(spark, block_chars, hash_bits):
    rows = documents()
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA), block_chars=block_chars, hash_bits=hash_bits).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=str) == expected_exact(rows)
    kept = defaultdict(int)
    for r in found:
        kept[r["text_sha256"]] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_where_blocks_and_row_keys_collide(spark, monkeypatch):
    monkeypatch.setattr("helixframe.llm.exact_dedup.row_key", lambda column: F.lit(0).cast("long"))
    rows = documents()
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA), hash_bits=1).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=str) == expected_exact(rows)


def test_drop_copies(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    texts = [WS.sub(" ", r["text"] or "") for r in left.collect()]
    assert sorted(texts) == sorted({WS.sub(" ", r[1] or "") for r in rows})


def naive_print(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, radius):
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and (a ^ b).bit_count() <= radius:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in up}


@pytest.mark.parametrize("shard_rows", [512, 3])
def test_near_dedup(spark, shard_rows):
    rows = documents()
    prints = [naive_print(r[1], 3) for r in rows]
    root = brute_components(set(prints), 2)
    low = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        low[root[p]] += [r[0]] if r[0] is not None else []
    expected = sorted([(r[0], f"{p:016x}", min(low[root[p]], default=None)) for r, p in zip(rows, prints, strict=True)], key=str)
    found = near_dedup(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()], key=str) == expected


def test_links_of_dense_clusters(spark):
    """Shards over the bound are dealt again without losing a link."""
    random.seed(5)
    values = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(random.randrange(5)):
                v ^= 1 << random.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    links = fingerprint_links(spark.createDataFrame(signed, "fp long"), 2, shard_rows=4).collect()
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    up = {v: v for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert {v: top(v) for v in values} == brute_components(values, 2)
    assert len(pairs) <= 4 * 81 * len(values)
    assert len(shards(spark.createDataFrame(signed, "fp long"), 2, 4)) > 1


def test_components(spark):
    """A star, a chain, a ring and no links at all; with a hot node whose join Spark may split."""
    random.seed(6)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    links = [(a, b) if random.random() < 0.5 else (b, a) for a, b in links]
    expected = {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(31)} | {2000 + i: 2000 for i in range(9)}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(expected) and {r["node"]: r["root"] for r in found} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_bk_tree():
    random.seed(1)
    values = [random.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for v in values[:80]]
    tree = BKTree()
    for i, v in enumerate(values):
        for r in (0, 2, 20):
            assert sorted(tree.near(v, r)) == sorted({x for x in values[:i] if (x ^ v).bit_count() <= r})
        tree.add(v)


def test_fingerprint_of_long_text():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(shingle_hashes(text[:4000], 3)) == naive_print(text[:4000], 3)
    assert len(shingle_hashes(text, 3)) == 69_998
    assert fingerprint(shingle_hashes(None, 3)) == 0


def test_near_copies_of_stated_similarity(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(5000)]
    rows, i = [], 0
    for _ in range(30):
        base = [random.choice(words) for _ in range(300)]
        rows.append((i, " ".join(base), "en", "s", 0, None, None, None, None))
        for _ in range(3):
            copy = list(base)
            for at in random.sample(range(300), 3):
                copy[at] = random.choice(words)
            i += 1
            rows.append((i, " ".join(copy), "en", "s", 0, None, None, None, None))
        i += 1
    left = [r["doc_id"] for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(left) == [4 * k for k in range(30)]
    odd = documents()
    kept = drop_near_copies(spark.createDataFrame(odd, SCHEMA))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert {r["text"] for r in kept.collect()} <= {r[1] for r in odd}


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_similar(texts, least=0.8):
    """The smallest place that each text reaches over pairs of that exact share of distinct shingles."""
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= least:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def similar(spark, texts, **bounds):
    rows = [(i, t, "en", "s", 0, None, None, None, None) for i, t in enumerate(texts)]
    found = similar_components(spark.createDataFrame(rows, SCHEMA), **bounds).collect()
    return [c for _, c in sorted((r["_id"], r["component_id"]) for r in found)]


def test_near_copies_with_repeated_lines(spark):
    random.seed(7)
    words, texts = [f"w{i}" for i in range(5000)], []
    for i in range(24):
        base = [random.choice(words) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(1 + i % 2):
            base += [random.choice(words) for _ in range(8)] * (20, 50, 100)[i % 3]
        texts.append(" ".join(base))
    expected = brute_similar(texts)
    assert expected == [i - i % 2 for i in range(48)]
    assert similar(spark, texts) == expected


def test_near_copies_in_divided_shards(spark):
    """Groups whose copies are near their middle only: small shards lose no link that undivided ones have."""
    random.seed(9)
    words, texts = [f"w{i}" for i in range(5000)], []
    for _ in range(12):
        base = [random.choice(words) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for k in range(6):
                copy[50 * k + random.randrange(5, 45)] = random.choice(words)
            texts.append(" ".join(copy))
    undivided = similar(spark, texts)
    assert len(set(undivided)) < 24
    assert similar(spark, texts, shard_rows=3) == undivided == similar(spark, texts, shard_rows=64)
    expected = brute_similar(texts)
    pairs = lambda labels: {(i, j) for i in range(len(labels)) for j in range(i) if labels[i] == labels[j]}
    assert pairs(undivided) <= pairs(expected)
    assert len(pairs(undivided)) >= 0.95 * len(pairs(expected))


def test_near_copies_by_exact_share(spark):
    """Pairs from 0.74 to 0.88 are linked exactly when four fifths of their distinct shingles agree."""
    random.seed(13)
    words, texts = [f"w{i}" for i in range(5000)], []
    for i in range(60):
        base = [random.choice(words) for _ in range(300)]
        copy = list(base)
        for k in range(4 + i % 6):
            copy[30 * k + random.randrange(5, 25)] = random.choice(words)
        texts += [" ".join(base), " ".join(copy)]
    expected = brute_similar(texts)
    assert 70 < len(set(expected)) < 100
    assert similar(spark, texts) == expected


def test_block_tasks(spark):
    """Rows of one shard and different roots meet; a group's own blocks do not."""
    random.seed(2)
    rows = [(s, 100 * s + i, 100 * s if i < 40 else 100 * s + i - i % (1 + s)) for s in range(3) for i in range(60)] + [(9, i, 7) for i in range(50)]
    tasks = defaultdict(set)
    for r in block_tasks(spark.createDataFrame([(*r, 1) for r in rows], "shard long, node long, root long, weight long"), 8).collect():
        tasks[r["task"]].add((r["node"], r["root"]))
    met = {(a, b) for members in tasks.values() for a, _ in members for b, _ in members}
    assert all((a, b) in met for s, a, r in rows for t, b, q in rows if s == t and r != q)
    assert max(len(members) for members in tasks.values()) <= 24
    assert all(len({root for _, root in members}) > 1 for members in tasks.values() if len(members) > 8)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).count() == near_dedup(docs).count() == drop_copies(docs).count() == drop_near_copies(docs).count() == 0
