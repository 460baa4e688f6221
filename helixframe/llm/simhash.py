"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit set where more than half of the hashes of its shingles
have it set. Distinct fingerprints are searched in BK-trees, whose children are keyed by
their Hamming distance to the parent, so that a search follows only the edges within the
radius of the query's distance.

A tree over all fingerprints would grow with the data, and so would its broadcast. Trees
are built over shards instead, to which fingerprints are shuffled: with radius r the bits
are cut into r + 1 fields, and two fingerprints within the radius agree in one field at
least, so each fingerprint goes to one shard for each field. A shard over the size bound is
dealt again by the fields of its remaining bits, until shards are small or few bits are
left; nothing is dropped. A shard gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import matching_rows, row_key, settle, text_of

SHINGLE_WORDS = 3
RADIUS = 2
SHARD_ROWS = 512
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if they are fewer than a shingle's."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: -words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned; 0 where there are no hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        some = np.ascontiguousarray(hashes[a : a + 65_536].astype(">u8"))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int) -> list[int]:
        """The members within the radius."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if len(children) <= 2 * radius:
                stack.extend(child for key, child in children.items() if d - radius <= key <= d + radius)
            else:
                stack.extend(children[key] for key in range(d - radius, d + radius + 1) if key in children)
        return found

    def add(self, value: int) -> None:
        at = self.root = self.root or [value, {}]
        while d := (at[0] ^ value).bit_count():
            at = at[1].setdefault(d, [value, {}])


class Forest:
    """Union-find over the members of a shard."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        rows = pa.Table.from_batches([batch])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def _fields(bits: list[int], parts: int) -> list[list[int]]:
    return [part.tolist() for part in np.array_split(np.array(bits), parts)]


def _pick(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def shards(prints: DataFrame, radius: int, shard_rows: int) -> list[DataFrame]:
    """(shard, fp) tables in which every two fingerprints within the radius share a shard.

    Shards of one fingerprint are left out. A shard is named by a hash of the fields its
    members agree in; the chance that two names meet costs search time, never a link. The
    levels end when no shard is over shard_rows, or when the bits that members may differ
    in are so few that a shard is bounded by them.
    """
    tables: list[DataFrame] = []
    base = prints.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"))
    paths = [list(range(64))]
    while True:
        following: list[list[int]] = []
        choices = F.lit(None).cast("array<struct<path:int,shard:bigint>>")
        for at, bits in enumerate(paths):
            options = []
            for field in _fields(bits, radius + 1):
                options.append(
                    F.struct(F.lit(len(following)).alias("path"), F.xxhash64("shard", F.lit(len(following)), _pick(F.col("fp"), field)).alias("shard"))
                )
                following.append([b for b in bits if b not in field])
            choices = F.when(F.col("path") == at, F.array(*options)).otherwise(choices)
        dealt = base.select("fp", F.explode(choices).alias("to")).select("fp", "to.path", "to.shard")
        sizes = settle(dealt.groupBy("shard", "path").agg(F.count("*").alias("n")).filter("n > 1"))
        last = len(following[0]) <= 13
        small = sizes if last else sizes.filter(F.col("n") <= shard_rows)
        tables.append(dealt.join(small.select("shard", "path"), ["shard", "path"]).select("shard", "fp"))
        large = sizes.filter(F.col("n") > shard_rows)
        if last or large.isEmpty():
            return tables
        base, paths = settle(dealt.join(large.select("shard", "path"), ["shard", "path"])), following


def _tree_links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs(batches, "shard"):
            tree, forest, a, b = BKTree(), Forest(), [], []
            for value in shard["fp"].to_pylist():
                for near in tree.near(value & (2**64 - 1), radius):
                    if forest.join(value & (2**64 - 1), near):
                        a.append(value)
                        b.append(near - (1 << 64) if near >= 1 << 63 else near)
                tree.add(value & (2**64 - 1))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a forest for each shard, together as connected as all pairs of prints (fp) within the radius."""
    out = None
    for rows in shards(prints, radius, shard_rows):
        found = rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_tree_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


#: Rows of a partition of the tables of links.
LINKS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, for every node in them.

    Large-star and small-star rounds: each hangs a node's larger (then smaller)
    neighbours on the smallest one, until nothing changes. Each node's least neighbour is
    read from a table, so that Spark can split a node with many links on the other side
    of the join. Tables are kept in partitions of about LINKS_PER_TASK rows, for rounds
    over few links in many partitions would be all overhead.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count = edges.count()
    if not count:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    parts = -(-2 * count // LINKS_PER_TASK)  # rounds never have more than both directions of them

    def kept(df: DataFrame) -> DataFrame:
        return settle(df.coalesce(parts))

    edges, before = kept(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large)
        down = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = kept(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now


def _prints(words: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(found.view(np.int64))], names=["_id", "_key", "fp"])

    return prints


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per row of docs: (id, fingerprint, component_id, _key).

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable over
    links of fingerprints that differ in radius bits or fewer, nulls aside (null where a
    component has no id). Texts without words, null ones included, have fingerprint
    zero and are linked like any other. Repeated rows share a fingerprint and so a
    component. An empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_key"), text_of(text_col).alias("text"))
    rows = settle(rows.mapInArrow(_prints(words), f"_id {kind}, _key long, fp long"))
    prints = settle(rows.groupBy("fp").agg(F.min("_id").alias("low")))
    roots = settle(components(fingerprint_links(prints.select("fp"), radius, shard_rows)))
    joined = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = settle(joined.groupBy("root").agg(F.min("low").alias("component_id")))
    labels = joined.join(lows, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_key"
    )


# Near copies at a stated similarity. Documents of which four fifths of the five-word
# shingles agree differ in up to a quarter of a fingerprint's bits, where fields of equal
# bits no longer narrow a search. Shards are therefore dealt by bands of minima of the
# shingles; within a shard a BK-tree gives the fingerprints within the wider radius,
# minima of more hash functions choose candidates, and the texts' shingles confirm them
# in the same task, which gives a forest of confirmed links and never a list of pairs.

SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Sets of distinct shingles that share four fifths are at most acos(2 * 0.8 / 1.8) apart, so that a bit differs
#: with chance 0.152 and more than 26 bits with chance 2e-7; for sets of a few shingles (4 of 5) 0.188 and 1.3e-5.
SIMILAR_RADIUS = 26
MINIMA = 512
BANDS, BAND_MINIMA = 16, 5
#: Estimates of 0.8 have a standard deviation of 0.018; pairs this little under the similarity are still candidates (a pair at 0.8 is missed with chance 1e-5).
MARGIN = 0.08
#: A shard's bound, where a text counts once for each WEIGHT_CHARS code points it has begun.
SIMILAR_SHARD_ROWS = 1024
WEIGHT_CHARS = 16_000
#: The most keys of texts, 8 bytes each, that are broadcast.
BROADCAST_KEYS = 500_000

_ODD = (np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of MINIMA hash functions over the shingles."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 256):
        np.minimum(low, (hashes[a : a + 256, None] * _ODD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketches(words: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands, sketch, nodes, weights = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                weights.append(1 + len(text) // WEIGHT_CHARS)
                hashes = np.unique(shingle_hashes(text, words))
                low = minima(hashes)
                prints.append(fingerprint(hashes))
                rows = low[: BANDS * BAND_MINIMA].reshape(BANDS, BAND_MINIMA)
                bands.append([xxhash.xxh64_intdigest(row.tobytes(), seed=b) for b, row in enumerate(rows)])
                sketch.append(low.astype(np.uint8).tobytes())
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED))
            columns = [
                batch.column("_id"),
                batch.column("_key"),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.array(list(np.array(bands, np.uint64).reshape(-1, BANDS).view(np.int64)), pa.list_(pa.int64())),
                pa.array(sketch, pa.binary()),
                pa.array(weights, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "node", "fp", "bands", "sketch", "weight"])

    return sketches


def _similar_links(words: int, radius: int, similarity: float, least: float):
    """Links of different roots whose exact share of distinct shingle hashes is similarity or more, a forest of them for each task."""

    def of_task(rows: pa.Table) -> list[tuple[int, int]]:
        tree, forest, by_print, found = BKTree(), Forest(), {}, []
        nodes, roots, texts = rows["node"].to_pylist(), rows["root"].to_pylist(), rows["text"]
        low = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(nodes), MINIMA)
        shingles: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in shingles:
                shingles[i] = np.unique(shingle_hashes(texts[i].as_py(), words))
            return shingles[i]

        for i, value in enumerate(rows["fp"].to_pylist()):
            value &= 2**64 - 1
            others = [j for x in tree.near(value, radius) for j in by_print[x] if forest.top(roots[j]) != forest.top(roots[i])]
            tree.add(value)
            by_print.setdefault(value, []).append(i)
            if not others:
                continue
            same = 1 - (low[others] != low[i]).mean(axis=1) * 256 / 255  # one byte agrees by chance once in 256
            for k in np.argsort(-same, kind="stable").tolist():  # the likeliest first: what it links needs no other
                if same[k] < least:
                    break
                j = others[k]
                if forest.top(roots[i]) != forest.top(roots[j]):
                    a, b = of(i), of(j)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if common >= similarity * (len(a) + len(b) - common):
                        forest.join(roots[i], roots[j])
                        found.append((nodes[i], nodes[j]))
        return found

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "task"):
            if found := of_task(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return links


def first_tasks(dealt: DataFrame, sizes: DataFrame, shard_rows: int) -> DataFrame:
    """(task, node, root): shards in whole, those over shard_rows in blocks of about that many rows; each node its own root.

    Every band's blocks are other ones, so that a large group of near copies comes
    together over its bands before its blocks meet.
    """
    block = F.pmod(F.xxhash64("node", "shard"), F.ceil(F.col("rows") / shard_rows))
    return dealt.join(sizes, "shard").select(F.xxhash64("shard", block).alias("task"), "node", F.col("node").alias("root"))


def block_tasks(rooted: DataFrame, shard_rows: int) -> DataFrame:
    """(task, node, root) in which every two rows (shard, node, root, weight) of one shard and of different roots share a task.

    The rows of a shard are cut into blocks of about half of shard_rows, large roots into
    blocks of their own. A task has two blocks; those of one root need not meet, so a
    shard that is one group nearly costs its stray rows times its size. Tasks are named
    by hashes; the chance that two names meet costs search time, never a link.
    """
    half = max(1, shard_rows // 2)
    groups = settle(rooted.groupBy("shard", "root").agg(F.sum("weight").alias("n")))
    loose = F.sum(F.when(F.col("n") < half, F.col("n")).otherwise(0)).alias("loose")
    shards_left = groups.groupBy("shard").agg(F.count("*").alias("roots"), F.sum("n").alias("rows"), loose).filter("roots > 1").drop("roots")
    groups = groups.join(shards_left, "shard")
    whole = (F.col("n") >= half) & (F.col("rows") > shard_rows)
    part = F.when(whole, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / half)))
    part = part.when(F.col("rows") > shard_rows, F.pmod(F.xxhash64("root"), F.ceil(F.col("loose") / half))).otherwise(0)
    alone = F.when(whole, F.col("root"))
    placed = rooted.join(groups, ["shard", "root"]).select("shard", "node", "root", alone.alias("alone"), F.xxhash64("shard", alone, part).alias("block"))
    placed = settle(placed)
    blocks = settle(placed.select("shard", "block", "alone").distinct())
    other = blocks.select("shard", F.col("block").alias("block2"), F.col("alone").alias("alone2"))
    apart = F.col("alone").isNull() | F.col("alone2").isNull() | (F.col("alone") != F.col("alone2"))
    met = blocks.join(other, (blocks["shard"] == other["shard"]) & (F.col("block") <= F.col("block2")) & apart)
    met = met.select(F.xxhash64("block", "block2").alias("task"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return placed.join(met, "block").select("task", "node", "root")


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SIMILAR_WORDS,
    similarity: float = SIMILARITY,
    radius: int = SIMILAR_RADIUS,
    shard_rows: int = SIMILAR_SHARD_ROWS,
) -> DataFrame:
    """One row per row of docs: (_id, _key, component_id, first).

    Two documents are linked when the share of their distinct shingles that they have in
    common is similarity or more; minima only choose the pairs that are compared, whole
    texts decide. component_id is the smallest id reachable; first marks one row of each
    component, the one of smallest id (of repeated rows any one). Texts without words are
    alike. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_key"), text_of(text_col).alias("text"))
    rows = settle(keyed.mapInArrow(_sketches(words), f"_id {kind}, _key long, node long, fp long, bands array<long>, sketch binary, weight long"))
    nodes = settle(rows.drop("_id").dropDuplicates(["node"]))

    def near(tasks: DataFrame) -> DataFrame:
        #  only texts of rows that have a task are read again
        asked = settle(nodes.join(tasks.select("node").distinct(), "node").select("node", "_key", "fp", "sketch"))
        wanted = asked.select("_key")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        texts = keyed.select("_key", "text").join(wanted, "_key", "left_semi").groupBy("_key").agg(F.max("text").alias("text"))
        tasks = tasks.join(asked.join(texts, "_key").drop("_key"), "node").repartition("task").sortWithinPartitions("task", "node")
        pairs = tasks.mapInArrow(_similar_links(words, radius, similarity, similarity - MARGIN), "a long, b long")
        return settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    dealt = nodes.select("node", "weight", F.explode("bands").alias("shard"))
    sizes = settle(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.sum("weight").alias("rows")).filter("n > 1").drop("n"))
    found = near(first_tasks(dealt, sizes, shard_rows))
    large = settle(sizes.filter(F.col("rows") > shard_rows).select("shard"))
    roots = settle(components(found))
    if not large.isEmpty():  # blocks of a divided shard meet where they hold different groups
        own = roots.withColumnRenamed("node", "own")
        rooted = dealt.join(large, "shard").join(own, F.col("node") == F.col("own"), "left")
        rooted = settle(rooted.select("shard", "node", "weight", F.coalesce("root", "node").alias("root")))
        more = near(block_tasks(rooted, shard_rows))
        if not more.isEmpty():
            roots = settle(components(found.unionByName(more)))
    marked = rows.select("_id", "_key", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    marked = settle(marked.select("_id", "_key", F.coalesce("root", "own").alias("root"), F.monotonically_increasing_id().alias("_rid")))
    lowest = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("low"), F.col("_rid").alias("rid")))
    lows = settle(marked.groupBy("root").agg(lowest.alias("lowest")))
    return marked.join(lows, "root").select("_id", "_key", F.col("lowest.low").alias("component_id"), (F.col("_rid") == F.col("lowest.rid")).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **similar) -> DataFrame:
    """The rows of docs without all but one of each group of near copies, with the columns of docs."""
    judged = similar_components(docs, id_col, text_col, **similar)
    pairs = settle(judged.groupBy("_id", "_key").agg(F.count("*").alias("_rows"), F.max("first").alias("_first")))
    return matching_rows(docs, pairs.filter("_first").drop("_first"), id_col, text_col).select("doc.*")
