"""Document fingerprints from prefix polynomial hashes.

A text's prefix hashes are sums of its code points times rising powers of a base, modulo a
prime, for two bases. They give the hash of any span in constant time, so spans compare
equal wherever they stand, and the longest common extension from two places is found by
binary search. A fingerprint is the whole text's hash and the least of its window hashes; two
fingerprints are as alike as their least windows agree.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.llm.common import settle, text_of
from helixframe.operators.relational import with_earlier

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_013 % PRIME)
#: Code points of a window, and how many windows a fingerprint keeps.
WINDOW = 24
KEPT = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of ids for each shuffle partition at least, and code points of a range otherwise: some 800,000 ranges for 100 TB of text.
RANGES_PER_PARTITION = 4
RANGE_CHARS = 128_000_000
#: Rows, chosen by a hash, that each range's bound is chosen from.
ROWS_PER_BOUND = 20

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, of values under 2**62; the prime is a row of ones in binary."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, to the n-th at least; kept by the process."""
    if not _powers or len(_powers[0][0]) <= n:
        size, made = max(4096, 1 << n.bit_length()), []
        for base in BASES:
            pair = []
            for b in (base, pow(base, -1, PRIME)):
                powers = np.ones(1, np.uint64)
                while len(powers) <= size:
                    powers = np.concatenate((powers, _mod(powers * np.uint64(pow(b, len(powers), PRIME)))))
                pair.append(powers)
            made.append(tuple(pair))
        _powers[:] = made
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix hashes of a text."""

    def __init__(self, points: np.ndarray):
        self.n, values = len(points), points.astype(np.uint64) + np.uint64(1)
        self.prefix = [
            np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mod(values * up[: self.n]), dtype=np.uint64) % np.uint64(PRIME)))
            for up, _ in _powers_to(self.n)
        ]

    def span(self, a: int, b: int) -> tuple[int, ...]:
        """The hash of code points a to b, the same wherever they stand."""
        return tuple(
            (int(h[b]) - int(h[a])) * int(down[a]) % PRIME for h, (_, down) in zip(self.prefix, _powers_to(self.n), strict=True)
        )

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """The hash of each window, mixed to 64 bits."""
        count = self.n - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        both = [
            _mod(_mod(h[width:] + np.uint64(PRIME) - h[:count]) * down[:count])
            for h, (_, down) in zip(self.prefix, _powers_to(self.n), strict=True)
        ]
        mixed = ((both[0] << np.uint64(31)) | both[1]) * _MIX
        return (mixed ^ (mixed >> np.uint64(29))) * _MIX

    def equal(self, a: int, other: PrefixHash, b: int, length: int) -> bool:
        return self.span(a, a + length) == other.span(b, b + length)

    def common_extension(self, a: int, other: PrefixHash, b: int, most: int | None = None) -> int:
        """The number of equal code points from a here and from b in the other."""
        longest = min(self.n - a, other.n - b, *([] if most is None else [most]))
        low, high = 0, 1  # doubling first: most extensions are short
        while high <= longest and self.equal(a, other, b, high):
            low, high = high, 2 * high
        high = min(high - 1, longest)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(a, other, b, middle) else (low, middle - 1)
        return low


def least(windows: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The least distinct windows, rising."""
    n = len(windows)
    if n > 8 * kept:
        some = windows[windows < np.uint64(min(2**64 - 1, 2**64 * 4 * kept // n))]
        some = np.unique(some)
        if len(some) >= kept:
            return some[:kept]
    return np.unique(windows)[:kept]


def whole_windows(hashes: PrefixHash) -> np.ndarray:
    """The windows; of a shorter text its own hash, of an empty one none."""
    if 0 < hashes.n < WINDOW:
        a, b = hashes.span(0, hashes.n)
        return np.array([(a << 31 | b) * int(_MIX) % 2**64], np.uint64)
    return hashes.windows()


def fingerprint(whole: tuple[int, ...], low: np.ndarray) -> str:
    """16 hex digits of the whole text's hash, a colon, 8 of each kept window."""
    return f"{whole[0] << 31 | whole[1]:016x}:{(low >> np.uint64(32)).astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """The share of the least windows of both together that each has; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(17, len(f), 8)} for f in (a, b))
    together = sorted(x | y)[:kept]
    return sum(w in x and w in y for w in together) / len(together) if together else 0.0


class Document:
    """A text with what its neighbour's edited text takes from it."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.points = doc_id, text, code_points(text)
        self.hashes = PrefixHash(self.points)
        self.windows = whole_windows(self.hashes)
        self.whole = self.hashes.span(0, self.hashes.n)
        self.fingerprint = fingerprint(self.whole, least(self.windows))

    def again(self, doc_id) -> Document:
        """The same text under another id."""
        same = copy.copy(self)
        same.doc_id = doc_id
        return same

    def row(self, after: Document) -> tuple:
        """The digest of this document, with after as the next one."""
        n = len(self.points)
        half = n // 2
        head, taken = n - half, min(half, len(after.points))
        edited = self.text[:head] + after.text[:taken]
        size = head + taken
        #  windows inside either part are known already; those across the joint are few
        joint = np.concatenate((self.points[max(0, head - WINDOW + 1) : head], after.points[: min(taken, WINDOW - 1)]))
        if size < WINDOW:
            windows = whole_windows(PrefixHash(joint))
        else:
            inner = [self.windows[: max(0, head - WINDOW + 1)] if n >= WINDOW else self.windows[:0]]
            inner.append(after.windows[: max(0, taken - WINDOW + 1)] if len(after.points) >= WINDOW else self.windows[:0])
            windows = np.concatenate((*inner, PrefixHash(joint).windows()))
        powers = _powers_to(max(n, len(after.points)))
        whole = tuple(
            (int(h[head]) + int(g[taken]) * int(up[head])) % PRIME
            for h, g, (up, _) in zip(self.hashes.prefix, after.hashes.prefix, powers, strict=True)
        )
        other = fingerprint(whole, least(windows))
        return (
            self.doc_id,
            n,
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            self.fingerprint,
            other,
            likeness(self.fingerprint, other),
            likeness(self.fingerprint, after.fingerprint),
            head + self.hashes.common_extension(head, after.hashes, 0, taken),
            self.hashes.common_extension(0, after.hashes, 0),
            size,
        )


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long, edited_chars long"


def _digests(id_type: pa.DataType):
    kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 3]
    names = ["_id", *[c.split()[0] for c in COLUMNS.split(", ")]]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, rows = None, None, []
        for batch in batches:
            for doc_id, text, bucket, extra in zip(*(batch.column(c) for c in ("_id", "text", "bucket", "extra")), strict=True):
                if bucket.as_py() != at:
                    at, last = bucket.as_py(), None
                elif last is None:  # the range is done with its first extra row
                    continue
                new = last.again(doc_id.as_py()) if last is not None and last.text == text.as_py() else Document(doc_id.as_py(), text.as_py())
                if last is not None:
                    rows.append(last.row(new))
                last = None if extra.as_py() else new
                if len(rows) >= 1000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return digests


def range_bounds(keys: DataFrame, ranges: int, rows: int) -> DataFrame:
    """(id, h): at most ranges different pairs that occur in keys (id, h), the least of all among them.

    The others are quantiles of a hash-chosen part of the pairs, ROWS_PER_BOUND for each
    range whatever the number of rows, counted with their repeats. They are ranked where
    they are; only the bounds themselves leave the tasks.
    """
    share = min(1.0, ROWS_PER_BOUND * ranges / max(rows, 1))
    chosen = keys.filter(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("id", "h").agg(F.count("*").alias("n"))
    placed = with_earlier(chosen, ["id", "h"], "before", size=F.col("n"), total="all")
    #  the pairs in which a new range's share of the rows begins
    first = (F.col("before") * ranges / F.col("all")).cast("long") < ((F.col("before") + F.col("n")) * ranges / F.col("all")).cast("long")
    least = keys.agg(F.min(F.struct(F.col("id").isNotNull().alias("named"), "id", "h")).alias("low")).select("low.id", "low.h")
    return placed.filter(first & (F.col("before") > 0)).select("id", "h").unionByName(least).distinct()


def _literal(bounds: DataFrame, kind: str):
    """The sorted bounds as one literal, nulls first, and their number."""
    rows = [r["b"] for r in bounds.sort("id", "h").select(F.to_json(F.struct("id", "h"), {"ignoreNullFields": "false"}).alias("b")).collect()]
    return F.from_json(F.lit(f"[{','.join(rows)}]"), f"array<struct<id:{kind},h:bigint>>"), len(rows)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of docs: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_edited, common_next, edited_chars).

    The next document is the one of the next higher id, after the last the first; ids may be
    of any type that sorts. Rows of equal id follow one another by a hash of their texts, and
    null ids come first. A document that is alone is its own next. common_edited and
    common_next are the lengths of the common beginnings. A null text is empty: fingerprint
    zero without windows. An empty table gives no rows; other columns are not read.

    The order of (id, hash of the text) is cut into ranges at pairs that occur, so one id of
    many rows is divided too; rows that agree in both are one range's, where their text is
    hashed once. Each range is sorted and read once, in one task's stream; the first
    document of a range also goes to the end of the range before, the first of all to the
    last range, so that every document meets its next. Without a number of ranges there is
    one for every RANGE_CHARS of text, or for a part of each shuffle partition.
    """
    kind = dict(docs.dtypes)[id_col]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = text_of(text_col)
    keys = settle(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("chars")))
    count, chars = keys.agg(F.count("*"), F.sum("chars")).first()
    if ranges is None:
        ranges = max(parts * RANGES_PER_PARTITION, -(-(chars or 0) // RANGE_CHARS))
    stops, n = _literal(range_bounds(keys, ranges, count), kind)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    place = F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step < n) & (F.get(stops, at + step) <= F.col("pair")), at + step).otherwise(at),
    )
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("pair"), text.alias("text")).withColumn("at", place)
    own = F.struct(F.col("at").alias("bucket"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("at") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("extra"))
    rows = rows.withColumn("to", F.explode(F.when(F.get(stops, F.col("at")) == F.col("pair"), F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("pair", F.col("pair.id").alias("_id"), "text", "to.bucket", "to.extra").repartition(max(parts, n // RANGES_PER_PARTITION), "bucket")
    rows = rows.sortWithinPartitions("bucket", "extra", "pair", "text").drop("pair")
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return rows.mapInArrow(_digests(id_type), f"_id {kind}, {COLUMNS}").withColumnRenamed("_id", id_col)
