"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms, one for each component that isn't zero. Queries and
candidates are dealt into blocks, and every pair of a query block and a candidate block is
one group: its candidates become postings (for each term the candidates that have it and
their weights), each term of each query scatters its weighted postings into that query's
dense array of scores, and a partition by the k-th score selects the block's best. What
the blocks select is merged by Spark's ranked window, which cuts to k rows a query before
the shuffle too. Blocks have a bounded number of rows whatever the ids, so a group's memory
is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.llm.common import settle
from helixframe.llm.vectors import flat, usable, whole

KEPT = 20
#: Rows of a block, about; candidates are dealt finer where there would be few groups, to no less than the last number.
QUERY_BLOCK, BLOCK, SMALLEST_BLOCK = 2048, 8192, 1024
GROUPS_PER_PARTITION = 4
#: Queries whose scores are accumulated together.
TOGETHER = 32


def sparse(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that aren't zero."""
    values, lengths = flat(lists)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = values != 0
    return row[there], term[there], values[there]


class Postings:
    """For each term the candidates that have it, and their weights."""

    def __init__(self, lists: pa.Array | pa.ChunkedArray, count: int):
        row, term, weight = sparse(lists)
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order]
        terms, starts = np.unique(term, return_index=True)
        self.count, self.most = count, int(np.abs(weight).max(initial=0))
        self.lists = {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(terms, starts, [*starts[1:], len(term)], strict=True)}

    def whole_lists(self, kind) -> None:
        """Weights in the kind of the scores; a list that has most candidates is laid out over all of them."""
        for term, (row, weight) in self.lists.items():
            if 2 * len(row) > self.count:
                laid = np.zeros(self.count, kind)
                laid[row] = weight
                self.lists[term] = None, laid
            else:
                self.lists[term] = row, weight.astype(kind)


def scores_of(lists: pa.Array | pa.ChunkedArray, n: int, postings: Postings):
    """Yields (number of the first query, dense scores) for the n queries, TOGETHER at a time."""
    row, term, weight = sparse(lists)
    longest = int(np.bincount(row).max(initial=0))
    kind = np.int32 if int(np.abs(weight).max(initial=0)) * postings.most * longest < 2**31 - 1 else np.int64
    postings.whole_lists(kind)
    spare = np.empty((TOGETHER, postings.count), kind)
    for first in range(0, n, TOGETHER):
        a, b = np.searchsorted(row, (first, first + TOGETHER))
        scores = np.zeros((min(TOGETHER, n - first), postings.count), kind)
        by_term = a + np.argsort(term[a:b], kind="stable")
        terms, starts = np.unique(term[by_term], return_index=True)
        for t, x, y in zip(terms, starts, [*starts[1:], len(by_term)], strict=True):
            found = postings.lists.get(int(t))
            if found is None:
                continue
            to, weights = row[by_term[x:y]] - first, weight[by_term[x:y]].astype(kind)
            at, values = found
            if at is not None:
                for q, w in zip(to, weights, strict=True):
                    scores[q, at] += w * values
            elif len(to) == len(scores):
                scores += np.multiply(weights[:, None], values, out=spare[: len(to)])
            else:
                scores[to] += np.multiply(weights[:, None], values, out=spare[: len(to)])
        yield first, scores


def best_of(scores: np.ndarray, kept: int) -> np.ndarray:
    """The places of the kept highest scores, of equal ones the first; in no order."""
    n = len(scores)
    if n <= kept:
        return np.arange(n)
    last = np.partition(scores, n - kept)[n - kept]
    above = np.flatnonzero(scores > last)
    return np.concatenate((above, np.flatnonzero(scores == last)[: kept - len(above)]))


def _search(kept: int, id_type: pa.DataType):
    schema = pa.schema([("_query", pa.int64()), ("query_id", id_type), ("_id", id_type), ("score", pa.int64())])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        ids = candidates.column("_id")
        candidates = candidates.take(pc.sort_indices(ids, null_placement="at_end"))  # of equal scores, the first is of the smaller id
        ids, rows = candidates.column("_id"), candidates.column("_rid").to_numpy()
        by_row = np.argsort(rows)
        at = np.searchsorted(rows, queries.column("_rid").to_numpy(), sorter=by_row)
        own = by_row[np.minimum(at, len(rows) - 1)]
        own = np.where(rows[own] == queries.column("_rid").to_numpy(), own, -1)  # a query's own row is no candidate
        who, where, what = [], [], []
        for first, scores in scores_of(queries.column("q"), queries.num_rows, Postings(candidates.column("q"), len(rows))):
            for q, row in enumerate(scores, first):
                if own[q] >= 0:
                    row[own[q]] = np.iinfo(row.dtype).min
                best = best_of(row, kept)
                best = best[best != own[q]]
                who.append(np.full(len(best), q))
                where.append(best)
                what.append(row[best].astype(np.int64))
        who, where = np.concatenate(who), np.concatenate(where)
        out = [queries.column("_rid").take(who), queries.column("_id").take(who), ids.take(where), pa.chunked_array([np.concatenate(what)])]
        return pa.Table.from_arrays(out, schema=schema)

    return search


def top_scores(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    kept: int = KEPT,
    query_block: int = QUERY_BLOCK,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query, the kept rows of highest integer inner product.

    Components x become floor(64 * x), one too large for exact sums is an error. Vectors
    that are null or hold a null or non-finite component take no part; those of different
    lengths meet in the components that both have, so an empty one scores 0. Candidates are
    all rows but the query's own; rows that repeat it, or its id, are candidates. Equal
    scores go by id, null ids last. A query of fewer candidates gets all of them, one of
    none no row. No queries or an empty table give no rows; other columns are not read.
    """
    rows = vectors.filter(usable(vector_col)).select(
        F.col(id_col).alias("_id"), whole(vector_col).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("_rid")
    )
    rows = settle(rows)  # row numbers stay as they are from here on
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, -(-asking // query_block))
    finer = min(-(-parts * GROUPS_PER_PARTITION // query_blocks), -(-count // SMALLEST_BLOCK))
    blocks = max(1, -(-count // block), finer)
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda n, name: F.pmod(F.xxhash64("_rid", F.lit(name)), F.lit(n)).cast("int").alias(name)
    queries = rows.filter("asks").select("_rid", "_id", "q", dealt(query_blocks, "query_block"), all_of(blocks, "block"))
    candidates = rows.select("_rid", "_id", "q", dealt(blocks, "block"), all_of(query_blocks, "query_block"))
    keys = ["query_block", "block"]
    kind = dict(rows.dtypes)["_id"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        _search(kept, to_arrow_type(rows.schema["_id"].dataType)), f"_query long, query_id {kind}, _id {kind}, score long"
    )
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_col), "score")
