"""Token counts from an exact length histogram.

Documents are aggregated by their encoded length, and suffix sums over the lengths answer,
for every context limit, how many documents and tokens are longer, what the total comes to
after truncation, and which length a quantile has. The histogram has one row per length
that occurs, whatever the number of documents.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import settle, text_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: what \s stands for there.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space in a row from which it is encoded by itself.
LONG_BLANK = 1_000
_LONG_BLANKS = re.compile(f"[{BLANKS}]{{{LONG_BLANK},}}")
#: Lengths whose suffix sums are made together; the sums of such ranges are few.
RANGE = 256

_encoders: dict[bytes, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """One for each process and vocabulary."""
    if ranks not in _encoders:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[ranks] = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encoders[ranks]


def token_count(encoding: tiktoken.Encoding, text: str) -> int:
    """The number of tokens of the text.

    The pattern backtracks through white space and overflows its stack in a run of a
    million. A long run is therefore cut out where the pattern cuts it too: all of it at
    the end of the text, all but its last character before another one. That piece goes
    to the merging of bytes directly, so the count is the same.
    """
    total, at = 0, 0
    for run in _LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per row of docs: (id, n_tokens); a null or empty text has 0.

    Very long texts are encoded whole. A pattern other than the usual one must cut white
    space in the same places.

    The driver reads the vocabulary, under a megabyte whatever the data, and broadcasts it.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def lengths(texts: pd.Series) -> pd.Series:
        encoding = encoder(ranks.value, pattern)
        return texts.map(lambda t: token_count(encoding, t))

    return docs.select(F.col(id_col), F.pandas_udf(lengths, "long")(text_of(text_col)).alias("n_tokens"))


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs, docs_from, tokens_from, docs_total, tokens_total), one row per length that occurs.

    docs_from and tokens_from are the sums over lengths of n_tokens or more. Null lengths
    are left out; repeated rows count each for itself; an empty table gives no rows.
    """
    counts = lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    counts = settle(counts.withColumn("range", F.expr(f"n_tokens div {RANGE}")))
    tokens = F.col("n_tokens") * F.col("n_docs")
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    longer = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_beyond"),
        F.sum("docs").over(whole).alias("docs_total"),
        F.sum("tokens").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_beyond")).alias("docs_from"),
        (F.sum(tokens).over(inside) + F.col("tokens_beyond")).alias("tokens_from"),
        "docs_total",
        "tokens_total",
    )


def with_truncation(histogram: DataFrame) -> DataFrame:
    """Adds, for a context limit of n_tokens: truncated_total, docs_cut and share_within.

    truncated_total: tokens left when longer documents are cut at the limit; docs_cut: the
    documents that are; share_within: the share of documents that fit.
    """
    beyond = F.col("docs_from") - F.col("n_docs")
    return histogram.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        beyond.alias("docs_cut"),
        ((F.col("docs_total") - beyond) / F.col("docs_total")).alias("share_within"),
    )


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_cut, truncated_total) for any limits, those at which no document ends included."""
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit")
    above = F.col("n_tokens") > F.col("limit")
    return (
        histogram.select("n_tokens", "n_docs", asked)
        .groupBy("limit")
        .agg(
            F.sum(F.when(above, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"),
        )
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least the share of documents do not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    rows = with_truncation(histogram).select("n_tokens", "share_within", asked)
    return rows.filter("share_within >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
