"""Packing by optimal length buckets: boundaries by dynamic programming over the histogram, batches by token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.tables import keep
from tallyframe.llm.words import pick

CONTEXT, BUCKETS, BUDGET = 2048, 16, 65_536
# Rows of a bucket that are numbered together.
SHARD_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges whose padding, every row padded to its bound, is least.

    best[k][j] = min over i of best[k-1][i] + padding of the lengths after i up to j, padded to the j-th length.
    """
    order = np.argsort(lengths)
    n, c = np.asarray(lengths)[order].astype(np.float64), np.asarray(counts)[order].astype(np.float64)
    if not len(n):
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * n)])
    best = np.concatenate([[0.0], np.full(len(n), np.inf)])
    choice = []
    for _ in range(min(buckets, len(n))):
        new, of = np.full(len(n) + 1, np.inf), np.zeros(len(n) + 1, np.int64)
        new[0] = 0.0
        for j in range(1, len(n) + 1):
            total = best[:j] + (rows[j] - rows[:j]) * n[j - 1] - (tokens[j] - tokens[:j])
            of[j] = total.argmin()
            new[j] = total[of[j]]
        best = new
        choice.append(of)
    out, j = [], len(n)
    for of in reversed(choice):
        if j:
            out.append(int(n[j - 1]))
            j = int(of[j])
    return sorted(set(out))


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", count: Column | None = None, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, ``piece``, ``start`` and ``n_tokens`` of it, ``bucket``, ``padded`` and ``batch``.

    A text longer than ``context`` tokens is cut into full pieces and a rest. The histogram of piece lengths, of at
    most ``context`` bars, gives the bucket bounds with the least padding; within a bucket, batches take as many pieces,
    padded to the bound, as ``budget`` tokens hold, at least one. Pieces are numbered in shards of a hash of the id, so
    a bucket of any size is spread; only the last batch of a bucket is short.

    Tokens are words unless ``count`` (an expression over the column ``t``) says otherwise. A null or empty text, or one
    without tokens, has one row of length 0 without bucket or batch. Repeated rows are packed each; an empty table gives
    no rows.
    """
    n = count if count is not None else word_count(F.col("t"))
    src = pick(docs, doc_id=doc_id, t=text).select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / context).cast("int") - 1, F.lit(0))))
    pieces = src.select("doc_id", "n", at.alias("piece")).withColumn("start", F.col("piece").cast("long") * context)
    pieces = keep(pieces.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(context)).alias("n_tokens")))
    # At most ``context`` rows.
    bars = [(r["n_tokens"], r["n"]) for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = boundaries(np.array([b[0] for b in bars]), np.array([b[1] for b in bars]), buckets)
    none = F.lit(None)
    if not bounds:
        return pieces.select("doc_id", "piece", "start", "n_tokens", none.cast("int").alias("bucket"), none.cast("long").alias("padded"), none.cast("long").alias("batch"))
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + F.when(F.col("n_tokens") > b, 1).otherwise(0)
    shards = sum(b[1] for b in bars) // shard_rows + 1
    placed = pieces.filter("n_tokens > 0").withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")
    numbered = placed.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["bucket", "shard"])
    table = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    batch = F.floor((F.col("before") + F.col("own")) / table([max(1, budget // b) for b in bounds]))
    out = numbered.select("doc_id", "piece", "start", "n_tokens", F.col("bucket").cast("int").alias("bucket"), table(bounds).alias("padded"), batch.alias("batch"))
    empty = pieces.filter("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.cast("int").alias("bucket"), none.cast("long").alias("padded"), none.cast("long").alias("batch"))
    return out.unionByName(empty)
