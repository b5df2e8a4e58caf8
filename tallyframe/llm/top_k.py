"""Exact top-k search: tiled matrix products of query blocks and shards, selection per tile, tree merge of lists."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import keep
from tallyframe.llm.words import pick

SCALE = 1024
BLOCK, TILE, FAN_IN = 512, 2048, 32


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and ``x`` (whole numbers as doubles); vectors that are null, or hold null or non-finite parts, are left out."""
    v = F.transform(F.col("e"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    sound = F.col("e").isNotNull() & F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return pick(vectors, vec_id=vec_id, e=embedding).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x"))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products: by floating point where every sum stays exact, else by unbounded integers."""
    bound = (np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    as_int = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    exact = as_int(queries) @ as_int(rows).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places) of the ``k`` highest scores of each row, ties to smaller ids, the row's own id left out."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    for i, s in enumerate(scores):
        ok = np.flatnonzero(ids != own[i])
        if len(ok) > k:
            t = s[ok]
            edge = np.partition(t, len(t) - k)[len(t) - k]
            above = ok[t > edge]
            ok = np.concatenate([above, ok[t == edge][: k - len(above)]])
        yield i, order[ok[np.lexsort((ids[ok], -s[ok]))]]


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, block: int = BLOCK, tile: int = TILE, fan_in: int = FAN_IN) -> DataFrame:
    """query_id, ``rank``, vec_id and ``score``: the ``k`` best rows of each query, by whole-number inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows, each once per row of the
    table. Queries form blocks of at most about ``block`` rows, packed as one matrix each; candidates stream past them
    in tiles. A tile gives one matrix product and, per query, a partial selection. The lists of a query meet in a tree
    whose nodes merge at most ``fan_in`` lists of ``k``. Ties go to the smaller id.

    Vectors that are null, or hold null or non-finite parts, take no part; vectors of different lengths are not
    compared. A repeated id is a row of its own as a candidate, and a query once per distinct vector; a query's own id
    is never its candidate. An empty table gives no rows.
    """
    rows = keep(quantised(vectors, vec_id, embedding).withColumn("dim", F.size("x")))
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])
    count = queries.count()
    blocks, shards = max(1, -(-count // block)), max(1, -(-rows.count() // (4 * tile)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks))).groupBy("block", "dim").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("queries"))
    # A candidate meets every block of queries once: its shard is read next to each block, tile by tile.
    c = rows.select("vec_id", "x", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    c = c.groupBy("shard", "dim", F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(4)).alias("part")).agg(F.collect_list(F.struct("vec_id", "x")).alias("rows"))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, part, qs, rs in zip(b["shard"], b["part"], b["queries"], b["rows"]):
                own, ids = np.array([r["vec_id"] for r in qs], np.int64), np.array([r["vec_id"] for r in rs], np.int64)
                qm, rm = np.array([r["x"] for r in qs], float).reshape(len(qs), -1), np.array([r["x"] for r in rs], float).reshape(len(rs), -1)
                lists: list[list] = [[] for _ in qs]
                for low in range(0, len(ids), tile):
                    s = products(qm, rm[low : low + tile])
                    for i, at in best(s, ids[low : low + tile], own, k):
                        lists[i].append((ids[low + at], s[i, at]))
                out = {"query_id": [], "hash": [], "node": [], "vec_id": [], "score": []}
                for i, found in enumerate(lists):
                    v, s = (np.concatenate(x) for x in zip(*found))
                    top = np.lexsort((v, -s))[:k]
                    out["query_id"] += [own[i]] * len(top)
                    out["hash"] += [zlib.crc32(qm[i].tobytes())] * len(top)
                    out["node"] += [int(shard) * 4 + int(part)] * len(top)
                    out["vec_id"] += v[top].tolist()
                    out["score"] += s[top].tolist()
                yield pd.DataFrame(out)

    joined = c.join(q, ["block", "dim"]).select("shard", "part", "queries", "rows")
    lists = joined.mapInPandas(run, "query_id long, hash long, node long, vec_id long, score long")
    nodes, entry = shards * 4, F.struct((-F.col("score")).alias("neg"), "vec_id", "score")
    lists = lists.groupBy("query_id", "hash", F.floor(F.col("node") / fan_in).alias("node")).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    nodes = -(-nodes // fan_in)
    while nodes > 1:
        lists = lists.groupBy("query_id", "hash", F.floor(F.col("node") / fan_in).alias("node")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        nodes = -(-nodes // fan_in)
    return lists.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
