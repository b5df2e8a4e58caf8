"""Nearest assignment along one axis: each base row, in base order, takes the nearest free place.

Places are the distinct basis values of the other table with their number of rows. Taking the best
free place in base order is a stable matching in which every place prefers earlier base rows. Such a
matching is unique and does not depend on the sequence of proposals, which allows two ways:

* an ordinary block is settled in one pass inside one task, many blocks per task;
* a block too large for a task is taken in batches of the base order and cut along the axis into
  chunks of bounded size. All chunks settle at once, rows whose next place lies beyond their chunk
  travel to the neighbour, and rounds go on until nothing travels. A place keeps its earliest
  applicants, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.batches import sorted_groups
from tallyframe.functions.names import join_keys, shared_groups
from tallyframe.operators.numbering import number_within
from tallyframe.session import CHUNK_ROWS, VISITOR_ROWS, cut, setting, spread

CLOSEST, BEFORE, AFTER = "closest", "immediately_before", "immediately_after"

_ARRIVING, _HELD, _OUT = 0, 1, 2
_GONE = -1  # chunk number of a side that has nothing left
_STATE = "g string, t long, x double, c long, lc long, lb double, rc long, rb double, place double, state int"
_STATE_NAMES = ["g", "t", "x", "c", "lc", "lb", "rc", "rb", "place", "state"]
_FRACTIONS = [0.5**k for k in range(1, 31)]


def assign(base: DataFrame, others: DataFrame, mode: str, ranked: bool = False) -> DataFrame:
    """(g, t, place) for every base row that finds a place.

    ``base``: block g, order t (unique in the block), basis x. ``others``: g and x, one row per row.
    ``ranked`` says that t counts 1, 2, 3 ... in each block and no basis is missing.
    """
    spark = base.sparkSession
    chunk, visitors = setting(spark, CHUNK_ROWS), setting(spark, VISITOR_ROWS)
    base = base.filter(F.col("x").isNotNull())
    others = others.filter(F.col("x").isNotNull())
    sizes = (
        base.groupBy("g").agg(F.count(F.lit(1)).alias("nb"))
        .join(others.groupBy("g").agg(F.count(F.lit(1)).alias("no")), "g")
    )
    # At most rows / limit blocks can be hot, so this table is small by construction.
    hot = sizes.filter((F.col("nb") > visitors) | (F.col("no") > chunk)).select("g", "no")
    if not hot.take(1):
        return _assign_blocks(base, others, mode)
    hot = cut(hot)
    names = hot.select("g")
    cold = _assign_blocks(
        join_keys(base, names, ["g"], "left_anti"), join_keys(others, names, ["g"], "left_anti"), mode
    )
    hot_base = join_keys(base, hot, ["g"], "inner")
    if ranked and mode == CLOSEST:
        # Every free place suits a closest match, so rows beyond the number of places stay without one.
        hot_base = hot_base.filter(F.col("t") <= F.col("no"))
    hot_others = join_keys(others, names, ["g"], "left_semi")
    return cold.unionByName(_assign_hot(hot_base.drop("no"), hot_others, mode, chunk, visitors))


def settle(
    places: np.ndarray,
    room: np.ndarray,
    x: np.ndarray,
    c: int,
    lc: np.ndarray,
    lb: np.ndarray,
    rc: np.ndarray,
    rb: np.ndarray,
    before: float | None = None,
    after: float | None = None,
) -> tuple[np.ndarray, ...]:
    """Give each row, in the given order, the nearest place of chunk ``c`` that has room.

    Each row searches down from bound ``lb`` in chunk ``lc`` and up from bound ``rb`` in chunk
    ``rc``; chunk -1 means nothing is left on that side. ``before`` and ``after`` are the nearest
    places of the neighbour chunks. Equal distances go to the smaller value. Returns, per row, the
    index of the place taken (-1: none) and the advanced lc, lb, rc, rb; a row that took nothing and
    has a side left must go on to that side's chunk.
    """
    n = len(places)
    values, left_room = places.tolist(), room.tolist()
    down, up = list(range(n + 1)), list(range(n + 1))  # down: node i stands for place i - 1
    low = np.searchsorted(places, lb, side="right").tolist()
    high = np.searchsorted(places, rb, side="left").tolist()
    lcs, lbs, rcs, rbs = lc.tolist(), lb.tolist(), rc.tolist(), rb.tolist()
    taken = [-1] * len(x)

    def root(parent: list[int], i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    far = float("inf")
    for k, at in enumerate(x.tolist()):
        lo = hi = -1
        if lcs[k] == c:
            lo = root(down, low[k]) - 1
            if lo >= 0:
                lbs[k] = values[lo]
            elif before is None:
                lcs[k] = _GONE
            else:
                lcs[k], lbs[k] = c - 1, min(lbs[k], before)
        if rcs[k] == c:
            hi = root(up, high[k])
            if hi < n:
                rbs[k] = values[hi]
            elif after is None:
                rcs[k] = _GONE
            else:
                rcs[k], rbs[k] = c + 1, max(rbs[k], after)
        dl = at - lbs[k] if lcs[k] != _GONE else far
        dr = rbs[k] - at if rcs[k] != _GONE else far
        if lcs[k] != _GONE and dl <= dr:
            pick = lo if lcs[k] == c else -1
        else:
            pick = hi if rcs[k] == c else -1
        if pick < 0:
            continue
        taken[k] = pick
        left_room[pick] -= 1
        if left_room[pick] == 0:
            down[pick + 1], up[pick] = pick, pick + 1
    return np.array(taken, dtype=np.int64), np.array(lcs), np.array(lbs), np.array(rcs), np.array(rbs)


def _first_bounds(x: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Down takes places <= x; up takes places > x, or >= x when only looking up."""
    return x, (x if mode == AFTER else np.nextafter(x, np.inf))


def _assign_blocks(base: DataFrame, others: DataFrame, mode: str) -> DataFrame:
    """Settle whole blocks that both sides have; many small blocks share a task and a batch."""
    base, others = shared_groups(base, others)
    rows = others.select("g", F.lit(None).cast("long").alias("t"), F.col("x").cast("double").alias("x")).unionByName(
        base.select("g", "t", F.col("x").cast("double").alias("x"))
    )
    ordered = spread(rows, "g").sortWithinPartitions("g", F.col("t").asc_nulls_first(), "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in sorted_groups(batches, ["g"]):
            t, x = block["t"].astype(float), block["x"]
            free = np.isnan(t)
            if free.all() or not free.any():
                continue
            places, room = np.unique(x[free], return_counts=True)
            bx = x[~free]
            lb, rb = _first_bounds(bx, mode)
            lc = np.full(len(bx), _GONE if mode == AFTER else 0)
            rc = np.full(len(bx), _GONE if mode == BEFORE else 0)
            taken = settle(places, room, bx, 0, lc, lb, rc, rb)[0]
            hit = taken >= 0
            if hit.any():
                yield pd.DataFrame({
                    "g": block["g"][0],
                    "t": t[~free][hit].astype(np.int64),
                    "place": places[taken[hit]],
                })

    return ordered.mapInPandas(run, "g string, t long, place double")


def _assign_hot(base: DataFrame, others: DataFrame, mode: str, chunk: int, visitors: int) -> DataFrame:
    """Hot blocks in batches of the base order.

    What a batch has taken is final for all later rows, so its places are gone for them. A batch is
    about half as large as the free places: then few rows contend and few travel far. When the free
    places fit into one chunk, the rest settles at once.
    """
    spark = base.sparkSession
    base = cut(number_within(base, ["g"], [F.col("t")], "n"))
    others = cut(others.select("g", "x"))
    # Driver state: one count per hot block, of which there are at most rows / limit.
    todo = {r["g"]: r["n"] for r in base.groupBy("g").agg(F.max("n").alias("n")).collect()}
    low = dict.fromkeys(todo, 0)
    parts = base.filter(F.lit(False)).select("g", "t", F.col("x").cast("double").alias("place"))
    while True:
        free = {r["g"]: r["n"] for r in others.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        bounds = []
        for g, n in todo.items():
            left = n - low[g]
            if left > 0 and free.get(g):
                take = visitors if free[g] <= chunk else max(free[g] // 2, left // 4)
                bounds.append((g, low[g], low[g] + take))
                low[g] += min(take, left)
        if not bounds:
            return parts
        current = spark.createDataFrame(bounds, "g string, low long, high long")
        batch = base.join(current, "g").filter((F.col("n") > F.col("low")) & (F.col("n") <= F.col("high")))
        open_others = join_keys(others, current.select("g"), ["g"], "left_semi")
        placed = cut(_assign_chunks(batch.select("g", "t", "x"), open_others, mode, chunk, visitors))
        parts = parts.unionByName(placed)
        used = placed.groupBy("g", F.col("place").alias("x")).agg(F.count(F.lit(1)).alias("used"))
        lined = number_within(others.select("g", F.col("x").cast("double").alias("x")), ["g", "x"], [F.col("x")], "n")
        rest = lined.join(used, ["g", "x"], "left").filter(F.col("n") > F.coalesce(F.col("used"), F.lit(0)))
        others = cut(rest.select("g", "x"))


def _assign_chunks(base: DataFrame, others: DataFrame, mode: str, chunk: int, visitors: int) -> DataFrame:
    """Settle a batch by rounds over bounded chunks of the axis."""
    numbered = number_within(others, ["g"], [F.col("x")], "i")
    chunked = numbered.withColumn("c", F.floor((F.col("i") - 1) / F.lit(chunk)).cast("long"))
    places = cut(chunked.groupBy("g", "c", F.col("x").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("room")))
    # One row per chunk, at most rows / chunk size of them: the only data the driver sees.
    edges: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    found = places.groupBy("g", "c").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    for g, part in found.sort_values(["g", "c"]).groupby("g"):
        edges[g] = (part["low"].to_numpy(), part["high"].to_numpy())

    state = cut(base.select("g", "t", F.col("x").cast("double").alias("x")).mapInPandas(_arrivals(edges, mode), _STATE))
    while not state.filter(F.col("state") == _ARRIVING).isEmpty():
        state = cut(_round(state, places, edges, visitors))
    return state.filter(F.col("state") == _HELD).select("g", "t", "place")


def _arrivals(edges: dict[str, tuple[np.ndarray, np.ndarray]], mode: str):
    """First chunk and bounds of every base row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, rows in batch.groupby("g"):
                low, high = edges[g]
                x = rows["x"].to_numpy()
                lb, rb = _first_bounds(x, mode)
                lc = np.searchsorted(low, x, side="right") - 1
                rc = np.searchsorted(high, x, side="left") if mode == AFTER else np.maximum(lc, 0)
                rc = np.where(rc >= len(low), _GONE, rc)
                if mode == AFTER:
                    lc = np.full(len(x), _GONE)
                if mode == BEFORE:
                    rc = np.full(len(x), _GONE)
                at = np.where(lc != _GONE, lc, rc)
                yield pd.DataFrame({
                    "g": g, "t": rows["t"].to_numpy(), "x": x, "c": at, "lc": lc, "lb": lb, "rc": rc, "rb": rb,
                    "place": np.nan, "state": np.where(at == _GONE, _OUT, _ARRIVING).astype(np.int32),
                })

    return run


def _round(state: DataFrame, places: DataFrame, edges: dict[str, tuple[np.ndarray, np.ndarray]], visitors: int) -> DataFrame:
    """One step: chunks with arrivals settle anew with the rows they hold.

    A chunk takes its earliest arrivals first, about ``visitors`` of them; the others wait.
    """
    arrivals = state.filter(F.col("state") == _ARRIVING)
    share = F.least(F.ceil(F.log2(F.col("n") / F.lit(visitors))), F.lit(len(_FRACTIONS))).cast("int")
    dirty = (
        arrivals.groupBy("g", "c")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("t", _FRACTIONS, F.lit(10_000)).alias("q"))
        .select("g", "c", F.when(F.col("n") <= visitors, F.lit(2**62)).otherwise(F.element_at("q", share)).alias("until"))
    )
    marked = join_keys(state, dirty, ["g", "c"], "left")
    moves = F.col("until").isNotNull() & (
        (F.col("state") == _HELD) | ((F.col("state") == _ARRIVING) & (F.col("t") <= F.col("until")))
    )
    marked = marked.withColumn("moves", F.coalesce(moves, F.lit(False)))
    resting = marked.filter(~F.col("moves")).select(*_STATE_NAMES)
    moving = marked.filter(F.col("moves")).select(*_STATE_NAMES, F.lit(0).cast("long").alias("room"))
    open_places = join_keys(places, dirty.select("g", "c"), ["g", "c"], "left_semi").select(
        "g", F.lit(None).cast("long").alias("t"), "x", "c",
        *[F.lit(None).cast(k).alias(n) for n, k in
          (("lc", "long"), ("lb", "double"), ("rc", "long"), ("rb", "double"), ("place", "double"), ("state", "int"))],
        "room",
    )
    ordered = spread(moving.unionByName(open_places), "g", "c").sortWithinPartitions(
        "g", "c", F.col("t").asc_nulls_first(), "x"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in sorted_groups(batches, ["g", "c"]):
            g, c = block["g"][0], int(block["c"][0])
            free = np.isnan(block["t"].astype(float))
            low, high = edges[g]
            rows, spots = ({n: v[pick] for n, v in block.items()} for pick in (~free, free))
            x = rows["x"]
            taken, lc, lb, rc, rb = settle(
                spots["x"], spots["room"].astype(np.int64), x, c,
                rows["lc"].astype(np.int64), rows["lb"].astype(float), rows["rc"].astype(np.int64), rows["rb"].astype(float),
                high[c - 1] if c > 0 else None, low[c + 1] if c + 1 < len(low) else None,
            )
            held = taken >= 0
            place = np.full(len(x), np.nan)
            place[held] = spots["x"][taken[held]]
            go_left = (lc != _GONE) & ((rc == _GONE) | (x - lb <= rb - x))
            target = np.where(held, c, np.where(go_left, lc, rc))
            status = np.where(held, _HELD, np.where((lc == _GONE) & (rc == _GONE), _OUT, _ARRIVING))
            yield pd.DataFrame({
                "g": g, "t": rows["t"].astype(np.int64), "x": x, "c": target, "lc": lc, "lb": lb,
                "rc": rc, "rb": rb, "place": place, "state": status.astype(np.int32),
            })

    return ordered.mapInPandas(run, _STATE).unionByName(resting)
