"""Vector code compression: part codebooks, with distances read from tables over the distinct integers of each dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import keep
from tallyframe.llm.words import pick

# Whole numbers beyond this many are not exact as sums of the table type.
MOST = 10**24
_LONG = 2**63 - 1


def whole(components: pa.Array, n: int) -> np.ndarray:
    """The components of ``n`` vectors as a matrix of whole numbers: int64 where squares and sums surely fit, else Python's."""
    x = components.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    top = np.abs(x).max(initial=0)
    if top > MOST:
        raise ArithmeticError("a component is beyond the range of exact sums")
    if (2 * top + 2) ** 2 * max(x.shape[1], 1) < 2**62 and (top + 1) * max(n, 1) < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class Tables:
    """Squared differences of the distinct integers of each dimension of some vectors to all entries of its codebook."""

    def __init__(self, x: np.ndarray, books: np.ndarray):
        """``books``: part, entry, place within the part."""
        self.parts, self.entries, self.wide = books.shape
        self.codes, self.squares = [], []
        big = x.dtype == object or np.abs(books.astype(float)).max(initial=0) > 2**30
        for d in range(x.shape[1]):
            values, code = np.unique(x[:, d], return_inverse=True)
            entry = books[d // self.wide, :, d % self.wide]
            if big:
                values, entry = values.astype(object), entry.astype(object)
            self.codes.append(code)
            self.squares.append((values[:, None] - entry[None, :]) ** 2)

    def distances(self, part: int) -> np.ndarray:
        """(vector, entry): a gather and an add for each dimension of the part."""
        low = part * self.wide
        out = self.squares[low][self.codes[low]]
        for d in range(low + 1, low + self.wide):
            out = out + self.squares[d][self.codes[d]]
        return out

    def nearest(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, distance) of each vector, ties to the lower entry."""
        far = self.distances(part)
        best = far.argmin(axis=1) if far.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in far], np.int64)
        return best, far[np.arange(len(far)), best]


def _matrix(column: pa.Array) -> np.ndarray:
    return whole(column.flatten(), len(column))


def sum_parts(books: np.ndarray):
    """For mapInArrow over (x): for each entry, the number and componentwise sum of the parts nearest to it in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), object)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            tables = Tables(x, books)
            for p in range(parts):
                best, _ = tables.nearest(p)
                own = np.zeros((entries, wide), x.dtype)
                np.add.at(own, best, x[:, p * wide : (p + 1) * wide])
                total[p] += own.astype(object)
                count[p] += np.bincount(best, minlength=entries)
        p, e, j = (i.ravel() for i in np.indices(books.shape))
        some = count[p, e] > 0
        p, e, j = p[some], e[some], j[some]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(count[p, e]), pa.array([str(v) for v in total[p, e, j]], pa.string())], names=["part", "entry", "place", "n", "total"])

    return run


def encode(books: np.ndarray, digits: int):
    """For mapInArrow over (x, other columns): the code and its error beside the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:0{digits}x}" for i in range(max(books.shape[1], 1))], f"S{digits}")
        for b in batches:
            n, parts = b.num_rows, books.shape[0]
            if not n:
                continue
            tables = Tables(_matrix(b.column(0)), books)
            code, error = np.empty((n, parts), f"S{digits}"), np.zeros(n, object)
            for p in range(parts):
                best, far = tables.nearest(p)
                code[:, p] = hexes[best]
                error = error + far
            text = [c.decode() for c in np.ascontiguousarray(code).view(f"S{digits * parts}").ravel()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string()), pa.array([min(int(v), _LONG) for v in error], pa.int64())], names=[*b.schema.names[1:], "code", "error"])

    return run


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, label, ``code``, ``error``, label_error and codebooks_sha256 of every sound vector.

    A component x is the whole number floor(``scale`` * x); a vector is cut into ``parts`` equal consecutive parts, each
    with a codebook of ``entries`` that starts as that part of the smallest ids. In each round every part goes to its
    nearest entry, ties to the lower one, and a used entry becomes the floored mean of its parts. The code is the last
    nearest entries, the error their squared distances, label_error the sum of errors of equal labels, nulls together.

    Distances are not computed vector by vector: each dimension of a batch becomes a dictionary of its distinct integers,
    whose squared differences to all entries are a table; a part's distances are gathers from the tables of its
    dimensions and adds. A task keeps sums of one codebook; the driver sees one row per codebook component.

    Vectors that are null, or hold null or non-finite parts, are left out, as are those whose length is not that of the
    smallest id with a length that ``parts`` divides. Repeated rows are rows of their own; a null id comes after all
    others as a start, equal ids in the order of their vectors. With fewer than ``entries`` vectors the codebooks are
    smaller. Errors beyond 64 bits are given as the largest long; components beyond 24 digits raise. An empty table gives no rows.
    """
    v = F.transform(F.col("e"), lambda x: x.cast("double") * scale)
    v = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    sound = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & (F.size("e") > 0) & (F.size("e") % parts == 0)
    rows = keep(pick(vectors, vec_id=vec_id, label=label, e=embedding).filter(sound).select(v.alias("x"), "vec_id", "label"))
    order = (F.col("vec_id").asc_nulls_last(), "x")
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dims = len(first[0]["x"])
    rows = rows.filter(F.size("x") == dims)
    start = [r["x"] for r in rows.orderBy(*order).limit(entries).collect()]
    books = np.array([[int(c) for c in r] for r in start], dtype=object).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)

    def typed() -> np.ndarray:
        return books.astype(np.int64) if all(abs(c) < 2**30 for c in books.ravel()) else books

    for _ in range(rounds):
        sums = rows.select("x").mapInArrow(sum_parts(typed()), "part int, entry int, place int, n long, total string")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in sums.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    digits = max(2, len(f"{entries - 1:x}"))
    types = dict(rows.dtypes)
    coded = keep(rows.mapInArrow(encode(typed(), digits), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("of"), F.least(F.col("sum"), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
