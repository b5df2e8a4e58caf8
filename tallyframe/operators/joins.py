"""Horizontal merges, match summaries and key coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import (
    all_of,
    col,
    cols,
    field_type,
    free_name,
    is_number,
    require,
)
from tallyframe.functions.text import exact_text, number_key, numeric_text
from tallyframe.session import MERGE_PAIRS, cut, setting

# Keys with more row pairs than one task should make, marked for broadcast at most.
_FEW_KEYS = 500_000

METHODS = ("inner", "left", "right", "outer")
CLASSES = ("both", "left_only", "right_only")


def merge(
    left: DataFrame,
    right: DataFrame,
    key_pairs: list[dict],
    method: str = "inner",
    keys_as: str = "typed",
) -> DataFrame:
    """Equi-join on all key pairs; NULL keys match NULL keys.

    A pair of equally named keys gives one column, differently named keys stay both, and other
    shared names get ``_left`` and ``_right``. ``keys_as`` is "typed" (differing types compare as
    numbers, or as text when one side is not a number), "text", or "loose" (number where both
    texts are numbers, trimmed text otherwise). Rows are counted per key when this is called; a key with
    more than ``spark.tallyframe.mergePairs`` row pairs is dealt to many tasks.
    """
    return _merge(left, right, key_pairs, method, keys_as, True)


def _merge(left: DataFrame, right: DataFrame, key_pairs: list[dict], method: str, keys_as: str, deal: bool) -> DataFrame:
    pairs = _pairs(left, right, key_pairs)
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    joined_keys = {l for l, r in pairs if l == r}
    shared = [c for c in left.columns if c in right.columns and c not in joined_keys]
    l_name = {c: f"{c}_left" if c in shared else c for c in left.columns}
    r_name = {c: f"{c}_right" if c in shared else c for c in right.columns}
    names = [l_name[c] for c in left.columns] + [r_name[c] for c in right.columns if c not in joined_keys]
    if len(set(names)) != len(names):
        raise ValueError("merged column names collide; rename a column first")

    l, r = _keyed(left, right, pairs, keys_as)
    on = all_of(F.col(f"__lk{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(len(pairs)))
    same = {a: i for i, (a, b) in enumerate(pairs) if a == b}

    def output(df: DataFrame) -> DataFrame:
        fields = []
        for i, c in enumerate(left.columns):
            value = F.col(f"__l{i}")
            if c in same:
                value = F.coalesce(value, F.col(f"__r{right.columns.index(c)}"))
            fields.append(value.alias(l_name[c]))
        fields += [
            F.col(f"__r{i}").alias(r_name[c]) for i, c in enumerate(right.columns) if c not in joined_keys
        ]
        return df.select(*fields)

    data = [f"__l{i}" for i in range(len(left.columns))] + [f"__r{i}" for i in range(len(right.columns))]
    crowded = _crowded(l, r, len(pairs)) if deal else None
    if crowded is None:
        return output(_joined(l, r, left, right, on, method, data))
    # A crowded key has rows on both sides, so every method pairs all of them.
    at = all_of(F.col(f"__lk{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(pairs)))
    bt = all_of(F.col(f"__rk{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(pairs)))
    plain = _joined(l.join(crowded, at, "left_anti"), r.join(crowded, bt, "left_anti"), left, right, on, method, data)
    l, r = _dealt(l, crowded, at, "l"), _dealt(r, crowded, bt, "r")
    cell = (F.col("__lid") == F.col("__rid")) & (F.col("__lcell") == F.col("__rcell"))
    # No broadcast of the copies: a task holds its cells only, and pairs come by left row, which files of columns keep small.
    return output(plain.unionByName(l.join(r.hint("merge"), cell).select(*data)))


def _joined(l: DataFrame, r: DataFrame, left: DataFrame, right: DataFrame, on: Column, method: str, data: list[str]) -> DataFrame:
    if method != "outer":
        return l.join(r, on, method).select(*data)
    # A full outer join cannot split a skewed key; a left join and an anti join can.
    left_keys = l.select(*[c for c in l.columns if c.startswith("__lk")]).distinct()
    right_only = r.join(left_keys, on, "left_anti").select(
        *[F.lit(None).cast(f.dataType).alias(f"__l{i}") for i, f in enumerate(left.schema.fields)],
        *[F.col(f"__r{i}") for i in range(len(right.columns))],
    )
    return l.join(r, on, "left").select(*data).unionByName(right_only)


def _crowded(l: DataFrame, r: DataFrame, n: int) -> DataFrame | None:
    """Keys ``__k0``.. with more row pairs than one task should make, or None: a number ``__id``, and into how many
    blocks their left and right rows are dealt (``__lblocks``, ``__rblocks``).

    Each two blocks are a cell that one task pairs. A row is copied to all cells of its block, so cells are as large as an
    even share of all pairs allows, and as square.
    """
    limit = setting(l.sparkSession, MERGE_PAIRS)
    l = l.groupBy(*[F.col(f"__lk{i}").alias(f"__k{i}") for i in range(n)]).agg(F.count(F.lit(1)).alias("__ln"))
    r = r.groupBy(*[f"__rk{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("__rn"))
    on = all_of(F.col(f"__k{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(n))
    made = F.col("__ln").cast("double") * F.col("__rn")
    found = l.join(r, on).filter(made > limit)
    found = cut(found.select(*[f"__k{i}" for i in range(n)], "__ln", "__rn", F.monotonically_increasing_id().alias("__id")))
    keys, total = found.agg(F.count(F.lit(1)), F.sum(made)).first()
    if not keys:
        return None
    cell = max(limit, total / _partitions(l), 1)
    few = F.greatest(F.lit(1), F.round(F.least("__ln", "__rn") / F.lit(cell**0.5))).cast("int")
    many = F.ceil(made / (few * F.lit(cell))).cast("int")
    long = F.col("__ln") >= F.col("__rn")
    found = found.select(
        *[f"__k{i}" for i in range(n)], "__id",
        F.when(long, many).otherwise(few).alias("__lblocks"), F.when(long, few).otherwise(many).alias("__rblocks"),
    )
    return F.broadcast(found) if keys <= _FEW_KEYS else found


def _dealt(df: DataFrame, crowded: DataFrame, on: Column, side: str) -> DataFrame:
    """Data columns of rows of crowded keys, dealt out evenly to the blocks of their key, once for each cell
    (``__lid`` and ``__lcell``, or ``__rid`` and ``__rcell``) of the block."""
    count = _partitions(df)
    data = [c for c in df.columns if not c.startswith(f"__{side}k")]
    rows = df.join(crowded, on).select(*data, "__id", "__lblocks", "__rblocks").repartition(count)
    l, r = F.col("__lblocks"), F.col("__rblocks")
    block = F.pmod(F.spark_partition_id(), F.col(f"__{side}blocks"))
    cells = F.sequence(block * r, block * r + r - 1) if side == "l" else F.sequence(block, block + (l - 1) * r, r)
    rows = rows.select(*data, F.col("__id").alias(f"__{side}id"), F.explode(cells).alias(f"__{side}cell"))
    # The join needs no other shuffle of the copies. Cells are few: over more partitions, fewer of them meet in one.
    return rows.repartition(4 * count, f"__{side}id", f"__{side}cell")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pairs(left: DataFrame, right: DataFrame, key_pairs: list[dict]) -> list[tuple[str, str]]:
    if not key_pairs:
        raise ValueError("key pairs are required")
    for pair in key_pairs:
        if "left" not in pair or "right" not in pair:
            raise ValueError("each key pair needs 'left' and 'right'")
    require(left, [p["left"] for p in key_pairs], "first table")
    require(right, [p["right"] for p in key_pairs], "second table")
    return [(p["left"], p["right"]) for p in key_pairs]


def _keyed(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keys_as: str) -> tuple[DataFrame, DataFrame]:
    """Both tables under positional names, with comparable key columns added."""
    l = left.toDF(*[f"__l{i}" for i in range(len(left.columns))])
    r = right.toDF(*[f"__r{i}" for i in range(len(right.columns))])
    l_keys, r_keys = [], []
    for i, (a, b) in enumerate(pairs):
        la, rb = F.col(f"__l{left.columns.index(a)}"), F.col(f"__r{right.columns.index(b)}")
        lk, rk = comparable(la, field_type(left, a), rb, field_type(right, b), keys_as)
        l_keys.append(lk.alias(f"__lk{i}"))
        r_keys.append(rk.alias(f"__rk{i}"))
    return l.select("*", *l_keys), r.select("*", *r_keys)


def comparable(a: Column, ta: T.DataType, b: Column, tb: T.DataType, keys_as: str = "typed") -> tuple[Column, Column]:
    """Two keys in one type."""
    if keys_as == "loose":
        return _loose(a, ta), _loose(b, tb)
    if keys_as == "typed":
        if ta == tb:
            return a, b
        if is_number(ta) and is_number(tb):
            if isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType):
                return a.cast("bigint"), b.cast("bigint")
            # A whole number and a fraction meet as digits: as doubles, neighbours beyond 2^53 would be equal.
            return _number_or_text(a, ta), _number_or_text(b, tb)
    return numeric_text(a, ta), numeric_text(b, tb)


def _loose(c: Column, t: T.DataType) -> Column:
    return _number_or_text(c, t)


def _number_or_text(c: Column, t: T.DataType) -> Column:
    text = F.trim(exact_text(c, t))
    return F.coalesce(number_key(text), text)


def match_summary(left: DataFrame, right: DataFrame, key_pairs: list[dict], method: str = "outer", keys_as: str = "typed") -> DataFrame:
    """(match, count) for both, left_only and right_only, zeros included.

    Each side is counted per key first, so no pair of rows is ever built.
    """
    pairs = _pairs(left, right, key_pairs)
    l, r = _keyed(left, right, pairs, keys_as)
    n = len(pairs)
    l = l.groupBy(*[f"__lk{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("__ln"))
    r = r.groupBy(*[f"__rk{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("__rn"))
    on = all_of(F.col(f"__lk{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(n))
    ln, rn = F.col("__ln"), F.col("__rn")
    zero = F.lit(0).cast("long")
    kept = {
        "both": F.when(ln.isNotNull() & rn.isNotNull(), ln * rn),
        "left_only": F.when(rn.isNull(), ln) if method in ("left", "outer") else zero,
        "right_only": F.when(ln.isNull(), rn) if method in ("right", "outer") else zero,
    }
    totals = l.join(r, on, "full").agg(*[F.coalesce(F.sum(e), zero).alias(k) for k, e in kept.items()])
    entries = [F.struct(F.lit(k).alias("match"), F.col(k).alias("count")) for k in CLASSES]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def merge_with_summary(left: DataFrame, right: DataFrame, key_pairs: list[dict], method: str = "inner", keys_as: str = "typed") -> tuple[DataFrame, DataFrame]:
    return merge(left, right, key_pairs, method, keys_as), match_summary(left, right, key_pairs, method, keys_as)


def merge_preview(left: DataFrame, right: DataFrame, key_pair: dict, method: str = "inner", n: int = 25) -> DataFrame:
    """First rows of a merge on one key compared as text."""
    return _merge(left, right, [key_pair], method, "text", False).limit(n)


def key_coverage(left: DataFrame, right: DataFrame, key_pairs: list[dict], keys_as: str = "typed") -> DataFrame:
    """Distinct keys with their class: both, left_only or right_only. NULL is a key."""
    pairs = _pairs(left, right, key_pairs)
    l, r = _keyed(left, right, pairs, keys_as)
    n = len(pairs)
    names = [a for a, _ in pairs]
    side = free_name(names, "__side")
    l = l.select(*[F.col(f"__lk{i}").alias(names[i]) for i in range(n)], F.lit(1).alias(side))
    r = r.select(*[F.col(f"__rk{i}").alias(names[i]) for i in range(n)], F.lit(2).alias(side))
    # One aggregation answers all three sets: bit 1 for the left side, bit 2 for the right.
    seen = l.unionByName(r).groupBy(*cols(names)).agg(F.bit_or(col(side)).alias(side))
    label = F.when(col(side) == 3, "both").when(col(side) == 1, "left_only").otherwise("right_only")
    return seen.select(*cols(names), label.alias("match"))


def keys_in_class(left: DataFrame, right: DataFrame, key_pairs: list[dict], match: str) -> DataFrame:
    if match not in CLASSES:
        raise ValueError(f"match must be one of {', '.join(CLASSES)}")
    return key_coverage(left, right, key_pairs).filter(F.col("match") == match).drop("match")
