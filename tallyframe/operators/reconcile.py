"""Two-table reconciliation: exact and fuzzy keys, one-to-one pairing, cross references, tolerances.

Pairing takes, in base order, each base row's best free partner inside its block of exact keys.

* Exact keys in row order: the i-th base row pairs with the i-th other row of the block, so both
  sides are numbered and joined. No candidate pairs are built.
* Nearest basis value: see ``nearest``; then rows of one block and basis value pair by position.
* Fuzzy keys: an ordinary block is scored and paired inside one task. In a large block distinct text
  tuples are scored once; base rows apply to their best group of equal other texts, each group keeps
  whom it would take, the rest apply to their next best, until no row has a group left to try. The
  outcome equals taking pairs one by one in rank order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import all_of, col, cols, field_type, free_name, is_number, is_time, require
from tallyframe.functions.similarity import MATCH_SCORE
from tallyframe.functions.text import as_text, group_id, normalise_key, numeric_text, to_number
from tallyframe.operators.clean import fill_blanks
from tallyframe.operators.fuzzy import large_blocks, pair_blocks, scored_texts, split_blocks
from tallyframe.operators.grouping import sum_by_keys
from tallyframe.operators.joins import comparable
from tallyframe.operators.nearest import AFTER, BEFORE, CLOSEST, assign
from tallyframe.operators.numbering import hot_groups, number_groups, number_rows, number_within, total_order
from tallyframe.session import cut

METHODS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")
FIRST = "first_occurrence"
# Accepted spellings of the ways to choose among several partners.
DUPLICATE_WORDS = {
    "first_occurrence": FIRST,
    "first_occurance": FIRST,
    "closest": CLOSEST,
    "immediately_before": BEFORE,
    "immedidately_before": BEFORE,
    "immediately_after": AFTER,
    "immedidately_after": AFTER,
}
CUSTOM, CUSTOM_ID = "__Custom__", "Custom-ID"
# Columns that exist only while two tables are reconciled begin with this.
HELPER = "__reco:"
STATUS = "Reco_Status"
MATCHED, UNMATCHED = "Matched", "Unmatched"
SIDES = ("left", "right")
_MARK = {"left": "-1", "right": "-2"}  # suffix of a column that comes from that side


@dataclass
class Plan:
    keys: list[dict]
    values: list[dict]
    method: str = "one-to-one"
    choice: str = FIRST
    base: str = "left"
    basis: dict = field(default_factory=dict)
    refs: dict = field(default_factory=lambda: {"left": [], "right": []})
    order: dict = field(default_factory=dict)
    threshold: float = MATCH_SCORE

    @property
    def exact(self) -> list[dict]:
        return [k for k in self.keys if k.get("criteria", "exact") == "exact"]

    @property
    def fuzzy(self) -> list[dict]:
        ranked = [k for k in self.keys if k.get("criteria") == "fuzzy"]
        return sorted(ranked, key=lambda k: not k.get("fuzzy_ranking_basis"))

    @property
    def nearest(self) -> bool:
        return self.choice != FIRST

    def grouped(self, side: str) -> bool:
        many = {"one-to-many": ("right",), "many-to-one": ("left",), "many-to-many": SIDES}
        return side in many.get(self.method, ())


def check_spec(keys: list[dict], values: list[dict], settings: dict | None = None, cross_reference: dict | None = None,
               order_by: dict | None = None) -> Plan:
    """Validate a specification and bring it into one form."""
    settings, cross = settings or {}, cross_reference or {}
    for k in keys:
        if not k.get("left") or not k.get("right"):
            raise ValueError("each key needs 'left' and 'right'")
        if k.get("criteria", "exact") not in ("exact", "fuzzy"):
            raise ValueError("criteria must be exact or fuzzy")
        for flag in ("case_sensitive", "ignore_special"):
            if k.get(flag) not in (None, "yes", "no", True, False):
                raise ValueError(f"{flag} must be yes or no")
    if not any(k.get("criteria", "exact") == "exact" for k in keys):
        raise ValueError("at least one exact key is needed")
    if sum(bool(k.get("fuzzy_ranking_basis")) for k in keys if k.get("criteria") == "fuzzy") > 1:
        raise ValueError("only one fuzzy key can be the ranking basis")
    for v in values:
        kind, bound = v.get("threshold_type"), v.get("threshold_value")
        if kind not in (None, "", "percent", "amount"):
            raise ValueError("threshold_type must be percent, amount or empty")
        if bound is not None and float(bound) < 0:
            raise ValueError("threshold_value must not be negative")
        if kind == "percent" and bound is not None and float(bound) > 100:
            raise ValueError("a percent threshold must not exceed 100")
    method = settings.get("method") or "one-to-one"
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    choice, base, basis = FIRST, "left", settings.get("basis_column") or {}
    if method == "one-to-one":
        word = settings.get("duplicate") or FIRST
        if word not in DUPLICATE_WORDS:
            raise ValueError(f"unknown way to handle duplicates: {word!r}")
        choice, base = DUPLICATE_WORDS[word], settings.get("basis_table") or "left"
        if base not in SIDES:
            raise ValueError("basis_table must be left or right")
        if choice != FIRST and not (basis.get("left") and basis.get("right")):
            raise ValueError(f"{choice} needs a basis column on both sides")
    else:
        basis = {}
    plan = Plan(keys, values, method, choice, base, basis,
                {s: list(cross.get(s) or []) for s in SIDES}, order_by or {},
                float(settings.get("threshold", MATCH_SCORE)))
    for side in SIDES:
        own_keys, own_values = {k[side] for k in keys}, {v[side] for v in values}
        refs = [r for r in plan.refs[side] if r != CUSTOM]
        if plan.grouped(side) and (bad := [r for r in refs if r not in own_keys]):
            raise ValueError(f"{side} is a 'many' side: cross references must be keys, not {', '.join(bad)}")
        if bad := [r for r in refs if r in own_values and r not in own_keys]:
            raise ValueError(f"cross references cannot be value columns: {', '.join(bad)}")
    return plan


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: list[dict],
    values: list[dict],
    settings: dict | None = None,
    cross_reference: dict | None = None,
    names: tuple[str, str] = SIDES,
    order_by: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both tables with their partner's columns, status, differences and value matches.

    ``order_by`` gives each side's row order, ``{"left": [...], "right": [...]}``; by default rows are
    ordered by basis (when there is one), keys and all other columns.
    """
    plan = check_spec(keys, values, settings, cross_reference, order_by)
    tables = {"left": left, "right": right}
    for side in SIDES:
        needed = [k[side] for k in keys] + [v[side] for v in values] + list(plan.order.get(side) or [])
        needed += [r for r in plan.refs[side] if r != CUSTOM]
        needed += [plan.basis[side]] if plan.basis.get(side) else []
        require(tables[side], needed, f"{side} table")
    if clash := [c for s in SIDES for c in tables[s].columns if c.startswith(HELPER)]:
        raise ValueError(f"column names cannot begin with {HELPER!r}: {', '.join(clash)}")
    tables = {s: _prepared(tables[s], s, plan, n) for s, n in zip(SIDES, names)}
    tables = _with_helpers(tables, plan)
    own = {s: [c for c in tables[s].columns if not c.startswith(HELPER)] for s in SIDES}

    block = [f"__reco:k{i}" for i in range(len(plan.exact))]
    counted = [tables[s] for s in SIDES if not _unique_keys(s, plan)]
    hot = hot_groups(counted, block) if counted else None
    numbered = {s: _numbered(tables[s], s, plan, block, hot) for s in SIDES}
    if not plan.nearest and not plan.fuzzy:
        joined = {
            s: _attach(numbered[s], numbered[_other(s)], s, plan, own, block + ["__reco:t"]) for s in SIDES
        }
    else:
        pairs = cut(_fuzzy_pairs(numbered, plan) if plan.fuzzy else _nearest_pairs(numbered, plan))
        joined = {}
        for s in SIDES:
            o = _other(s)
            # Pairs carry the partner's number; joined to it they have the own key of this side.
            matched = pairs.select(F.col("g").alias("__reco:g"), F.col(o).alias("__reco:t"), F.col(s).alias("__reco:own"))
            partner = numbered[o].join(matched, ["__reco:g", "__reco:t"]).drop("__reco:t").withColumnRenamed("__reco:own", "__reco:t")
            joined[s] = _attach(numbered[s], partner, s, plan, own, ["__reco:g", "__reco:t"])
    return joined["left"], joined["right"]


def _other(side: str) -> str:
    return "right" if side == "left" else "left"


def _flag(key: dict, name: str, default: str) -> bool:
    return key.get(name, default) in ("yes", True)


def _key_text(c: Column, t: T.DataType, key: dict) -> Column:
    sensitive = _flag(key, "case_sensitive", "yes")
    return normalise_key(numeric_text(c, t), sensitive, _flag(key, "ignore_special", "no"))


def _as_is(key: dict) -> bool:
    return _flag(key, "case_sensitive", "yes") and not _flag(key, "ignore_special", "no")


def _prepared(df: DataFrame, side: str, plan: Plan, name: str) -> DataFrame:
    """Blanks filled; a "many" side summed by its normalised keys; row labels when asked for."""
    df = fill_blanks(df)
    if plan.grouped(side):
        by_name = {k[side]: k for k in plan.keys if not _as_is(k)}
        df = df.select(*[
            _key_text(col(c), field_type(df, c), by_name[c]).alias(c) if c in by_name else col(c) for c in df.columns
        ])
        df = sum_by_keys(df, list(dict.fromkeys(k[side] for k in plan.keys)), [v[side] for v in plan.values])
    if CUSTOM in plan.refs[side]:
        at = free_name(df.columns, "__reco:row")
        df = number_rows(df, _order(df, side, plan), at)
        label = F.concat(F.lit(f"{name}-"), col(at).cast("string"))
        df = df.select(*cols(c for c in df.columns if c not in (at, CUSTOM_ID)), label.alias(CUSTOM_ID))
        plan.refs[side] = [CUSTOM_ID if r == CUSTOM else r for r in plan.refs[side]]
    return df


def _order(df: DataFrame, side: str, plan: Plan) -> list[Column]:
    first = list(plan.order.get(side) or [])
    if not first:
        first = [plan.basis[side]] if plan.basis.get(side) else []
        first += [k[side] for k in plan.keys]
    first = [c for c in dict.fromkeys(first) if c in df.columns]
    return total_order(df, [col(c).asc_nulls_last() for c in first], first)


def _pair_order(df: DataFrame, side: str, plan: Plan) -> list[Column]:
    """Order in which a side's rows are taken: the partner side of "first occurrence" goes by its basis."""
    order = _order(df, side, plan)
    if plan.choice == FIRST and side != plan.base and plan.basis.get(side):
        return [col(plan.basis[side]).asc_nulls_last(), *order]
    return order


def _with_helpers(tables: dict[str, DataFrame], plan: Plan) -> dict[str, DataFrame]:
    """Add comparable exact keys, fuzzy texts and the basis as a number. No key is NULL: blanks are
    filled, and a missing value of another type reads as empty text."""
    extra: dict[str, list[Column]] = {s: [] for s in SIDES}
    for i, k in enumerate(plan.exact):
        (a, ta), (b, tb) = ((col(k[s]), field_type(tables[s], k[s])) for s in SIDES)
        plain = _as_is(k) and not any(isinstance(t, T.BooleanType) for t in (ta, tb))
        made = comparable(a, ta, b, tb) if plain else [F.coalesce(_key_text(c, t, k), F.lit("")) for c, t in ((a, ta), (b, tb))]
        for s, e in zip(SIDES, made):
            extra[s].append(e.alias(f"__reco:k{i}"))
    for i, k in enumerate(plan.fuzzy):
        for s in SIDES:
            extra[s].append(F.coalesce(_key_text(col(k[s]), field_type(tables[s], k[s]), k), F.lit("")).alias(f"__reco:f{i}"))
    if plan.nearest:
        for s in SIDES:
            c = plan.basis[s]
            extra[s].append(_axis(col(c), field_type(tables[s], c)).alias("__reco:x"))
    return {s: tables[s].select("*", *extra[s]) for s in SIDES}


def _axis(c: Column, t: T.DataType) -> Column:
    if is_time(t):
        # Microseconds of the wall clock; a zone with daylight saving must not bend the axis.
        c = c.cast("timestamp_ntz")
        days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
        seconds = days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1e6 + F.round(F.extract(F.lit("SECOND"), c).cast("double") * 1e6)
    return c.cast("double") if is_number(t) else to_number(as_text(c, t))


def _unique_keys(side: str, plan: Plan) -> bool:
    return plan.grouped(side) and not plan.fuzzy


def _numbered(df: DataFrame, side: str, plan: Plan, block: list[str], hot: DataFrame | None) -> DataFrame:
    plain = [c for c in df.columns if not c.startswith(HELPER)]
    order = _pair_order(df.select(*cols(plain)), side, plan)
    if _unique_keys(side, plan):
        numbered = df.withColumn("__reco:t", F.lit(1).cast("long"))
    else:
        numbered = number_groups(df, block, order, "__reco:t", hot)
    if plan.nearest or plan.fuzzy:
        numbered = numbered.withColumn("__reco:g", group_id(*cols(block)))
    return numbered


def _pair_up(placed: DataFrame, others: DataFrame, base: str) -> DataFrame:
    """Pair, per group and place, the i-th base row with the i-th other row: (g, left, right)."""
    others = others.withColumnRenamed("x", "place")
    hot = hot_groups([others], ["q", "place"])  # a place never takes more base rows than it has rows
    b = number_groups(placed, ["q", "place"], [F.col("t")], "n", hot)
    o = number_groups(others, ["q", "place"], [F.col("t")], "n", hot)
    o = o.select("q", "place", "n", F.col("t").alias("ot"))
    joined = b.join(o, ["q", "place", "n"])
    left, right = ("t", "ot") if base == "left" else ("ot", "t")
    return joined.select("g", F.col(left).alias("left"), F.col(right).alias("right"))


def _nearest_pairs(numbered: dict[str, DataFrame], plan: Plan) -> DataFrame:
    base, others = (
        numbered[s].select(F.col("__reco:g").alias("g"), F.col("__reco:t").alias("t"), F.col("__reco:x").alias("x"))
        for s in (plan.base, _other(plan.base))
    )
    kind = field_type(numbered[plan.base], plan.basis[plan.base])
    placed = assign(base, others, plan.choice, ranked=is_number(kind) or is_time(kind))
    return _pair_up(placed.withColumn("q", F.col("g")), others.withColumn("q", F.col("g")), plan.base)


def _fuzzy_pairs(numbered: dict[str, DataFrame], plan: Plan) -> DataFrame:
    n = len(plan.fuzzy)
    place = F.col("__reco:x") if plan.nearest else F.lit(0.0)

    def slim(side: str, letter: str) -> DataFrame:
        texts = [F.col(f"__reco:f{i}").alias(f"{letter}{i}") for i in range(n)]
        return numbered[side].select(F.col("__reco:g").alias("g"), F.col("__reco:t").alias("t"), place.alias("x"), *texts)

    base, others = slim(plan.base, "a"), slim(_other(plan.base), "b")
    large = large_blocks(base, others)
    if large is None:
        return _pairs_in_blocks(base, others, plan)
    (base, base_large), (others, others_large) = split_blocks(base, large), split_blocks(others, large)
    return _pairs_in_blocks(base, others, plan).unionByName(_pairs_by_rounds(base_large, others_large, plan))


def _pairs_in_blocks(base: DataFrame, others: DataFrame, plan: Plan) -> DataFrame:
    paired = pair_blocks(
        base, others, len(plan.fuzzy), plan.threshold, low=plan.choice != AFTER, high=plan.choice != BEFORE
    )
    left, right = ("t", "ot") if plan.base == "left" else ("ot", "t")
    return paired.select("g", F.col(left).alias("left"), F.col(right).alias("right"))


def _pairs_by_rounds(base: DataFrame, others: DataFrame, plan: Plan) -> DataFrame:
    """Large blocks: applications to groups of equal other texts, round by round."""
    n = len(plan.fuzzy)
    a, b = [f"a{i}" for i in range(n)], [f"b{i}" for i in range(n)]
    others = others.withColumn("q", group_id(*cols(["g", *b])))
    scored = scored_texts(base, others, n, plan.threshold)
    ranked = number_within(scored, ["g", *a], [F.col("s0").desc(), *cols(b)], "r")
    choices = cut(ranked.select("g", *a, "r", group_id(*cols(["g", *b])).alias("q")))
    others = others.select("q", "t", "x")

    applying = base.withColumn("r", F.lit(1).cast("long")).join(choices, ["g", *a, "r"])
    while True:
        applying = cut(applying)
        kept = _kept(applying, others, plan)
        rejected = applying.join(kept.select("g", "q", "t"), ["g", "q", "t"], "left_anti")
        moved = rejected.drop("q").withColumn("r", F.col("r") + 1).join(choices, ["g", *a, "r"])
        moved = cut(moved.select(*applying.columns))
        if moved.isEmpty():
            return _pair_up(kept, others, plan.base)
        stay = applying.join(kept.select("g", "q", "t"), ["g", "q", "t"], "left_semi")
        applying = stay.unionByName(moved)


def _kept(applying: DataFrame, others: DataFrame, plan: Plan) -> DataFrame:
    """(g, q, t, place) of the applicants their group takes."""
    if plan.nearest:
        placed = assign(
            applying.select(F.col("q").alias("g"), "t", "x"), others.select(F.col("q").alias("g"), "x"), plan.choice
        ).withColumnRenamed("g", "q")
        return applying.select("g", "q", "t").join(placed, ["q", "t"])
    room = others.groupBy("q").agg(F.count(F.lit(1)).alias("room"))
    lined = number_within(applying.select("g", "q", "t"), ["q"], [F.col("t")], "n").join(room, "q")
    return lined.filter(F.col("n") <= F.col("room")).select("g", "q", "t", F.lit(0.0).alias("place"))


def _pulled(side: str, plan: Plan, own: dict[str, list[str]]) -> dict[str, str]:
    """Partner column -> its name in this side's output."""
    o = _other(side)
    taken = set(own[side])
    names = {}
    for ref in plan.refs[o]:
        names[ref] = ref + _MARK[o] if ref in plan.refs[side] or ref in taken else ref
    for v in plan.values:
        names.setdefault(v[o], v[o] + _MARK[o] if v[o] in taken else v[o])
    # An output that is reconciled again has such names already; each further time adds the mark once more.
    used = {c.lower() for c in taken} | {STATUS.lower()}
    for ref, name in names.items():
        while name.lower() in used:
            name += _MARK[o]
        used.add(name.lower())
        names[ref] = name
    return names


def _attach(rows: DataFrame, partner: DataFrame, side: str, plan: Plan, own: dict[str, list[str]], on: list[str]) -> DataFrame:
    """One side's output: own columns, partner columns, status, differences and matches."""
    o = _other(side)
    names = _pulled(side, plan, own)
    slim = partner.select(*cols(on), *[col(c).alias(f"__reco:p{i}") for i, c in enumerate(names)], F.lit(True).alias("__reco:hit"))
    joined = rows.join(slim, on, "left")
    at = {c: F.col(f"__reco:p{i}") for i, c in enumerate(names)}
    made = [at[c].alias(n) for c, n in names.items()]
    made.append(F.when(F.col("__reco:hit"), MATCHED).alias(STATUS))
    for v in {v[side]: v for v in plan.values}.values():
        a = col(v[side]).try_cast("double")
        b = at[v[o]].try_cast("double")
        made += [
            F.abs(a - b).alias(f"{v[side]}-Difference"),
            value_match(a, b, v.get("threshold_type"), v.get("threshold_value")).alias(f"{v[side]}-Match"),
        ]
    # A table that was reconciled before gets its status and matches anew.
    fresh = {STATUS} | {f"{v[side]}-{what}" for v in plan.values for what in ("Difference", "Match")}
    return joined.select(*cols([c for c in own[side] if c not in fresh]), *made)


def value_match(a: Column, b: Column, kind: str | None, bound: float | None) -> Column:
    """``Matched`` when two values agree within the tolerance; a missing value is ``Unmatched``."""
    difference, bound = F.abs(a - b), abs(float(bound or 0))
    if kind == "percent":
        within = difference <= F.abs((a + b) / 2 * F.lit(bound) / 100)
    elif kind == "amount":
        within = difference <= F.lit(bound)
    else:
        within = difference == 0
    return F.when(F.coalesce(within, F.lit(False)), MATCHED).otherwise(UNMATCHED)


def statistics(left_out: DataFrame, right_out: DataFrame) -> DataFrame:
    """(side, matched, unmatched): one aggregate per side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count_if(col(STATUS) == MATCHED).alias("matched"), F.count_if(col(STATUS).isNull()).alias("unmatched")
        ).select(F.lit(name).alias("side"), "matched", "unmatched")
    return side(left_out, "left").unionByName(side(right_out, "right"))


def block_sizes(left: DataFrame, right: DataFrame, keys: list[dict]) -> DataFrame:
    """Rows per block of exact keys on both sides, for a look at skew before reconciling."""
    plan = check_spec(keys, [])
    tables = _with_helpers({"left": left, "right": right}, plan)
    block = [f"__reco:k{i}" for i in range(len(plan.exact))]
    counts = [tables[s].groupBy(*block).agg(F.count(F.lit(1)).alias(f"{s}_rows")) for s in SIDES]
    joined = counts[0].select(*[F.col(k).alias(f"l{k}") for k in block], "left_rows").join(
        counts[1], all_of(F.col(f"l{k}").eqNullSafe(F.col(k)) for k in block), "full"
    )
    shown = [F.coalesce(F.col(f"l{k}"), F.col(k)).alias(plan.exact[i]["left"]) for i, k in enumerate(block)]
    zero = F.lit(0).cast("long")
    return joined.select(*shown, F.coalesce("left_rows", zero).alias("left_rows"), F.coalesce("right_rows", zero).alias("right_rows"))
