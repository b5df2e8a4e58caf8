"""Reconciliations. The SQL of the greedy ones walks each block row by row with a recursive query."""

from pyspark.sql import functions as F

from tallyframe.operators.reconcile import block_sizes, reconcile, statistics
from tallyframe.queries.registry import query


def _rounded(df, digits=2):
    names = [c for c in df.columns if df.schema[c].dataType.typeName() == "double"]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


# Orders against a second ledger that words the priority differently, adds a fee and lacks open orders.
def _ledgers(t):
    left = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    right = t.orders.filter("o_orderstatus <> 'P'").select(
        "o_orderkey", "o_custkey", F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" / "))).alias("o_orderpriority"),
        (F.col("o_totalprice") + 1250.75).alias("o_totalprice"),
    )
    return left, right


_LEDGERS_SQL = """
WITH l0 AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders),
     r0 AS (SELECT o_orderkey, o_custkey, lower(replace(o_orderpriority, '-', ' / ')) AS o_orderpriority,
                   o_totalprice + 1250.75 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
     l AS (SELECT *, upper(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) AS k,
                  row_number() OVER (PARTITION BY o_custkey, upper(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) ORDER BY o_orderkey) AS rn FROM l0),
     r AS (SELECT *, upper(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) AS k,
                  row_number() OVER (PARTITION BY o_custkey, upper(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) ORDER BY o_totalprice, o_orderkey) AS rn FROM r0)
"""
_LEDGER_KEYS = [
    {"left": "o_custkey", "right": "o_custkey", "criteria": "exact"},
    {"left": "o_orderpriority", "right": "o_orderpriority", "criteria": "exact", "case_sensitive": "no", "ignore_special": "yes"},
]


def _ledger_pair(t):
    return reconcile(
        *_ledgers(t), _LEDGER_KEYS,
        [{"left": "o_totalprice", "right": "o_totalprice", "threshold_type": "percent", "threshold_value": 60}],
        {"method": "one-to-one", "duplicate": "first_occurrence", "basis_table": "left",
         "basis_column": {"left": "o_totalprice", "right": "o_totalprice"}},
        {"left": ["o_orderkey"], "right": ["o_orderkey"]},
        order_by={"left": ["o_orderkey"], "right": ["o_orderkey"]},
    )


def _ledger_side(a, b, mark):
    diff = f"abs({a}.o_totalprice - {b}.o_totalprice)"
    return f"""{_LEDGERS_SQL}
    SELECT {a}.o_orderkey, {a}.o_custkey, {a}.o_orderpriority, round({a}.o_totalprice, 2) AS o_totalprice, {b}.o_orderkey AS "o_orderkey{mark}",
           round({b}.o_totalprice, 2) AS "o_totalprice{mark}", CASE WHEN {b}.rn IS NOT NULL THEN 'Matched' END AS "Reco_Status",
           round({diff}, 2) AS "o_totalprice-Difference",
           CASE WHEN {diff} <= abs(({a}.o_totalprice + {b}.o_totalprice) / 2 * 60 / 100) THEN 'Matched' ELSE 'Unmatched' END AS "o_totalprice-Match"
    FROM {a} LEFT JOIN {b} ON {a}.o_custkey = {b}.o_custkey AND {a}.k = {b}.k AND {a}.rn = {b}.rn"""


@query("reco_exact_left", _ledger_side("l", "r", "-2"))
def _(t):
    return _rounded(_ledger_pair(t)[0])


@query("reco_exact_right", _ledger_side("r", "l", "-1"))
def _(t):
    return _rounded(_ledger_pair(t)[1])


@query(
    "reco_stats",
    f"""{_LEDGERS_SQL} SELECT 'left' AS side, count(r.rn) AS matched, count(*) - count(r.rn) AS unmatched
        FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.k = r.k AND l.rn = r.rn
        UNION ALL SELECT 'right', count(l.rn), count(*) - count(l.rn)
        FROM r LEFT JOIN l ON l.o_custkey = r.o_custkey AND l.k = r.k AND l.rn = r.rn""",
)
def _(t):
    return statistics(*_ledger_pair(t))


@query(
    "reco_block_sizes",
    """SELECT coalesce(a.c_nationkey, b.s_nationkey) AS c_nationkey, coalesce(n, 0) AS left_rows, coalesce(m, 0) AS right_rows
       FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) a
       FULL OUTER JOIN (SELECT s_nationkey, count(*) AS m FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey""",
)
def _(t):
    return block_sizes(t.customer, t.supplier, [{"left": "c_nationkey", "right": "s_nationkey"}])


@query(
    "reco_custom_ids",
    """WITH l AS (SELECT c_custkey, c_nationkey, c_acctbal, 'customers-' || row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id,
                         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer),
            r AS (SELECT s_suppkey, s_nationkey, s_acctbal, 'suppliers-' || row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS id,
                         row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier)
       SELECT c_custkey, c_nationkey, c_acctbal, l.id AS "Custom-ID", r.id AS "Custom-ID-2", s_acctbal,
              CASE WHEN r.rn IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(c_acctbal - s_acctbal), 2) AS "c_acctbal-Difference",
              CASE WHEN abs(c_acctbal - s_acctbal) <= 1000 THEN 'Matched' ELSE 'Unmatched' END AS "c_acctbal-Match"
       FROM l LEFT JOIN r ON c_nationkey = s_nationkey AND l.rn = r.rn""",
)
def _(t):
    left, _ = reconcile(
        t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"),
        [{"left": "c_nationkey", "right": "s_nationkey"}],
        [{"left": "c_acctbal", "right": "s_acctbal", "threshold_type": "amount", "threshold_value": 1000}],
        {"method": "one-to-one"}, {"left": ["__Custom__"], "right": ["__Custom__"]}, ("customers", "suppliers"),
        {"left": ["c_acctbal", "c_custkey"], "right": ["s_acctbal", "s_suppkey"]},
    )
    return _rounded(left)


# Order totals against the sum of their lines.
def _order_lines(t):
    return reconcile(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), t.lineitem.select("l_orderkey", "l_extendedprice", "l_tax"),
        [{"left": "o_orderkey", "right": "l_orderkey"}],
        [{"left": "o_totalprice", "right": "l_extendedprice", "threshold_type": "percent", "threshold_value": 40}],
        {"method": "one-to-many"}, {"left": ["o_custkey"], "right": ["l_orderkey"]},
    )


_LINES = "(SELECT l_orderkey, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey) r"


@query(
    "reco_one_to_many_left",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, l_orderkey, round(l_extendedprice, 2) AS l_extendedprice,
               CASE WHEN l_orderkey IS NOT NULL THEN 'Matched' END AS "Reco_Status",
               round(abs(o_totalprice - l_extendedprice), 2) AS "o_totalprice-Difference",
               CASE WHEN abs(o_totalprice - l_extendedprice) <= abs((o_totalprice + l_extendedprice) / 2 * 40 / 100) THEN 'Matched' ELSE 'Unmatched' END AS "o_totalprice-Match"
        FROM orders LEFT JOIN {_LINES} ON o_orderkey = l_orderkey""",
)
def _(t):
    return _rounded(_order_lines(t)[0])


@query(
    "reco_one_to_many_right",
    f"""SELECT l_orderkey, round(l_extendedprice, 2) AS l_extendedprice, o_custkey, o_totalprice,
               CASE WHEN o_orderkey IS NOT NULL THEN 'Matched' END AS "Reco_Status",
               round(abs(o_totalprice - l_extendedprice), 2) AS "l_extendedprice-Difference",
               CASE WHEN abs(o_totalprice - l_extendedprice) <= abs((o_totalprice + l_extendedprice) / 2 * 40 / 100) THEN 'Matched' ELSE 'Unmatched' END AS "l_extendedprice-Match"
        FROM {_LINES} LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def _(t):
    return _rounded(_order_lines(t)[1])


@query(
    "reco_many_to_one",
    """SELECT l.l_partkey, round(l.q, 2) AS l_quantity, p_partkey, p_size, CASE WHEN p_partkey IS NOT NULL THEN 'Matched' END AS "Reco_Status",
              round(abs(l.q - p_size), 2) AS "l_quantity-Difference",
              CASE WHEN abs(l.q - p_size) <= 500 THEN 'Matched' ELSE 'Unmatched' END AS "l_quantity-Match"
       FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) l LEFT JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    left, _ = reconcile(
        t.lineitem.select("l_partkey", "l_quantity"), t.part.select("p_partkey", "p_size"),
        [{"left": "l_partkey", "right": "p_partkey"}],
        [{"left": "l_quantity", "right": "p_size", "threshold_type": "amount", "threshold_value": 500}],
        {"method": "many-to-one"}, {"left": [], "right": ["p_partkey"]},
    )
    return _rounded(left)


@query(
    "reco_many_to_many",
    """SELECT r.o_custkey, round(r.total, 2) AS o_totalprice, l.user_id, round(l.v, 2) AS value,
              CASE WHEN l.user_id IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(r.total - l.v), 2) AS "o_totalprice-Difference",
              CASE WHEN abs(r.total - l.v) = 0 THEN 'Matched' ELSE 'Unmatched' END AS "o_totalprice-Match"
       FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) r
       LEFT JOIN (SELECT user_id, sum(value) AS v FROM events GROUP BY user_id) l ON user_id = o_custkey""",
)
def _(t):
    _, right = reconcile(
        t.events.select("user_id", "value"), t.orders.select("o_custkey", "o_totalprice"),
        [{"left": "user_id", "right": "o_custkey"}], [{"left": "value", "right": "o_totalprice"}],
        {"method": "many-to-many"}, {"left": ["user_id"], "right": []},
    )
    return _rounded(right)


# Each click against the purchases of the same user, one purchase per click.
def _clicks(t, how, base="left"):
    click = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    bought = t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("sale_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("sold_at"), F.col("value").alias("price")
    )
    return reconcile(
        click, bought, [{"left": "user_id", "right": "buyer"}],
        [{"left": "value", "right": "price", "threshold_type": "percent", "threshold_value": 50}],
        {"method": "one-to-one", "duplicate": how, "basis_table": base, "basis_column": {"left": "ts", "right": "sold_at"}},
        {"left": ["event_id"], "right": ["sale_id", "sold_at"]},
        order_by={"left": ["value", "event_id"], "right": ["price", "sale_id"]},
    )


def _greedy(base: str, others: str, condition: str, key: str) -> str:
    """CTEs ``b``, ``o`` and the greedy walk ``g``; ``b`` has blk, rn, id and ``o`` has blk, id."""
    return f"""WITH RECURSIVE b AS ({base}), o AS ({others}),
    g AS (SELECT blk, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS bid, CAST(NULL AS BIGINT) AS oid
          FROM (SELECT DISTINCT blk FROM b)
          UNION ALL
          SELECT blk, i, CASE WHEN oid IS NULL THEN used ELSE list_append(used, oid) END, bid, oid FROM (
            SELECT g.blk, g.i + 1 AS i, g.used, b.id AS bid, arg_min(o.id, {key}) AS oid
            FROM g JOIN b ON b.blk = g.blk AND b.rn = g.i + 1
                   LEFT JOIN o ON o.blk = g.blk AND {condition} AND NOT list_contains(g.used, o.id)
            GROUP BY g.blk, g.i, g.used, b.id))"""


_CLICKS = "SELECT user_id AS blk, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, event_id AS id, epoch_us(ts) AS x FROM events WHERE event_type = 'click'"
_SALES = "SELECT user_id AS blk, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, event_id AS id, epoch_us(ts) AS x FROM events WHERE event_type = 'purchase'"


def _click_sql(condition, base="left"):
    walk = _greedy(
        _CLICKS if base == "left" else _SALES, _SALES if base == "left" else _CLICKS, condition,
        "{'d': abs(b.x - o.x), 'x': o.x, 'id': o.id}",
    )
    click, sale = ("bid", "oid") if base == "left" else ("oid", "bid")
    return f"""{walk}
    SELECT e.event_id, e.user_id, e.ts, e.value, s.event_id AS sale_id, s.ts AS sold_at, s.value AS price,
           CASE WHEN s.event_id IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(e.value - s.value), 2) AS "value-Difference",
           CASE WHEN abs(e.value - s.value) <= abs((e.value + s.value) / 2 * 50 / 100) THEN 'Matched' ELSE 'Unmatched' END AS "value-Match"
    FROM (SELECT * FROM events WHERE event_type = 'click') e
    LEFT JOIN (SELECT {click} AS click, {sale} AS sale FROM g WHERE oid IS NOT NULL) p ON p.click = e.event_id
    LEFT JOIN events s ON s.event_id = p.sale"""


@query("reco_closest", _click_sql("TRUE"))
def _(t):
    return _rounded(_clicks(t, "closest")[0])


@query("reco_closest_right_base", _click_sql("TRUE", "right"))
def _(t):
    return _rounded(_clicks(t, "closest", "right")[0])


@query("reco_before", _click_sql("o.x <= b.x"))
def _(t):
    return _rounded(_clicks(t, "immediately_before")[0])


@query("reco_after", _click_sql("o.x >= b.x"))
def _(t):
    return _rounded(_clicks(t, "immediately_after")[0])


# Order notes against memos of the same customer that word the same facts differently.
def _notes(t, how="first_occurrence"):
    left = t.orders.select(
        "o_orderkey", "o_custkey", F.concat(F.lower("o_orderpriority"), F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("note"),
        "o_totalprice",
    )
    right = t.orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("memo_id"), F.col("o_custkey").alias("cust"),
        F.concat(F.replace(F.lower("o_orderpriority"), F.lit("i"), F.lit("y")), F.lit(" "), F.date_format("o_orderdate", "yyyy/MM/dd")).alias("memo"),
        F.col("o_totalprice").alias("amount"),
    )
    return reconcile(
        left, right, [{"left": "o_custkey", "right": "cust"}, {"left": "note", "right": "memo", "criteria": "fuzzy"}],
        [{"left": "o_totalprice", "right": "amount", "threshold_type": "amount", "threshold_value": 100}],
        {"method": "one-to-one", "duplicate": how, "basis_table": "left",
         "basis_column": {"left": "o_totalprice", "right": "amount"}},
        {"left": [], "right": ["memo_id", "memo"]}, order_by={"left": ["o_orderkey"], "right": ["memo_id"]},
    )


def _notes_sql(key):
    walk = _greedy(
        "SELECT o_custkey AS blk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderkey AS id, o_totalprice AS x, lower(o_orderpriority) || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS note FROM orders",
        "SELECT o_custkey AS blk, o_orderkey AS id, o_totalprice AS x, replace(lower(o_orderpriority), 'i', 'y') || strftime(o_orderdate, ' %Y/%m/%d') AS memo FROM orders WHERE o_orderstatus <> 'P'",
        "round(jaro_winkler_similarity(b.note, o.memo), 12) >= 0.85", key,
    )
    return f"""{walk}
    SELECT l.o_orderkey, l.o_custkey, lower(l.o_orderpriority) || ' ' || strftime(l.o_orderdate, '%Y-%m-%d') AS note, l.o_totalprice,
           r.o_orderkey AS memo_id, replace(lower(r.o_orderpriority), 'i', 'y') || strftime(r.o_orderdate, ' %Y/%m/%d') AS memo, r.o_totalprice AS amount,
           CASE WHEN r.o_orderkey IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(l.o_totalprice - r.o_totalprice), 2) AS "o_totalprice-Difference",
           CASE WHEN abs(l.o_totalprice - r.o_totalprice) <= 100 THEN 'Matched' ELSE 'Unmatched' END AS "o_totalprice-Match"
    FROM orders l LEFT JOIN (SELECT bid, oid FROM g WHERE oid IS NOT NULL) p ON p.bid = l.o_orderkey
    LEFT JOIN orders r ON r.o_orderkey = p.oid"""


@query(
    "reco_fuzzy",
    _notes_sql("{'s': -round(jaro_winkler_similarity(b.note, o.memo), 12), 't': o.memo, 'x': o.x, 'id': o.id}"),
)
def _(t):
    return _rounded(_notes(t)[0])


@query(
    "reco_fuzzy_closest",
    _notes_sql("{'s': -round(jaro_winkler_similarity(b.note, o.memo), 12), 't': o.memo, 'd': abs(b.x - o.x), 'x': o.x, 'id': o.id}"),
)
def _(t):
    return _rounded(_notes(t, "closest")[0])


# Customers and suppliers with blanks in their keys and amounts, which count as 0.
_BLANKS_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM (
                   SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer)),
            r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM (
                   SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier))"""


def _blank_keys(t, left=None):
    blank = lambda c, by, n: F.when(F.col(by) % n != 0, F.col(c)).alias(c)
    people = t.customer.select("c_custkey", blank("c_nationkey", "c_custkey", 10), blank("c_acctbal", "c_custkey", 7))
    firms = t.supplier.select("s_suppkey", blank("s_nationkey", "s_suppkey", 3), blank("s_acctbal", "s_suppkey", 2))
    return reconcile(
        people if left is None else left, firms, [{"left": "c_nationkey", "right": "s_nationkey"}],
        [{"left": "c_acctbal", "right": "s_acctbal", "threshold_type": "amount", "threshold_value": 1000}],
        {"method": "one-to-one"}, {"left": ["c_custkey"], "right": ["s_suppkey"]}, ("customers", "suppliers"),
        {"left": ["c_acctbal", "c_custkey"], "right": ["s_acctbal", "s_suppkey"]},
    )[0]


@query(
    "reco_blank_keys",
    f"""{_BLANKS_SQL} SELECT c_custkey, c_nationkey, c_acctbal, s_suppkey, s_acctbal,
              CASE WHEN r.rn IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(c_acctbal - s_acctbal), 2) AS "c_acctbal-Difference",
              CASE WHEN abs(c_acctbal - s_acctbal) <= 1000 THEN 'Matched' ELSE 'Unmatched' END AS "c_acctbal-Match"
       FROM l LEFT JOIN r ON c_nationkey = s_nationkey AND l.rn = r.rn""",
)
def _(t):
    return _rounded(_blank_keys(t))


@query(
    "reco_again",
    f"""{_BLANKS_SQL} SELECT c_custkey, c_nationkey, c_acctbal, coalesce(s_suppkey, 0) AS s_suppkey, coalesce(s_acctbal, 0) AS s_acctbal,
              s_suppkey AS "s_suppkey-2", s_acctbal AS "s_acctbal-2",
              CASE WHEN r.rn IS NOT NULL THEN 'Matched' END AS "Reco_Status", round(abs(c_acctbal - s_acctbal), 2) AS "c_acctbal-Difference",
              CASE WHEN abs(c_acctbal - s_acctbal) <= 1000 THEN 'Matched' ELSE 'Unmatched' END AS "c_acctbal-Match"
       FROM l LEFT JOIN r ON c_nationkey = s_nationkey AND l.rn = r.rn""",
)
def _(t):
    """An output that is reconciled with the same table once more: pulled columns of both times stay, under own names."""
    return _rounded(_blank_keys(t, _blank_keys(t)))
