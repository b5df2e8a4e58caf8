"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import col, keep

KINDS = ("assign", "access", "hex", "owned")
# The base patterns; letters of the first group in either case.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
# What else may be a credential: a long run with digits and both cases.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# What every assignment holds: texts without it are not taken apart.
_MAY_ASSIGN = "(?i:passw|secret|token|api_?key)"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of the non-overlapping matches; positions are code points.

    The pieces between the matches and the matches themselves, summed up, are the positions.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["hit"].alias("value")))).alias("out"))

    return F.aggregate(both, start, step, lambda s: s["out"])


def spans(text: str) -> Column:
    """Base spans and further candidates of a text; texts without a sign of a kind are not taken apart for it."""
    t = F.col(text)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    only = lambda sign, pattern, kind: F.when(t.rlike(sign), _spans(t, pattern, kind)).otherwise(none)
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    assign = F.transform(only(_MAY_ASSIGN, ASSIGN, "assign"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value")))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")
    other = F.filter(only(CANDIDATE, CANDIDATE, "owned"), mixed)
    return F.concat(assign, only(ACCESS, ACCESS, "access"), only(HEX, HEX, "hex"), other)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos): distinct owners and repositories of every candidate value.

    Rows of (hash, owner, repo) are combined before they meet, so a value that a third of all rows hold arrives as one
    row per owner and repository and map task.
    """
    pairs = found.select("hash", "owner", "repo").distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang", most_owners: int = 2, most_repos: int = 3) -> DataFrame:
    """One row per document: counts and digest of the base spans, all ``spans``, ``n_live`` and ``n_example``.

    Candidates are the base spans and any other run of 20 or more characters with digits and letters of both cases.
    The hash of each value (of an assignment: what is assigned) is counted over the corpus by distinct repositories and
    owners; an owner is a value of ``owner``, a repository a value of ``repo`` within one. A value that at most
    ``most_owners`` owners and ``most_repos`` repositories hold looks live; one held by more is an example that was
    copied around. A live candidate outside the base spans is added as a span of kind ``owned``. Base spans stay,
    whatever their ownership.

    A null text is empty; null owners and repositories are values of their own. Documents are told apart by id and text,
    so rows that repeat both get the same result. An empty table gives no rows.
    """
    t = F.coalesce(col(text), F.lit(""))
    base = docs.select(col(doc_id).alias("doc_id"), t.alias("t"), F.coalesce(col(owner).cast("string"), F.lit("\u0000")).alias("owner"), F.coalesce(col(repo).cast("string"), F.lit("\u0000")).alias("repo"))
    rows = base.select("doc_id", F.unhex(F.md5("t")).alias("node"), "owner", "repo", spans("t").alias("s"))
    rows = keep(rows.withColumn("s", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.unhex(F.sha2(s["value"].cast("binary"), 256)).alias("hash")))))
    some = F.size("s") > 0
    flat = rows.filter(some).select("doc_id", "node", "owner", "repo", F.explode("s").alias("x")).select("doc_id", "node", "owner", "repo", "x.*")
    owned = ownership(flat)
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    # Texts that are equal have the same spans, so a text is judged once.
    per = flat.select("node", "kind", "start", "end", "hash").distinct().join(owned.select("hash", live.alias("live")), "hash")
    judged = per.groupBy("node").agg(F.collect_list(F.struct("start", "end", "kind", "live")).alias("all"))
    out = rows.select("doc_id", "node", some.alias("some")).join(judged, "node", "left")
    rank = lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("kind"), s["live"].alias("live"))
    every = F.array_sort(F.transform(F.coalesce("all", F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>")), rank))
    out = out.select("doc_id", every.alias("all"))
    of_base = F.filter("all", lambda s: s["kind"] != "owned")
    clear = lambda s: ~F.exists(of_base, lambda b: (b["a"] < s["c"]) & (s["a"] < b["c"]))
    shown = F.filter("all", lambda s: (s["kind"] != "owned") | (s["live"] & clear(s)))
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["a"], s["c"])), ",")
    is_kind = lambda k: lambda s: s["kind"] == k
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    return out.select(
        "doc_id", *[count(of_base, is_kind(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text_of(of_base).cast("binary"), 256).alias("base_sha256"), text_of(shown).alias("spans"),
        count(shown, lambda s: s["live"]).alias("n_live"), count(shown, lambda s: ~s["live"]).alias("n_example"),
    )
