"""Line dedup by a segment-partition edit join, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.tables import checked_broadcast, col, drop, free_name, keep

EDITS, LEAST_CHARS = 2, 20
# Texts of a segment group that are compared pair by pair; a larger group is split by segments of what is left of them.
GROUP_TEXTS = 64
# Signatures are compared at a small part of the cost of texts: a group may have so many times more before it is split.
SIGNATURES = 16


def _bucket(total: Column, edits: int) -> Column:
    """A length rounded down to a multiple of up to a quarter of it; short ones, of which a segment needs every character, as they are.

    Texts of one bucket are cut at the same places, so one row serves texts of all lengths that can be near.
    """
    step = F.when(total < 16, 2).when(total < 32, 4).when(total < 64, 8).otherwise(16)
    return F.when(total < max(8, 2 * (edits + 1)), total).otherwise(total - total % step)


def _probes(edits: int) -> list[tuple[int, int, bool, int, int]]:
    """(kind of the row, segment, whether its place counts from the end, shift, delta): the places in a text at which a segment
    of one shorter by ``delta`` can stand; kind 0 are the text's own segments, which other texts may have in the same place.

    Of several segments that may match, the one whose left side has fewest edits is enough, seen from either end. Segments
    are counted from the nearer end, where a longer text is shifted least.
    """
    out = []
    for i in range(edits + 1):
        end = 2 * i > edits
        for delta in range(edits + 1):
            low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            if edits <= 2 and delta == 0:
                # Of texts of equal length with one edit on either side, one has its middle further on in the other.
                low = 0
            out += [(int(delta > 0 or s != 0), i, end, s - delta if end else s, delta) for s in range(low, high + 1)]
    return out


def _rows(df: DataFrame, group: list[str], edits: int) -> DataFrame:
    """Rows of (h, rest, ...) times the segments and probes of ``rest``: ``key`` (a hash), ``kind``, ``start``, ``size``.

    A text is cut into segments at places that its bucket of lengths fixes; a longer one looks for them in its own bucket
    and in another one only where a text shorter by so much falls there. Each text is exploded by a constant list of
    places, so that one short expression makes all keys. Segments are cut from the text at four bytes a character, where
    a place is found without counting characters.
    """
    probes = _probes(edits)
    # The next smaller delta with the same place: its row serves this one too, where both lengths have one bucket.
    less = [max((p[4] for p in probes if p[1:4] == q[1:4] and p[4] < q[4]), default=-1) for q in probes]
    names = ("kind", "i", "end", "shift", "delta", "less")
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (*p, d))]) for p, d in zip(probes, less)])
    out = df.select("*", F.length("rest").alias("n"), F.encode("rest", "UTF-32").alias("wide")).select("*", F.explode(places).alias("w"))
    total = _bucket(F.col("n") - F.col("w.delta"), edits)
    out = out.filter((F.col("n") >= F.col("w.delta")) & ((F.col("w.less") < 0) | (total != _bucket(F.col("n") - F.col("w.less"), edits))))
    out = out.select(*df.columns, "wide", total.alias("total"), "n", F.col("w.kind").alias("kind"), F.col("w.i").alias("i"), F.col("w.end").alias("end"), F.col("w.shift").alias("shift"))
    k = edits + 1
    low = F.expr(f"CAST(total * i div {k} AS INT)")
    out = out.select(*df.columns, "wide", "total", "n", "kind", "i", (low + F.col("shift") + F.when(F.col("end"), F.col("n") - F.col("total")).otherwise(0)).alias("start"),
                     (F.expr(f"CAST(total * (i + 1) div {k} AS INT)") - low).alias("size"))
    out = out.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    key = F.xxhash64(*group, "total", "i", F.substring(F.col("wide"), 4 * F.col("start") + 1, 4 * F.col("size")))
    return out.select(*df.columns, key.alias("key"), "kind", "start", "size")


def edit_within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``: a band of 2 * edits + 1 diagonals, one bit each.

    The bits of a column hold its vertical differences (Hyyro's form); a column costs a few word operations.
    """
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    top, one = edits * 2, F.lit(1).cast("long")
    whole = (1 << (top + 1)) - 1
    n, m = F.length(long), F.length(short)

    def column(state: Column, i: Column, x: Column, y: Column) -> Column:
        at = F.get(y, i)
        match = F.lit(0).cast("long")
        for d in range(-edits, edits + 1):
            here = F.when((i + d >= 0) & (F.get(x, i + d) == at), F.lit(1 << (edits + d)).cast("long")).otherwise(F.lit(0).cast("long"))
            match = match.bitwiseOR(here)
        keep_bits = lambda c: c.bitwiseAND(F.lit(whole).cast("long"))
        vp, vn = state["vp"], state["vn"]
        d0 = keep_bits((match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn))
        # Until the longer text ends, the score runs down the lowest diagonal; then it runs along the last row.
        last = state["last"]
        along = i >= state["turn"]
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), last.alias("last"), along.alias("along"), state["score"].alias("score"), state["turn"].alias("turn"))

    def settle(s: Column) -> Column:
        flip = lambda c: F.lit(whole).cast("long").bitwiseAND(F.bitwise_not(c))
        hp = s["vn"].bitwiseOR(flip(s["d0"].bitwiseOR(s["vp"])))
        hn = s["d0"].bitwiseAND(s["vp"])
        down = F.when(s["d0"].bitwiseAND(F.lit(1 << top).cast("long")) == 0, one).otherwise(0 * one)
        right = F.when(hp.bitwiseAND(s["last"]) != 0, one).otherwise(0 * one) - F.when(hn.bitwiseAND(s["last"]) != 0, one).otherwise(0 * one)
        half = F.shiftright(s["d0"], 1)
        return F.struct(
            hn.bitwiseOR(flip(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
            F.when(s["along"], F.shiftright(s["last"], 1)).otherwise(s["last"]).alias("last"),
            (s["score"] + F.when(s["along"], right).otherwise(down)).alias("score"), s["turn"].alias("turn"),
        )

    start = F.struct(F.lit(whole & ~((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(1 << (top - 1)).cast("long").alias("last"), F.lit(edits).cast("long").alias("score"), (n - edits).alias("turn"))
    chars = F.struct(F.split(long, "").alias("x"), F.split(short, "").alias("y"))
    # Both columns of characters are made once per pair, as the only element of an array.
    score = F.transform(F.array(chars), lambda c: F.aggregate(
        F.sequence(F.lit(0), m - 1), start, lambda s, i: F.transform(F.array(column(s, i, c["x"], c["y"])), settle)[0], lambda s: s["score"]))[0]
    return F.when(n - m > edits, F.lit(False)).when(m <= edits, F.levenshtein(long, short) <= edits).otherwise(score <= edits)


def lines_of(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """Lines of at least ``least_chars`` characters without the blanks around them: row, doc_id, pos, line."""
    src = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("t"))
    # The name of the row is made once per text, before its lines are.
    rows = src.select("doc_id", "t", _row(F.col("doc_id"), F.col("t")).alias("row")).select("row", "doc_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    rows = rows.select("row", "doc_id", "pos", _trimmed(F.col("line")).alias("line"))
    return rows.filter(F.length("line") >= least_chars)


def _trimmed(line: Column) -> Column:
    """``line`` without the blanks around it; the built-in trim walks through the whole line, so it is left to lines that need it."""
    blanks = " \t\n\x0b\x0c\r"
    outer = reduce(Column.__or__, [at(line, F.lit(c)) for at in (F.startswith, F.endswith) for c in blanks])
    return F.when(outer, F.btrim(line, F.lit(blanks))).otherwise(line)


def _row(doc_id: Column, text: Column) -> Column:
    """What names a row: its id and its text. Rows that repeat both are one row that occurs several times."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), text)))


# Keys that are marked for broadcast at most, with the texts of their rows at hand.
_FEW_KEYS = 500_000
# Rows with removed lines, of ten lines on average, that are marked for broadcast at most; beyond, texts are shuffled.
_FEW_ROWS = 200_000


def _shared(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(rows (key, h, kind) whose key several texts have, one of them segmented; whether ``rest`` came along).

    Where the keys are few, their rows are picked out of the scan, with the text; otherwise only short rows are shuffled.
    """
    found = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("kind").alias("kind"))
    found = keep(found.filter((F.col("low") != F.col("high")) & (F.col("kind") == 0)).select("key"))
    few = found.count() <= _FEW_KEYS
    if few:
        out = keep(rows.select("key", "h", "kind", "rest").join(F.broadcast(found), "key", "left_semi").distinct())
    else:
        out = keep(rows.select("key", "h", "kind").join(found, "key", "left_semi").distinct())
    drop(found)
    return out, few


def _without_repeats(rows: DataFrame) -> DataFrame:
    """Rows of one key for each set of texts: a passage of several segments brings the same texts together once."""
    sets = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.bit_xor(F.xxhash64("h", "kind")).alias("mix"), F.count(F.lit(1)).alias("n"))
    one = keep(sets.groupBy("low", "high", "mix", "n").agg(F.min("key").alias("key")).select("key"))
    out = keep(rows.join(checked_broadcast(one), "key", "left_semi"))
    drop(one)
    return out


def signature(line: Column) -> Column:
    """64 bits: for each class of characters (code point modulo 64) whether it occurs an odd number of times.

    An edit takes away one character at most and brings one at most, so it flips two bits at most.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63)))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(bit(c)))


def pair_signature(line: Column) -> Column:
    """64 bits: for each class of a character and the one before it whether they occur together an odd number of times.

    An edit takes away two such pairs and brings two at most, so it flips four bits at most.
    """
    def add(s: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (s["last"] * 37 + F.ascii(c)).bitwiseAND(F.lit(63)))
        return F.struct(F.ascii(c).alias("last"), s["bits"].bitwiseXOR(bit).alias("bits"))

    return F.aggregate(F.split(line, ""), F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("bits")), add, lambda s: s["bits"])


def _alike(a: Column, b: Column, edits: int, flips: int = 2) -> Column:
    """Whether two signatures of so many ``flips`` an edit allow ``edits`` edits; texts within ``edits`` always do."""
    return F.bit_count(a.bitwiseXOR(b)) <= flips * edits


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_lines(lines: DataFrame, edits: int = EDITS, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """(node, root) of the distinct lines that are within ``edits`` of another one, or linked through others.

    Two texts within ``edits`` agree in one of ``edits`` + 1 segments of the shorter (or, of equal length, of either), at a
    shift that its place and the difference of lengths bound. Of a group of texts with the same segment, all are compared with the first; those
    still apart are compared in pairs, or, in a large group, meet again by the segments of their remaining parts, whose
    distance is bounded too. A pair is a row only if what is left of its texts is within ``edits``, so a group's pairs
    are the links it has, not the square of its size; signatures spare most distances.
    """
    h = F.xxhash64("line").alias("h")
    shared, whole = _shared(_rows(lines.select(h, F.col("line").alias("rest")), [], edits))
    texts = shared.select("h", F.col("rest").alias("line")).distinct() if whole else lines.select(h, "line").join(shared.select("h").distinct(), "h", "left_semi").distinct()
    rows = _without_repeats(shared.select("key", "h", "kind").distinct())
    # Lines are told apart by their text; h only brings candidates together.
    texts = keep(texts.withColumns({"node": F.unhex(F.md5("line")), "sig": signature(F.col("line"))}))
    drop(shared)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("h").alias(s), F.col("line").alias(f"line_{s}"), F.col("node").alias(f"node_{s}")) for s in "ab")
        both = pairs.join(x, "a").join(y, "b").filter(F.abs(F.length("line_a") - F.length("line_b")) <= edits)
        # The built-in distance with a bound rejects most candidates early; the band decides.
        both = both.filter(F.levenshtein(F.col("line_a"), F.col("line_b"), edits) >= 0)
        return keep(both.filter(edit_within(F.col("line_a"), F.col("line_b"), edits)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))

    same = texts.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter(F.col("a") != F.col("b"))
    clash = texts.join(same, "h").filter(F.col("node") != F.col("a"))
    clash = clash.join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a").filter(edit_within(F.col("line_a"), F.col("line"), edits))
    links = clash.select("a", F.col("node").alias("b"))

    # Where several texts have one h, each brings a row of its own.
    rows = keep(rows.join(texts.select("h", "sig"), "h"))
    first = rows.filter("kind = 0").groupBy("key").agg(F.min(F.struct("h", "sig")).alias("first"))
    near_first = rows.join(first, "key").filter((F.col("first.h") != F.col("h")) & _alike(F.col("first.sig"), F.col("sig"), edits))
    links = keep(links.unionByName(verified(_ordered(near_first.select(F.col("first.h").alias("a"), F.col("h").alias("b"))))))
    root = components(links)
    where = texts.join(root, "node", "left").select("h", "sig", "node", F.coalesce("root", "node").alias("root"))
    apart = rows.join(where, ["h", "sig"])
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = keep(mixed.filter(F.col("low") != F.col("high")).select("key", "n"))
    if mixed.isEmpty():
        return root
    apart = keep(apart.join(mixed, "key").select("key", "h", "kind", "node", "root", "n"))
    open_texts = texts.join(apart.select("node").distinct(), "node", "left_semi")
    open_texts = keep(open_texts.select("node", "sig", pair_signature(F.col("line")).alias("grams"), F.col("line").alias("rest")))
    most = group_texts * SIGNATURES
    found = [verified(keep(_ordered(_cross(apart.filter(F.col("n") <= most).join(open_texts, "node"), edits))))]
    hot = apart.filter(F.col("n") > most)
    if not hot.isEmpty():
        hot_texts = open_texts.join(hot.select("node", "h", "root").distinct(), "node").select("h", "sig", "grams", "root", "rest")
        found.append(verified(keep(_ordered(_split(hot_texts, keep(hot.select("key").distinct()), edits, most)))))
    more = found[0] if len(found) == 1 else found[0].union(found[1])
    return components(links.union(more)) if not more.isEmpty() else root


def _cross(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs of a segmented and another text of one key that are in different components and whose rests are within ``edits``.

    The distance is part of the join, so that a pair beyond it is no row; signatures come before it.
    """
    a, b = (rows.select("key", "kind", F.col("h").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "grams", "root", "rest")]) for s in "ab")
    both = a.filter("kind = 0").drop("kind").join(b.drop("kind"), "key")
    alike = _alike(F.col("sig_a"), F.col("sig_b"), edits) & _alike(F.col("grams_a"), F.col("grams_b"), edits, 4)
    near = F.levenshtein(F.col("rest_a"), F.col("rest_b"), edits) >= 0
    return both.filter((F.col("root_a") != F.col("root_b")) & alike & near).select("a", "b")


def _split(texts: DataFrame, hot: DataFrame, edits: int, most: int) -> DataFrame:
    """Candidate pairs of groups too large to pair, of texts (h, sig, grams, root, rest): split by what is left of the texts, again
    and again, into groups of at most ``most`` rows. The component of a text and its signatures travel with its rows.

    Each level shortens the rests. Once the segmented ones have no more than ``edits`` characters, texts are compared in
    pairs: only so many different ones exist.
    """
    level, before = _rows(texts, [], edits).join(hot, "key", "left_semi"), [hot]
    found = None
    while True:
        level = keep(level.select("key", "h", "sig", "grams", "root", "kind", F.concat(
            F.substring(F.col("rest"), F.lit(1), F.col("start")), F.substring(F.col("rest"), F.col("start") + F.col("size") + 1, F.length("rest"))).alias("rest")).distinct())
        drop(*before)
        sizes = level.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kind") == 0, F.length("rest"))).alias("chars"), F.min("kind").alias("some"))
        sizes = keep(sizes.filter((F.col("low") != F.col("high")) & (F.col("some") == 0)).select("key", ((F.col("n") <= most) | (F.col("chars") <= edits)).alias("small")))
        pairs = keep(_cross(level.join(sizes.filter("small"), "key", "left_semi"), edits))
        found = pairs if found is None else found.union(pairs)
        hot = sizes.filter("NOT small")
        if hot.isEmpty():
            drop(level, sizes)
            return found
        again = level.join(hot, "key", "left_semi")
        before = [level, sizes]
        # Each text of a group may be the shorter one of what is left, wherever its segment was.
        level = _rows(again.select("h", "sig", "grams", "root", "rest", F.col("key").alias("above")), ["above"], edits)


def _short_roots(short: DataFrame, root: DataFrame, edits: int, least_chars: int, group_texts: int) -> DataFrame:
    """``root`` of the long lines, joined with the links of shorter ones; ``short`` holds the lines below ``least_chars`` + ``edits`` characters.

    ``least_chars`` characters of the shorter line allow ``edits`` edits, shorter lines proportionally fewer. Lines that
    allow none are only compared whole.
    """
    found = root
    if edits > 1:
        chars = F.length("line")
        few = keep(short.filter(chars * edits >= least_chars).select("line").distinct())
        for e in range(edits - 1, 0, -1):
            low, high = -(-least_chars * e // edits), -(-least_chars * (e + 1) // edits) - 1
            more = near_lines(few.filter(chars.between(low, high + e)), e, group_texts)
            found = found if more.isEmpty() else found.unionByName(more)
    return root if found is root else components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS, group_texts: int = GROUP_TEXTS, short_lines: bool = False) -> DataFrame:
    """(row, removed): positions, from 0, of the lines of a row that repeat an earlier line; only rows that have some."""
    lines = lines_of(docs, doc_id, text, 1 if short_lines else least_chars)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row", "pos")
    seen = keep(lines.select(F.unhex(F.md5("line")).alias("node"), place.alias("place"), F.when(F.length("line") < least_chars + edits, F.col("line")).alias("line")))
    root = near_lines(lines.filter(F.length("line") >= least_chars).select("line"), edits, group_texts)
    if short_lines:
        root = _short_roots(seen.select("line").filter("line IS NOT NULL"), root, edits, least_chars, group_texts)
    nodes = keep(seen.groupBy("node").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).join(root, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")))
    classes = nodes.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    of = keep(nodes.select("node", "root").join(classes, "root").select("node", "first"))
    again = seen.join(of, "node").filter(F.col("place") != F.col("first"))
    return again.groupBy(F.col("place.row").alias("row")).agg(F.sort_array(F.collect_set("place.pos")).alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with its columns and rows, the text without repeated lines, and ``n_lines`` and ``n_removed``.

    Lines of 20 characters or more, without the blanks around them, are compared over all documents: a line goes if an
    earlier one (by doc_id, then position; null ids last) is equal, within two edits, or linked with it through others.
    Shorter lines stay, unless ``short_lines`` is set: then every line with a word is compared, those whose shorter one
    has 10 to 19 characters within one edit, those below 10 as a whole. Edits are counted in code points. A null text stays null, with no lines; an empty text has one
    empty line. Rows that repeat id and text keep the same lines. An empty table gives no rows.
    Where ``docs`` has a column of one of these two names, that count gets an underscore appended; both are the last columns.
    """
    cut = keep(removed_lines(docs, doc_id=doc_id, text=text, **options))
    sizes = cut.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("lines")).first()
    if sizes["rows"] <= _FEW_ROWS and sizes["lines"] <= 10 * _FEW_ROWS:
        cut = F.broadcast(cut)
    n_lines = free_name("n_lines", docs.columns)
    n_removed = free_name("n_removed", docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[col(n).alias(m) for n, m in zip(docs.columns, names)], _row(col(doc_id), F.coalesce(col(text), F.lit(""))).alias("row"))
    at = F.col(names[docs.columns.index(text)])
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed"))
    # The lines of a text are made once, as the only element of an array, and only where some go.
    left = F.transform(F.array(F.split(at, "\n")), lambda x: F.array_join(F.transform(places(x), lambda i: F.get(x, i)), "\n"))[0]
    new = F.when(F.col("removed").isNull(), at).otherwise(left)
    breaks = F.octet_length(at) - F.octet_length(F.replace(at, F.lit("\n"), F.lit("")))
    out = plain.join(cut, "row", "left")
    return out.select(
        *[(new if n == text else F.col(m)).alias(n) for n, m in zip(docs.columns, names)],
        F.when(at.isNull(), F.lit(0)).otherwise(breaks + 1).cast("long").alias(n_lines),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(n_removed),
    )
