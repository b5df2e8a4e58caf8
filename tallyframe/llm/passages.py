"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms of shards of candidate records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import col, keep
from tallyframe.llm.words import _BYTES, _powers, mix

# Bytes that are searched for anchors in one numpy step, that are merged in one step, and that make one shard of it.
STEP, CHUNK, SHARD = 1 << 20, 2 << 20, 1 << 19
# A group of records with more distinct bytes is dealt by narrower keys; widths of those in bytes, the last always fits.
HOT_BYTES, WIDTHS = 4 << 20, (32, 4, 1)
BROADCAST_BYTES = 8 << 20
_LOW = np.uint64((1 << 24) - 1)


class Sums:
    """Hashes of any byte range of one flat array, from running sums."""

    def __init__(self, flat: np.ndarray):
        powers, self.inverse = _powers(len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTES[flat] * powers[: len(flat)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        last = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:last]) * self.inverse[:last])


def anchors(sums: Sums, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor) of every record of the flat texts that end at ``ends``.

    The anchor of a window of ``length`` bytes is its leftmost least-hashed string of a quarter of that length. A record
    is a run of windows with one anchor, so every window is in one record, and equal windows have equal anchors at equal
    places.
    """
    size = max(1, length // 4)
    n = len(sums.sums) - 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    key = sums.every(size)
    key = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
    best, wide = key, 1
    windows = length - size + 1
    while wide * 2 <= windows:
        best, wide = np.minimum(best[:-wide], best[wide:]), wide * 2
    if wide < windows:
        best = np.minimum(best[: n - length + 1], best[windows - wide :])
    anchor = (best & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    ok = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(ok):
        return (np.zeros(0, np.int64),) * 3
    turn = np.flatnonzero((np.diff(anchor[ok], prepend=-1) != 0) | (np.diff(text[ok], prepend=-1) != 0))
    first = ok[turn]
    return first, ok[np.append(turn[1:], len(ok)) - 1], anchor[first]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and its offsets."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _steps(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, past the last text, first byte, past the last byte): whole texts, or overlapping slices of one long text."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > 2 * STEP and high - low > 4 * length:
            cut = max(STEP, 2 * length)
            yield i, j, low, low + cut + length - 1
            low += cut
        yield i, j, low, high
        i = j


_PLACE = "row long, h long, rid long, s long, n int, at int"
_PLACES = "row long, places array<struct<h:long,rid:long,s:long,n:int,at:int>>"


def _places(row: np.ndarray, h, rid, s, n, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(h.view(np.int64)), pa.array(rid.view(np.int64)), pa.array(s, pa.int64()), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))],
        names=["row", "h", "rid", "s", "n", "at"])


def find_places(length: int):
    """For mapInArrow over (row, text): each record as anchor hash, content hash, first window, windows, place of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            flat, offsets = flat_bytes(b.column(1))
            for i, j, low, high in _steps(offsets, length):
                sums = Sums(flat[low:high])
                first, last, anchor = anchors(sums, np.minimum(offsets[i + 1 : j + 1], high) - low, length)
                if len(first):
                    text = np.searchsorted(offsets, first + low, side="right") - 1
                    size = max(1, length // 4)
                    yield _places(rows[text], sums.of(anchor, anchor + size), sums.of(first, last + length), first + low - offsets[text], last - first + 1, anchor - first)

    return run


def _joined(texts: pa.Array, lists: pa.Array) -> tuple:
    """Flat bytes with offsets, and for each listed place: index of its text and its fields."""
    flat, offsets = flat_bytes(texts)
    place = lists.flatten()
    text = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    return flat, offsets, text, {f.name: place.field(f.name).to_numpy(zero_copy_only=False) for f in place.type}


def narrow_places(length: int, width: int):
    """For mapInArrow over (row, text, places): records cut where the window's distance from its anchor passes a multiple
    of ``width``; the key becomes the hash of the bytes that all windows of the piece share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets, text, p = _joined(b.column(1), b.column(2))
            rows = b.column(0).to_numpy()[text]
            first = offsets[text] + p["s"]
            anchor, last = first + p["at"], first + p["n"] - 1
            # Cells of the distance back from the anchor, the farthest first.
            far, near = (anchor - first) // width, (anchor - last) // width
            k = far - near + 1
            of = np.repeat(np.arange(len(first)), k)
            cell = np.repeat(far, k) - (np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k))
            low = np.maximum(first[of], anchor[of] - (cell + 1) * width + 1)
            high = np.minimum(last[of], anchor[of] - cell * width)
            core = anchor[of] - cell * width, anchor[of] - (cell + 1) * width + 1 + length
            # One set of sums for each text that has places keeps them as short as that text.
            h, rid = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
            for t in np.unique(text[of]):
                at = np.flatnonzero(text[of] == t)
                sums, base = Sums(flat[offsets[t] : offsets[t + 1]]), offsets[t]
                h[at] = mix(sums.of(core[0][at] - base, core[1][at] - base) + cell[at].astype(np.uint64) * np.uint64(3) + np.uint64(width))
                rid[at] = sums.of(low[at] - base, high[at] + length - base)
            if len(of):
                yield _places(rows[of], h, rid, low - offsets[text[of]], high - low + 1, anchor[of] - low)

    return run


def cut_records(length: int):
    """For mapInArrow over (row, text, places): the bytes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets, text, p = _joined(b.column(1), b.column(2))
            low = offsets[text] + p["s"]
            high = low + p["n"] - 1 + length
            for i in range(0, len(low), 4096):
                rec = pa.array([flat[x:y].tobytes() for x, y in zip(low[i : i + 4096], high[i : i + 4096])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(p["h"][i : i + 4096]), pa.array(p["rid"][i : i + 4096]), pa.array(p["n"][i : i + 4096]), pa.array(p["at"][i : i + 4096]), rec], names=["h", "rid", "n", "at", "rec"])

    return run


def symbol_width(length: int) -> int:
    """Bytes of a symbol: the largest divisor of ``length`` up to an eighth of it."""
    return max(w for w in range(1, max(1, length // 8) + 1) if length % w == 0)


def dense(key: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct values, in their order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.zeros(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _pairs(first: np.ndarray, second: np.ndarray, base: int) -> np.ndarray:
    """One number for each pair of numbers, the second below ``base``."""
    out = first.astype(np.int64)
    out *= base
    out += second
    return out


def name_symbols(flat: np.ndarray, width: int) -> np.ndarray:
    """Dense ordered names of the ``width`` bytes from each place on, exact, by doubling; bytes past the end are zero."""
    size = min(8, width)
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    key = np.zeros(len(flat), np.uint64)
    for i in range(size):
        key <<= np.uint64(8)
        key |= padded[i : i + len(flat)]
    name = dense(key)
    while size < width:
        step = min(size, width - size)
        key = _pairs(name, np.concatenate([name[step:], np.zeros(step, np.int32)]), len(flat))
        name, size = dense(key), size + step
    return name


class Shard:
    """Burrows-Wheeler transform of some records. A record is ``width`` strings of symbols, one for each phase, so that
    each of its places, and the place past its end, starts one suffix; a suffix shorter than a symbol is the end of its
    string. Suffixes are in order to ``depth`` symbols."""

    def __init__(self, symbol: np.ndarray, left: np.ndarray, since: np.ndarray, width: int, depth: int):
        """``symbol``: name at each place; ``left``: bytes left in its record; ``since``: bytes since its start."""
        n = len(symbol)
        end = left < width
        ends = np.flatnonzero(end)
        self.strings = len(ends)
        rank = symbol + np.int32(self.strings)
        rank[ends] = np.arange(self.strings)
        rank, size = dense(rank), 1
        while size < depth:
            step = size * width
            later = np.zeros(n, np.int32)
            later[: n - step] = rank[step:] + 1
            later[left < step] = 0
            rank, size = dense(_pairs(rank, later, n + 2)), size * 2
        self.places = np.argsort(rank, kind="stable").astype(np.int32)
        before = self.places - width
        self.transform = np.where(since[self.places] >= width, symbol[before], -1).astype(np.int32)


def _stable_order(key: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers below 2^32, by two passes of counting."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged suffix, symbols that it shares with the one before it, ``depth`` for that or more).

    Holt and McMillan's refinement: an interleave of the shards that is right for suffixes of h symbols, read with the
    transforms and dealt by the symbols that stand before, is right for h + 1. A place where neighbours come to differ
    in round h has h common symbols, and stays a boundary in every later round.
    """
    strings = sum(s.strings for s in shards)
    turn = np.concatenate([np.repeat(np.arange(len(shards)), [s.strings for s in shards]), np.repeat(np.arange(len(shards)), [len(s.places) - s.strings for s in shards])]).astype(np.int16)
    n = len(turn)
    common = np.full(n, depth, np.int16)
    common[: strings + 1] = 0
    block = np.zeros(n, np.int32)
    before = np.empty(n, np.int32)
    for h in range(depth):
        for i, s in enumerate(shards):
            before[turn == i] = s.transform
        inner = np.flatnonzero(before >= 0).astype(np.int32)
        inner = inner[_stable_order(before[inner])]
        symbol, old = before[inner], block[inner]
        differ = np.empty(len(inner), bool)
        differ[:1] = True
        differ[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        turn = np.concatenate([turn[:strings], turn[inner]])
        fresh = np.flatnonzero(differ) + strings
        common[fresh[common[fresh] == depth]] = h
        block = np.concatenate([np.arange(strings, dtype=np.int32), np.cumsum(differ, dtype=np.int32) + np.int32(strings - 1)])
    return turn, common


def repeated_windows(records: list[bytes], length: int, shard_bytes: int = SHARD) -> np.ndarray:
    """For the records laid end to end, one place after each: whether ``length`` bytes from there occur at another place too."""
    width = symbol_width(length)
    depth = length // width
    sizes = np.fromiter(map(len, records), np.int64, len(records))
    flat = np.frombuffer(b"\0".join(records) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    since = np.arange(len(flat), dtype=np.int32) - np.repeat(starts[:-1].astype(np.int32), sizes + 1)
    left = np.repeat(sizes.astype(np.int32), sizes + 1) - since
    symbol = name_symbols(flat, width)
    edges = [0]
    for i in range(1, len(records) + 1):
        if i == len(records) or starts[i + 1] - starts[edges[-1]] > shard_bytes:
            edges.append(i)
    shards = []
    for i, j in zip(edges, edges[1:]):
        part = slice(starts[i], starts[j])
        shards.append(Shard(symbol[part], left[part], since[part], width, depth))
    del symbol, left, since
    turn, common = merge(shards, depth)
    # Repeated intervals: runs of merged suffixes that share the whole depth with a neighbour.
    deep = common >= depth
    hit = deep | np.append(deep[1:], False)
    out = np.zeros(len(flat), bool)
    for k, (i, shard) in enumerate(zip(edges, shards)):
        out[starts[i] + shard.places] = hit[turn == k]
    return out


def solve(length: int, chunk: int, shard_bytes: int):
    """For mapInArrow over records in order of their keys: the repeated windows of each record, as runs (first, past the last)."""

    def done(keys: list[tuple], records: list[bytes]) -> pa.RecordBatch:
        hit = repeated_windows(records, length, shard_bytes)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        first, past = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in records])])
        of = np.searchsorted(starts, first, side="right") - 1
        h, rid, n, at = (np.array(x) for x in zip(*keys))
        return pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(rid[of]), pa.array(n[of].astype(np.int32)), pa.array(at[of].astype(np.int32)), pa.array((first - starts[of]).astype(np.int32)), pa.array((past - starts[of]).astype(np.int32))],
                                          names=["h", "rid", "n", "at", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        records: list[bytes] = []
        # Bytes of all records at hand, and, of these, the records and bytes before those of the last key.
        size, whole, before = 0, 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                cells = [b.column(c).slice(i, 1024).to_pylist() for c in range(5)]
                for h, rid, n, at, rec in zip(*cells):
                    if keys and keys[-1][0] != h:
                        whole, before = len(keys), size
                    keys.append((h, rid, n, at))
                    records.append(rec)
                    size += len(rec)
                    # A step ends between two keys only; a key's records are bounded by what is dealt to narrower keys.
                    if size > chunk and whole:
                        yield done(keys[:whole], records[:whole])
                        keys, records, size, whole, before = keys[whole:], records[whole:], size - before, 0, 0
        if keys:
            yield done(keys, records)

    return run


_COVERED = "row long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def cover(length: int, with_text: bool):
    """For mapInArrow over (row, text, runs of repeated windows): what stays of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets, text, p = _joined(b.column(1), b.column(2))
            order = np.argsort(offsets[text] + p["first"], kind="stable")
            text, first, past = text[order], (offsets[text] + p["first"])[order], (offsets[text] + p["past"])[order] - 1 + length
            edges = np.searchsorted(text, np.arange(len(offsets)))
            removed, spans, digest, kept = [], [], [], []
            for t in range(len(offsets) - 1):
                x, y = first[edges[t] : edges[t + 1]], np.maximum.accumulate(past[edges[t] : edges[t + 1]])
                apart = np.flatnonzero(x[1:] > y[:-1])
                low, high = x[np.append(0, apart + 1)], y[np.append(apart, len(y) - 1)]
                rest = b"".join(flat[i:j].tobytes() for i, j in zip(np.append(offsets[t], high), np.append(low, offsets[t + 1])))
                removed.append(int((high - low).sum()))
                spans.append([{"start": int(i - offsets[t]), "end": int(j - offsets[t])} for i, j in zip(low, high)])
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cells = {"row": b.column(0), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(cells | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return run


def _within(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a kept table whose rows take ``row_bytes`` at most, marked for broadcast if its counted bytes are few."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _listed(places: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """(row, text, places) of the texts that have places; the texts are dealt out only if those are many."""
    lists = keep(places.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("places")))
    some = texts.join(_within(lists.select("row"), 8), "row", "left_semi")
    return some.join(lists, "row").select("row", "text", "places")


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, with_text: bool = False, hot_bytes: int = HOT_BYTES, chunk: int = CHUNK, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, ``spans`` (start and end of each removed run, in bytes) and kept_sha256 of every row, and
    the bytes that are left as ``kept`` if ``with_text``.

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, in the same text or another;
    strings are judged on the input. Texts are UTF-8 bytes, and null is the empty text.

    Equal texts are merged first: all of a text that occurs twice goes. In one row of each text every window of
    ``length`` bytes belongs to one record, that of its anchor. Windows in records whose anchor occurs once occur once.
    Equal records are one; where an anchor has several distinct records, tasks build a Burrows-Wheeler transform for
    each shard of them and merge the shards by refining their interleave, whose common prefixes give the repeated
    windows. An anchor with more than ``hot_bytes`` of distinct records is dealt by narrower keys, which all equal
    windows still share, in the end by the window itself.

    A repeated row counts as another place. Texts shorter than ``length`` stay whole. An empty table gives no rows. Ids
    are only passed through, so they may be null or repeat; other columns are not read.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), col(doc_id).alias("doc_id"), body.alias("text"))
                .withColumns({"key": F.md5(F.col("text").cast("binary")), "n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2(F.col("text").cast("binary"), 256)}))
    long = F.col("n_bytes") >= length
    long_texts = rows.filter(long).select("row", "text")
    texts_of = keep(rows.filter(long).groupBy("key").agg(F.min("row").alias("row"), (F.count("*") > 1).alias("copied")))
    others = keep(rows.filter(long).select("row", "key").join(texts_of.filter("copied").select("key", F.col("row").alias("first_row")), "key").filter("row <> first_row").select("row"))
    # Places name one row of each text, so that what is listed by them needs no other look for copies.
    texts = long_texts.join(_within(others, 8), "row", "left_anti")

    places = keep(texts.mapInArrow(find_places(length), _PLACE))
    key = ["h", "rid", "n", "at"]
    parts, solved = [], []
    for width in (*WIDTHS, None):
        shared = keep(places.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))
        found = keep(places.join(_within(shared, 8), "h"))
        records = keep(found.groupBy(*key).agg(F.min(F.struct("row", "s")).alias("one"), (F.count("*") > 1).alias("twice")))
        size = keep(records.groupBy("h").agg(F.count("*").alias("c"), F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")).filter("c > 1"))
        hot = size.filter(F.col("bytes") > hot_bytes).select("h")
        more = width is not None and not hot.isEmpty()
        if more:
            hot = keep(hot)
            parts.append(found.join(_within(hot, 8), "h", "left_anti"))
            records, size = records.join(_within(hot, 8), "h", "left_anti"), size.join(_within(hot, 8), "h", "left_anti")
        else:
            parts.append(found)
        whole = records.filter("twice").select(*key, F.lit(0).alias("first"), F.col("n").alias("past"))
        rest = records.join(_within(keep(size.select("h")), 8), "h", "left_semi").select(F.col("one.row").alias("row"), F.col("one.s").alias("s"), *key)
        cut = _listed(rest, long_texts, ["h", "rid", "s", "n", "at"]).mapInArrow(cut_records(length), "h long, rid long, n int, at int, rec binary")
        ordered = cut.repartition("h").sortWithinPartitions("h", "rid", "n", "at")
        runs = ordered.mapInArrow(solve(length, chunk, shard_bytes), "h long, rid long, n int, at int, first int, past int")
        solved.append(keep(runs.join(_within(keep(records.filter("twice").select(*key)), 24), key, "left_anti").union(whole)))
        if not more:
            break
        wide = _listed(found.join(_within(hot, 8), "h", "left_semi"), long_texts, ["s", "n", "at"])
        places = keep(wide.mapInArrow(narrow_places(length, width), _PLACE))

    hits = None
    for part, runs in zip(parts, solved):
        one = part.join(runs, key).select("row", (F.col("s") + F.col("first")).alias("first"), (F.col("s") + F.col("past")).alias("past"))
        hits = one if hits is None else hits.union(one)
    # A text that occurs twice goes as a whole, whatever its places say.
    once = long_texts.join(_within(keep(texts_of.filter("copied").select("row")), 8), "row", "left_anti")
    covered = _COVERED + ", kept binary" * with_text
    done = keep(_listed(hits, once, ["first", "past"]).mapInArrow(cover(length, with_text), covered))

    by_text = texts_of.join(done, "row", "left").filter("copied or n_removed is not null").drop("row")
    out = rows.join(by_text, "key", "left")
    gone, empty = F.coalesce("copied", F.lit(False)), F.lit("").cast("binary")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    result = {
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"),
        "spans": F.when(gone, everything).otherwise(F.coalesce("spans", nothing)),
        "kept_sha256": F.when(gone, F.sha2(empty, 256)).otherwise(F.coalesce("kept_sha256", "sha")),
    }
    if with_text:
        result["kept"] = F.when(gone, empty).otherwise(F.coalesce("kept", F.col("text").cast("binary")))
    return out.select("doc_id", "n_bytes", *[v.alias(k) for k, v in result.items()])
