"""Near copies by ProbMinHash of weighted shingles: sketches, bands, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.tables import checked_broadcast, col, keep
from tallyframe.llm.words import map_with_ids, mix, pick, steps, text_list, weighted_shingles

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 8
# Pairs whose signatures agree in fewer registers than the least similarity less this many standard errors are not verified.
_ERRORS = 5
# Signatures of a block that are compared with another block.
BLOCK = 256
_GOLDEN = 0x9E3779B97F4A7C15


def weights(times: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs so many times; the logarithm keeps repeated filler from outweighing the text."""
    return 1 + np.log(times)


def prob_min_hash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures (``n_docs`` x ``size``) of weighted items: the item that arrives first in each register, 0 if none.

    Every item sends the points of a Poisson process of rate ``weight``, each to a random register; times and registers
    depend on the item and the turn alone. An item stops once its time is beyond the latest first arrival of its text.
    Two signatures agree in a register with a probability that is the probability Jaccard similarity.
    """
    first, who = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, np.uint64)
    late = np.full(n_docs, np.inf)
    time = np.zeros(len(item))
    turn = 0
    while len(item):
        turn += 1
        bits = mix(item + np.uint64((turn * _GOLDEN) & ((1 << 64) - 1)))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        alive = time < late[doc]
        doc, item, weight, time, bits = doc[alive], item[alive], weight[alive], time[alive], bits[alive]
        at = doc * size + (mix(bits) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        who[at[won]] = item[won]
        some = np.unique(doc)
        late[some] = first.reshape(n_docs, size)[some].max(axis=1)
        alive = time < late[doc]
        doc, item, weight, time = doc[alive], item[alive], weight[alive], time[alive]
    return who.reshape(n_docs, size)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(signatures), bands)).copy()
    parts = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = mix(keys * np.uint64(3) + parts[:, :, i])
    return keys.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two sorted (item, weight) vectors: the sum over common items x of
    1 / sum over all items d of max(a(d)/a(x), b(d)/b(x))."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    wa, wb = np.zeros(len(a[0]) + len(b[0]) - len(i)), np.zeros(len(a[0]) + len(b[0]) - len(i))
    wa[: len(a[0])] = a[1]
    wb[i] = b[1][j]
    wb[len(a[0]) :] = np.delete(b[1], j)
    # max(a(d)/a(x), b(d)/b(x)) is b(d)/b(x) where b(d)/a(d) > b(x)/a(x): order d by that ratio, then two running sums.
    ratio = np.divide(wb, wa, out=np.full(len(wa), np.inf), where=wa > 0)
    order = np.argsort(ratio, kind="stable")
    up, down = np.concatenate([[0], np.cumsum(wa[order])]), np.concatenate([np.cumsum(wb[order][::-1])[::-1], [0]])
    ax, bx = wa[i], wb[i]
    cut_at = np.searchsorted(ratio[order], bx / ax, side="right")
    return float((1 / (up[cut_at] / ax + down[cut_at] / bx)).sum())


def sketches(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, ``node`` (md5 of the text), ``keys`` (band keys; none for a text without words), ``low`` (a byte per register)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = text_list(b["t"])
            for part in steps(texts):
                some = texts[part]
                d, item, times = weighted_shingles(some, words)
                signature = prob_min_hash(d, item, weights(times), len(some), bands * rows)
                keys, low = band_keys(signature, bands, rows), signature.astype(np.uint8)
                found = np.bincount(d, minlength=len(some)) > 0
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[part], "node": b["node"].to_numpy()[part], "keys": [k if f else k[:0] for k, f in zip(keys, found)], "low": [x.tobytes() for x in low]})

    src = pick(docs, doc_id=doc_id, t=text).select("doc_id", F.coalesce("t", F.lit("")).alias("t"))
    return map_with_ids(src.withColumn("node", F.unhex(F.md5("t"))), run, "node binary, keys array<long>, low binary")


def likely(pairs: DataFrame, signatures: DataFrame, registers: int, similarity: float) -> DataFrame:
    """The pairs whose signatures allow the similarity, within a few standard errors."""
    least = similarity - _ERRORS * np.sqrt(similarity * (1 - similarity) / registers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), registers) for c in ("low_a", "low_b"))
                yield b.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    x, y = (signatures.select(F.col("node").alias(s), F.col("low").alias(f"low_{s}")) for s in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "low_a", "low_b").mapInPandas(run, "a binary, b binary")


def crossing(apart: DataFrame, signatures: DataFrame, registers: int, similarity: float, errors: float, nearest: bool) -> DataFrame:
    """Likely pairs of texts that share a bucket and are in different components, found in blocks.

    In each bucket, texts outside its largest component meet all texts of the bucket, a block of signatures against a
    block, so a large bucket is spread over many small matrix comparisons and no pair is a row before it is likely.
    With ``nearest``, only the most similar partner of a text in each block counts. Without, a pair that shares several
    buckets comes from the bucket of the first band it shares.
    """
    least = similarity - errors * np.sqrt(similarity * (1 - similarity) / registers)
    roots = apart.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    rows = apart.join(keep(main), "key").join(signatures, "node")

    def blocks(df: DataFrame, n, name: str) -> DataFrame:
        many = F.ceil(n / BLOCK).cast("long")
        at = F.pmod(F.xxhash64("node"), many).alias(name)
        count = F.ceil(F.col("n") / BLOCK).cast("long").alias("count")
        return df.select("key", at, count, F.struct("node", "root", "low", *([] if nearest else ["keys"])).alias("x")).groupBy("key", name, "count").agg(F.collect_list("x").alias(f"{name}_rows"))

    few = blocks(rows.filter(F.col("root") != F.col("main")), F.col("n") - F.col("most"), "p")
    few = few.select("key", "p_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("q"))
    both = few.join(blocks(rows, F.col("n"), "q").select("key", "q", "q_rows"), ["key", "q"]).select("key", "p_rows", "q_rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, ps, qs in zip(b["key"], b["p_rows"], b["q_rows"]):
                x, y = (np.frombuffer(b"".join(r["low"] for r in side), np.uint8).reshape(len(side), registers) for side in (ps, qs))
                _, code = np.unique(np.array([r["root"].hex() for r in [*ps, *qs]]), return_inverse=True)
                i, j = np.nonzero(code[: len(ps), None] != code[None, len(ps) :])
                share = np.zeros(len(i))
                for low in range(0, len(i), 20_000):
                    part = slice(low, low + 20_000)
                    share[part] = (x[i[part]] == y[j[part]]).mean(axis=1)
                ok = share >= least
                if nearest and len(i):
                    first = np.searchsorted(i, np.arange(len(ps)))
                    first = first[(first < len(i)) & (i[np.minimum(first, len(i) - 1)] == np.arange(len(ps)))]
                    ok &= share == np.repeat(np.maximum.reduceat(share, first), np.diff(np.append(first, len(i))))
                if not nearest and ok.any():
                    # Texts in different components meet in every bucket that they share, and one of these is enough.
                    x_keys, y_keys = (np.array([r["keys"] for r in side], dtype=np.int64) for side in (ps, qs))
                    for part in np.array_split(np.flatnonzero(ok), 1 + np.count_nonzero(ok) // 20_000):
                        same = x_keys[i[part]] == y_keys[j[part]]
                        ok[part] = (x_keys[i[part], same.argmax(axis=1)] == key) | ~same.any(axis=1)
                found = [sorted((ps[k]["node"], qs[m]["node"])) for k, m in zip(i[ok], j[ok])]
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return both.mapInPandas(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have a probability Jaccard of ``similarity`` or more."""
    needed = keep(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    one = texts.join(checked_broadcast(needed), "node", "left_semi")
    one = keep(one.groupBy("node").agg(F.min("t").alias("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in steps([x + y for x, y in zip(b["ta"], b["tb"])]):
                p = b.iloc[part]
                code, distinct = pd.factorize(pd.concat([p["ta"], p["tb"]], ignore_index=True))
                d, item, times = weighted_shingles(list(distinct), words)
                at = np.searchsorted(d, np.arange(len(distinct) + 1))
                v = [(item[x:y], weights(times[x:y])) for x, y in zip(at, at[1:])]
                ok = [probability_jaccard(v[i], v[j]) >= similarity - 1e-9 for i, j in zip(code[: len(p)], code[len(p) :])]
                yield p.loc[ok, ["a", "b"]]

    both = pairs.join(one.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(one.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


def near_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(sketch rows: doc_id, node; classes: node, root) - see ``near_copies``."""
    rows_of = keep(sketches(docs, doc_id, text, bands, rows, words))
    texts = pick(docs, t=text).select(F.unhex(F.md5(F.coalesce("t", F.lit("")))).alias("node"), F.coalesce("t", F.lit("")).alias("t"))
    nodes = rows_of.groupBy("node").agg(F.first("keys").alias("keys"))
    signatures = rows_of.groupBy("node").agg(F.first("low").alias("low"), F.first("keys").alias("keys"))

    member = nodes.select("node", F.explode("keys").alias("key"))
    shared = keep(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    member = keep(member.join(shared, "key"))
    # First the pairs with one text of each bucket, the one with most company over all its buckets: an original rather
    # than a copy. As many pairs as members, however large a bucket is.
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    first = member.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("a"))
    star = member.join(first, "key").filter(F.col("node") != F.col("a")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    done = keep(likely(star, signatures, bands * rows, similarity))
    links = keep(verified(done, texts, words, similarity))
    root = components(links)
    # Then, across components, the nearest texts of a bucket, and last every pair of what is still apart.
    for nearest in (True, False):
        apart = member.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high")).select("key")
        apart = keep(apart.join(mixed, "key", "left_semi"))
        # A pair that was verified before and failed is not verified again.
        fresh = keep(crossing(apart, signatures, bands * rows, similarity, _ERRORS, nearest).distinct().join(done, ["a", "b"], "left_anti"))
        done = keep(done.union(fresh))
        more = keep(verified(fresh, texts, words, similarity))
        if not more.isEmpty():
            links = keep(links.union(more))
            root = components(links)
    return rows_of.select("doc_id", "node"), root


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, ``class_id`` (least doc_id of its class), ``class_size``.

    Texts are vectors of five-word shingles weighted by 1 + log(count); ProbMinHash signatures of 384 registers are cut
    into 48 bands of 8, so that a pair of similarity 0.8 shares a band with probability 0.9998. Texts that share a
    band and whose signatures allow the similarity are verified by the exact probability Jaccard of their vectors, and linked texts form classes. Equal texts are
    one node from the start. Buckets are first compared with one text only; what is still apart after
    contraction is compared in full, in blocks of signatures.

    A text of one to four words is one shingle. A null or empty text or one without words is in a class of its own, as
    are documents without a copy; a null id shows as null. Repeated rows are copies of each other; an empty table gives
    no rows.
    """
    rows, root = near_classes(docs, **options)
    plain = F.unhex(F.md5(F.lit("")))
    at = rows.join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    sizes = at.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = at.join(sizes, "root")
    alone = F.col("root") == plain
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the least doc_id of each class (nulls last); texts without
    words stay. Of rows that repeat both id and text one stays."""
    rows, root = near_classes(docs, doc_id=doc_id, text=text, **options)
    at = rows.join(root, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    first = at.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "node")).alias("m"))
    stay = first.select(F.col("m.id").alias("stay_id"), F.col("m.node").alias("stay_node"))
    node = F.unhex(F.md5(F.coalesce(col(text), F.lit(""))))
    wordless = F.coalesce(F.length(F.regexp_replace(col(text), "[\\x20\\x09-\\x0D]+", "")) == 0, F.lit(True))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[col(n).alias(m) for n, m in zip(docs.columns, names)], col(doc_id).alias("own_id"), node.alias("own_node"), wordless.alias("wordless"))
    count = rows.groupBy(F.col("doc_id").alias("of_id"), F.col("node").alias("of_node")).agg(F.count(F.lit(1)).alias("times"))
    stay = stay.join(count, F.col("stay_id").eqNullSafe(F.col("of_id")) & (F.col("stay_node") == F.col("of_node"))).select("stay_id", "stay_node", "times")
    kept = plain.filter(~F.col("wordless")).join(stay, (F.col("own_node") == F.col("stay_node")) & F.col("own_id").eqNullSafe(F.col("stay_id")))
    once = kept.filter("times = 1").select(*names)
    again = kept.filter("times > 1").dropDuplicates(["stay_node"]).select(*names)
    out = once.union(again).union(plain.filter("wordless").select(*names))
    return out.select(*[F.col(m).alias(n) for n, m in zip(docs.columns, names)])
