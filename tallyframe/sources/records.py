"""Records of csv files whose quoted cells hold line breaks, read in splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Splits whose offsets are sent to every task; with more of them the join is shuffled.
MOST_SPLITS = 500_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of their file, with the split that they come from; a line may end in a carriage return."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def split_parities(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, open, broken, total): whether a quote is open where a split begins, how many of its lines have an odd
    number of quotes, and the parity of the whole file. One row per split; the running sum goes over those rows only."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = _lines(spark, path).groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"), F.sum(quotes % 2).alias("broken"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    return counts.select("file", "split", (opened == 1).alias("open"), "broken", (F.sum("odd").over(Window.partitionBy("file")) % 2).alias("total"))


def has_line_breaks(parities: DataFrame) -> bool:
    """Whether any quoted cell holds a line break; a quote that is open at the end of a file raises."""
    worst = parities.groupBy().agg(F.max(F.struct("total", "file")).alias("worst"), F.sum("broken").alias("broken")).first()
    if worst["broken"] and worst["worst"]["total"]:
        raise ValueError(f"a quote is still open at the end of {worst['worst']['file']!r}; read it with line_breaks=False if quotes are plain characters")
    return bool(worst["broken"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of records that began in an earlier split or go on in the next one."""
    at, inside, held, place = None, False, [], 0

    def rows(found: list[tuple]) -> pa.RecordBatch:
        names = ("file", "split", "place", "piece", "record")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    for b in batches:
        found: list[tuple] = []
        files, splits, opens, values = (b.column(i) for i in range(4))
        values = values.to_pylist()
        odd = np.fromiter((v.count('"') & 1 for v in values), bool, len(values))
        keys = list(zip(files.to_pylist(), splits.to_pylist()))
        for key, start, odd_line, value in zip(keys, opens.to_pylist(), odd, values):
            if key != at:
                if held:
                    found.append((*at, place, "tail", "\n".join(held)))
                at, inside, held, place, first = key, start, [], 0, start
            held.append(value)
            inside ^= bool(odd_line)
            if not inside:
                found.append((*at, place, "head" if first else "whole", "\n".join(held)))
                held, first, place = [], False, place + 1
        if found:
            yield rows(found)
    if held:
        # Lines of a split that lies within one record are a piece of their own.
        yield rows([(*at, place, "middle" if first else "tail", "\n".join(held))])


def records(spark: SparkSession, path: str | list[str], parities: DataFrame) -> DataFrame:
    """(file, split, place, record): every record of the files with its line breaks, in order of those three columns.

    Tasks read splits of lines. The quotes before a split say whether its first line goes on with a record; records within
    a split are put together in its task, and only the pieces at its edges are shuffled, by the split where they began.
    """
    offsets = parities.select("file", "split", "open")
    offsets = F.broadcast(offsets) if offsets.count() <= MOST_SPLITS else offsets
    lines = _lines(spark, path).join(offsets, ["file", "split"]).select("file", "split", "open", "value")
    cut = lines.mapInArrow(_cut, "file string, split long, place long, piece string, record string")
    # A piece that goes on belongs to the last split before it that has the beginning of a record.
    edges = cut.filter("piece <> 'whole'")
    before = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = F.last(F.when(F.col("piece") == "tail", F.struct("split", "place")), ignorenulls=True).over(before)
    joined = (
        edges.withColumn("began", began).groupBy("file", "began")
        .agg(F.sort_array(F.collect_list(F.struct("split", "place", "record"))).alias("pieces"))
        .select("file", "began.split", "began.place", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    )
    whole = cut.filter("piece = 'whole'").select("file", "split", "place", "record")
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def parse(reader, found: DataFrame, header: list[str] | None) -> DataFrame:
    """The records as a table, typed by the reader; the first record of each file is its header."""
    spark = found.sparkSession
    first = found.filter("split = 0 and place = 0")
    body = found.filter("not (split = 0 and place = 0) and record <> ''").select("record")
    if header is None:
        top = first.select("record").orderBy("file").limit(1)
        head = spark.read.option("quote", '"').option("escape", '"')._df(_csv(spark.read.option("quote", '"').option("escape", '"'), top)).first()
        header = [n or f"_c{i}" for i, n in enumerate(head)] if head else []
    out = reader._df(_csv(reader.option("header", False), body))
    return out.toDF(*header) if len(header) == len(out.columns) else out


def _csv(reader, lines: DataFrame):
    encoder = lines.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return reader._jreader.csv(getattr(lines._jdf, "as")(encoder))
