"""Kept tables are removed by name only, and counts of lines never share a name with a column."""

import os

from tallyframe.llm import line_dedup
from tallyframe.llm.tables import drop, keep, shared_folder


def test_only_superseded_tables_go(spark):
    first, second = keep(spark.range(3)), keep(spark.range(5))
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    drop(first, first, spark.range(2))
    gone = before - set(os.listdir(shared_folder(spark).removeprefix("file:")))
    assert len(gone) == 1 and second.count() == 5


def test_counts_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a line of more than twenty characters", 7, 8)], "doc_id long, text string, n_lines int, N_Removed int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "N_Removed", "n_lines_", "n_removed_"]
