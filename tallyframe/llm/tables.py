"""Intermediate tables in the shared folder, and names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the frames that ``keep`` returned are written.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or an own one where a local session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="tallyframe-shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as a table of the shared folder and read from there: lineage ends, only used columns are read."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Removes kept tables that later kept tables have superseded; nothing that is still to run may read them."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column has it; case does not tell columns apart."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def through_arrow(docs: DataFrame, text: str, run) -> DataFrame:
    """``docs`` through mapInArrow under names of place, ``run(place)`` being the function; columns that it hands on keep
    every value, and names may differ in case only."""
    place = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run(place), plain.schema).toDF(*docs.columns)


def checked_broadcast(kept: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A kept table of a few short columns, marked for broadcast if its counted rows are few; else as it is."""
    return F.broadcast(kept) if kept.count() <= most_rows else kept
