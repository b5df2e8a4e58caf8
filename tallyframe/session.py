"""Session settings, size limits and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Keys a deployment may set on the session; the second item is the default.
HOT_GROUP_ROWS = ("spark.tallyframe.hotGroupRows", 2_000_000)
PIVOT_MAX_COLUMNS = ("spark.tallyframe.pivotMaxColumns", 10_000)
PAGE_TAKE_ROWS = ("spark.tallyframe.pageTakeRows", 100_000)
CHUNK_ROWS = ("spark.tallyframe.chunkRows", 200_000)
BLOCK_PAIRS = ("spark.tallyframe.blockPairs", 1_000_000)
MERGE_PAIRS = ("spark.tallyframe.mergePairs", 1_000_000)
VISITOR_ROWS = ("spark.tallyframe.visitorRows", 800_000)


def local_session(app: str = "tallyframe", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, key: tuple[str, int]) -> int:
    return int(spark.conf.get(key[0], str(key[1])))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session, whose one process has one disk, gets a folder of its own when none is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="tallyframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition for a compute-bound Python stage; the fixed count keeps AQE from merging small inputs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
