"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 50_000
# Shuffle files of a finished write go at once; the written table takes their place.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
        folder = tempfile.mkdtemp(prefix="schemaloom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from the written rows.

    Cuts the lineage, survives lost executors, and gives later joins the true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


ARROW_TYPES = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of metadata known on the driver; a local relation whose size Spark knows."""
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(c, ARROW_TYPES[kind]) for c, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/schemaloom-{name}-{uuid.uuid4().hex}"


def free_column(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; stops counting beyond the bound."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a checked size; otherwise the join shuffles and AQE splits skew."""
    return F.broadcast(df) if fits(df, max_rows) else df
