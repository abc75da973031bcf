"""Tables that change in one step: a write goes to a folder of its own, and one rename makes it current.

A table's folder holds ``data/version=.../`` and the manifest, which names the schema and the folders that
make up the table now. A write that fails, at any point, leaves the old manifest and so the old rows; readers
that have begun go on with the folders that they know. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.runtime import free_column
from schemaloom.sources.store import exists

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, which are as many as key values."""
    target, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the table at ``path`` consists of; None where nothing was committed yet."""
    file = f"{path}/{MANIFEST}"
    return json.loads(spark.read.text(file, wholetext=True).first()[0]) if exists(spark, file) else None


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    """The manifest is written beside its place and renamed onto it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    staged, fs = _path(spark, f"{path}/staged-{uuid.uuid4().hex}.json")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(staged, _path(spark, f"{path}/{MANIFEST}")[0], options)


def commit(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Replace the table, or with ``key`` only the rows of the key values that ``rows`` has; null is one too.

    With a key the rows lie in a folder per value, whose files are as many as its size asks for. A table
    that is replaced whole may get another schema and another key; one that is replaced by key may not.
    """
    spark = rows.sparkSession
    before = manifest(spark, path) if key else None
    schema = rows.schema.jsonValue()
    if before and (before["key"] != key or T.StructType.fromJson(before["schema"]) != rows.schema):
        raise ValueError(f"The table has the key {before['key']} and the columns of its first write.")
    version = f"version={uuid.uuid4().hex}"
    staged = f"{path}/data/{version}"
    try:
        if key:
            copy = free_column(rows, "folder")
            # a letter in front keeps the empty text apart from null
            keyed = rows.withColumn(copy, F.concat(F.lit("k"), F.col(key).cast("string")))
            keyed.hint("rebalance", F.col(copy)).write.partitionBy(copy).parquet(staged)
        else:
            rows.write.parquet(staged)
    except Exception:
        target, fs = _path(spark, staged)
        fs.delete(target, True)
        raise
    fresh = _folders(spark, staged) if key else [""]
    kept = [f for f in before["folders"] if f.split("/", 1)[1] not in set(fresh)] if before else []
    folders = kept + [f"{version}/{name}" for name in fresh]
    _publish(spark, path, {"schema": schema, "key": key, "folders": folders})


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last commit."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"Nothing was committed to {path}.")
    schema = T.StructType.fromJson(found["schema"])
    if not found["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in found["folders"]])


def drop_old(spark: SparkSession, path: str) -> int:
    """Delete the folders of versions that no row of the table is read from any more; returns how many."""
    used = {f.split("/", 1)[0] for f in (manifest(spark, path) or {"folders": []})["folders"]}
    old = [v for v in _folders(spark, f"{path}/data") if v not in used]
    for version in old:
        target, fs = _path(spark, f"{path}/data/{version}")
        fs.delete(target, True)
    return len(old)
