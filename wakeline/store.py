"""Results kept by their arguments and the versions of their inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version(spark: SparkSession, inputs: list[str]) -> str:
    """A digest of the names, sizes and times of all files of the inputs; contents are not read, and one row comes to the driver."""
    found = []
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        mark = [F.sum(F.xxhash64(F.lit(k), "path", "length", "modificationTime").cast("decimal(38,0)")) for k in (1, 2)]
        found.append([path, *map(str, files.agg(F.count(F.lit(1)), *mark).first())])
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()[:32]


def stored(spark: SparkSession, folder: str, name: str, arguments: dict, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` for these arguments and inputs: read where it is stored, else made, written and read.

    It lies under ``folder/name/<digest of the arguments>/<version of the inputs>`` as Parquet, and counts as stored once its
    write has been committed as a whole, so a run that failed half way is made again. When the inputs have changed the
    results of earlier versions for the same arguments are dropped, after the new one is there. Arguments are plain values.
    """
    digest = hashlib.sha256(json.dumps(arguments, sort_keys=True).encode()).hexdigest()[:32]
    jvm = spark.sparkContext._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    own, now = f"{folder.rstrip('/')}/{name}/{digest}", version(spark, inputs)
    files = at(own).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at(own, now, "_SUCCESS")):
        make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{own}/{now}")
        for status in files.listStatus(at(own)):
            if status.getPath().getName() != now:
                files.delete(status.getPath(), True)
    return spark.read.parquet(f"{own}/{now}")
