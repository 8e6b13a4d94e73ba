"""Grids of experiments whose results are kept one by one, so that a run that ends early is gone on with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class ProgressTable:
    """Results below ``path``, in a folder for each setting that is named by a hash of its keys.

    A result counts once its folder holds the mark that Spark writes last. What a run that was
    killed has left without one is written over, so running a setting again changes nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def folder(self, setting: Row) -> str:
        named = json.dumps([[k, setting[k]] for k in self.keys], default=str)
        return f"{self.path}/setting-{hashlib.sha256(named.encode()).hexdigest()[:24]}"

    def done(self, setting: Row) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(setting)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def run(self, settings: DataFrame, compute: Callable[[Row], DataFrame]) -> int:
        """Compute and keep the settings that have no result yet, in the order of their keys; how many there were.

        ``settings`` is a plan of experiments, a small table with one row for each. What is raised ends the
        run; results that were kept stay.
        """
        plan = settings.select(*self.keys).distinct().orderBy(*self.keys).collect()
        left = [s for s in plan if not self.done(s)]
        for setting in left:
            made = compute(setting)
            named = made.withColumns({k: F.lit(setting[k]).cast(settings.schema[k].dataType) for k in self.keys})
            named.write.mode("overwrite").parquet(self.folder(setting))
        return len(left)

    def results(self, settings: DataFrame) -> DataFrame:
        """The kept results of ``settings``, with the settings' keys; ValueError if there is none."""
        plan = settings.select(*self.keys).distinct().orderBy(*self.keys).collect()
        there = [self.folder(s) for s in plan if self.done(s)]
        if not there:
            raise ValueError("no setting has a result yet")
        return self.spark.read.parquet(*there)
