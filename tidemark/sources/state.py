"""The stored tables: Parquet that Spark partitions, of which a run overwrites only what it touched.

Rows of a source lie in hash buckets of their key. A run works out its result for the buckets it
touches, stages it in a folder of its own, notes that folder as ready, and then overwrites those
buckets with Spark's dynamic partition overwrite. That last step can be repeated at will, so a job that
died in it is finished by the next one, and one that died earlier has changed nothing. A source has one
writer at a time; another one that got ready in the meantime makes a run fail before it publishes.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import at_once

#: Buckets that a source's rows are dealt into unless the caller says otherwise.
BUCKETS = 32
READY = "path string, buckets array<int>, _part string, _run string"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that the frame has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A partitioned table by its whole schema; one that was never written has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # anything else is no empty table
            raise
        return spark.createDataFrame([], schema)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Store:
    """One source's part of the stored tables.

    ``tables`` names the bucketed tables and ``logs`` the tables that hold a run's rows in a partition of
    its own, each with its columns. With ``shrinks`` rows may leave, and a bucket may be left empty.
    """

    def __init__(
        self, spark: SparkSession, root: str, part: str, tables: dict[str, str], logs: dict[str, str], key: str, buckets: int = BUCKETS,
        shrinks: bool = False,
    ):
        self.spark, self.root, self.part, self.key, self.buckets = spark, root.rstrip("/"), part, key, buckets
        self.shrinks = shrinks
        self.tables, self.logs = tables, logs  # the log ``runs`` says which runs are done

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows of this source, those of some buckets if they are named; other files are not opened."""
        rows = read_partitions(self.spark, self._path(name), f"{self.tables[name]}, _part string, _bucket int").filter(F.col("_part") == self.part)
        return (rows if buckets is None else rows.filter(F.col("_bucket").isin(buckets))).drop("_part", "_bucket")

    def history(self, name: str, run: str | None = None) -> DataFrame:
        """A log's rows of this source, of all runs or of one."""
        rows = read_partitions(self.spark, self._path(name), f"{self.logs[name]}, _part string, _run string").filter(F.col("_part") == self.part)
        return (rows if run is None else rows.filter(F.col("_run") == run)).drop("_part", "_run")

    def bucket(self) -> Column:
        return bucket_of(self.key, self.buckets)

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets that some keys lie in, at most as many as there are buckets."""
        rows = [k.select(self.bucket().alias("b")) for k in keys]
        for more in rows[1:]:
            rows[0] = rows[0].union(more)
        return sorted(r.b for r in rows[0].distinct().collect())

    def ready(self) -> dict[str, tuple[str, list[int]]]:
        """The runs of this source that were staged whole but not published to the end: their folders and
        the buckets that they touch."""
        rows = read_partitions(self.spark, self._path("_ready"), READY).filter(F.col("_part") == self.part)
        return {r._run: (r.path, r.buckets) for r in rows.collect()}

    def finished(self) -> set[str]:
        """The runs that have rows in the run log."""
        rows = read_partitions(self.spark, self._path("runs"), f"{self.logs['runs']}, _part string, _run string")
        return {r._run for r in rows.filter(F.col("_part") == self.part).select("_run").distinct().collect()}

    def staging(self) -> str:
        """A fresh folder for a run's result."""
        return f"{self.root}/_staged/{uuid.uuid4().hex}"

    def stage(self, path: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows worked out once and put aside."""
        rows.write.parquet(f"{path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    def note(self, run: str, path: str, touched: list[int], known: set[str]) -> None:
        """The run is staged whole; fails if another one came about that was not ``known`` when it began."""
        if others := (set(self.ready()) | self.finished()) - known - {run}:
            raise RuntimeError(f"{self.part}: {', '.join(sorted(others))} came about while {run} was worked out")
        row = self.spark.createDataFrame([(path, touched, self.part, run)], READY)
        overwrite_partitions(row.coalesce(1), self._path("_ready"), ["_part", "_run"])

    def publish(self, run: str) -> None:
        """A staged run's rows take the place of those in the buckets it touched; repeating it changes nothing."""
        path, touched = self.ready()[run]

        def replace(name: str) -> None:
            rows = read_partitions(self.spark, f"{path}/{name}", self.tables[name])
            rows = rows.withColumns({"_part": F.lit(self.part), "_bucket": self.bucket()})
            overwrite_partitions(rows.repartition("_bucket"), self._path(name), ["_part", "_bucket"])
            if self.shrinks:
                filled = {r[0] for r in rows.select("_bucket").distinct().collect()}
                for bucket in set(touched) - filled:
                    delete_folder(self.spark, f"{self._path(name)}/_part={self._escaped(self.part)}/_bucket={bucket}")

        told = {name: read_partitions(self.spark, f"{path}/{name}", columns) for name, columns in self.logs.items()}
        at_once(*[lambda n=n: replace(n) for n in self.tables], *[lambda n=n: self.log(n, told[n], run) for n in told if n != "runs"])
        self.log("runs", told["runs"], run)  # last, as it says that the run is done
        delete_folder(self.spark, f"{self._path('_ready')}/_part={self._escaped(self.part)}/_run={self._escaped(run)}")
        delete_folder(self.spark, path)

    def _escaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

    def log(self, name: str, rows: DataFrame, run: str) -> None:
        """A run's rows of a log."""
        overwrite_partitions(rows.withColumns({"_part": F.lit(self.part), "_run": F.lit(run)}), self._path(name), ["_part", "_run"])


def write_run_summary(df: DataFrame, path: str) -> None:
    """Run figures as JSON, one document a run."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
