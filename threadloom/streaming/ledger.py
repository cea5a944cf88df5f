"""Exactly-once tables from streams: a ledger of committed batches, and a merge by key when reading.

A batch first writes its rows into a folder of its own attempt, then commits by one rename of a small
file that names the folder, the number of rows and the range of keys.  A table is what the ledger
names, so what a cut-off attempt has left is never read; a batch that the ledger names is not
written again.  Later batches win over earlier ones of the same key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "query string, batch long, path string, n_rows long, low string, high string"


class Interrupted(RuntimeError):
    """A run that was cut off on purpose."""


class Ledger:
    """Sink of one query below ``folder``; ``keys`` name a row of the table."""

    def __init__(self, spark: SparkSession, folder: str, query: str, keys: Sequence[str]) -> None:
        self.spark, self.folder, self.query, self.keys = spark, folder, query, list(keys)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: int) -> bool:
        return self._files().exists(self._path("ledger", f"{self.query}-{batch}.json"))

    def commit(self, batch: int, path: str, rows: DataFrame) -> None:
        """Name the folder of a batch in the ledger; the rename either happens or does not."""
        key = F.to_json(F.struct(*self.keys))
        n, low, high = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
        entry = {"query": self.query, "batch": batch, "path": path, "n_rows": n, "low": low, "high": high}
        files, draft = self._files(), self._path("drafts", uuid.uuid4().hex)
        files.mkdirs(self._path("ledger"))
        out = files.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not files.rename(draft, self._path("ledger", f"{self.query}-{batch}.json")) and not self.committed(batch):
            raise OSError(f"cannot commit batch {batch} of {self.query}")

    def entries(self) -> DataFrame:
        """The committed batches of the query."""
        if not self._files().exists(self._path("ledger")):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.folder}/ledger").where(F.col("query") == self.query)

    def run(self, stream: DataFrame, mode: str = "append", stop: tuple[str, int] | None = None) -> bool:
        """Process what is available; true if the end was reached.

        ``stop`` cuts the run off in a batch: ``written`` before its commit, ``committed`` after it but before
        the engine has noted the batch, so that it is tried again.
        """

        def write(df: DataFrame, batch: int) -> None:
            if not self.committed(batch):
                path = f"{self.folder}/rows/{self.query}-{batch}-{uuid.uuid4().hex[:12]}"
                df.write.parquet(path)
                if stop == ("written", batch):
                    raise Interrupted(f"batch {batch} is written")
                self.commit(batch, path, self.spark.read.schema(df.schema).parquet(path))
            if stop == ("committed", batch):
                raise Interrupted(f"batch {batch} is committed")

        log = f"{self.folder}/progress-{self.query}"
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except StreamingQueryException as e:
            if stop is None or f"batch {stop[1]} is {stop[0]}" not in str(e):
                raise
            return False
        return True

    def read(self, schema: StructType, low: str | None = None, high: str | None = None) -> DataFrame:
        """The table: of each key the row of its latest batch.

        Only batches whose key range (keys as JSON) meets ``low`` to ``high`` are opened.
        """
        named = self.entries().where("n_rows > 0")
        if low is not None:
            named = named.where(F.col("high") >= low)
        if high is not None:
            named = named.where(F.col("low") <= high)
        paths = {r.path: r.batch for r in named.select("path", "batch").collect()}  # one row a batch
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = None
        for path, batch in sorted(paths.items()):
            one = self.spark.read.schema(schema).parquet(path).withColumn("_batch", F.lit(batch))
            rows = one if rows is None else rows.unionByName(one)
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*schema.names), "_batch").alias("_row"))
        return latest.select("_row.*")

    def pending(self, work: DataFrame, schema: StructType) -> DataFrame:
        """The rows of ``work`` whose keys no committed batch holds."""
        return work.join(self.read(schema).select(*self.keys), self.keys, "left_anti")
