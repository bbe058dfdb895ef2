"""A table as a feed that may be asked only so often: a streaming source with a rate limit and a back-off.

``spark.readStream.format("throttled").option("path", ...)`` reads the rows of Parquet files in their
order, at most ``rows_per_batch`` of them a batch, and asks again ``every_seconds`` after a success
and ``retry_seconds`` after a failure at the earliest. Where the reader stands, when it last asked
and when it last succeeded are parts of the offset, so they are kept in the stream's checkpoint. A
restarted stream is given the last of them (``resume``, see ``last_offset``): it goes on at the next
row and does not ask sooner than the one before it would have.

Partitions of a batch are stretches of at most ``rows_per_task`` rows; an executor reads only the
row groups that hold its stretch. Paths are those that pyarrow opens: local, hdfs://, s3:// and gs://.
A table without rows gives no batch. Files must not change while they are read; further files are
fed after those that are there.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Stretch(InputPartition):
    """Rows begin to end of a file."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def _opened(path: str):
    """(file system, path) of a path or address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


def sizes(path: str) -> list[tuple[str, int]]:
    """The Parquet files at a path, in the order of their names, with their rows."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [at] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".parquet"))
    return [(f, pq.ParquetFile(f, filesystem=system).metadata.num_rows) for f in files]


class Throttled(DataSource):
    @classmethod
    def name(cls):
        return "throttled"

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        system, _ = _opened(self.options["path"])
        return from_arrow_schema(pq.read_schema(sizes(self.options["path"])[0][0], filesystem=system))

    def streamReader(self, schema):  # noqa: N802  Spark's name
        return ThrottledReader(schema, self.options)


class ThrottledReader(DataSourceStreamReader):
    def __init__(self, schema, options, clock=time.time, sizes_of=sizes):
        self.path, self.columns = options["path"], schema.names
        self.limit, self.task = int(options.get("rows_per_batch", 10_000)), int(options.get("rows_per_task", 50_000))
        self.every, self.retry = float(options.get("every_seconds", 0)), float(options.get("retry_seconds", 60))
        self.clock, self.sizes_of = clock, sizes_of
        self.at = json.loads(options["resume"]) if options.get("resume") else self.initialOffset()

    def initialOffset(self):  # noqa: N802
        return {"row": 0, "asked": 0.0, "succeeded": 0.0}

    def latestOffset(self):  # noqa: N802
        """The offset up to which the next batch may go: where it stands if it may not ask yet; after a failure the same row, and when that was."""
        now = self.clock()
        if now - self.at["succeeded"] < self.every or (self.at["asked"] > self.at["succeeded"] and now - self.at["asked"] < self.retry):
            return dict(self.at)
        try:
            there = sum(n for _, n in self.sizes_of(self.path))
        except OSError:
            self.at = self.at | {"asked": now}
            return dict(self.at)
        if there > self.at["row"]:
            self.at = {"row": min(there, self.at["row"] + self.limit), "asked": now, "succeeded": now}
        return dict(self.at)

    def partitions(self, start, end):
        if end["row"] > self.at["row"]:  # a batch that is run again after a restart
            self.at = dict(end)
        if start["row"] >= end["row"]:
            return []
        out, begin = [], 0
        for file, n in self.sizes_of(self.path):
            low, high = max(start["row"], begin), min(end["row"], begin + n)
            for a in range(low, high, self.task):
                out.append(Stretch(file, a - begin, min(high, a + self.task) - begin))
            begin += n
        return out

    def read(self, partition: Stretch):
        import pyarrow.parquet as pq

        system, _ = _opened(self.path)
        file = pq.ParquetFile(partition.file, filesystem=system)
        begin = 0
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            low, high = max(partition.begin, begin), min(partition.end, begin + n)
            if low < high:
                yield from file.read_row_group(g, columns=self.columns).slice(low - begin, high - low).to_batches()
            begin += n


def last_offset(spark: SparkSession, checkpoint: str) -> str:
    """The last offset of a stream's only source that its checkpoint has, as JSON; empty before its first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    log = hadoop.Path(f"{checkpoint}/offsets")
    system = log.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [int(f.getPath().getName()) for f in (system.listStatus(log) if system.exists(log) else []) if f.getPath().getName().isdigit()]
    if not names:
        return ""
    return spark.read.text(f"{checkpoint}/offsets/{max(names)}", wholetext=True).first()[0].strip().split("\n")[-1]
