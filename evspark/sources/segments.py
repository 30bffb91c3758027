"""Landed log segments as a streaming source whose offsets are those of the log.

A log is a folder of Parquet files ``<topic>-<partition>/<first offset>.parquet`` (first offset in twenty digits), as an export of a broker's
log leaves them: a segment holds the records from its first offset to the next segment's. Files may come at any time, but a partition's
segments come in order. The source keeps an end offset per partition, so a query goes on where its checkpoint says, whatever files
have come since, and takes at most ``segments_per_batch`` new segments of each partition at a time.

``start`` is ``earliest`` or ``latest`` (the segments that are there when the query starts for the first time are left out).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "log_segments"
SCHEMA = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
ROWS = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("timestamp", pa.timestamp("us", "UTC"))])


class Segment(InputPartition):
    """A file, and the offsets of it that a batch reads."""

    def __init__(self, path: str, partition: str, begin: int, end: int):
        self.path, self.partition, self.begin, self.end = path, partition, begin, end


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SegmentReader(self.options["path"], self.options.get("start", "earliest"), int(self.options.get("segments_per_batch", 1000)))


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str, most: int):
        if start not in ("earliest", "latest"):
            raise ValueError("start must be 'earliest' or 'latest'")
        if most < 1:
            raise ValueError("segments_per_batch must be positive")
        self.path, self.start, self.most = path, start, most
        self.taken: dict[str, int] | None = None

    def _listed(self) -> dict[str, list[tuple[int, str]]]:
        """First offset and file of every segment, per partition in order. Names are listed, files are not opened."""
        files, base = fs.FileSystem.from_uri(self.path)
        out: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name, folder = info.base_name, info.path.rsplit("/", 2)[-2]
            if info.is_file and name.endswith(".parquet") and name[:-8].isdigit():
                out[folder].append((int(name[:-8]), info.path))
        return {k: sorted(v) for k, v in out.items()}

    def _end(self, file: str) -> int:
        """Offset behind the last record, from the file's statistics."""
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(file) as f:
            meta = pq.read_metadata(f)
        at = meta.schema.to_arrow_schema().get_field_index("offset")
        ends = [meta.row_group(g).column(at).statistics.max for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
        return max(ends) + 1 if ends else int(file.rsplit("/", 1)[1][:-8])

    def initialOffset(self) -> dict:  # noqa: N802
        listed = self._listed()
        return {k: (v[0][0] if self.start == "earliest" else self._end(v[-1][1])) for k, v in listed.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        """End offsets that the next batch reaches: at most so many segments beyond what is taken."""
        before = self.taken if self.taken is not None else self.initialOffset()
        out = dict(before)
        for partition, segments in self._listed().items():
            at = before.get(partition, segments[0][0])
            ahead = [k for k, (first, _) in enumerate(segments) if first >= at or k == len(segments) - 1 or segments[k + 1][0] > at]
            for k in ahead[: self.most]:
                end = segments[k + 1][0] if k + 1 < len(segments) else self._end(segments[k][1])
                out[partition] = max(at, end)
        self.taken = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.taken = dict(end)
        out = []
        for partition, segments in self._listed().items():
            until = end.get(partition, 0)
            begin = start.get(partition, segments[0][0])
            for k, (first, file) in enumerate(segments):
                following = segments[k + 1][0] if k + 1 < len(segments) else until
                if first < until and following > begin:
                    out.append(Segment(file, partition, max(begin, first), min(until, max(following, first))))
        return out

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        topic, number = partition.partition.rsplit("-", 1)
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=8192, columns=["offset", "key", "value", "timestamp"]):
                offset = batch.column("offset").to_numpy()
                rows = batch.filter(pa.array((offset >= partition.begin) & (offset < partition.end)))
                n = rows.num_rows
                columns = [pa.array([topic] * n, pa.string()), pa.array([int(number)] * n, pa.int32()), *(rows.column(c).cast(ROWS.field(c).type) for c in ("offset", "key", "value", "timestamp"))]
                yield pa.RecordBatch.from_arrays(columns, schema=ROWS)

    def commit(self, end: dict) -> None:
        """Nothing is held beside the checkpoint."""


def read_segments(spark: SparkSession, path: str, start: str = "earliest", segments_per_batch: int = 1000):
    """Stream of the records of a log, with ``topic``, ``partition``, ``offset``, ``key``, ``value`` and ``timestamp``."""
    spark.dataSource.register(SegmentSource)
    return spark.readStream.format(FORMAT).option("path", path).option("start", start).option("segments_per_batch", segments_per_batch).load()
