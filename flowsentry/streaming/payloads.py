"""A replayable stream of event payloads: one JSON object per line of the files in a folder.

The offset is the number of files read, in the order of their names, so files are added under
ascending names and never changed. A micro-batch names its files from the checkpoint's offsets;
after a restart it reads the same lines again. Each file is a partition of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowsentry.streaming.events import parse_payload

NAME = "flowsentry_payloads"
#: Bytes read at once.
CHUNK = 1 << 22


@dataclass
class PayloadFile(InputPartition):
    path: str


class PayloadReader(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri.removeprefix('file:')}")

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, path = self._system()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return system, sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(self._files()[1])}

    def partitions(self, start: dict, end: dict) -> list[PayloadFile]:
        return [PayloadFile(path) for path in self._files()[1][start["files"] : end["files"]]]

    def read(self, partition: PayloadFile) -> Iterator[pa.RecordBatch]:
        system = self._system()[0]
        rest = b""
        with system.open_input_stream(partition.path) as file:
            while chunk := file.read(CHUNK):
                *lines, rest = (rest + chunk).split(b"\n")
                yield self._batch(lines)
        yield self._batch([rest])

    @staticmethod
    def _batch(lines: list[bytes]) -> pa.RecordBatch:
        texts = [line.decode("utf-8", errors="replace") for line in lines if line.strip()]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> PayloadReader:  # noqa: N802
        return PayloadReader(self.options["path"])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Event columns of the payloads in a folder; a line that is no payload is an all-null event."""
    spark.dataSource.register(PayloadSource)
    return parse_payload(spark.readStream.format(NAME).load(path))
