"""A data source for zstd files whose frames need a larger decoder window than usual."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_WINDOW = 2**31
CHUNK = 8 * 1024 * 1024
SCHEMA = "path string, file_name string, value string"


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ZstdLinesReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(path) for path in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        path = partition.value
        name = path.rsplit("/", 1)[-1]
        for lines in _line_batches(path):
            count = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * count), pa.array([name] * count), pa.array(lines)],
                names=["path", "file_name", "value"],
            )


def _open(path: str):
    """The raw bytes of a file on any file system Arrow knows."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        system, location = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, location = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(location, compression=None)


def _line_batches(path: str) -> Iterator[list[str]]:
    """Lines of one file in batches; only one chunk and one unfinished line are held at a time."""
    import zstandard

    decoder = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW)
    with _open(path) as raw, decoder.stream_reader(raw, read_across_frames=True) as stream:
        rest: list[bytes] = []
        while chunk := stream.read(CHUNK):
            head, newline, tail = chunk.rpartition(b"\n")
            if not newline:
                rest.append(chunk)
                continue
            complete = b"".join([*rest, head])
            rest = [tail]
            yield [line.decode("utf-8", "replace") for line in complete.split(b"\n")]
        last = b"".join(rest)
        if last:
            yield [last.decode("utf-8", "replace")]


class ZstdLines(DataSource):
    """`spark.read.format("zstd_lines").option("paths", newline-separated paths)`."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZstdLinesReader([path for path in self.options["paths"].split("\n") if path])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZstdLines)
