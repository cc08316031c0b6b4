"""Results of OCR jobs as a data source: text files and zip archives of them, below a folder of any store that pyarrow opens.

    spark.dataSource.register(OcrResults)
    spark.read.format("ocr_results").load("s3://bucket/jobs")

Planning reads the archives' tables of contents only. A partition is a run of an archive's members of a bounded size, or a
file, and members are decompressed one at a time where the partition is read.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import NativeFile, fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of decompressed text that a partition reads, about.
PART_BYTES = 64 << 20
#: Bytes up to which an archive is read at once.
SMALL = 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def _archive(source: NativeFile) -> zipfile.ZipFile:
    """A zip archive: read in places if it is large, whole if it is small, since a stream of its own can't be sought beyond its start."""
    return zipfile.ZipFile(source if source.size() > SMALL else io.BytesIO(source.read()))


def kept(name: str) -> bool:
    """Whether a member of an archive is a result: folders, and names that begin with two underscores or a dot, are none."""
    return not name.startswith(("__", ".")) and not name.endswith("/")


@dataclass
class Members(InputPartition):
    """Some members of an archive, or, without any, a file."""

    store: str
    path: str
    members: tuple[str, ...] | None

    def __init__(self, store: str, path: str, members: tuple[str, ...] | None):
        super().__init__((path, members))
        self.store, self.path, self.members = store, path, members


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        for path in sorted(f.path for f in files if f.is_file and kept(f.base_name)):
            if not path.endswith(".zip"):
                out.append(Members(self.path, path, None))
                continue
            held, size = [], 0
            with store.open_input_file(path) as source, _archive(source) as archive:
                for member in sorted(archive.infolist(), key=lambda m: m.filename):
                    if not kept(member.filename):
                        continue
                    if held and size + member.file_size > self.part_bytes:
                        out.append(Members(self.path, path, tuple(held)))
                        held, size = [], 0
                    held.append(member.filename)
                    size += member.file_size
            if held:
                out.append(Members(self.path, path, tuple(held)))
        return out

    def read(self, partition: Members) -> Iterator[tuple[str, str, str]]:
        store, _ = _opened(partition.store)
        job = partition.path.rpartition("/")[0].rpartition("/")[2]
        with store.open_input_file(partition.path) as source:
            if partition.members is None:
                yield job, partition.path.rpartition("/")[2], _text(source.read())
                return
            with _archive(source) as archive:
                for name in partition.members:
                    yield job, name, _text(archive.read(name))


class OcrResults(DataSource):
    """(job, name, content) of every result below a path: job is the folder that a file or archive lies in.

    Bytes that are no UTF-8 become replacement characters. Names may repeat between archives; empty archives give no rows.
    The option part_bytes bounds what a partition decompresses; a larger member is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "ocr_results"

    def schema(self) -> str:
        return "job string, name string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))
