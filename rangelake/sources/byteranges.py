"""Python data sources: frame files pruned by name, and large logs read in byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from rangelake.sources.recordings import NAME


def _list(path: str, pattern: str):
    """(filesystem, [(path, size)]) of the files under a URI or folder whose name matches."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    want = re.compile(pattern)
    return system, sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and want.search(i.path))


class _Span(InputPartition):
    def __init__(self, items):
        self.items = items


class FrameFiles(DataSource):
    """``spark.read.format("frame_files").load(dir)``: recording, frame_no, ts, path, payload.

    Comparisons on ts and frame_no are answered from file names, so pruned files are never
    opened. Option ``files_per_task`` sets the split size.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "recording string, frame_no bigint, ts double, path string, payload binary"

    def reader(self, schema) -> "FrameReader":
        return FrameReader(self.options)


_COMPARE = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.per_task = int(options.get("files_per_task", "256"))
        self.tests: list[tuple[str, type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and getattr(f, "attribute", None) in (("ts",), ("frame_no",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        _, files = _list(self.path, rf"(^|/){NAME}\.bin$")
        kept = []
        for path, _ in files:
            sec, frac, frame = re.search(rf"{NAME}\.bin$", path).groups()
            row = {"ts": int(sec) + int(frac) / 1e5, "frame_no": int(frame)}
            if all(_COMPARE[kind](row[name], value) for name, kind, value in self.tests):
                kept.append((path, row["frame_no"], row["ts"]))
        return [_Span(kept[i: i + self.per_task]) for i in range(0, len(kept), self.per_task)] or [_Span([])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path, frame, ts in partition.items:
            with system.open_input_stream(path) as f:
                yield path.split("/")[-2], frame, ts, path, f.read()


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").load(path)``: path, start, own_bytes, content.

    A large log is cut every ``chunk_bytes``; ``content`` runs ``overlap_bytes`` further so that
    a record starting in a chunk can be finished there. With a chunk that is a multiple of a
    fixed record size and no overlap, records never straddle chunks. With ``magic`` (hex) and
    ``size_at`` (place of a record's total size, 4 bytes little-endian) ``content`` runs on to
    the end of every record that starts in the chunk and is followed by another one or by the
    end of the file.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start bigint, own_bytes bigint, content binary"

    def reader(self, schema) -> "RangeReader":
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.pattern = options.get("pattern", ".*")
        self.chunk = int(options.get("chunk_bytes", str(64 << 20)))
        self.overlap = int(options.get("overlap_bytes", "0"))
        self.magic = bytes.fromhex(options.get("magic", ""))
        self.size_at = int(options.get("size_at", "0"))

    def _rest(self, f, start: int, own: int, content: bytes) -> int:
        """Bytes beyond ``own`` that finish the records starting in the first ``own`` bytes."""
        size, need = f.size(), 0
        at = content.find(self.magic)
        while 0 <= at < own:
            end = at + int.from_bytes(content[at + self.size_at: at + self.size_at + 4], "little")
            if own < end <= size - start:
                f.seek(start + end)
                if self.magic.startswith(f.read(len(self.magic))):
                    need = max(need, end + len(self.magic) - own)
            at = content.find(self.magic, at + 1)
        return need

    def partitions(self) -> Sequence[InputPartition]:
        _, files = _list(self.path, self.pattern)
        return [_Span((path, at, min(self.chunk, size - at))) for path, size in files for at in range(0, size, self.chunk)] or [_Span(None)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        if partition.items is None:
            return
        from pyarrow import fs

        path, start, own = partition.items
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(path) as f:
            f.seek(start)
            content = f.read(own + max(self.overlap, self.size_at + 4 + len(self.magic) if self.magic else 0))
            if self.magic and (rest := self._rest(f, start, own, content)):
                f.seek(start)
                content = f.read(own + rest)
            yield path, start, own, content


def register(spark) -> None:
    """Make both sources available to ``spark.read``, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)
    spark.dataSource.register(ByteRanges)
