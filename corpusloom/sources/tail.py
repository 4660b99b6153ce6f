"""The live tail of growing JSON-lines files as a streaming source.

Spark's file source reads a file once; a log that grows needs offsets within files. The driver only asks for sizes;
executors read the bytes, in ranges, through Arrow's file systems. A line counts once its end is written.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16


def _files(path: str):
    """(file system, {file: size}) of a file, or of the .jsonl files of a folder."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return system, {}
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.path.endswith(".jsonl")]
    return system, {f.path: f.size for f in found}


def _last_line_end(system, name: str, start: int, size: int) -> int:
    """The place after the last line end within [start, size); start if there is none."""
    with system.open_input_file(name) as source:
        end = size
        while end > start:
            low = max(start, end - BLOCK)
            at = source.read_at(end - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return start


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, piece: int):
        self.path, self.most, self.piece, self.seen = path, most, piece, {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Up to `most` further bytes of each file, cut at a line's end; a line longer than that is taken whole. A file that
        shrank is read anew."""
        system, sizes = _files(self.path)
        for name, size in sorted(sizes.items()):
            start = self.seen.get(name, 0)
            start = start if start <= size else 0
            end = _last_line_end(system, name, start, min(size, start + self.most))
            self.seen[name] = end if end > start else _last_line_end(system, name, start, size)
        return {"files": dict(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = {**end["files"]}
        out = []
        for name, stop in sorted(end["files"].items()):
            low = start["files"].get(name, 0)
            low = low if low <= stop else 0
            out += [Range(name, a, min(a + self.piece, stop)) for a in range(low, stop, self.piece)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        """The lines that begin in a range, each with its place; bytes that aren't UTF-8 become U+FFFD."""
        if part.end <= part.start:
            return
        system, _ = _files(self.path)
        with system.open_input_file(part.name) as source:
            size, at, held = source.size(), part.start, b""
            skip = part.start > 0 and source.read_at(1, part.start - 1) != b"\n"
            place = part.start
            while at < size and (place < part.end or held):
                block = source.read_at(min(BLOCK, size - at), at)
                at += len(block)
                lines = (held + block).split(b"\n")
                held = lines.pop()
                for line in lines:
                    if not skip and place < part.end and line.strip():
                        yield part.name, place, line.decode("utf-8", "replace")
                    place += len(line) + 1
                    skip = False
                if place >= part.end:
                    return

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    """Format "jsonl_tail": options path, max_bytes (of a file in a batch), piece_bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("max_bytes", 64 << 20)), int(self.options.get("piece_bytes", 8 << 20)))


def tail_jsonl(spark: SparkSession, path: str, schema: str, **options):
    """A stream of the columns of `schema` and of file and place: the lines of growing files. A line that isn't JSON
    gives nulls."""
    from pyspark.sql import functions as F

    spark.dataSource.register(JsonlTail)
    lines = spark.readStream.format("jsonl_tail").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()
    return lines.select("file", "place", F.from_json("line", schema).alias("r")).select("file", "place", "r.*")


