"""Files that are still being written, as a source whose offsets are bytes.

``spark.readStream.format("log_tail").load(folder)`` gives the lines of every file directly in a
folder as they are completed: ``source, split, pos, value``. An offset is the position after the
last complete line of each file, so a restarted query goes on in the middle of a file, and files
may grow side by side in any order. A batch takes all that has been completed since the last one.

* What a file has grown by is cut into ranges of ``splitBytes``, each read by a task of its own. A
  line belongs to the range it begins in. ``split`` is where its range begins and ``pos`` where
  the line does, so lines are ordered by bytes and those of a split come together and in order.
* The driver keeps one number for each file, and reads the end of a file that has grown back to
  its last line feed.
* With ``recursive`` files of folders below count too. Names that begin with ``_`` or ``.`` are
  marks of writers and are left out.
* A line that is not UTF-8 fails its batch and names its place (``utf8=replace`` reads on), and so
  does a file that shrank: its place in the file is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brackenlog.sources.files import _open_system

LINES = "source string, split long, pos long, value string"
SPLIT_BYTES = 64 << 20
#: Bytes a task reads at once.
CHUNK = 4 << 20


class TailError(ValueError):
    """A file that cannot be followed."""


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines that begin in ``[start, stop)``; ``first`` is a line's beginning."""

    path: str
    start: int
    stop: int
    end: int
    first: bool

    def __post_init__(self):
        super().__init__(None)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Tail:
    def __init__(self, options):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.strict = options.get("utf8", "fail") != "replace"
        self.known: dict[str, tuple[int, int]] = {}

    def sizes(self) -> dict[str, int]:
        system, inner = _open_system(self.folder)
        found = system.get_file_info(pa_fs.FileSelector(inner, allow_not_found=True, recursive=self.recursive))
        return {x.path: x.size for x in found if x.is_file and x.base_name[0] not in "._"}

    def complete(self) -> dict[str, int]:
        """Where the last complete line of each file ends."""
        system, _ = _open_system(self.folder)
        out = {}
        for path, size in sorted(self.sizes().items()):
            before = self.known.get(path, (0, 0))
            if size != before[0]:
                if size < before[1]:
                    raise TailError(f"{path} shrank from {before[1]} to {size} bytes")
                before = self.known[path] = (size, _last_line_end(system, path, before[1], size))
            if before[1]:
                out[path] = before[1]
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                raise TailError(f"{path} shrank from {begin} to {stop} bytes")
            for at in range(begin, stop, self.split_bytes):
                out.append(Range(path, at, min(at + self.split_bytes, stop), stop, at == begin))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _open_system(self.folder)
        with system.open_input_file(part.path) as file:
            # The byte before a range tells whether it begins with a line.
            at = part.start if part.first else part.start - 1
            file.seek(at)
            rest, skip = b"", not part.first
            while at + len(rest) < part.end:
                data = file.read(min(CHUNK, part.end - at - len(rest)))
                if not data:
                    raise TailError(f"{part.path} shrank while it was read")
                rest += data
                cut = rest.rfind(b"\n") + 1
                if not cut:
                    continue
                lines = rest[:cut].split(b"\n")[:-1]
                begins = [at]
                for line in lines:
                    begins.append(begins[-1] + len(line) + 1)
                at, rest = begins.pop(), rest[cut:]
                if skip:
                    lines, begins, skip = lines[1:], begins[1:], False
                inside = len(begins)
                while inside and begins[inside - 1] >= part.stop:
                    inside -= 1
                if inside:
                    values = [self._text(part.path, b, x) for b, x in zip(begins[:inside], lines)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * inside), pa.array([part.start] * inside), pa.array(begins[:inside]), pa.array(values)],
                        ["source", "split", "pos", "value"],
                    )
                if at >= part.stop:
                    return

    def _text(self, path: str, at: int, line: bytes) -> str:
        line = line.rstrip(b"\r\n")
        try:
            return line.decode()
        except UnicodeDecodeError:
            if self.strict:
                raise TailError(f"{path}: the line at byte {at} is not UTF-8") from None
            return line.decode("utf-8", "replace")


class _Batch(_Tail, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.complete())


class _Stream(_Tail, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.complete()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)


def _last_line_end(system, path: str, least: int, size: int) -> int:
    """The position after the last line feed in ``[least, size)``, else ``least``."""
    with system.open_input_file(path) as file:
        stop = size
        while stop > least:
            start = max(least, stop - CHUNK)
            file.seek(start)
            found = file.read(stop - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return least


def tail_lines(spark: SparkSession, folder: str, stream: bool = True, **options):
    """Lines of the files of a folder, ``source, split, pos, value``, as a stream or a batch."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream if stream else spark.read
    return reader.format("log_tail").options(**options).load(folder)
