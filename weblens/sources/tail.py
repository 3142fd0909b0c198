"""A streaming source that follows growing files of lines below a folder that driver and executors share.

Unlike the built-in file stream it reads what is appended to a file that it has seen, and leaves a line without its line
break for later. An offset is a map from file to bytes read. A file that is now shorter than its offset starts anew.
"""

import os
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads.
SPLIT = 64 << 20
STEP = 1 << 16


def files(root: str, pattern: str) -> list[str]:
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(at, n) for at, _, names in os.walk(root) for n in names if fnmatch(n, pattern))


def whole_lines(path: str) -> int:
    """The bytes of a file up to its last line break."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        while end > 0:
            start = max(0, end - STEP)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.json")
        self.at_end = str(options.get("startAtEnd", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {p: os.path.getsize(p) for p in files(self.root, self.pattern)} if self.at_end else {}

    def latestOffset(self) -> dict:
        return {p: whole_lines(p) for p in files(self.root, self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of bounded size; a piece's task ends at the line in which its bytes end, the next one starts after it."""
        out = []
        for path, to in end.items():
            at = start.get(path, 0)
            at = 0 if at > to else at
            out += [Piece(path, i, min(to, i + SPLIT)) for i in range(at, to, SPLIT)]
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple[str, str]]:
        if not piece.path:
            return
        with open(piece.path, "rb") as f:
            at = piece.start
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(f.readline())
            while at < piece.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                at += len(line)
                if line.strip():
                    yield line.decode("utf-8", "replace").rstrip("\r\n"), piece.path

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("weblens_tail").option("path", ...)``, with ``pattern`` and ``startAtEnd``."""

    @classmethod
    def name(cls) -> str:
        return "weblens_tail"

    def schema(self) -> str:
        return "value string, source string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
