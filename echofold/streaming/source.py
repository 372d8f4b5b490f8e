"""A launch feed as a streaming data source: frames that are appended to the files of a log, read by byte ranges.

A file of the log is a shard with lines of JSON, one a frame. An offset is how far each shard has been read, always a line's
end; a batch is the ranges that have been added, cut into pieces of PIECE_BYTES for as many tasks. Frames that are no created
launch, are messages of the feed itself, or have no whole address are dropped, as are lines that are no JSON object. What can't
be read is tried again after waits that grow and vary, ATTEMPTS times.

Options: path (a folder that driver and executors reach, also by a scheme that Arrow knows), progress (a folder where what has
been committed is noted, for whoever prunes the log).
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from echofold.functions.parse import BASE58
from echofold.model import LAUNCH
from echofold.streaming.feed import backoff_ms

SCHEMA = LAUNCH + ", shard string"
PIECE_BYTES, TAIL_BYTES, ATTEMPTS = 32 << 20, 1 << 16, 5
_ADDRESS = re.compile(BASE58)


def patiently(act: Callable, attempts: int = ATTEMPTS, sleep: Callable = time.sleep):
    """act(), again after a jittered wait where it can't read, up to so many times."""
    for attempt in range(1, attempts + 1):
        try:
            return act()
        except OSError:
            if attempt == attempts:
                raise
            sleep(backoff_ms(attempt) / 1000)


def launch_of(line: bytes) -> dict | None:
    """The frame of a line, if it is a created launch with a whole address."""
    try:
        frame = json.loads(line)
    except ValueError:
        return None
    if not isinstance(frame, dict) or frame.get("txType") != "create" or "message" in frame:
        return None
    mint = frame.get("mint")
    return frame if isinstance(mint, str) and _ADDRESS.fullmatch(mint) else None


@dataclass
class Piece(InputPartition):
    """The lines of a shard in a range of bytes, whole ones."""

    shard: str
    begin: int
    end: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.progress = options["path"], options.get("progress")

    def _files(self):
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri.removeprefix("file:"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return patiently(self._ends)

    def _ends(self) -> dict:
        """The last line's end of each shard."""
        files, root = self._files()
        out = {}
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                with files.open_input_file(info.path) as f:
                    out[info.base_name] = self._line_end(f, info.size)
        return out

    @staticmethod
    def _line_end(f: pa.NativeFile, end: int) -> int:
        """The end of the last whole line in the first so many bytes."""
        while end > 0:
            begin = max(0, end - TAIL_BYTES)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(shard, k, min(k + PIECE_BYTES, to)) for shard, to in sorted(end.items()) for k in range(start.get(shard, 0), to, PIECE_BYTES)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The launches of lines that begin in the piece."""
        rows = [x for line in patiently(lambda: self._lines(piece)) if (x := launch_of(line))]
        text = lambda name: pa.array([x.get(name) if isinstance(x.get(name), str) else None for x in rows], pa.string())
        at = [x.get("observedAt") for x in rows]
        observed = pa.array([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in at], pa.float64())
        columns = [text("mint"), text("name"), text("symbol"), text("uri"), observed, pa.array([piece.shard] * len(rows), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["mint", "name", "symbol", "uri", "observedAt", "shard"])

    def _lines(self, piece: Piece) -> list[bytes]:
        files, root = self._files()
        with files.open_input_file(f"{root.rstrip('/')}/{piece.shard}") as f:
            data = f.read_at(piece.end - piece.begin, piece.begin)
            if piece.begin and f.read_at(1, piece.begin - 1) != b"\n":  # its first line began in the piece before
                data = data[data.index(b"\n") + 1 :] if b"\n" in data else b""
            at = piece.end
            while data and not data.endswith(b"\n"):  # its last one ends in a later piece
                more = f.read_at(TAIL_BYTES, at)
                if not more:
                    break
                stop = more.find(b"\n")
                data, at = data + (more if stop < 0 else more[: stop + 1]), at + len(more)
        return data.split(b"\n")

    def commit(self, end: dict) -> None:
        if self.progress:
            files, root = fs.FileSystem.from_uri(self.progress) if "://" in self.progress else (fs.LocalFileSystem(), self.progress)
            files.create_dir(root)
            with files.open_output_stream(f"{root.rstrip('/')}/committed.json") as f:
                f.write(json.dumps(end, sort_keys=True).encode())


class LaunchFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "launch_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def launch_feed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of created launches of a log."""
    spark.dataSource.register(LaunchFeed)
    return spark.readStream.format("launch_feed").option("path", path).options(**options).load()
