"""A tree of files as a stream of changes: what is new, changed or gone since the last batch, each told once.

The stream's offset is the number of a stored manifest, the list of paths, sizes and times of change as it was found.
A new one is stored when a listing differs from the last; a batch is the difference of two, worked out in parts by a
hash of the path. Manifests stay in the shared folder, so that a stream that is started again on its checkpoint goes on
from the one it has seen. As with Spark's own file sources, one process holds a listing (paths, sizes and times, never
contents) while it plans a batch.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Parts of a manifest.
PARTS = 16
_SCHEMA = "path string, change string, size bigint, version bigint"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Manifests:
    """Numbered lists of files in a folder; a list counts once its mark, which is written last, is there."""

    def __init__(self, folder: str):
        self.fs, self.base = _place(folder)

    def last(self) -> int:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return max((int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".done")), default=0)

    def write(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        parts: list[list] = [[] for _ in range(PARTS)]
        for path, (size, mtime) in files.items():
            parts[zlib.crc32(path.encode()) % PARTS].append((path, size, mtime))
        self.fs.create_dir(f"{self.base}/{number}")
        for i, rows in enumerate(parts):
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(("path", "size", "mtime"), columns, (pa.string(), pa.int64(), pa.int64()), strict=True)}), f"{self.base}/{number}/{i}.parquet", filesystem=self.fs)
        self.fs.open_output_stream(f"{self.base}/{number}.done").close()

    def part(self, number: int, i: int) -> dict[str, tuple[int, int]]:
        import pyarrow.parquet as pq

        if not number:
            return {}
        rows = pq.read_table(f"{self.base}/{number}/{i}.parquet", filesystem=self.fs, partitioning=None).to_pydict()
        return dict(zip(rows["path"], zip(rows["size"], rows["mtime"], strict=True), strict=True))

    def whole(self, number: int) -> dict[str, tuple[int, int]]:
        return {k: v for i in range(PARTS) for k, v in self.part(number, i).items()}


def listing(root: str, suffix: str = "") -> dict[str, tuple[int, int]]:
    """Size and time of change of each file below a folder, by path within it; a missing folder has none."""
    from pyarrow import fs

    place, base = _place(root)
    found = place.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {f.path[len(base) :].lstrip("/"): (f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)}


def put(rows: DataFrame, root: str) -> int:
    """Write the files ``path, text`` below a folder from the tasks that hold them (null texts: delete them); how many."""

    def run(batches):
        import pyarrow as pa

        place, base = _place(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                if text is None:
                    if place.get_file_info(at).is_file:
                        place.delete_file(at)
                else:
                    place.create_dir(os.path.dirname(at))
                    with place.open_output_stream(at) as f:
                        f.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return rows.select("path", "text").mapInArrow(run, "path string").count()


class _Part(InputPartition):
    def __init__(self, i: int, start: int, end: int):
        self.i, self.start, self.end = i, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.folder, self.suffix = options["root"], options["manifests"], options.get("suffix", "")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"manifest": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        kept, now = _Manifests(self.folder), listing(self.root, self.suffix)
        last = kept.last()
        if now != kept.whole(last):
            last += 1
            kept.write(last, now)
        return {"manifest": last}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(i, start["manifest"], end["manifest"]) for i in range(PARTS)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        kept = _Manifests(self.folder)
        old, new = kept.part(partition.start, partition.i), kept.part(partition.end, partition.i)
        for path, (size, mtime) in new.items():
            if path not in old:
                yield path, "added", size, partition.end
            elif old[path] != (size, mtime):
                yield path, "changed", size, partition.end
        for path in old.keys() - new.keys():
            yield path, "removed", None, partition.end

    def commit(self, end: dict) -> None:
        pass


class WatchedTree(DataSource):
    """``spark.readStream.format("watched_tree").option("root", ...).option("manifests", ...)``: ``path, change (added,
    changed, removed), size, version`` of the files below a folder, those with a ``suffix`` alone if one is given. A file
    is changed when its size or time of change is another; of what comes and goes between two batches nothing is told."""

    @classmethod
    def name(cls) -> str:
        return "watched_tree"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options)
