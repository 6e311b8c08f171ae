"""Image files without compression (binary PPM) as a data source of Spark: read and written in strips of rows.

A large file is read as several ranges of bytes, each of whole rows; frames are written as strips, each a file of its
own that any viewer opens, with the carrier, its first row and the frame's height in comments of the header. Files are
reached by the filesystems of Arrow, so a path may be local or of a store that Arrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from inkmark.functions.formulas import KEYS, RGB, level
from inkmark.sources.carriers import sizes

FORMAT, ENDING, TEMPORARY = "ppm_strips", ".ppm", "_temporary"
SCHEMA = "path string, carrier_id long, y int, x int, r int, g int, b int"
WRITTEN = "carrier_id long, height int, width int, y int, x int, r int, g int, b int"
#: Bytes of a split at most, if rows aren't longer; pixels of a batch.
SPLIT, BATCH = 8 << 20, 1 << 16


@dataclass
class Ranges(InputPartition):
    """(path, first byte, end, bytes of the file) of files or of parts of one."""

    parts: list[tuple[str, int, int, int]]


@dataclass
class Moved(WriterCommitMessage):
    """The folder that a task has written, and the name that it gets."""

    folder: str | None
    name: str


def listed(path: str, recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose name ends in .ppm in any case, or of one file, by path."""
    fs, root = pa.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(root, recursive=recursive))
    names = [(f.path, f.size) for f in found if f.type == pa.fs.FileType.File and f.path.lower().endswith(ENDING) and f"/{TEMPORARY}-" not in f.path]
    return sorted(names)


def header(file) -> tuple[int, int, int, dict[str, int]]:
    """(offset of the pixels, width, height, numbers of comments by name) of an open file; an error if it isn't a
    binary PPM of 256 levels."""
    size, numbers, said, at = 0, [], {}, 2
    start = file.read(512)
    while True:
        if start[:2] != b"P6":
            raise ValueError("not a binary PPM file")
        at, numbers = 2, []
        try:
            while len(numbers) < 3:
                while start[at : at + 1].isspace():
                    at += 1
                if start[at : at + 1] == b"#":
                    end = start.index(b"\n", at)
                    word, _, value = start[at + 1 : end].decode("latin-1").strip().partition(" ")
                    if value.lstrip("-").isdigit():
                        said[word] = int(value)
                    at = end + 1
                    continue
                end = at
                while start[end : end + 1].isdigit():
                    end += 1
                if end == at or end == len(start):
                    raise IndexError
                numbers.append(int(start[at:end]))
                at = end
            break
        except (IndexError, ValueError):
            more = file.read(4096)
            if not more or size > 1 << 16:
                raise ValueError("a header without end") from None
            start, size = start + more, size + len(more)
    width, height, most = numbers
    if most != 255 or width < 1 or height < 1:
        raise ValueError("only files of 256 levels and a pixel at least")
    return at + 1, width, height, said


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Ranges]:
        """Small files share a partition, large ones are cut; no file is opened here."""
        out, now, size = [], [], 0
        for path, n in listed(self.path, self.recursive):
            for begin in range(0, n, self.split):
                end = min(n, begin + self.split)
                if now and size + end - begin > self.split:
                    out.append(Ranges(now))
                    now, size = [], 0
                now.append((path, begin, end, n))
                size += end - begin
        return [*out, Ranges(now)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        import numpy as np

        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        for path, begin, end, size in partition.parts:
            with fs.open_input_file(path) as file:
                offset, width, height, said = header(file)
                of_row = 3 * width
                if offset + height * of_row > size:
                    raise ValueError(f"{path} is cut short")
                first, last = (min(height, max(0, -(-(b - offset) // of_row))) for b in (begin, end))  # rows that begin in the range
                step = max(1, BATCH // width)
                for row in range(first, last, step):
                    n = min(step, last - row)
                    file.seek(offset + row * of_row)
                    rgb = np.frombuffer(file.read(n * of_row), np.uint8).reshape(-1, 3).astype(np.int32)
                    y, x = np.divmod(np.arange(n * width, dtype=np.int32), np.int32(width))
                    ids = pa.array([said.get("carrier")] * len(x), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), ids, pa.array(y + np.int32(row + said.get("row", 0))), pa.array(x), *(pa.array(np.ascontiguousarray(rgb[:, i])) for i in range(3))], ["path", *KEYS, *RGB])


class Writer(DataSourceArrowWriter):
    """Takes rows by carrier, y and x, as write_carriers sends them. A task writes into a folder of its own below one of
    the job; the commit gives these folders their names, so a failed or repeated task leaves nothing behind."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.strip, self.overwrite, self.job = options["path"], int(options["strip"]), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        import numpy as np
        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        name = f"{self.job[:8]}-{task.partitionId():06d}"
        folder, key, held, any_ = f"{root}/{TEMPORARY}-{self.job}/{name}-{task.taskAttemptId()}", None, [], False

        def put() -> None:
            carrier, row, height, width = key
            data = np.concatenate(held)
            if len(data) % width:
                raise ValueError(f"carrier {carrier} lacks pixels")
            with fs.open_output_stream(f"{folder}/carrier-{carrier}-row-{row}{ENDING}") as out:
                out.write(f"P6\n# carrier {carrier}\n# row {row}\n# height {height}\n{width} {len(data) // width}\n255\n".encode())
                out.write(data.tobytes())

        for b in iterator:
            if not b.num_rows:
                continue
            column = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            row = column["y"] // self.strip * self.strip
            new = np.flatnonzero((np.diff(column["carrier_id"]) != 0) | (np.diff(row) != 0)) + 1
            levels = np.column_stack([column[c] for c in RGB]).astype(np.uint8)
            for part in np.split(np.arange(b.num_rows), new):
                own = tuple(int(v[part[0]]) for v in (column["carrier_id"], row, column["height"], column["width"]))
                if key != own:
                    if key:
                        put()
                    elif not any_:
                        fs.create_dir(folder, recursive=True)
                        any_ = True
                    key, held = own, []
                held.append(levels[part])
        if key:
            put()
        return Moved(folder if any_ else None, name)

    def commit(self, messages: list[Moved | None]) -> None:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        if self.overwrite and fs.get_file_info(root).type == pa.fs.FileType.Directory:
            for f in fs.get_file_info(pa.fs.FileSelector(root)):
                if f.type == pa.fs.FileType.Directory and f.base_name != f"{TEMPORARY}-{self.job}":
                    fs.delete_dir(f.path)
                elif f.type == pa.fs.FileType.File:
                    fs.delete_file(f.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m and m.folder:
                fs.move(m.folder, f"{root}/{m.name}")
        self._clear(fs, root)

    def abort(self, messages: list[Moved | None]) -> None:
        self._clear(*pa.fs.FileSystem.from_uri(self.path))

    def _clear(self, fs, root: str) -> None:
        folder = f"{root}/{TEMPORARY}-{self.job}"
        if fs.get_file_info(folder).type == pa.fs.FileType.Directory:
            fs.delete_dir(folder)


class CarrierFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def read_carriers(spark: SparkSession, path: str, recursive: bool = True, split: int = SPLIT) -> DataFrame:
    """(path, carrier_id, y, x, r, g, b) of the PPM files below a folder; carrier_id is null for files that don't say it."""
    spark.dataSource.register(CarrierFiles)
    return spark.read.format(FORMAT).option("recursive", str(recursive)).option("split", split).load(path)


def write_carriers(pixels: DataFrame, path: str, strip: int = 256, mode: str = "append") -> None:
    """Writes frames of whole-number carriers, a file for each strip of rows; levels are clipped and rounded first.

    A strip is what a task holds, whatever the frame's size. mode: append or overwrite. Missing pixels are an error.
    """
    if strip < 1:
        raise ValueError("a strip has a row at least")
    spark = pixels.sparkSession
    spark.dataSource.register(CarrierFiles)
    rows = pixels.select(F.col("carrier_id").cast("bigint").alias("carrier_id"), "y", "x", *[F.expr(level(c)).alias(c) for c in RGB])
    placed = rows.join(sizes(rows), "carrier_id").withColumn("__strip", F.floor(F.col("y") / strip))
    sorted_ = placed.repartition("carrier_id", "__strip").sortWithinPartitions("carrier_id", "y", "x")
    sorted_.select(*[f.split()[0] for f in WRITTEN.split(", ")]).write.format(FORMAT).option("strip", strip).mode(mode).save(path)
