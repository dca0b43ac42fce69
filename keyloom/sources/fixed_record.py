"""``spark.read/write.format("fixedrecord")``: files of 100-byte records, on any storage of ``storage``.

Reading: every file is split at record bounds and read in Arrow batches. A trailing partial record is
dropped, which is logged with its size, or raises with ``strict``. Directories are listed one level deep; names that start with "."
or "_" are not data. With ``positions`` rows also have the file's name and their number in it.

Writing: rows of a task go to ``partition.<n>`` files in their order, a new file every ``cap`` bytes.
Numbers come from ``bases`` (first file number of each task, comma-joined) or else from the task's id,
one file a task. Files are written under a hidden name by each attempt and renamed when the job
commits, so a retried task leaves nothing behind. ``append`` refuses a folder in which a file of a name to be
written is; ``overwrite`` first moves all new files in place, then deletes what else was there. ``path``
must be storage that all executors share.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from keyloom.functions.records import KEY_LEN, RECORD_LEN, RECORD_SCHEMA
from keyloom.sources import storage

LOG = logging.getLogger("keyloom")

SPLIT_BYTES = 32_000_000


@dataclass
class Split(InputPartition):
    path: str
    start: int
    records: int


def _paths(options: dict) -> list[str]:
    if options.get("paths"):
        import json

        return json.loads(options["paths"])
    return [options["path"]]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.strict = _paths(options), options.get("strict", "false").lower() == "true"
        self.positions = options.get("positions", "false").lower() == "true"
        self.split = max(RECORD_LEN, int(options.get("splitbytes", SPLIT_BYTES)) // RECORD_LEN * RECORD_LEN)

    def partitions(self) -> list[Split]:
        out = []
        for path, size in storage.data_files(self.paths):
            if size % RECORD_LEN:
                if self.strict:
                    raise ValueError(f"{path}: {size} bytes are not whole records of {RECORD_LEN} bytes")
                LOG.warning("%s: %d trailing bytes are no whole record and are dropped", path, size % RECORD_LEN)
            for start in range(0, size // RECORD_LEN * RECORD_LEN, self.split):
                out.append(Split(path, start, min(self.split, size - start) // RECORD_LEN))
        return out or [Split("", 0, 0)]

    def read(self, split: Split):
        if not split.records:
            return
        at, held = split.start // RECORD_LEN, b""
        name = split.path.rsplit("/", 1)[-1]
        for piece in storage.read_at(split.path, split.start, split.records * RECORD_LEN):
            raw = held + piece
            n = len(raw) // RECORD_LEN
            held = raw[n * RECORD_LEN :]
            rows = np.frombuffer(raw, dtype=np.uint8, count=n * RECORD_LEN).reshape(n, RECORD_LEN)
            arrays, names = [_binary(rows[:, :KEY_LEN]), _binary(rows[:, KEY_LEN:])], ["key", "value"]
            if self.positions:
                arrays += [pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n))]
                names += ["file", "row"]
            at += n
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int, what: str) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows."""
    if column.null_count:
        raise ValueError(f"a record's {what} is null")
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if (np.diff(offsets) != width).any():
        raise ValueError(f"a record's {what} must have {width} bytes")
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.cap = int(options["cap"]) if options.get("cap") else None
        if self.cap is not None and (self.cap <= 0 or self.cap % RECORD_LEN):
            raise ValueError(f"cap must be a positive multiple of {RECORD_LEN} bytes")
        self.bases = [int(x) for x in options["bases"].split(",")] if options.get("bases") else None
        if self.cap is not None and self.bases is None:
            raise ValueError("a cap needs bases, else file numbers of tasks would collide")
        self.staging = f"{self.path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        base = self.bases[task] if self.bases else task
        per_file = self.cap // RECORD_LEN if self.cap else None
        files, out, room = [], None, 0
        try:
            for batch in batches:
                names = batch.schema.names
                rows = np.concatenate([_bytes(batch.column(names.index("key")), KEY_LEN, "key"), _bytes(batch.column(names.index("value")), RECORD_LEN - KEY_LEN, "value")], axis=1)
                while len(rows):
                    if out is None or not room:
                        if out is not None:
                            out.close()
                        name = f"partition.{base + len(files)}"
                        temp = f"{self.staging}/{name}-{attempt}"
                        out, room = storage.create(temp), per_file if per_file else 1 << 62
                        files.append((temp, name))
                    out.write(rows[:room].tobytes())
                    taken = min(room, len(rows))
                    rows, room = rows[taken:], room - taken
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        storage.make_folder(self.path)
        old = {name for name, _ in storage.listed(self.path)}
        new = [pair for m in messages for pair in (m.files if m else ())]
        clash = sorted(old & {name for _, name in new})
        if clash and not self.overwrite:
            storage.remove(self.staging)
            raise FileExistsError(f"{self.path} holds {clash[0]} already")
        for temp, name in new:
            storage.move(temp, f"{self.path.rstrip('/')}/{name}")
        if self.overwrite:
            for name in sorted(old - {name for _, name in new}):
                storage.remove(f"{self.path.rstrip('/')}/{name}")
        storage.remove(self.staging)

    def abort(self, messages: list) -> None:
        storage.remove(self.staging)


class FixedRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrecord"

    def schema(self):
        extra = [T.StructField("file", T.StringType(), False), T.StructField("row", T.LongType(), False)]
        return T.StructType([*RECORD_SCHEMA.fields, *(extra if self.options.get("positions", "false").lower() == "true" else [])])

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(FixedRecordSource)


def read_records(spark, paths: list[str], strict: bool = False, positions: bool = False):
    """All records of files and folders."""
    import json

    register(spark)
    return spark.read.format("fixedrecord").option("paths", json.dumps(paths)).option("strict", str(strict).lower()).option("positions", str(positions).lower()).load()
