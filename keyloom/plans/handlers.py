"""The four jobs of the sort as handlers: sample, sort, partition and merge, from files to files.

Each runs as a DataFrame plan. Files are written by the tasks under hidden names and moved by the
driver when all are there. Arguments are checked first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from keyloom.functions.records import MAX_KEY, RECORD_LEN
from keyloom.operators import output, partitioning
from keyloom.operators.sampling import HEAD_RECORDS
from keyloom.plans.jobs import Context, Engine
from keyloom.sources import storage
from keyloom.sources.fixed_record import read_records


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _write(df: DataFrame, outputs: list[list[str]], cap: int | None = None) -> None:
    """Task i writes its records, in their order, to the files ``outputs[i]``: all to each, or ``cap`` bytes to one after the other."""
    tag = uuid.uuid4().hex
    hidden = lambda path: f"{path.rsplit('/', 1)[0]}/_{path.rsplit('/', 1)[1]}-{tag}"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        own = [(path, f"{hidden(path)}-{context.taskAttemptId()}") for path in outputs[context.partitionId()]]
        streams, at, room = [storage.create(temp) for _, temp in own], 0, cap
        for b in batches:
            raw = b"".join(k + v for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if cap is None:
                for f in streams:
                    f.write(raw)
                continue
            while raw:
                if not room:
                    at, room = at + 1, cap
                _need(at < len(streams), "more records than the outputs may hold")
                streams[at].write(raw[:room])
                taken = min(room, len(raw))
                raw, room = raw[taken:], room - taken
        for f in streams:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([t for _, t in own], pa.string()), pa.array([p for p, _ in own], pa.string())], names=["temp", "path"])

    for r in df.select("key", "value").mapInArrow(run, "temp string, path string").collect():  # one row a file
        storage.move(r["temp"], r["path"])


def sample(context: Context, args: tuple, inputs: list[str], outputs: list[str]) -> bytes:
    """The first records of one file."""
    _need(len(inputs) == 1, "a sample needs one input")
    whole = storage.size_of(inputs[0]) // RECORD_LEN
    return b"".join(storage.read_at(inputs[0], 0, min(whole, HEAD_RECORDS) * RECORD_LEN))


def sort(context: Context, args: tuple, inputs: list[str], outputs: list[str]) -> None:
    """All records of the inputs in order, the same in every output."""
    _need(len(inputs) > 0 and len(outputs) > 0, "a sort needs inputs and outputs")
    _write(read_records(context.spark, inputs).repartition(1).sortWithinPartitions("key", "value"), [outputs])


def partition(context: Context, args: tuple, inputs: list[str], outputs: list[str]) -> None:
    """One file to a file for each range, empty ones too; arguments are the ranges' exclusive ends."""
    _need(len(inputs) == 1, "a partition needs one input")
    _need(len(outputs) > 0, "a partition needs outputs")
    _need(len(args) == len(outputs) and all(isinstance(a, bytes) for a in args), "a partition needs an end for each output")
    _need(list(args) == sorted(args) and args[-1] >= MAX_KEY[:-1], "ends must rise, and the last must be above all keys")
    records = read_records(context.spark, inputs)
    assigned = records.withColumn("pid", partitioning.assign(records["key"], list(args))) if len(args) <= 256 else partitioning.assign_many(records, list(args))
    _write(partitioning.exchange(assigned, len(outputs)).sortWithinPartitions("key", "value"), [[o] for o in outputs])


def merge(context: Context, args: tuple, inputs: list[str], outputs: list[str]) -> None:
    """Sorted runs to outputs of at most the bytes that the argument says; no inputs, no outputs."""
    _need(len(args) == 1 and isinstance(args[0], int), "a merge needs the outputs' size")
    per_file = output.records_per_file(args[0])
    if not inputs:
        return
    records = sum(storage.size_of(p) // RECORD_LEN for p in inputs)
    _need(-(-records // per_file) <= len(outputs), "more records than the outputs may hold")
    _write(read_records(context.spark, inputs).repartition(1).sortWithinPartitions("key", "value"), [outputs], args[0])


def sorting_engine(context: Context, **options) -> Engine:
    """An engine that knows the four jobs."""
    engine = Engine(context, **options)
    for handler in (sample, sort, partition, merge):
        engine.add_handler(handler.__name__, handler)
    return engine
