"""A small jobs API: named handlers over DataFrames and files, run in stages.

A handler is called with (context, args, inputs, outputs) and may return bytes. Specs of one call are
independent and run side by side; the call returns when all are complete, as a barrier. Scheduling,
retries and placement within a handler's DataFrames are Spark's. An engine is used from ``wait_init`` to ``complete``;
``__sync__`` is a reserved job that deletes working files no one knows any more.
"""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import SparkSession


LOG = logging.getLogger("keyloom")
SYNC = "__sync__"


class ErrorKind(Enum):
    BODY_ERROR = "BODY_ERROR"
    JOB_NOT_FOUND = "JOB_NOT_FOUND"
    INPUT_ERROR = "INPUT_ERROR"
    OUTPUT_ERROR = "OUTPUT_ERROR"
    UNKNOWN = "UNKNOWN"


class JobError(RuntimeError):
    """Why a job failed; ``__cause__`` has what was raised."""

    def __init__(self, kind: ErrorKind, message: str):
        super().__init__(f"{kind.value}: {message}")
        self.kind = kind

    def causes(self) -> list[BaseException]:
        """What led to it, the nearest first."""
        out, e = [], self.__cause__
        while e is not None and e not in out:
            out.append(e)
            e = e.__cause__ or e.__context__
        return out


@dataclass(frozen=True)
class FileEntry:
    path: str
    size: int = -1
    replicas: tuple[int, ...] = ()


@dataclass(frozen=True)
class JobSpec:
    """A job by name. Arguments are texts, whole numbers of at most 64 bits, or bytes."""

    name: str
    args: tuple[Any, ...] = ()
    inputs: tuple[FileEntry, ...] = ()
    outputs: tuple[FileEntry, ...] = ()

    def __post_init__(self) -> None:
        for a in self.args:
            if isinstance(a, bool) or not isinstance(a, str | int | bytes):
                raise TypeError(f"an argument of {self.name} is a {type(a).__name__}")
            if isinstance(a, int) and not -(2**63) <= a < 2**63:
                raise ValueError(f"an argument of {self.name} needs more than 64 bits")


@dataclass(frozen=True)
class JobResult:
    spec: JobSpec
    success: bool
    retval: bytes | None = None
    error: JobError | None = None
    outputs: tuple[FileEntry, ...] = ()


@dataclass(frozen=True)
class Directories:
    """Symbolic paths: @{input} is followed by an absolute path, the others by a path below their folder."""

    inputs: tuple[str, ...]
    output: str
    working: str | None = None

    def prepared(self) -> "Directories":
        for d in self.inputs:
            if not os.path.isdir(d):
                raise JobError(ErrorKind.INPUT_ERROR, f"{d} is not a folder")
        done = Directories(self.inputs, self.output, self.working or os.path.join(self.output, "working"))
        os.makedirs(done.output, exist_ok=True)
        os.makedirs(done.working, exist_ok=True)
        return done

    def resolve(self, path: str) -> str:
        for name, root in (("@{input}", ""), ("@{working}", self.working or ""), ("@{output}", self.output)):
            if path.startswith(name + "/"):
                return root + path[len(name) :]
        return path

    def input_files(self) -> list[FileEntry]:
        """All files of the input folders, not of folders in them."""
        found = [os.path.join(d, n) for d in self.inputs for n in sorted(os.listdir(d))]
        return [FileEntry("@{input}" + os.path.abspath(p), os.path.getsize(p)) for p in found if os.path.isfile(p)]


Handler = Callable[["Context", tuple, list[str], list[str]], "bytes | None"]


@dataclass
class Context:
    spark: SparkSession | None
    directories: Directories


def in_order(specs: list[JobSpec]) -> list[list[JobSpec]]:
    """The usual schedule: all specs in one wave."""
    return [specs]


@dataclass
class Engine:
    """Runs jobs. ``schedule`` deals specs to waves, one after the other; ``machines`` are waited for at the start."""

    context: Context
    handlers: dict[str, Handler] = field(default_factory=dict)
    parallel: int = 4
    schedule: Callable[[list[JobSpec]], list[list[JobSpec]]] = in_order
    machines: int = 1

    def __post_init__(self) -> None:
        self.handlers[SYNC] = lambda c, args, inputs, outputs: "\n".join(self._sync(set(inputs))).encode()
        self._done = threading.Event()

    def add_handler(self, name: str, handler: Handler) -> "Engine":
        if name == SYNC:
            raise ValueError(f"{SYNC} is reserved")
        self.handlers[name] = handler
        return self

    def get_num_machines(self) -> int:
        """Executors that are there now; one without a session or in local mode."""
        return len(self.machine_addrs())

    def machine_addrs(self) -> list[str]:
        """host:port of the executors, the driver's own in local mode."""
        if self.context.spark is None:
            return [self.net_addr()]
        sc = self.context.spark.sparkContext
        held = sc._jsc.sc().getExecutorMemoryStatus().keys().iterator()
        every = []
        while held.hasNext():
            every.append(str(held.next()))
        driver = f"{sc.getConf().get('spark.driver.host', '')}:"
        return sorted(a for a in every if not a.startswith(driver)) or sorted(every)[:1]

    worker_addrs = machine_addrs

    def net_addr(self) -> str:
        """The driver's address."""
        if self.context.spark is None:
            return "localhost"
        conf = self.context.spark.sparkContext.getConf()
        return f"{conf.get('spark.driver.host', 'localhost')}:{conf.get('spark.driver.port', '0')}"

    def wait_init(self, timeout: float = 300.0) -> "Engine":
        """Wait until ``machines`` executors are there."""
        end = time.monotonic() + timeout
        while self.get_num_machines() < self.machines:
            if time.monotonic() > end:
                raise JobError(ErrorKind.UNKNOWN, f"{self.get_num_machines()} of {self.machines} machines after {timeout} s")
            time.sleep(0.2)
        return self

    def complete(self) -> None:
        """No more jobs; whoever waits for that goes on."""
        self._done.set()

    def wait_for_complete(self, timeout: float | None = None) -> bool:
        return self._done.wait(timeout)

    def _run(self, spec: JobSpec) -> JobResult:
        dirs = self.context.directories
        if spec.name not in self.handlers:
            return JobResult(spec, False, error=JobError(ErrorKind.JOB_NOT_FOUND, spec.name))
        inputs, outputs = [dirs.resolve(f.path) for f in spec.inputs], [dirs.resolve(f.path) for f in spec.outputs]
        missing = [p for p in inputs if not os.path.exists(p)]
        if missing and spec.name != SYNC:
            return JobResult(spec, False, error=JobError(ErrorKind.INPUT_ERROR, ", ".join(missing)))
        LOG.info("job %s: %d inputs, %d outputs", spec.name, len(inputs), len(outputs))
        try:
            got = self.handlers[spec.name](self.context, spec.args, inputs, outputs)
        except Exception as e:  # a handler may raise anything
            error = JobError(ErrorKind.BODY_ERROR, f"{spec.name}: {e}")
            error.__cause__ = e
            return JobResult(spec, False, error=error)
        absent = [p for p in outputs if not os.path.exists(p)]
        if absent:
            return JobResult(spec, False, error=JobError(ErrorKind.OUTPUT_ERROR, f"{spec.name} did not make {', '.join(absent)}"))
        made = tuple(FileEntry(f.path, os.path.getsize(p), f.replicas) for f, p in zip(spec.outputs, outputs))
        return JobResult(spec, True, got, None, made)

    def run_jobs(self, specs: list[JobSpec], sync: bool = False) -> list[JobResult]:
        """Results in the order of ``specs``; the first failure is raised after its wave has ended.

        With ``sync`` only the results of these jobs stay in the working folder.
        """
        if self._done.is_set():
            raise JobError(ErrorKind.UNKNOWN, "the engine is complete")
        done: dict[int, JobResult] = {}
        for wave in self.schedule(specs):
            with ThreadPoolExecutor(max(1, self.parallel)) as pool:
                for spec, result in zip(wave, pool.map(self._run, wave)):
                    done[id(spec)] = result
            for spec in wave:
                if not done[id(spec)].success:
                    raise done[id(spec)].error
        results = [done[id(s)] for s in specs]
        if sync:
            self.sync([f for r in results for f in r.outputs])
        return results

    def sync(self, keep: list[FileEntry]) -> list[str]:
        """Delete files of the working folder that are not in ``keep``; returns what went."""
        got = self._run(JobSpec(SYNC, (), tuple(keep)))
        if not got.success:
            raise got.error
        return got.retval.decode().splitlines()

    def _sync(self, kept: set[str]) -> list[str]:
        local = {os.path.join(d, n) for d, _, names in os.walk(self.context.directories.working or "") for n in names}
        gone = sorted(local - kept)
        for p in gone:
            os.remove(p)
        return gone
