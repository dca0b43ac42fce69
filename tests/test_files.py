"""Record files in and out, the whole sort, jobs, streams."""

import os
import random

import pytest

from keyloom import cli
from keyloom.functions.records import MAX_KEY
from keyloom.plans import jobs
from keyloom.plans.file_sort import sort_files
from keyloom.sources.fixed_record import read_records, register
from keyloom.streaming.runs import write_runs


def records(seed, n, hot=0):
    r = random.Random(seed)
    return [(b"hot-key-01" if r.random() < hot else r.randbytes(10)) + b" " + r.randbytes(87) + b"\r\n" for _ in range(n)]


def put(path, recs, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(recs) + tail)


def read_out(folder):
    names = sorted(os.listdir(folder), key=lambda n: int(n.split(".")[1]))
    assert names == [f"partition.{i}" for i in range(len(names))]  # nothing else is left
    parts = [(folder / n).read_bytes() for n in names]
    assert all(len(p) % 100 == 0 and p for p in parts)
    return parts


def check(folder, want):
    got = b"".join(read_out(folder))
    assert [got[i : i + 100] for i in range(0, len(got), 100)] == sorted(want)


@pytest.mark.parametrize("files,n,hot,ranges", [(1, 100, 0, 1), (2, 100, 0, 2), (5, 1000, 0, 7), (3, 2000, 0.9, 4), (24, 5, 0, 2)])
def test_sort_of_files(spark, tmp_path, files, n, hot, ranges):
    every = [records(i, n, hot) for i in range(files)]
    for i, recs in enumerate(every):
        put(tmp_path / f"in{i % 2}" / f"input.{i}", recs)
    dirs = [str(tmp_path / d) for d in ("in0", "in1") if (tmp_path / d).exists()]
    done = sort_files(spark, dirs, str(tmp_path / "out"), ranges=ranges)
    assert done.records == files * n
    check(tmp_path / "out", [r for recs in every for r in recs])


def test_output_is_cut_at_the_cap(spark, tmp_path):
    recs = records(1, 10_000)
    put(tmp_path / "in" / "a", recs)
    done = sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), cap=100_000, ranges=1)
    assert done.files == 10 and [len(p) for p in read_out(tmp_path / "out")] == [100_000] * 10
    check(tmp_path / "out", recs)


def test_output_must_be_empty_or_is_replaced(spark, tmp_path):
    put(tmp_path / "in" / "a", records(1, 3000))
    sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), cap=50_000, ranges=3)
    put(tmp_path / "in" / "a", records(2, 700))
    with pytest.raises(FileExistsError):
        sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), ranges=2)
    check(tmp_path / "out", records(1, 3000))
    sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), ranges=2, overwrite=True)
    check(tmp_path / "out", records(2, 700))


def test_a_hot_key_is_split_by_value(spark, tmp_path):
    recs = records(3, 6000, 0.9)
    put(tmp_path / "in" / "a", recs)
    done = sort_files(spark, ["file://" + str(tmp_path / "in")], str(tmp_path / "out"), ranges=8)
    sizes = [len(p) // 100 for p in read_out(tmp_path / "out")]
    assert done.ranges == 8 and len(sizes) == 8 and max(sizes) < 2 * 6000 / 8
    check(tmp_path / "out", recs)


def test_more_ranges_than_a_tree_holds(spark, tmp_path):
    recs = records(4, 3000, 0.5)
    put(tmp_path / "in" / "a", recs)
    assert sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), ranges=300).ranges == 300
    check(tmp_path / "out", recs)


def test_bytes_dropped_are_counted(spark, tmp_path):
    put(tmp_path / "in" / "a", records(5, 20), b"x" * 37)
    put(tmp_path / "in" / "b", [], b"y" * 5)
    assert sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), ranges=1).dropped == 42


def test_storage(tmp_path):
    from pyarrow import fs

    from keyloom.sources import storage

    storage.register_scheme("sub", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.removeprefix("sub://")))
    storage.save("sub://a/b/c", b"hello")
    assert storage.size_of("sub://a/b/c") == 5 and storage.listed("sub://a/b") == [("c", 5)] and b"".join(storage.read_at("sub://a/b/c", 1, 3)) == b"ell"
    assert (tmp_path / "a" / "b" / "c").read_bytes() == b"hello" and storage.data_files([f"file://{tmp_path}/a/b"])[0][1] == 5
    storage.remove("sub://a")
    assert storage.size_of("sub://a/b/c") == -1 and storage.listed("sub://nowhere") == []
    storage.remove("sub://a")


def test_identical_files_keep_every_copy(spark, tmp_path):
    recs = records(2, 300)
    for i in range(9):
        put(tmp_path / "in" / f"f{i}", recs)
    sort_files(spark, [str(tmp_path / "in")], str(tmp_path / "out"), ranges=3)
    check(tmp_path / "out", recs * 9)


def test_nothing_in_nothing_out(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert sort_files(spark, [str(tmp_path / "none")], str(tmp_path / "out")).files == 0
    put(tmp_path / "empty" / "zero", [])
    assert sort_files(spark, [str(tmp_path / "empty")], str(tmp_path / "out"), ranges=2).files == 0
    assert not (tmp_path / "out").exists()
    put(tmp_path / "empty" / "some", records(3, 1000))
    sort_files(spark, [str(tmp_path / "empty"), str(tmp_path / "none")], str(tmp_path / "out"), ranges=2)
    check(tmp_path / "out", records(3, 1000))


def test_partial_record_is_dropped_or_refused(spark, tmp_path):
    put(tmp_path / "in" / "a", records(4, 55), b"x" * 37)
    assert read_records(spark, [str(tmp_path / "in")]).count() == 55
    with pytest.raises(Exception, match="whole records"):
        read_records(spark, [str(tmp_path / "in")], strict=True).count()
    with pytest.raises(Exception, match="nowhere"):
        read_records(spark, [str(tmp_path / "nowhere")]).count()


def test_splits_cover_a_file(spark, tmp_path):
    register(spark)
    recs = records(5, 1003)
    put(tmp_path / "a", recs)
    df = spark.read.format("fixedrecord").option("path", str(tmp_path / "a")).option("splitBytes", "12345").load()
    assert df.rdd.getNumPartitions() == 9
    assert sorted(bytes(r.key) + bytes(r.value) for r in df.collect()) == sorted(recs)


def test_failed_write_leaves_nothing(spark, tmp_path):
    register(spark)
    bad = spark.createDataFrame([(bytearray(b"short"), bytearray(90))], "key binary, value binary")
    with pytest.raises(Exception, match="10 bytes"):
        bad.write.format("fixedrecord").mode("append").option("path", str(tmp_path / "out")).save()
    assert not (tmp_path / "out").exists() or not os.listdir(tmp_path / "out")


def test_command_line(spark, tmp_path):
    put(tmp_path / "in" / "a", records(6, 500))
    assert cli.main(["-I", str(tmp_path / "in"), "-O", str(tmp_path / "out"), "--ranges", "2", "--sample", "head"]) == 0
    check(tmp_path / "out", records(6, 500))


def engine(tmp_path):
    (tmp_path / "in").mkdir(exist_ok=True)
    dirs = jobs.Directories((str(tmp_path / "in"),), str(tmp_path / "out")).prepared()
    return jobs.Engine(jobs.Context(None, dirs))


def test_jobs_length_then_sum(tmp_path):
    put(tmp_path / "in" / "a", [b"Hello scala!"])
    put(tmp_path / "in" / "b", [b"Hello scala!"])
    e = engine(tmp_path)
    e.add_handler("length", lambda c, args, i, o: open(o[0], "w").write(str(os.path.getsize(i[0]))) and None)
    e.add_handler("sum", lambda c, args, i, o: str(sum(int(open(p).read()) for p in i)).encode())
    files = e.context.directories.input_files()
    lengths = e.run_jobs([jobs.JobSpec("length", (), (f,), (jobs.FileEntry(f"@{{working}}/n.{k}"),)) for k, f in enumerate(files)])
    outs = tuple(f for r in lengths for f in r.outputs)
    assert [f.size for f in outs] == [2, 2]
    assert e.run_jobs([jobs.JobSpec("sum", (), outs)])[0].retval == b"24"
    assert [os.path.basename(p) for p in e.sync([outs[0]])] == ["n.1"]


def test_job_errors(tmp_path):
    e = engine(tmp_path).add_handler("fail", lambda *a: 1 / 0)
    for spec, kind in ((jobs.JobSpec("none"), "JOB_NOT_FOUND"), (jobs.JobSpec("fail"), "BODY_ERROR"), (jobs.JobSpec("fail", (), (jobs.FileEntry("@{working}/x"),)), "INPUT_ERROR")):
        with pytest.raises(jobs.JobError) as err:
            e.run_jobs([spec])
        assert err.value.kind.value == kind
    with pytest.raises(jobs.JobError):
        jobs.Directories((str(tmp_path / "nowhere"),), str(tmp_path / "out")).prepared()


def test_engine_api(spark, tmp_path):
    e = engine(tmp_path)
    e.context.spark = spark
    assert e.wait_init(5) is e and e.get_num_machines() == 1 and len(e.machine_addrs()) == 1 and ":" in e.net_addr()
    with pytest.raises(ValueError):
        e.add_handler("__sync__", print)
    for bad in (1.5, None, True, [1]):
        with pytest.raises(TypeError):
            jobs.JobSpec("x", (bad,))
    with pytest.raises(ValueError):
        jobs.JobSpec("x", (2**63,))
    made = tuple(jobs.FileEntry(f"@{{working}}/{n}") for n in "ab")
    e.add_handler("touch", lambda c, args, i, o: [open(p, "w").close() for p in o] and None)
    e.add_handler("idle", lambda *a: None)
    e.run_jobs([jobs.JobSpec("touch", ("t", 1, b"x"), (), made)])
    with pytest.raises(jobs.JobError) as err:
        e.run_jobs([jobs.JobSpec("idle", (), (), (jobs.FileEntry("@{working}/none"),))])
    assert err.value.kind is jobs.ErrorKind.OUTPUT_ERROR
    e.run_jobs([jobs.JobSpec("touch", (), (), (jobs.FileEntry("@{working}/c"),))], sync=True)
    assert sorted(os.listdir(e.context.directories.working)) == ["c"]
    order = []
    e.add_handler("note", lambda c, args, i, o: order.append(args[0]))
    e.schedule = lambda specs: [[s] for s in reversed(specs)]
    e.run_jobs([jobs.JobSpec("note", (k,)) for k in range(4)])
    assert order == [3, 2, 1, 0]
    e.add_handler("fail", lambda *a: 1 / 0)
    with pytest.raises(jobs.JobError) as err:
        e.run_jobs([jobs.JobSpec("fail")])
    assert isinstance(err.value.causes()[0], ZeroDivisionError)
    assert not e.wait_for_complete(0)
    e.complete()
    assert e.wait_for_complete(0)
    with pytest.raises(jobs.JobError):
        e.run_jobs([])


def test_the_four_jobs(spark, tmp_path):
    from keyloom.plans import handlers

    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a", records(1, 120), b"tail")
    put(tmp_path / "in" / "b", records(2, 80))
    e = handlers.sorting_engine(jobs.Context(spark, jobs.Directories((str(tmp_path / "in"),), str(tmp_path / "out")).prepared()))
    a, b = e.context.directories.input_files()
    work = lambda n: jobs.FileEntry(f"@{{working}}/{n}")
    data = lambda n: (tmp_path / "out" / "working" / n).read_bytes()
    cut = lambda raw: [raw[i : i + 100] for i in range(0, len(raw), 100)]
    assert e.run_jobs([jobs.JobSpec("sample", (), (a,))])[0].retval == b"".join(records(1, 120))
    e.run_jobs([jobs.JobSpec("sort", (), (a, b), (work("s.0"), work("s.1")))])
    want = sorted(records(1, 120) + records(2, 80))
    assert cut(data("s.0")) == cut(data("s.1")) == want
    ends = (b"\x40" + bytes(9), b"\x40" + bytes(9), MAX_KEY)
    e.run_jobs([jobs.JobSpec("partition", ends, (work("s.0"),), tuple(work(f"p.{i}") for i in range(3)))])
    assert cut(data("p.0")) == [r for r in want if r[:10] < ends[0]] and data("p.1") == b"" and cut(data("p.2")) == [r for r in want if r[:10] >= ends[0]]
    e.run_jobs([jobs.JobSpec("merge", (5_000,), (work("p.2"), work("p.0")), tuple(jobs.FileEntry(f"@{{output}}/partition.{i}") for i in range(4)))])
    got = [(tmp_path / "out" / f"partition.{i}").read_bytes() for i in range(4)]
    assert [len(x) for x in got] == [5_000] * 4 and cut(b"".join(got)) == want
    e.run_jobs([jobs.JobSpec("merge", (5_000,))])
    for spec in (jobs.JobSpec("sample", (), (a, b)), jobs.JobSpec("partition", (), (a,)), jobs.JobSpec("partition", (MAX_KEY,), (a, b), (work("x"),)), jobs.JobSpec("merge", (150,), (a,), (work("x"),)), jobs.JobSpec("merge", (), (a,), (work("x"),)), jobs.JobSpec("merge", (100,), (a,), (work("x"),))):
        with pytest.raises(jobs.JobError) as err:
            e.run_jobs([spec])
        assert err.value.kind is jobs.ErrorKind.BODY_ERROR and isinstance(err.value.__cause__, ValueError)


def test_stream_to_sorted_runs(spark, tmp_path):
    for i in range(2):
        recs = records(10 + i, 200)
        rows = [(bytearray(r[:10]), bytearray(r[10:])) for r in recs]
        spark.createDataFrame(rows, "key binary, value binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    write_runs(stream, str(tmp_path / "runs"), [b"\x80" + bytes(9), MAX_KEY], str(tmp_path / "checkpoint")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "runs"))
    assert got.count() == 400 and got.select("batch").distinct().count() == 2
