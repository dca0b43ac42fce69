"""Operators on small fixtures: bounds, ties, empty ranges, duplicates."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from keyloom.functions import records as R
from keyloom.operators import catalog, output, partitioning, sampling, sorting, validate
from keyloom.sources import datagen

KEY = lambda *b: bytes(9 - len(b) + 1) + bytes(b)


def frame(spark, keys, parts=3):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in keys], "key binary, value binary").repartition(parts)


def pairs(seed, n, distinct=50):
    r = random.Random(seed)
    pool = [bytes(r.randrange(256) for _ in range(10)) for _ in range(distinct)] + [b"\x00" * 10, b"\x7f" * 10, b"\x80" * 10, b"\xff" * 10]
    return [(r.choice(pool), bytes([r.randrange(4)]) * 90) for _ in range(n)]


def test_key_and_value_of_a_packed_record(spark):
    rec = bytes(range(100))
    r = spark.createDataFrame([(bytearray(rec),)], "r binary").select(R.key_of(F.col("r")).alias("k"), R.value_of(F.col("r")).alias("v")).first()
    assert bytes(r.k) == rec[:10] and bytes(r.v) == rec[10:]


def test_order_is_unsigned(spark):
    rows = pairs(1, 500)
    got = [(bytes(r.key), bytes(r.value)) for r in sorting.global_sort(frame(spark, rows)).collect()]
    assert got == sorted(rows)


def test_positions_number_the_total_order(spark):
    rows = pairs(2, 700)
    got = sorted((r.pos, bytes(r.key), bytes(r.value)) for r in sorting.with_positions(frame(spark, rows, 5)).collect())
    assert [p for p, _, _ in got] == list(range(700)) and [x[1:] for x in got] == sorted(rows)
    assert sorting.with_positions(frame(spark, rows).limit(0)).count() == 0


def test_merge_of_runs_keeps_every_copy(spark):
    a, b = pairs(3, 55), pairs(4, 45)
    got = [(bytes(r.key), bytes(r.value)) for r in sorting.kway_merge([frame(spark, a), frame(spark, b), frame(spark, a)]).collect()]
    assert got == sorted(a + a + b)
    assert [bytes(r.key) for r in sorting.kway_merge([frame(spark, a)]).collect()] == sorted(k for k, _ in a)
    with pytest.raises(ValueError):
        sorting.kway_merge([])


@pytest.mark.parametrize("parts,want", [(3, [10, 20]), (7, [4, 8, 12, 17, 21, 25])])
def test_split_points_are_at_exact_positions(spark, parts, want):
    keys = sorted({bytes(random.Random(i).randrange(256) for _ in range(10)) for i in range(30)})
    ends = partitioning.collected_ends(partitioning.split_points(frame(spark, [(k, b"") for k in keys]), parts))
    assert ends == [keys[i] for i in want] + [R.MAX_KEY]


def test_split_points_of_nothing_or_one_part(spark):
    none = frame(spark, [(b"a" * 10, b"")]).limit(0)
    assert partitioning.collected_ends(partitioning.split_points(none, 4)) == [R.MAX_KEY]
    assert partitioning.collected_ends(partitioning.split_points(frame(spark, pairs(1, 9)), 1)) == [R.MAX_KEY]


@pytest.mark.parametrize("ends,want", [([KEY(9), R.MAX_KEY], [2, 3]), ([KEY(0x30), R.MAX_KEY], [5, 0]), ([R.MAX_KEY], [5]), ([KEY(5), KEY(5), KEY(9), R.MAX_KEY], [1, 0, 1, 3])])
def test_ranges_are_left_inclusive_and_empty_ones_exist(spark, ends, want):
    df = frame(spark, [(KEY(k), b"") for k in (0x01, 0x05, 0x10, 0x15, 0x20)])
    assigned = df.withColumn("pid", partitioning.assign(df["key"], ends))
    assert [r.n for r in partitioning.sizes(assigned, len(ends)).orderBy("pid").collect()] == want
    joined = partitioning.range_join(df, ends, partitioning.ranges_frame(spark, ends))
    assert sorted((bytes(r.key), r.pid) for r in joined.collect()) == sorted((bytes(r.key), r.pid) for r in assigned.select("key", "pid").collect())


def test_assignment_equals_bisection_in_both_ways(spark):
    rows = pairs(6, 400)
    ends = sorted(k for k, _ in pairs(7, 40)) + [R.MAX_KEY]
    df = frame(spark, rows)
    want = sorted((k, bisect_right(ends, k)) for k, _ in rows)
    assert sorted((bytes(r.key), r.pid) for r in df.withColumn("pid", partitioning.assign(df["key"], ends)).collect()) == want
    assert sorted((bytes(r.key), r.pid) for r in partitioning.assign_many(df, ends).collect()) == want
    edges = [(bytes(10), b""), (b"\x00" * 9 + b"\x01", b""), (b"a" + bytes(9), b""), (b"\xff" * 10, b"")]
    ends = [b"\x00" * 9 + b"\x01", b"a" + bytes(9), b"a" + bytes(9) + b"x", R.MAX_KEY]
    got = {bytes(r.key): r.pid for r in partitioning.assign_many(frame(spark, edges), ends).collect()}
    assert got == {k: min(bisect_right(ends, k), 3) for k, _ in edges}


def test_exchange_gives_each_range_a_task(spark):
    df = frame(spark, pairs(8, 300))
    ends = [b"\x40" + bytes(9), b"\x80" + bytes(9), b"\x80" + bytes(9), R.MAX_KEY]
    moved = partitioning.exchange(df.withColumn("pid", partitioning.assign(df["key"], ends)), 4)
    assert moved.rdd.getNumPartitions() == 4
    assert all(r.pid == r.t for r in moved.select("pid", F.spark_partition_id().alias("t")).distinct().collect())


def test_manifest_is_contiguous_and_full_but_for_the_last_of_a_range(spark):
    sizes = spark.createDataFrame([(0, 250), (1, 0), (2, 100), (3, 101), (4, 0)], "pid long, n long")
    got = [(r.file_no, r.pid, r.n, r.lo, r.hi) for r in output.manifest(sizes, 100).orderBy("file_no").collect()]
    assert got == [(0, 0, 100, 0, 100), (1, 0, 100, 100, 200), (2, 0, 50, 200, 250), (3, 2, 100, 0, 100), (4, 3, 100, 0, 100), (5, 3, 1, 100, 101)]


def test_planned_files_for_uneven_machines(spark):
    mib = 1 << 20
    sizes = spark.createDataFrame([(0, 128 * mib // 100 * 100 // 100), (1, 624 * mib // 100)], "pid long, n long")
    per = 128 * mib // 100
    assert [(r.files, r.base) for r in output.files_by_range(sizes, per).orderBy("pid").collect()] == [(1, 0), (5, 1)]


@pytest.mark.parametrize("cap", [0, -100, 150])
def test_caps_hold_whole_records(cap):
    with pytest.raises(ValueError):
        output.records_per_file(cap)


def test_validators(spark):
    good = [(bytearray(KEY(i // 2)),) for i in range(40)]
    bad = [(bytearray(KEY(39 - i)),) for i in range(40)]
    f = lambda rows, n: validate.order_violations(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "key binary")).first()[0]
    assert [f(good, 7), f(bad, 7), f(bad, 1), f(bad, 40), f(good[:1], 7), f([], 2)] == [0, 39, 39, 39, 0, 0]
    overlap = spark.createDataFrame([(0, bytearray(KEY(5))), (1, bytearray(KEY(4)))], "pid long, key binary")
    assert validate.range_violations(overlap).first()[0] == 1
    rows = frame(spark, [(KEY(1), b"a"), (KEY(1), b"b"), (KEY(2), b"a")])
    assert tuple(validate.duplicate_keys(rows).first()) == (3, 2, 1)
    assert validate.checksum(rows).first() == validate.checksum(rows.orderBy(F.desc("key"))).first()


def test_generators(spark):
    a = datagen.uniform(spark, 50, seed=1).collect()
    b = datagen.uniform(spark, 20, seed=1).collect() + datagen.uniform(spark, 30, seed=1, offset=20).collect()
    assert sorted(a) == sorted(b)
    assert all(len(r.key) == 10 and len(r.value) == 90 and bytes(r.value)[:1] == b" " and bytes(r.value)[-2:] == b"\r\n" for r in a)
    assert all(0x20 <= c < 0x7F for r in datagen.ascii(spark, 20).collect() for c in r.key)
    skew = validate.duplicate_keys(datagen.skew(spark, 4000)).first()
    assert skew.duplicates >= 3800


def test_spread_sample_does_not_depend_on_partitions(spark):
    df = datagen.uniform(spark, 2000, seed=3)
    a, b = (sorted(bytes(r.key) for r in sampling.spread(x, 200).collect()) for x in (df, df.repartition(7)))
    assert a == b and 120 < len(a) < 300


def test_spread_sample_of_a_hot_key_is_bounded(spark):
    df = datagen.uniform(spark, 20_000, seed=4).withColumn("key", F.when(F.col("id") % 2 == 0, F.lit(bytearray(b"hot-key-00"))).otherwise(F.col("key")))
    for seed in (1, 17, 31):
        got = sampling.spread(df.select("key", "value"), 1000, seed=seed).collect()
        assert 800 < len(got) < 1200 and 350 < sum(bytes(r.key) == b"hot-key-00" for r in got) < 650


def test_positions_within_groups_of_any_size(spark):
    rows = [(0 if i % 10 else i // 10 % 5 + 1, bytearray(KEY(i * 37 % 251, i % 7)), i) for i in range(1000)]
    got = sorting.run_sort(spark.createDataFrame(rows, "run long, key binary, value long").repartition(5)).collect()
    want, seen = {}, {}
    for run, key, value in sorted(rows, key=lambda r: (r[0], bytes(r[1]), r[2])):
        want[value] = seen[run] = seen.get(run, -1) + 1
    assert {r.value: r.pos for r in got} == want


def test_catalog(spark):
    make = lambda rows: spark.createDataFrame(rows, catalog.SCHEMA)
    c = make([(0, "@{working}/a.in", 1, [0]), (0, "@{working}/b.in", 1, [0]), (1, "@{input}/c.in", 1, [1]), (1, "@{input}/d.in", 1, [1])])
    made = make([(0, "@{working}/a.out", 2, [0]), (0, "@{working}/b.out", 2, [0]), (1, "@{working}/c.out", 2, [1]), (1, "@{working}/d.out", 2, [1])])
    got = sorted((r.mid, r.path.split("/")[-1]) for r in catalog.update(c, catalog.obsolete(c), made).collect())
    assert got == [(0, "a.out"), (0, "b.out"), (1, "c.in"), (1, "c.out"), (1, "d.in"), (1, "d.out")]
    local = make([(0, "@{working}/a", 1, [0]), (0, "@{working}/b", 1, [0])])
    assert [r.path for r in catalog.sync_diff(local, make([(0, "@{working}/a", 9, [0]), (0, "@{input}/x", 1, [0])])).collect()] == ["@{working}/b"]
    machines = spark.createDataFrame([(0,), (1,)], "mid int")
    both = make([(0, "a", 1, [0, 1]), (1, "b", 1, [0, 1])])
    assert sorted((r.mid, r.path) for r in catalog.placements(both, machines).collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]
    paths = spark.createDataFrame([("@{input}/root/input1/a",), ("@{working}/a",), ("@{output}/a",), ("/x",)], "p string")
    assert [r[0] for r in paths.select(catalog.resolve(F.col("p"), "/", "/root/working", "/root/output")).collect()] == ["/root/input1/a", "/root/working/a", "/root/output/a", "/x"]
