"""The query catalogue: one query for each operator, with the same in DuckDB SQL.

Queries run over whole tables. Keys leave as upper-case hex, counts and positions as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import records as R
from keyloom.operators import catalog as C
from keyloom.operators import output, partitioning, sampling, sorting, validate
from keyloom.sources import datagen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SAMPLE, PARTS, PER_FILE = 100, 7, 1000
#: Exclusive ends with an empty range between two equal ones.
ENDS = [bytes([b]) + b"\x00" * 9 for b in (0x20, 0x40, 0x60, 0x80, 0x80, 0xC0)] + [R.MAX_KEY]
ENDS_SQL = "[" + ", ".join(f"'{e.hex().upper()}'" for e in ENDS) + "]"

RECORDS_SQL = """records AS (SELECT upper(substr(md5(concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR))), 1, 20)) AS key,
 upper(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
 CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
 CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR)))) AS value,
 l_suppkey % 4 AS run FROM lineitem)"""
SAMPLE_SQL = f"""sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY key, value) - 1 AS pos FROM records) WHERE pos < {SAMPLE})"""
ASSIGNED_SQL = f"assigned AS (SELECT *, CAST(len(list_filter({ENDS_SQL}, lambda e: e <= key)) AS BIGINT) AS pid FROM records)"
SIZES_SQL = f"sizes AS (SELECT CAST(r.pid AS BIGINT) AS pid, CAST(count(a.key) AS BIGINT) AS n FROM range({len(ENDS)}) r(pid) LEFT JOIN assigned a ON a.pid = r.pid GROUP BY r.pid)"
CATALOG_SQL = """catalog AS (SELECT CAST(s_suppkey % 5 AS INTEGER) AS mid,
 CASE s_suppkey % 4 WHEN 0 THEN concat('@{input}/data/input.', s_suppkey) WHEN 1 THEN concat('@{working}/partition.', s_suppkey // 4, '.', s_suppkey % 3)
 WHEN 2 THEN concat('@{working}/sorted.', s_suppkey) ELSE concat('@{output}/partition.', s_suppkey) END AS path,
 CAST(s_suppkey * 1000 AS BIGINT) AS size, [CAST(s_suppkey % 5 AS INTEGER), CAST(s_suppkey % 3 AS INTEGER)] AS replicas FROM supplier)"""
MACHINES_SQL = "machines AS (SELECT DISTINCT CAST(s_suppkey % 5 AS INTEGER) AS mid FROM supplier)"


def query(sql: str | None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.record_view(_t(spark, d, "lineitem"))


def _hexed(df: DataFrame, *binary: str) -> DataFrame:
    return df.withColumns({c: R.hex_of(F.col(c)) for c in binary or ("key", "value")})


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d)
    return df.withColumn("pid", partitioning.assign(df["key"], ENDS))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(_records(spark, d), SAMPLE)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.sizes(_assigned(spark, d).select("pid"), len(ENDS))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("@{input}/data/input."), s)).when(k % 4 == 1, F.concat(F.lit("@{working}/partition."), F.expr("CAST(s_suppkey div 4 AS STRING)"), F.lit("."), (k % 3).cast("string"))).when(k % 4 == 2, F.concat(F.lit("@{working}/sorted."), s)).otherwise(F.concat(F.lit("@{output}/partition."), s))
    return _t(spark, d, "supplier").select((k % 5).cast("int").alias("mid"), path.alias("path"), (k * 1000).alias("size"), F.array((k % 5).cast("int"), (k % 3).cast("int")).alias("replicas"))


def _machines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("mid")).distinct()


@query(f"WITH {RECORDS_SQL} SELECT * FROM records")
def record_scan(spark, d):
    """A1-A3: all records."""
    return _hexed(_records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT substr(concat(key, value), 1, 20) AS key, substr(concat(key, value), 21) AS value FROM records")
def key_value_projection(spark, d):
    """Key and value cut from the packed record."""
    packed = _records(spark, d).select(R.packed(F.col("key"), F.col("value")).alias("r"))
    return _hexed(packed.select(R.key_of(F.col("r")).alias("key"), R.value_of(F.col("r")).alias("value")))


@query(f"WITH {RECORDS_SQL}, p AS (SELECT unnest(['7F000000000000000000', '80000000000000000000', 'FFFFFFFFFFFFFFFFFFFF']) AS bound) SELECT bound, CAST(count(*) FILTER (key < bound) AS BIGINT) AS below, CAST(count(*) FILTER (key = bound) AS BIGINT) AS equal, CAST(count(*) FILTER (key > bound) AS BIGINT) AS above FROM records, p GROUP BY bound")
def key_compare(spark, d):
    """C4: unsigned comparison with constants around the sign bit."""
    pivots = [bytes([b]) + fill * 9 for b, fill in ((0x7F, b"\x00"), (0x80, b"\x00"), (0xFF, b"\xff"))]
    names = [("below", -1), ("equal", 0), ("above", 1)]
    counts = [F.count_if(R.compare(F.col("key"), R.key_literal(p)) == c).alias(f"{n}{i}") for i, p in enumerate(pivots) for n, c in names]
    rows = F.array(*(F.struct(F.lit(p.hex().upper()).alias("bound"), *(F.col(f"{n}{i}").alias(n) for n, _ in names)) for i, p in enumerate(pivots)))
    return _records(spark, d).agg(*counts).select(F.explode(rows).alias("x")).select("x.*")


@query(f"WITH {RECORDS_SQL} SELECT * FROM records WHERE key >= '40000000000000000000' AND key < '80000000000000000000'")
def range_filter(spark, d):
    """Left-inclusive, right-exclusive."""
    df = _records(spark, d)
    return _hexed(df.where(R.in_range(df["key"], ENDS[1], ENDS[3])))


@query(f"WITH {RECORDS_SQL} SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM records")
def global_sort(spark, d):
    """Every record with its position in the total order."""
    return _hexed(sorting.with_positions(_records(spark, d).select("key", "value")))


@query(f"WITH {RECORDS_SQL} SELECT run, key, value, row_number() OVER (PARTITION BY run ORDER BY key, value) - 1 AS pos FROM records")
def run_sort(spark, d):
    """Positions in each run."""
    return _hexed(sorting.run_sort(_records(spark, d))).select("run", "key", "value", "pos")


@query(f"WITH {RECORDS_SQL} SELECT run, row_number() OVER (ORDER BY run) - 1 AS number FROM (SELECT DISTINCT run FROM records)")
def run_numbering(spark, d):
    """Runs numbered in order."""
    return sorting.run_numbering(_records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM (SELECT * FROM records WHERE run = 0 UNION ALL SELECT * FROM records WHERE run = 1 UNION ALL SELECT * FROM records WHERE run = 2 UNION ALL SELECT * FROM records WHERE run = 3)")
def kway_merge(spark, d):
    """Four runs merged; equals global_sort."""
    df = _records(spark, d)
    runs = [df.where(F.col("run") == i).select("key", "value") for i in range(4)]
    merged = runs[0].union(runs[1]).union(runs[2]).union(runs[3])
    return _hexed(sorting.with_positions(merged))


@query(f"WITH {RECORDS_SQL} SELECT key, value FROM records ORDER BY key, value LIMIT 1000")
def topk(spark, d):
    """The first thousand records."""
    return _hexed(sorting.top_k(_records(spark, d).select("key", "value"), 1000))


@query(f"WITH {RECORDS_SQL} SELECT key, value, CAST(o.o AS BIGINT) AS output FROM records, range(3) o(o)")
def sort_fanout(spark, d):
    """The same rows for three outputs."""
    return _hexed(sorting.sort_fanout(_records(spark, d).select("key", "value"), 3))


@query(f"WITH {RECORDS_SQL}, {SAMPLE_SQL} SELECT run, key, value, pos FROM sample")
def sample_head(spark, d):
    """The head of every run."""
    return _hexed(_sample(spark, d)).select("run", "key", "value", "pos")


@query(f"WITH {RECORDS_SQL} SELECT run % 2 AS machine, min(run) AS run FROM records GROUP BY 1")
def sample_first_file(spark, d):
    """The run each machine samples."""
    return sampling.first_run(_records(spark, d).withColumn("machine", F.col("run") % 2))


@query(f"WITH {RECORDS_SQL}, {SAMPLE_SQL} SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, CAST(count(*) OVER () AS BIGINT) AS n FROM sample")
def sample_keys_sorted(spark, d):
    """Sample keys in order, with their number."""
    s = _sample(spark, d).select("key")
    n = s.agg(F.count("*").alias("n"))
    return _hexed(sorting.with_positions(s, ("key",)).crossJoin(F.broadcast(n)), "key")


@query(f"WITH {RECORDS_SQL}, {SAMPLE_SQL} SELECT run, string_agg(key, '' ORDER BY key) AS keys, CAST(count(*) AS BIGINT) AS n FROM sample GROUP BY run")
def sample_concat(spark, d):
    """Each run's sample as one text."""
    return sampling.concatenated(_sample(spark, d))


@query(f"WITH {RECORDS_SQL}, {SAMPLE_SQL}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM sample) SELECT i.i AS i, k.key AS \"end\" FROM range(1, {PARTS}) i(i) JOIN k ON k.pos = (i.i * k.n) // {PARTS} UNION ALL SELECT CAST({PARTS} AS BIGINT), repeat('FF', 11)")
def split_points(spark, d):
    """Exact split points of the sample."""
    return _hexed(partitioning.split_points(_sample(spark, d), PARTS), "end")


@query(f"WITH e AS (SELECT unnest({ENDS_SQL}) AS hi, generate_subscripts({ENDS_SQL}, 1) AS i) SELECT CAST(i - 1 AS BIGINT) AS pid, lag(hi, 1, repeat('00', 10)) OVER (ORDER BY i) AS lo, hi FROM e")
def split_ranges(spark, d):
    """Ends to ranges."""
    points = spark.createDataFrame([(i, bytearray(e)) for i, e in enumerate(ENDS)], "i long, end binary")
    return _hexed(partitioning.ranges(points), "lo", "hi")


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL} SELECT key, value, pid FROM assigned")
def range_partition_assign(spark, d):
    """The range of every record."""
    return _hexed(_assigned(spark, d).select("key", "value", "pid"))


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL}, {SIZES_SQL} SELECT pid, n FROM sizes")
def range_partition_sizes(spark, d):
    """All ranges with their records, empty ones too."""
    return _sizes(spark, d)


@query(f"WITH {RECORDS_SQL}, e AS (SELECT unnest({ENDS_SQL}) AS hi, generate_subscripts({ENDS_SQL}, 1) AS i), r AS (SELECT CAST(i - 1 AS BIGINT) AS pid, lag(hi, 1, repeat('00', 10)) OVER (ORDER BY i) AS lo, hi FROM e) SELECT key, value, pid FROM records JOIN r ON key >= lo AND key < hi")
def range_join_partition(spark, d):
    """The same by a range join."""
    bounds = partitioning.ranges_frame(spark, ENDS)
    return _hexed(partitioning.range_join(_records(spark, d).select("key", "value"), ENDS, bounds)).select("key", "value", "pid")


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL} SELECT pid, pid AS task, CAST(count(*) AS BIGINT) AS n FROM assigned GROUP BY pid")
def exchange_layout(spark, d):
    """Where the exchange puts ranges; one task each."""
    moved = partitioning.exchange(_assigned(spark, d), len(ENDS)).withColumn("task", F.spark_partition_id().cast("long"))
    return moved.groupBy("pid", "task").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY key, value) - 1 AS pos FROM assigned) SELECT pid, key, value, pos, pos // {PER_FILE} AS chunk FROM p")
def rolling_output(spark, d):
    """The output of each record in its range."""
    return _hexed(output.rolling(_assigned(spark, d).select("key", "value", "pid"), PER_FILE)).select("pid", "key", "value", "pos", "chunk")


@query(f"""WITH {RECORDS_SQL}, {ASSIGNED_SQL}, {SIZES_SQL}, f AS (SELECT *, (n + {PER_FILE - 1}) // {PER_FILE} AS files FROM sizes),
b AS (SELECT *, CAST(coalesce(sum(files) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM f)
SELECT base + k AS file_no, pid, CAST(least({PER_FILE}, n - k * {PER_FILE}) AS BIGINT) AS n, k * {PER_FILE} AS lo, CAST(least((k + 1) * {PER_FILE}, n) AS BIGINT) AS hi FROM (SELECT *, unnest(range(files)) AS k FROM b)""")
def output_manifest(spark, d):
    """All output files, planned before writing."""
    return output.manifest(_sizes(spark, d), PER_FILE)


@query(f"WITH {RECORDS_SQL}, o AS (SELECT key, lag(key) OVER (ORDER BY key, value) AS before FROM records) SELECT CAST(count(*) FILTER (before > key) AS BIGINT) AS violations FROM o")
def validate_sorted(spark, d):
    """The sorted records have no record before a smaller one."""
    return validate.order_violations(sorting.global_sort(_records(spark, d).select("key", "value")))


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL}, e AS (SELECT pid, min(key) AS lo, max(key) AS hi FROM assigned GROUP BY pid), l AS (SELECT lo, lag(hi) OVER (ORDER BY pid) AS before FROM e) SELECT CAST(count(*) FILTER (before > lo) AS BIGINT) AS violations FROM l")
def validate_ranges(spark, d):
    """Ranges don't overlap."""
    return validate.range_violations(_assigned(spark, d))


@query(f"WITH {RECORDS_SQL}, {ASSIGNED_SQL} SELECT (SELECT count(*) FROM records) AS n_in, (SELECT count(*) FROM assigned) AS n_out, (SELECT count(*) FROM records) = (SELECT count(*) FROM assigned) AS equal")
def record_count_parity(spark, d):
    """as many records out as in."""
    return validate.count_parity(_records(spark, d), sorting.kway_merge([_assigned(spark, d)]))


@query(f"""WITH {RECORDS_SQL}, {SAMPLE_SQL}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM sample),
e AS (SELECT list(k.key) AS ends FROM range(1, {PARTS}) i(i) JOIN k ON k.pos = (i.i * k.n) // {PARTS}), a AS (SELECT key, CAST(len(list_filter(ends, lambda x: x <= key)) AS BIGINT) AS pid FROM records, e)
SELECT pid, CAST(count(*) AS BIGINT) AS n, min(key) AS lo, max(key) AS hi FROM a GROUP BY pid""")
def sampled_ranges(spark, d):
    """D5, E2, E3 as one: the head of every run, its split points, and the records of each range they make."""
    ends = partitioning.collected_ends(partitioning.split_points(_sample(spark, d), PARTS))
    df = _records(spark, d)
    by = df.withColumn("pid", partitioning.assign(df["key"], ends)).groupBy("pid")
    return _hexed(by.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")), "lo", "hi")


def _sorted_files(spark, records, name, cap, ranges):
    """``records`` written as files, sorted by the whole job, and read again with positions in the output."""
    import uuid

    from keyloom.plans.file_sort import sort_files
    from keyloom.sources.fixed_record import read_records, register

    register(spark)
    root = (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    root = f"{root}/{name}-{uuid.uuid4().hex}"
    records.select("key", "value").write.format("fixedrecord").mode("append").option("path", f"{root}/in").save()
    sort_files(spark, [f"{root}/in"], f"{root}/out", cap, ranges)
    got = read_records(spark, [f"{root}/out"], positions=True).withColumn("number", F.substring_index("file", ".", -1).cast("long"))
    sizes = got.groupBy("number").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return _hexed(got.join(F.broadcast(sizes.select("number", F.coalesce(before, F.lit(0)).alias("base"))), "number").select("key", "value", (F.col("base") + F.col("row")).alias("pos")))


def _long_value(value):
    """A value of 90 bytes that begins with a shorter one."""
    return F.substring(F.concat(value, *[F.unhex(F.md5(value))] * 5), 1, R.VALUE_LEN)


_LONG_SQL = "substr(concat(value, repeat(upper(md5(unhex(value))), 5)), 1, 180)"


@query(f"WITH {RECORDS_SQL}, l AS (SELECT key, {_LONG_SQL} AS value FROM records) SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM l")
def file_sort(spark, d):
    """100-byte records written as files, sorted by the job, read again."""
    df = _records(spark, d)
    return _sorted_files(spark, df.select("key", _long_value(df["value"]).alias("value")), "file-sort", 100_000, 16)


@query(f"WITH {RECORDS_SQL}, l AS (SELECT CASE WHEN run <> 0 THEN '68' || repeat('00', 9) ELSE key END AS key, {_LONG_SQL} AS value FROM records) SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM l")
def file_sort_skewed(spark, d):
    """The same where three of four records share one key."""
    df = _records(spark, d)
    key = F.when(F.col("run") != 0, R.key_literal(b"h" + bytes(9))).otherwise(F.col("key"))
    return _sorted_files(spark, df.select(key.alias("key"), _long_value(df["value"]).alias("value")), "file-sort-skewed", 100_000, 16)


@query("SELECT 'lineitem' AS name, CAST(count(*) AS BIGINT) AS rows, true AS sized FROM lineitem UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT), true FROM orders")
def file_metadata(spark, d):
    """Files, their sizes and rows, from the files themselves."""
    found = C.file_catalog(_t(spark, d, "lineitem")).unionByName(C.file_catalog(_t(spark, d, "orders")))
    return found.groupBy(F.regexp_extract("path", "([a-z]+)[.]parquet", 1).alias("name")).agg(F.sum("rows").cast("long").alias("rows"), F.bool_and(F.col("size") > 0).alias("sized"))


@query(f"WITH {RECORDS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT key) AS BIGINT) AS distinct_keys, CAST(count(*) - count(DISTINCT key) AS BIGINT) AS duplicates FROM records")
def duplicate_keys(spark, d):
    """F8: how many records repeat a key."""
    return validate.duplicate_keys(_records(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST('0x' || substr(md5(concat(key, value)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM records")
def checksum(spark, d):
    """An order-free checksum of all records."""
    return validate.checksum(_records(spark, d))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS total FROM documents")
def length_sum(spark, d):
    """the length of each text, then their sum."""
    each = _t(spark, d, "documents").select(F.octet_length("text").cast("long").alias("n"))
    return each.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


@query(f"WITH {CATALOG_SQL} SELECT mid, path, size, array_to_string(replicas, ',') AS replicas FROM catalog")
def file_catalog(spark, d):
    """The catalog, with sizes."""
    return _catalog(spark, d).withColumn("replicas", F.array_join(F.col("replicas").cast("array<string>"), ","))


@query(f"WITH {CATALOG_SQL} SELECT mid, path, size FROM catalog WHERE NOT starts_with(path, '@{{input}}')")
def catalog_filter(spark, d):
    """What is not an input."""
    return C.without_inputs(_catalog(spark, d)).select("mid", "path", "size")


@query(f"WITH {CATALOG_SQL} SELECT path, CAST(regexp_extract(path, '^@\\{{working\\}}/partition\\.(\\d+).(\\d+)$', 1) AS BIGINT) AS run, CAST(regexp_extract(path, '^@\\{{working\\}}/partition\\.(\\d+).(\\d+)$', 2) AS BIGINT) AS owner, string_split(path, '.')[-1] AS suffix FROM catalog WHERE regexp_matches(path, '^@\\{{working\\}}/partition\\.(\\d+).(\\d+)$')")
def catalog_regex(spark, d):
    """Run and owner from the path."""
    return C.parsed(_catalog(spark, d)).select("path", "run", "owner", "suffix")


@query(f"WITH {CATALOG_SQL} SELECT path, CASE WHEN starts_with(path, '@{{working}}') THEN concat('/data/work', substr(path, 11)) WHEN starts_with(path, '@{{output}}') THEN concat('/data/out', substr(path, 10)) ELSE substr(path, 9) END AS resolved FROM catalog")
def path_resolve(spark, d):
    """Symbolic roots resolved."""
    return _catalog(spark, d).select("path", C.resolve(F.col("path"), "/", "/data/work", "/data/out").alias("resolved"))


@query(f"WITH {CATALOG_SQL} SELECT mid, path FROM catalog EXCEPT SELECT mid, path FROM catalog WHERE size % 3000 = 0")
def catalog_sync_diff(spark, d):
    """Local files that the catalog doesn't know."""
    c = _catalog(spark, d)
    return C.sync_diff(c, c.where(F.col("size") % 3000 == 0))


@query(f"""WITH {CATALOG_SQL}, gone AS (SELECT mid, path FROM catalog WHERE starts_with(path, '@{{working}}') AND replicas[1] = mid),
added AS (SELECT mid, concat(path, '.out') AS path, size * 2 AS size FROM catalog WHERE size % 2000 = 0 UNION ALL SELECT mid, path, size + 1 AS size FROM catalog WHERE starts_with(path, '@{{output}}'))
SELECT mid, path, size FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.mid = c.mid AND g.path = c.path) AND NOT EXISTS (SELECT 1 FROM added a WHERE a.mid = c.mid AND a.path = c.path) UNION ALL SELECT mid, path, size FROM added""")
def catalog_update(spark, d):
    """S3, C14: consumed files go, results come and win."""
    c = _catalog(spark, d)
    added = c.where(F.col("size") % 2000 == 0).withColumns({"path": F.concat("path", F.lit(".out")), "size": F.col("size") * 2}).union(c.where(F.col("path").startswith("@{output}")).withColumn("size", F.col("size") + 1))
    return C.update(c, C.obsolete(c), added).select("mid", "path", "size")


@query(f"WITH {CATALOG_SQL}, {MACHINES_SQL} SELECT DISTINCT c.path, m.mid FROM catalog c JOIN machines m ON list_contains(c.replicas, m.mid)")
def replica_placement(spark, d):
    """Machines that hold a replica."""
    return C.placements(_catalog(spark, d), _machines(spark, d))


@query(f"""WITH {CATALOG_SQL}, {MACHINES_SQL}, s AS (SELECT CAST(regexp_extract(path, '^@\\{{working\\}}/partition\\.(\\d+).(\\d+)$', 2) AS BIGINT) AS mid, size FROM catalog WHERE regexp_matches(path, '^@\\{{working\\}}/partition\\.(\\d+).(\\d+)$'))
SELECT CAST(m.mid AS BIGINT) AS mid, CAST(count(s.size) AS BIGINT) AS files, CAST(coalesce(sum(s.size), 0) AS BIGINT) AS bytes FROM machines m LEFT JOIN s ON s.mid = m.mid GROUP BY m.mid""")
def merge_inputs(spark, d):
    """What each machine merges."""
    return C.merge_inputs(_catalog(spark, d), _machines(spark, d))


@query(f"WITH {CATALOG_SQL}, l AS (SELECT mid, CAST(count(*) AS BIGINT) AS pending FROM catalog GROUP BY mid) SELECT mid, pending FROM l ORDER BY pending, mid LIMIT 1")
def least_loaded(spark, d):
    """The machine with the smallest load."""
    return C.least_loaded(_catalog(spark, d).groupBy("mid").agg(F.count("*").alias("pending")))


@query(f"WITH {MACHINES_SQL} SELECT mid, row_number() OVER (ORDER BY mid) - 1 AS pos FROM machines")
def machine_order(spark, d):
    """Machines in order."""
    return C.machine_order(_machines(spark, d))


@query(f"WITH {CATALOG_SQL} SELECT coalesce(bool_or(starts_with(path, '@{{input}}')), false) AS any_input, coalesce(bool_and(size >= 0), true) AS all_sized FROM catalog")
def catalog_flags(spark, d):
    """forall and exists over the catalog."""
    return C.flags(_catalog(spark, d))


@query(f"WITH {CATALOG_SQL} SELECT mid, CAST(count(*) AS BIGINT) AS files FROM catalog WHERE starts_with(path, '@{{input}}') GROUP BY mid")
def nonempty_inputs(spark, d):
    """Machines with input files."""
    return C.nonempty_inputs(_catalog(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT key, 'lineitem' AS source FROM records UNION ALL SELECT upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 20)), 'orders' FROM orders")
def multi_input_union(spark, d):
    """Keys of two tables."""
    orders = _t(spark, d, "orders").select(F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 20)).alias("key"), F.lit("orders").alias("source"))
    return _hexed(_records(spark, d).select("key", F.lit("lineitem").alias("source")).unionByName(orders), "key")


@query(f"WITH {RECORDS_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT key) AS BIGINT) AS duplicates FROM records WHERE false")
def empty_input(spark, d):
    """No input gives one row of zeros."""
    return validate.duplicate_keys(_records(spark, d).where(F.lit(False))).select("n", "duplicates")


_VALUE_SQL = "concat('20', upper(hex(encode(substr(concat(md5(concat('{s}-0-', id)), md5(concat('{s}-1-', id)), md5(concat('{s}-2-', id))), 1, 87)))), '0D0A')"


@query(f"SELECT id, upper(substr(md5(concat('7-', id)), 1, 20)) AS key, {_VALUE_SQL.format(s=7)} AS value FROM range(5000) r(id)")
def datagen_uniform(spark, d):
    """Uniform keys."""
    return _hexed(datagen.uniform(spark, 5000, seed=7))


@query(f"SELECT id, upper(hex(encode(substr(md5(concat('7-', id)), 1, 10)))) AS key, {_VALUE_SQL.format(s=7)} AS value FROM range(5000) r(id)")
def datagen_ascii(spark, d):
    """Printable keys."""
    return _hexed(datagen.ascii(spark, 5000, seed=7))


@query(f"SELECT id, upper(substr(md5(concat('7-', CASE WHEN id % 40 = 0 THEN id ELSE id % 100 END)), 1, 20)) AS key, {_VALUE_SQL.format(s=7)} AS value FROM range(5000) r(id)")
def datagen_skew(spark, d):
    """Skewed keys."""
    return _hexed(datagen.skew(spark, 5000, seed=7))
