"""Queries by name, and the SQL that must give the same rows.  Names with ``ext_`` are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.dtypes import multiply, wide, wrap
from lattice.operators import catalog, kernels, linalg, memory, spirv, transfer
from lattice.plans.fixtures import RANK, devices, devices_sql, modules, modules_sql, platforms, platforms_sql, properties, properties_sql, rank_system, spd_system, tasks, tasks_sql
from lattice.plans.scheduler import device_seconds, event_edges
from lattice.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, 2 * l_quantity + l_extendedprice AS c FROM lineitem")
def axpy(spark, d):
    df = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return kernels.launch(df, lambda k, a, b: k * a + b, 2, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "c")


@query("""SELECT o_orderkey, (((d * (o_custkey * 3) + o_orderkey + 128) % 256 + 256) % 256 - 128)::TINYINT AS i1, (((d * (o_custkey * 3) + o_orderkey) % 65536 + 65536) % 65536)::INTEGER AS u2,
  (((d * (o_custkey * 3) + o_orderkey + 2147483648) % 4294967296) - 2147483648)::INTEGER AS i4, (d * (o_custkey * 3) + o_orderkey)::BIGINT AS i8 FROM orders, (SELECT 2 AS d)""")
def axpy_typed(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    tripled = wrap(wide(F.col("o_custkey"), "i8") * 3, "i8")
    value = wrap(wide(multiply(tripled, F.lit(2), "i8"), "i8") + wide(F.col("o_orderkey"), "i8"), "i8")
    return df.select("o_orderkey", wrap(value, "i1").alias("i1"), wrap(value, "u2").alias("u2"), wrap(value, "i4").alias("i4"), value.alias("i8"))


@query("SELECT l_orderkey, l_linenumber, 0.5 * l_quantity + 2 * l_tax AS y FROM lineitem")
def axpby(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", linalg.axpby_of(0.5, F.col("l_quantity"), 2, F.col("l_tax")).alias("y"))


@query("SELECT l_orderkey, l_linenumber, 3 * (l_quantity + l_discount) AS c FROM lineitem")
def scaled_sum(spark, d):
    return kernels.launch(read_table(spark, d, "lineitem"), lambda k, a, b: k * (a + b), 3, "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "c")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS r FROM lineitem")
def vec_sub(spark, d):
    return kernels.launch(read_table(spark, d, "lineitem"), linalg.subtracted, "l_extendedprice", "l_quantity", out="r").select("l_orderkey", "l_linenumber", "r")


@query("SELECT o_orderkey, o_orderkey + o_custkey AS c FROM orders")
def vec_add_int(spark, d):
    return kernels.launch(read_table(spark, d, "orders"), lambda a, b: a + b, "o_orderkey", "o_custkey").select("o_orderkey", "c")


@query("""SELECT o_orderkey, a, b, least(a, b) AS c FROM (SELECT o_orderkey, (o_orderkey % 17) * (o_orderkey % 17) % 17 AS a,
  ((o_orderkey % 27) * (o_orderkey % 27) % 27) * (o_orderkey % 27) % 27 AS b FROM orders)""")
def kernel_dag(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey")
    df = kernels.launch(df, lambda i, m: (i % m) * (i % m) % m, "o_orderkey", 17, out="a")
    df = kernels.launch(df, lambda i, m: ((i % m) * (i % m) % m) * (i % m) % m, "o_orderkey", 27, out="b")
    return kernels.launch(df, F.least, "a", "b")


@query("SELECT o_orderkey, (o_custkey - o_orderkey) % 7 AS m FROM orders")
def mod_reduce(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", linalg.reduced(F.col("o_custkey") - F.col("o_orderkey"), 7).alias("m"))


@query("SELECT l_orderkey, l_linenumber, round(sin(sqrt(l_quantity + 1)), 6) AS y FROM lineitem")
def unary_chain(spark, d):
    df = kernels.launch(read_table(spark, d, "lineitem"), lambda x: x + 1, "l_quantity", out="a")
    df = kernels.launch(kernels.launch(df, F.sqrt, "a", out="b"), F.sin, "b")
    return df.select("l_orderkey", "l_linenumber", F.round("c", 6).alias("y"))


@query("SELECT p_partkey, p_size * 2 AS y FROM part")
def double_it(spark, d):
    return kernels.launch(read_table(spark, d, "part"), lambda x: x * 2, "p_size", out="y").select("p_partkey", "y")


@query("SELECT p_partkey, p_size * 10::DOUBLE + 2.5::DOUBLE AS y FROM part")
def spec_const(spark, d):
    bundle = kernels.Bundle().specialize(kernels.SpecConstant(0, 10), kernels.SpecConstant(1, 2.5, "f8"), kernels.SpecConstant(2, True, "?"))
    bundle.kernels["scale"] = lambda x: F.when(bundle.constant(2, F.lit(True)), x.cast("double") * bundle.constant(0, F.lit(1)) + bundle.constant(1, F.lit(0.0)))
    return kernels.launch(read_table(spark, d, "part"), bundle.get("scale"), "p_size", out="y").select("p_partkey", "y")


@query("SELECT p_partkey, ((64 * p_size + 105 + 128) % 256 - 128)::TINYINT AS a FROM part")
def struct_arg_chain(spark, d):
    import struct

    df = read_table(spark, d, "part").select("p_partkey", F.col("p_size").alias("a"))
    arg = kernels.RawArg(struct.pack("=2i", 4, 5), "=2i", ["mul", "add"])
    for _ in range(3):
        df = kernels.launch(df, lambda a, p: wrap(wide(a, "i1") * p["mul"] + p["add"], "i1"), "a", arg, out="a")
    return df


@query("SELECT o_orderkey, (sum(2) OVER (PARTITION BY o_orderkey // 32) * (o_orderkey + 1))::BIGINT AS y FROM orders")
def group_scratch(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 32").alias("wg"))
    memory = kernels.WorkGroupMemory.of("i8", 32)
    return kernels.launch(df, lambda i, shared: shared.shared(F.lit(2)) * (i + 1), "o_orderkey", memory, out="y").select("o_orderkey", "y")


@query("SELECT o_orderkey, o_custkey AS y FROM orders")
def wg_copy(spark, d):
    return kernels.launch(read_table(spark, d, "orders"), lambda x: x, "o_custkey", out="y").select("o_orderkey", "y")


@query("SELECT i, i // 12 AS i0, i // 4 % 3 AS i1, i % 4 AS i2, (i // 12) * 2 + (i % 4) // 2 AS wg FROM range(24) t(i)")
def index_space(spark, d):
    return kernels.index_space(spark, [2, 3, 4], [1, 3, 2]).withColumnRenamed("idx", "i")


@query("SELECT j, round(sum(v), 3) AS total FROM (SELECT unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY j")
def column_totals(spark, d):
    matrix = read_table(spark, d, "embeddings").select(F.posexplode("embedding").alias("j", "v")).select(F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    return linalg.column_totals(matrix).select("j", F.round("total", 3).alias("total"))


@query("SELECT round(sum(l_quantity * l_quantity), 2) AS s FROM lineitem")
def norm_squared(spark, d):
    return linalg.norm_squared(read_table(spark, d, "lineitem").select(F.col("l_quantity").alias("v"))).select(F.round("s", 2).alias("s"))


@query("SELECT round(sum(l_quantity * l_tax), 2) AS s FROM lineitem")
def dot(spark, d):
    return read_table(spark, d, "lineitem").agg(F.round(linalg.dot_of(F.col("l_quantity"), F.col("l_tax")), 2).alias("s"))


@query("SELECT vec_id AS idx, round(sum(v * (j + 1)), 3) AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id")
def gemv(spark, d):
    matrix = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    x = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 1).cast("double").alias("v"))
    return linalg.gemv(matrix, x).select("idx", F.round("v", 3).alias("v"))


@query("SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, -2.0), (2, 3.0), (3, 0.5), (4, 4.0)) t(idx, v)")
def cg_solve(spark, d):
    x, _ = linalg.conjugate_gradient(*spd_system(spark))
    return x.select("idx", F.round("v", 6).alias("v"))


@query("SELECT idx, (CASE WHEN idx < 4 THEN 127 ELSE 0 END)::SMALLINT AS v FROM range(16) t(idx) UNION ALL SELECT 100 + idx, 44::SMALLINT FROM range(8) t(idx)")
def memset_clamp(spark, d):
    part = transfer.memset(transfer.allocate(spark, 16), 0x7F, 4, 16)
    clamped = transfer.memset(transfer.allocate(spark, 8), 300, 32, 8)
    return part.unionByName(clamped.withColumn("idx", F.col("idx") + 100))


@query("SELECT o_orderkey AS idx, CASE WHEN o_orderkey < 500 THEN o_custkey ELSE 0 END AS v FROM orders")
def typed_copy(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey")
    return transfer.copy(orders.select("idx", F.lit(0).cast("bigint").alias("v")), orders.select("idx", F.col("o_custkey").alias("v")), 500, "i8")


@query("SELECT idx, (CASE WHEN idx < 26 THEN 97 + idx ELSE 45 END)::SMALLINT AS v FROM range(30) t(idx)")
def prefix_overlay(spark, d):
    dashes = spark.range(30).select(F.col("id").alias("idx"), F.lit(45).cast("smallint").alias("v"))
    return transfer.copy_from_host(dashes, bytes(range(97, 123)))


@query("SELECT pos, 9 + (pos // 2) * 10 + (pos % 2) * -2 AS v FROM range(4) t(pos)")
def strided_gather(spark, d):
    buffer = spark.range(20).select(F.col("id").alias("idx"), F.col("id").alias("v"))
    return transfer.gather(buffer, transfer.strided_indices(spark, (2, 2), (10, -2), 9))


@query("SELECT doc_id, strlen(text)::INTEGER AS n FROM documents")
def byte_length(spark, d):
    return read_table(spark, d, "documents").select("doc_id", transfer.byte_length(F.col("text")).alias("n"))


@query("SELECT region.r_regionkey, upper(hex(encode(r_name)))  AS before, 'ABABABAB' || substr(upper(hex(encode(r_name))), 9) AS after FROM region")
def memset_bytes(spark, d):
    data = F.col("r_name").cast("binary")
    return read_table(spark, d, "region").select("r_regionkey", F.hex(data).alias("before"), F.hex(transfer.memset_bytes(data, 0xAB, 4)).alias("after"))


@query(f"SELECT device_id, backend, device_type, score FROM ({devices_sql()}) WHERE score > 0 AND list_contains(aspects, 'fp64') AND NOT list_contains(aspects, 'emulated') ORDER BY score DESC, enum_order LIMIT 1")
def select_device(spark, d):
    return catalog.select_with_aspects(devices(spark), ["fp64"], ["emulated"]).select("device_id", "backend", "device_type", "score")


@query(f"SELECT device_id, enum_order FROM ({devices_sql()}) WHERE backend = 'opencl' AND device_type = 'gpu' AND score >= 0")
def list_devices(spark, d):
    return catalog.get_devices(devices(spark), " OpenCL ", "GPU").select("device_id", "enum_order")


@query(f"SELECT device_id FROM (SELECT *, row_number() OVER (ORDER BY enum_order) - 1 AS n FROM ({devices_sql()}) WHERE device_type = 'gpu' AND score >= 0) WHERE n = 1")
def select_by_filter(spark, d):
    return catalog.select_by_filter(devices(spark), "cuda:cpu,gpu:1").select("device_id")


@query(f"""SELECT device_id, row_number() OVER (ORDER BY enum_order) - 1 AS n, row_number() OVER (PARTITION BY backend ORDER BY enum_order) - 1 AS n_backend,
  row_number() OVER (PARTITION BY device_type ORDER BY enum_order) - 1 AS n_type, row_number() OVER (PARTITION BY backend, device_type ORDER BY enum_order) - 1 AS n_both FROM ({devices_sql()}) WHERE score >= 0""")
def device_ordinals(spark, d):
    return catalog.ordinals(devices(spark)).select("device_id", "n", "n_backend", "n_type", "n_both")


@query(f"""WITH RECURSIVE dev AS ({devices_sql()}), up(device_id, root, depth) AS (SELECT device_id, device_id, 0 FROM dev UNION ALL
  SELECT up.device_id, dev.parent_id, depth + 1 FROM up JOIN dev ON dev.device_id = up.root WHERE dev.parent_id IS NOT NULL) SELECT device_id, arg_max(root, depth) AS root_id FROM up GROUP BY device_id""")
def root_device(spark, d):
    return catalog.roots(devices(spark)).select("device_id", "root_id")


@query(f"WITH dev AS ({devices_sql()}) SELECT a.device_id, b.device_id AS peer_id FROM dev a JOIN dev b ON a.backend = b.backend AND a.device_id <> b.device_id WHERE a.backend IN ('cuda', 'hip', 'level_zero')")
def peer_pairs(spark, d):
    return catalog.peer_pairs(devices(spark))


@query(f"SELECT device_id, unnest(range(compute_units // 3))::BIGINT AS sub, 3 AS compute_units FROM ({devices_sql()})")
def partition_equal(spark, d):
    return catalog.create_sub_devices(devices(spark), 3)


@query(f"""SELECT device_id, unnest([0, 1, 2])::INTEGER AS sub, unnest([4, 2, 1])::INTEGER AS compute_units FROM ({devices_sql()}) WHERE compute_units >= 7
  UNION ALL SELECT device_id, NULL, NULL FROM ({devices_sql()}) WHERE compute_units < 7""")
def partition_counts(spark, d):
    return catalog.create_sub_devices(devices(spark), [4, 2, 1])


@query(f"SELECT platform_id, platform_name, vendor, p.backend, count(device_id) AS n_devices FROM ({platforms_sql()}) p LEFT JOIN ({devices_sql()}) v USING (platform_id) GROUP BY ALL")
def platform_listing(spark, d):
    return catalog.platform_listing(platforms(spark), devices(spark), 1).select("platform_id", "platform_name", "vendor", "backend", "n_devices")


@query(f"SELECT event_id, unnest(depends_on) AS needs FROM ({tasks_sql()})")
def task_edges(spark, d):
    return event_edges(tasks(spark))


@query(f"SELECT round(sum(end_ns - start_ns) * 1e-9::DOUBLE, 9) AS seconds FROM ({tasks_sql()})")
def timer_sum(spark, d):
    return device_seconds(tasks(spark))


@query("SELECT o_orderkey AS i, list(l_quantity ORDER BY l_linenumber, l_quantity) AS row FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def matrix_rows(spark, d):
    matrix = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v"))
    known = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    return linalg.to_lists(matrix.join(known, "i", "left_semi"))


@query(f"SELECT idx, CASE WHEN idx % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS v FROM range({RANK[0]}) t(idx)")
def cg_rank16(spark, d):
    """The reference harness's shape: n unknowns, a low-rank perturbation of a diagonal."""
    x, _ = linalg.conjugate_gradient(*rank_system(spark))
    return x.select("idx", F.round("v", 6).alias("v"))


@query("SELECT vec_id AS idx, round(list_sum(list_transform(embedding, lambda v, j: v::DOUBLE * j)), 3) AS v FROM embeddings")
def gemv_rows(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("row"))
    return linalg.gemv_rows(rows, list(range(1, 65))).select("idx", F.round("v", 3).alias("v"))


@query("SELECT 0::BIGINT + i AS idx, (15 * i + 4)::DOUBLE AS v FROM range(3) t(i)")
def gemv_leading(spark, d):
    """Rows of eight elements of which seven count: six ones and 15 i - 2."""
    flat = spark.range(24).select(F.col("id").alias("idx"), F.when(F.col("id") % 8 == 6, F.expr("15 * (id div 8) - 2")).when(F.col("id") % 8 == 7, F.lit(1000)).otherwise(F.lit(1)).cast("double").alias("v"))
    return linalg.gemv(flat, spark.range(7).select(F.col("id").alias("idx"), F.lit(1.0).alias("v")), 8)


@query("SELECT round(sum(l_quantity * l_quantity + l_discount * l_discount), 2) AS s FROM lineitem")
def norm_complex(spark, d):
    df = read_table(spark, d, "lineitem").select(F.struct(F.col("l_quantity").alias("real"), F.col("l_discount").alias("imag")).alias("v"))
    return linalg.norm_squared_complex(df).select(F.round("s", 2).alias("s"))


@query("SELECT round(sum(p_size * p_retailprice + p_retailprice * p_size), 1) AS real, round(sum(p_size * p_size - p_retailprice * p_retailprice), 1) AS imag FROM part")
def dot_complex(spark, d):
    df = read_table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    pair = lambda a, b: df.select(F.col("p_partkey").alias("idx"), F.struct(F.col(a).alias("real"), F.col(b).alias("imag")).alias("v"))
    return linalg.dot_complex(pair("p_size", "p_retailprice"), pair("p_retailprice", "p_size")).select(F.round("real", 1).alias("real"), F.round("imag", 1).alias("imag"))


@query("SELECT c_custkey, upper(hex(encode(c_name[1:4] || c_mktsegment[5:]))) AS v FROM customer WHERE length(c_mktsegment) >= 4")
def memcpy_bytes(spark, d):
    df = read_table(spark, d, "customer").where("octet_length(c_mktsegment) >= 4")
    return df.select("c_custkey", F.hex(transfer.memcpy(F.col("c_mktsegment").cast("binary"), F.col("c_name").cast("binary"), 4)).alias("v"))


@query("SELECT idx, 'DEADBEEF' AS v FROM range(48) t(idx)")
def fill_pattern(spark, d):
    return transfer.fill(spark, bytes.fromhex("DEADBEEF"), 48).select("idx", F.hex("v").alias("v"))


@query(f"SELECT device_type, count(*) AS n, count(*) > 0 AS found FROM ({devices_sql()}) WHERE score >= 0 GROUP BY device_type")
def device_counts(spark, d):
    rows = [(t, catalog.num_devices(devices(spark), "all", t), catalog.has_devices(devices(spark), t)) for t in catalog.TYPES]
    return spark.createDataFrame(rows, "device_type string, n long, found boolean").where("found")


@query(f"SELECT device_id, list_contains(aspects, 'fp64') AS has FROM ({devices_sql()})")
def aspect_of_device(spark, d):
    return catalog.has_aspect(devices(spark), "fp64")


@query(f"SELECT device_id FROM ({devices_sql()}) WHERE score >= 0 ORDER BY score DESC, enum_order LIMIT 1")
def best_device(spark, d):
    return catalog.select_best(devices(spark)).select("device_id")


@query(f"""WITH RECURSIVE dev AS ({devices_sql()}), up(device_id, root) AS (SELECT device_id, device_id FROM dev WHERE parent_id IS NULL UNION ALL SELECT dev.device_id, up.root FROM dev JOIN up ON dev.parent_id = up.device_id),
  nth AS (SELECT device_id AS root, row_number() OVER (ORDER BY enum_order) - 1 AS number FROM dev WHERE parent_id IS NULL AND score >= 0) SELECT up.device_id, number FROM up JOIN nth USING (root)""")
def device_number(spark, d):
    return catalog.device_numbers(devices(spark))


@query(f"SELECT parent_id AS device_id, list(device_id ORDER BY enum_order) AS component_ids FROM ({devices_sql()}) WHERE parent_id IS NOT NULL GROUP BY parent_id")
def composite_devices(spark, d):
    return catalog.composites(devices(spark))


@query(f"SELECT platform_id, platform_name FROM ({platforms_sql()})")
def platform_names(spark, d):
    return catalog.platform_listing(platforms(spark), devices(spark), 0)


@query(f"SELECT platform_id, platform_name, vendor, p.backend, device_id, device_type, enum_order FROM ({platforms_sql()}) p LEFT JOIN ({devices_sql()}) v USING (platform_id)")
def platform_devices(spark, d):
    return catalog.platform_listing(platforms(spark), devices(spark), 2).select("platform_id", "platform_name", "vendor", "backend", "device_id", "device_type", "enum_order")


@query(modules_sql())
def spirv_constants(spark, d):
    return spirv.parse_modules(modules(spark))


def _allocations(spark: SparkSession) -> list[memory.Allocation]:
    here, there = memory.Context.of(spark, [13, 11]), memory.Context.of(spark, 14)
    return [memory.allocate(spark, 16 << k, kind, c) for k, (kind, c) in enumerate([("device", here), ("shared", here), ("host", there)])]


@query("SELECT * FROM (VALUES (0::BIGINT, 16::BIGINT, 'device', 13), (1, 32, 'shared', 13), (2, 64, 'unknown', 14)) t(alloc, nbytes, kind, device_id)")
def allocation_kinds(spark, d):
    return memory.catalog(spark, _allocations(spark), memory.Context.of(spark, [13, 11]))


@query(f"SELECT alloc, device_id, backend, device_type FROM (VALUES (0::BIGINT, 13), (1, 13), (2, 14)) t(alloc, device_id) JOIN ({devices_sql()}) USING (device_id)")
def allocation_owner(spark, d):
    return memory.owners(memory.catalog(spark, _allocations(spark)), devices(spark))


@query("SELECT idx, (CASE WHEN idx < 16 THEN 7 ELSE 0 END)::SMALLINT AS v FROM range(32) t(idx)")
def device_copy(spark, d):
    small, large, _ = _allocations(spark)
    seven = memory.Allocation(transfer.memset(small.vector, 7, 0, 16), small.kind, 16, "u1", small.device, small.context)
    return memory.copy_from_device(large, seven).vector


@query(f"SELECT device_id, max_work_item_sizes[1:2] AS sizes, least(max_work_item_sizes[1]::BIGINT * max_work_item_sizes[2], max_work_group_size) AS total FROM ({properties_sql()})")
def work_item_limits(spark, d):
    return catalog.max_work_items(properties(spark), 2)


@query(f"SELECT device_id, global_mem_size AS value FROM ({properties_sql()})")
def device_memory(spark, d):
    return catalog.device_property(properties(spark), "global_mem_size")


@query(f"SELECT device_id FROM ({devices_sql()}) JOIN ({properties_sql()}) USING (device_id) WHERE score >= 0 AND local_mem_size >= 49152 AND max_work_group_size >= 512")
def fitting_devices(spark, d):
    return catalog.fitting(devices(spark), properties(spark), 49152, 512).select("device_id")
