from __future__ import annotations

import copy
import math
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.functions.dtypes import DTYPES, multiply, wide, wrap
from lattice import __main__ as cli
from lattice.operators import catalog, kernels, linalg, memory, spirv, transfer
from lattice.plans import fixtures
from lattice.plans.scheduler import Event, OrderManager, Queue, SequentialOrderManager, Timer, cached_context, cached_queue, default_device, device_seconds, queues_are_compatible, traced

NUMPY = {"i1": np.int8, "i2": np.int16, "i4": np.int32, "i8": np.int64, "u1": np.uint8, "u2": np.uint16, "u4": np.uint32, "u8": np.uint64}


def test_integers_wrap_like_numpy(spark):
    for code, kind in NUMPY.items():
        lo, hi = int(np.iinfo(kind).min), int(np.iinfo(kind).max)
        values = [lo, lo + 1, 0, 1, hi // 3, hi - 1, hi]
        pairs = [(a, b) for a in values for b in values]
        rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({n}, CAST('{a}' AS {DTYPES[code].spark}), CAST('{b}' AS {DTYPES[code].spark}))" for n, (a, b) in enumerate(pairs)) + " AS t(n, a, b)")
        got = rows.select("n", wrap(wide(F.col("a"), code) + wide(F.col("b"), code), code).alias("s"), multiply(F.col("a"), F.col("b"), code).alias("p")).orderBy("n").collect()
        with np.errstate(over="ignore"):
            for r, (a, b) in zip(got, pairs, strict=True):
                x, y = np.array([a], kind), np.array([b], kind)
                assert (int(r["s"]), int(r["p"])) == (int((x + y)[0]), int((x * y)[0])), (code, a, b)


@pytest.mark.parametrize("sizes,local", [([24], [8]), ([4, 6], [2, 3]), ([2, 3, 4], [1, 3, 2]), ([5], None)])
def test_index_space(spark, sizes, local):
    got = kernels.index_space(spark, sizes, local).orderBy("idx").collect()
    for n, r in enumerate(got):
        at = np.unravel_index(n, sizes)
        assert [r[f"i{k}"] for k in range(len(sizes))] == list(at)
        if local:
            groups = [g // lo for g, lo in zip(sizes, local, strict=True)]
            assert r["wg"] == np.ravel_multi_index([i // lo for i, lo in zip(at, local, strict=True)], groups)


def test_ranges_and_arguments_are_checked(spark):
    for bad in ([], [1, 2, 3, 4], [0]):
        with pytest.raises(kernels.InvalidRange):
            kernels.check_range(bad)
    with pytest.raises(ValueError):
        kernels.check_range([4, 4], [2])
    with pytest.raises(kernels.InvalidRange):
        kernels.check_range([10], [3])
    with pytest.raises(TypeError):
        kernels.launch(spark.range(1), lambda x: x, object())
    assert kernels.WorkGroupMemory.of("f4", 8).nbytes == 32 and kernels.LocalAccessor("i8", (2, 3)).shape == (2, 3)
    with pytest.raises(ValueError):
        kernels.LocalAccessor("i8", (1, -1))
    buffer = bytearray(struct.pack("=2i", 4, 5))
    arg = kernels.RawArg(buffer)
    buffer[0] = 9
    assert spark.range(1).select(arg.unpack("=2i", ["a", "b"]).alias("s")).first()["s"].a == 4
    assert kernels.SpecConstant(0, 1) == kernels.SpecConstant(0, 1) and len({kernels.SpecConstant(0, 1), kernels.SpecConstant(0, 1)}) == 1


def test_bundles(spark):
    b = kernels.Bundle()

    @b.kernel
    def twice(x):
        return x * 2

    assert b.has("twice") and not b.has("thrice") and b.num_args("twice") == 1
    with pytest.raises(KeyError):
        b.get("thrice")
    v = kernels.bind(spark.range(3).withColumnRenamed("id", "idx"), a=spark.range(3).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("v")))
    assert [r["c"] for r in kernels.launch(v, b.get("twice"), "a").orderBy("idx").collect()] == [0, 20, 40]


def test_struct_argument_wraps_to_its_type(spark):
    a = F.lit(1)
    for _ in range(3):
        a = wrap(wide(a, "i1") * 4 + 5, "i1")
    assert spark.range(1).select(a.alias("a")).first()["a"] == -87  # 64 * 1 + 105, as a byte


def vector(spark, values):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "idx long, v double")


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    m, x, y = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3)
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(3)], "i long, j long, v double")
    vx, vy = vector(spark, x), vector(spark, y)
    values = lambda df: [r["v"] for r in df.orderBy("idx").collect()]
    assert np.allclose(values(linalg.gemv(matrix, vx)), m @ x)
    assert np.allclose(values(linalg.subtract(vx, vy)), x - y)
    assert np.allclose(values(linalg.axpby(2.0, vx, 1.0, vy)), 2 * x + y) and np.allclose(values(linalg.axpby(2.0, vx, 3.0, vy)), 2 * x + 3 * y)
    assert math.isclose(linalg.dot(vx, vy).first()["s"], x @ y) and math.isclose(linalg.norm_squared(vx).first()["s"], x @ x)
    assert linalg.norm_squared(vx.limit(0)).first()["s"] == 0
    assert [r["row"] for r in linalg.to_lists(matrix).orderBy("i").collect()] == m.tolist()
    totals = linalg.column_totals(spark.createDataFrame([(i, j, v) for i, row in enumerate([(2, 3), (3, 4), (5, 6), (7, 8), (9, 10)]) for j, v in enumerate(row)], "i long, j long, v int"))
    assert {r["j"]: r["total"] for r in totals.collect()} == {0: 26, 1: 31}
    z = spark.sql("SELECT 0L AS idx, named_struct('real', 1D, 'imag', 2D) AS v")
    w = spark.sql("SELECT 0L AS idx, named_struct('real', 3D, 'imag', -1D) AS v")
    r = linalg.dot_complex(z, w).first()
    assert complex(r["real"], r["imag"]) == (1 - 2j) * (3 - 1j) and linalg.norm_squared_complex(z).first()["s"] == 5


def test_conjugate_gradient(spark):
    matrix, b = fixtures.spd_system(spark)
    x, k = linalg.conjugate_gradient(matrix, b)
    assert np.allclose([r["v"] for r in x.orderBy("idx").collect()], fixtures.SOLUTION) and k <= 5
    assert linalg.conjugate_gradient(matrix, linalg.zeros(spark, 5))[1] == 0


def test_memset_and_copy(spark):
    whole = lambda df: [r["v"] for r in df.orderBy("idx").collect()]
    zero = transfer.allocate(spark, 16)
    assert whole(transfer.memset(zero, 0x7F, 4, 16)) == [0x7F] * 4 + [0] * 12
    assert whole(transfer.memset(zero, 1, 0, 16)) == [1] * 16 and whole(transfer.memset(zero, 2, 32, 16)) == [2] * 16
    assert [whole(transfer.memset(transfer.allocate(spark, 1), v, 0, 1))[0] for v in (0xAB, 0, 255, 256, -1, 300)] == [0xAB, 0, 0xFF, 0, 0xFF, 0x2C]
    twice = transfer.memset(transfer.memset(zero, 1, 0, 16), 2, 8, 16)
    assert whole(twice) == [2] * 8 + [1] * 8
    for bad in (2**31, -(2**31) - 1):
        with pytest.raises(OverflowError):
            transfer.memset(zero, bad, 0, 16)
    with pytest.raises(OverflowError):
        transfer.clamp_count(-1, 4)
    with pytest.raises(ValueError):
        transfer.allocate(spark, 0)
    src = spark.range(16).select(F.col("id").alias("idx"), (F.col("id") + 1).cast("smallint").alias("v"))
    assert whole(transfer.copy(zero, src, 3)) == [1, 2, 3] + [0] * 13
    with pytest.raises(ValueError):
        transfer.copy(zero, src, 3, "x9")
    assert whole(transfer.copy_from_host(zero, b"")) == [0] * 16
    data = spark.range(1).select(F.lit(bytearray(b"abcdef")).alias("d"), F.lit(bytearray(b"XYZ")).alias("s"))
    assert bytes(data.select(transfer.memcpy(F.col("d"), F.col("s"), 2).alias("o")).first()["o"]) == b"XYcdef"
    with pytest.raises(Exception, match="beyond a buffer"):
        data.select(transfer.memcpy(F.col("d"), F.col("s"), 4).alias("o")).collect()
    assert bytes(data.select(transfer.memset_bytes(F.col("d"), 0x141, 2).alias("o")).first()["o"]) == b"AAcdef"
    assert [bytes(r["v"]) for r in transfer.fill(spark, b"ab", 2).collect()] == [b"ab", b"ab"]
    with pytest.raises(ValueError):
        transfer.checked_copy_to_host(3, 4)


def test_strided_views(spark):
    at = lambda *a: [r["idx"] for r in transfer.strided_indices(spark, *a).orderBy("pos").collect()]
    assert at((10,), (2,), 8) == list(range(8, 28, 2)) and transfer.span((10,), (2,)) == 19
    assert sorted(at((2, 2), (10, -2), 9)) == [7, 9, 17, 19] and transfer.span((2, 2), (10, -2)) == 13
    assert at((2, 3)) == list(range(6)) and at((0, 3), (3, 1)) == [] and transfer.span((0, 3), (3, 1)) == 0
    good = {"version": 1, "data": (0, True), "shape": (2,), "typestr": "|u1", "strides": None}
    transfer.check_interface(good)
    for bad in ({"version": 2}, {"data": 1}, {"typestr": "|O8"}, {"strides": (1, 1)}):
        with pytest.raises(ValueError):
            transfer.check_interface(good | bad)


def test_device_catalog(spark):
    d = fixtures.devices(spark)
    ids = lambda df: [r["device_id"] for r in df.collect()]
    assert ids(catalog.get_devices(d)) == [10, 11, 12, 13, 14, 16, 17] and ids(catalog.get_devices(d, " CUDA")) == [14]
    assert catalog.num_devices(d, "all", "gpu") == 5 and catalog.has_devices(d, "cpu")
    with pytest.raises(ValueError):
        catalog.get_devices(d, "openkl")
    with pytest.raises(TypeError):
        catalog.get_devices(d, 3)
    assert ids(catalog.select_best(d)) == [13] and ids(catalog.select_best(d, "accelerator")) == [10]
    assert ids(catalog.select_with_aspects(d, "accelerator")) == [] and ids(catalog.select_with_aspects(d, ["fp64"], "gpu")) == [11]
    with pytest.raises(catalog.NoDevice):
        catalog.one(catalog.select_with_aspects(d, ["gpu", "cpu"]))
    with pytest.raises(AttributeError):
        catalog.select_with_aspects(d, ["nope"], known=["gpu"])
    assert catalog.parse_selector("opencl:gpu:1, cpu") == [("opencl", "gpu", 1), ("cpu",)[:0] or (None, "cpu", None)]
    for bad in ("", "gpu:opencl", "x", "opencl:gpu:1:2", "1:gpu"):
        with pytest.raises(ValueError):
            catalog.parse_selector(bad)
    assert ids(catalog.select_by_filter(d, "gpu:2")) == [14] and ids(catalog.select_by_filter(d, "hip,cpu")) == [11]
    assert {r["device_id"]: r["root_id"] for r in catalog.roots(d).collect()}[17] == 13
    assert ids(catalog.sub_devices(d, 13)) == [16]
    rows = {r["device_id"]: r.asDict() for r in d.collect()}
    assert catalog.peer_error(rows[11], rows[14]) == "the backends differ" and "support" in catalog.peer_error(rows[11], rows[12])
    assert catalog.peer_error(rows[14], rows[14]) and catalog.peer_error(rows[14], rows[15]) is None
    subs = catalog.create_sub_devices(d, 5).where("device_id = 12").collect()
    assert [r["compute_units"] for r in subs] == [5] * 4
    for bad in (0, [], [1, 0], "core"):
        with pytest.raises(ValueError):
            catalog.create_sub_devices(d, bad)
    with pytest.raises(NotImplementedError):
        catalog.create_sub_devices(d, "numa")
    with pytest.warns(UserWarning):
        assert catalog.platform_listing(fixtures.platforms(spark), d, 7).columns == ["platform_id", "platform_name"]
    assert catalog.platform_listing(fixtures.platforms(spark), d, 2).count() == 9
    assert catalog.info({"a": 1, "b": None}) == {"a": 1}


def module(*instructions):
    words = [spirv.MAGIC, 0x10000, 0, 100, 0]
    for op, *args in instructions:
        words += [(len(args) + 1) << 16 | op, *args]
    return struct.pack(f"={len(words)}I", *words)


def test_spirv(spark):
    half = struct.unpack("=I", struct.pack("=f", 4.0))[0]
    data = module(
        (spirv.DECORATE, 11, spirv.SPEC_ID, 1), (spirv.DECORATE, 10, spirv.SPEC_ID, 0), (spirv.DECORATE, 12, spirv.SPEC_ID, 2), (spirv.DECORATE, 13, spirv.SPEC_ID, 0),
        (spirv.NAME, 11, *struct.unpack("=2I", b"scale\0\0\0")), (spirv.TYPE_INT, 1, 32, 0), (spirv.TYPE_FLOAT, 2, 32), (spirv.TYPE_BOOL, 3),
        (spirv.SPEC_CONSTANT, 1, 10, 1), (spirv.SPEC_CONSTANT, 2, 11, half), (spirv.SPEC_FALSE, 3, 12), (spirv.FUNCTION, 1, 1, 1, 1), (spirv.NAME, 10, 0x61),
    )
    want = [(0, "u4", "unnamed_spec_const_0", 4, "1"), (1, "f4", "scale", 4, "4.0"), (2, "?", "unnamed_spec_const_2", 1, "False")]
    df = spark.createDataFrame([("m", bytearray(data))], "path string, content binary")
    assert [tuple(r)[1:] for r in spirv.parse_modules(df).orderBy("spec_id").collect()] == want
    odd = module((spirv.DECORATE, 10, spirv.SPEC_ID, 5), (spirv.DECORATE, 11, spirv.SPEC_ID, 6), (spirv.TYPE_INT, 1, 48, 0), (spirv.SPEC_CONSTANT, 1, 11, 1, 2))
    assert [tuple(r.values()) for r in spirv.specializations(odd)] == [(5, "unknown_type", "unnamed_spec_const_5", 0, None), (6, "u6", "unnamed_spec_const_6", 6, None)]
    for bad in (module((spirv.NAME, 3, 0xFFFFFFFF)), module((spirv.TYPE_INT, 1, 32)), module((spirv.DECORATE, 1, spirv.SPEC_ID)), module((spirv.SPEC_CONSTANT, 1, 2))):
        with pytest.raises(ValueError):
            spirv.specializations(bad)
    for bad in (b"", data[:-2], b"\0" * 24, module((spirv.NAME,))[:-4] + struct.pack("=I", 5), module() + struct.pack("=I", 4 << 16 | 5)):
        with pytest.raises(ValueError):
            spirv.specializations(bad)


def test_queues_and_events(spark):
    q = Queue(spark, "in_order")
    done = []
    a = q.submit_async(lambda: (time.sleep(0.2), done.append("a")))
    b = q.submit_async(lambda: done.append("b"), [a])
    assert b.get_wait_list() == [a] and a.execution_status in ("submitted", "running")
    q.submit_barrier().wait()
    assert done == ["a", "b"] and b.execution_status == "complete" and Event().execution_status == "complete"
    assert q.submit(lambda: spark.range(10).count()).wait() == 10
    for bad in (3, [3], "x"):
        with pytest.raises(TypeError):
            Event.wait_for(bad)
    with pytest.raises(TypeError):
        q.submit_async(lambda: None, [3])
    with pytest.raises(ValueError):
        Queue(spark, "fast")
    with pytest.raises(RuntimeError):
        a.profiling_info()
    assert cached_queue(spark) is cached_queue(spark) and cached_queue(spark, "gpu") is not cached_queue(spark)
    assert queues_are_compatible(q, cached_queue(spark)) and q != Queue(spark)
    p = Queue(spark, ["enable_profiling"])
    timer = Timer(scale=1000)
    for _ in range(3):
        with timer(p):
            p.submit_async(lambda: time.sleep(0.02))
    host, device = timer.dt
    assert host > 0 and device >= 50
    with pytest.raises(ValueError), timer(q):
        pass
    with pytest.raises(TypeError), timer("q"):
        pass
    with pytest.raises(ValueError):
        Timer(device_timer="clock")
    assert math.isclose(device_seconds(timer.recorded(spark)).first()["seconds"] * 1000, device, abs_tol=1e-3)


def test_barriers_fence_and_managers_time(spark):
    for kind in ((), "in_order"):
        q = Queue(spark, kind)
        order = []
        for k in range(20):
            q.submit_async(lambda k=k: (time.sleep(0.01), order.append(k)))
        barrier = q.submit_barrier()
        late = [q.submit_async(lambda: order.append(barrier.execution_status)) for _ in range(20)]
        q.wait()
        assert sorted(order[:20]) == list(range(20)) and order[20:] == ["complete"] * 20 and all(e.execution_status == "complete" for e in late)
    # A barrier after one event waits for that one only, and fences what is submitted later.
    q = Queue(spark, threads=2)
    gate, seen = threading.Event(), []
    a, slow = q.submit_async(lambda: seen.append("a")), q.submit_async(gate.wait)
    q.submit_barrier([a]).wait()
    q.submit_async(lambda: seen.append("b")).wait()
    assert seen == ["a", "b"] and slow.execution_status != "complete"
    gate.set()
    with pytest.raises(ZeroDivisionError):
        q.submit_async(lambda: 1 / 0).wait()
    p = Queue(spark, "enable_profiling")
    managers = SequentialOrderManager()
    timer = Timer(device_timer="order_manager", managers=managers)
    with timer(p):
        for _ in range(3):
            e = p.submit_async(lambda: time.sleep(0.02), managers[p].submitted_events)
            managers[p].add_event_pair(e, e)
    assert timer.dt[1] >= 0.055


def test_arguments_reach_the_kernel(spark):
    df = spark.range(8).select(F.col("id").alias("idx"), F.expr("id div 4").alias("wg"))
    arg = kernels.RawArg(struct.pack("=if", 3, 0.5), "=if", ["k", "s"])
    assert [r["c"] for r in kernels.launch(df, lambda i, p: i * p["k"] + p["s"], "idx", arg).orderBy("idx").collect()] == [3 * i + 0.5 for i in range(8)]
    turned = kernels.launch(df, lambda i, m: m.filled(i, 3 - i % 4)[(i % 4).cast("int")], "idx", kernels.LocalAccessor("i8", (4,)))
    assert [r["c"] for r in turned.orderBy("idx").collect()] == [3, 2, 1, 0, 7, 6, 5, 4]
    value = spark.range(1).select(kernels.SpecConstant(0, 1 + 2j, "f8").column().alias("z"), kernels.SpecConstant(1, b"ab").column().alias("b")).first()
    assert (value["z"]["real"], value["z"]["imag"], bytes(value["b"])) == (1.0, 2.0, b"ab")
    with pytest.raises(ValueError):
        kernels.SpecConstant(0, b"")
    assert kernels.Bundle.can_compile("column") and not kernels.Bundle.can_compile("opencl")
    with pytest.raises(ValueError):
        linalg.reduced(F.lit(1), 0)
    with pytest.raises(ValueError):
        linalg.gemv(fixtures.spd_system(spark)[0], linalg.zeros(spark, 5), 4)
    with pytest.raises(OverflowError):
        transfer.copy(linalg.zeros(spark, 3), linalg.zeros(spark, 3), -1)


def test_order_managers(spark):
    q = Queue(spark)
    managers = SequentialOrderManager()
    m = managers[q]
    assert m is managers[q] and isinstance(m, OrderManager)
    with pytest.raises(TypeError):
        managers["q"]
    slow = q.submit_async(lambda: time.sleep(0.3))
    m.add_event_pair(Event(), slow)
    assert m.num_submitted_events == 1 and m.num_host_task_events == 1 and m.submitted_events == [slow] and m.host_task_events == []
    assert copy.copy(m).num_submitted_events == 1
    m.wait()
    assert m.num_submitted_events == 1 and m.submitted_events == []
    managers.clear()
    with traced("LATTICE_TEST"):
        import os

        assert os.environ["LATTICE_TEST"] == "1"
    assert "LATTICE_TEST" not in os.environ


def test_contexts_and_queues_on_devices(spark):
    d = fixtures.devices(spark)
    for bad in ([], "gpu", [None]):
        with pytest.raises(TypeError):
            memory.Context.of(spark, bad)
    c = memory.Context.of(spark, [13, 14])
    assert c == memory.Context.of(spark, [13, 14]) and c.get_devices() == [13, 14] and c.device_count == 2
    assert cached_context(spark, (13, 14)) is cached_context(spark, (13, 14)) and default_device(d) == 13
    assert Queue.select(spark, d, "opencl:cpu").device == 11 and Queue.select(spark, d, properties="in_order").is_in_order
    assert Queue(spark, context=c).device == 13 and Queue(spark, device=14).context == memory.Context.of(spark, 14)
    with pytest.raises(ValueError):
        Queue(spark, device=11, context=c)
    assert queues_are_compatible(Queue(spark, context=c), Queue(spark, device=14, context=c)) and not queues_are_compatible(Queue(spark, context=c), Queue(spark, device=11))


def test_allocations(spark, tmp_path):
    c, other = memory.Context.of(spark, 13), memory.Context.of(spark, 11)
    a = memory.copy_from_host(memory.allocate(spark, 8, "shared", c), b"abcd")
    assert a.usm_type() == a.usm_type(c) == "shared" and a.usm_type(other) == "unknown"
    assert memory.copy_to_host(a) == b"abcd\0\0\0\0" == bytes(memory.buffer(a))
    memory.save(a, str(tmp_path / "a"))
    back = memory.load(spark, str(tmp_path / "a"), other)
    assert memory.copy_to_host(back) == b"abcd\0\0\0\0" and (back.kind, back.nbytes, back.device) == ("shared", 8, 11)
    spark.sql("SELECT 0L AS idx, 1 AS v, 'odd' AS kind, 'u1' AS code").write.parquet(str(tmp_path / "b"))
    big = memory.copy_from_device(memory.allocate(spark, 10, "device", other), a)
    assert memory.copy_to_host(big) == b"abcd" + b"\0" * 6
    for bad in (lambda: memory.load(spark, str(tmp_path / "b"), c), lambda: memory.allocate(spark, 8, "odd", c), lambda: memory.copy_from_device(a, big), lambda: memory.copy_from_host(a, b"x" * 9), lambda: memory.allocate(spark, 0, "host", c)):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: memory.buffer(big), lambda: memory.copy_to_host(memory.allocate(spark, 8, "host", c, "i4"))):
        with pytest.raises(TypeError):
            bad()
    q = Queue(spark)
    made = q.transfer_async(transfer.memset, a.vector, 1, 0, 8, depends_on=[q.submit_async(lambda: None)]).wait()
    assert [r["v"] for r in made.collect()] == [1] * 8
    q.release(made)


def test_listing(spark, capsys):
    assert [cli.listing(spark, v).count() for v in (0, 1, 2)] == [6, 6, 9]
    cli.main(["-s"])
    assert "platform f" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["-s", "-l"])


def test_device_properties(spark):
    p, d = fixtures.properties(spark), fixtures.devices(spark)
    assert {r["device_id"]: r["value"] for r in catalog.device_property(p, "sub_group_sizes").collect()}[14] == [32]
    assert {r["device_id"]: (r["sizes"], r["total"]) for r in catalog.max_work_items(p, 3).collect()}[14] == ([1024, 1024, 64], 1024)
    assert catalog.fitting(d, p, 65536, 512).first()["device_id"] == 13
    for bad in ("device_id", "speed"):
        with pytest.raises(AttributeError):
            catalog.device_property(p, bad)
    with pytest.raises(ValueError):
        catalog.max_work_items(p, 4)
