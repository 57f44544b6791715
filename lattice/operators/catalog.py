"""Device catalogs: filters, selection, ordinals, hierarchy and partitions over a ``devices`` frame.

Columns used: device_id, platform_id, parent_id, backend, device_type, enum_order, score, compute_units, aspects.
An unknown backend or type raises; ordinals and lists go over devices with a score of zero or more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BACKENDS = ("cuda", "hip", "level_zero", "opencl")
TYPES = ("accelerator", "cpu", "gpu")
AFFINITIES = ("numa", "L4_cache", "L3_cache", "L2_cache", "L1_cache", "next_partitionable", "not_applicable")
#: Backends whose devices can reach each other's memory.
PEERS = ("cuda", "hip", "level_zero")


class NoDevice(LookupError):
    """No device of the catalog meets the request."""


def _known(name: str, names: Sequence[str]) -> str | None:
    if not isinstance(name, str):
        raise TypeError(f"expected a name, got {type(name).__name__}")
    low = name.strip().lower()
    if low == "all":
        return None
    if low not in names:
        raise ValueError(f"unknown name {name!r}; expected all, {', '.join(names)}")
    return low


def get_devices(devices: DataFrame, backend: str = "all", device_type: str = "all") -> DataFrame:
    b, t = _known(backend, BACKENDS), _known(device_type, TYPES)
    out = devices.where("score >= 0")
    out = out.where(F.col("backend") == b) if b else out
    out = out.where(F.col("device_type") == t) if t else out
    return out.orderBy("enum_order")


def num_devices(devices: DataFrame, backend: str = "all", device_type: str = "all") -> int:
    return get_devices(devices, backend, device_type).count()


def has_devices(devices: DataFrame, device_type: str) -> bool:
    return not get_devices(devices, "all", device_type).isEmpty()


def select_best(devices: DataFrame, device_type: str = "all") -> DataFrame:
    """The device with the highest score that isn't negative."""
    return get_devices(devices, "all", device_type).orderBy(F.col("score").desc(), "enum_order").limit(1)


def select_with_aspects(devices: DataFrame, required: Sequence[str] = (), excluded: Sequence[str] = (), known: Sequence[str] | None = None) -> DataFrame:
    """The first device of the highest score above zero with all required and no excluded aspects."""
    required, excluded = ([x] if isinstance(x, str) else list(x) for x in (required, excluded))
    if known is not None and (odd := [a for a in (*required, *excluded) if a not in known]):
        raise AttributeError(f"unknown aspects: {', '.join(odd)}")
    fits = F.col("score") > 0
    for a in required:
        fits = fits & F.array_contains("aspects", a)
    for a in excluded:
        fits = fits & ~F.array_contains("aspects", a)
    return devices.where(fits).orderBy(F.col("score").desc(), "enum_order").limit(1)


def one(selected: DataFrame) -> dict:
    """The selected row; raises where there is none."""
    row = selected.first()
    if row is None:
        raise NoDevice("no device meets the request")
    return row.asDict()


def parse_selector(text: str) -> list[tuple[str | None, str | None, int | None]]:
    """``backend:type:number`` alternatives, separated by commas; each part is optional, one at least is needed."""
    out = []
    for part in text.split(","):
        found: list = [None, None, None]
        fields = [x.strip().lower() for x in part.split(":")]
        if not part.strip() or len(fields) > 3:
            raise ValueError(f"bad selector {part!r}")
        place = -1
        for f in fields:
            now = 0 if f in BACKENDS else 1 if f in TYPES else 2 if f.isdigit() else -1
            if now <= place:
                raise ValueError(f"bad selector {part!r}")
            found[now], place = int(f) if now == 2 else f, now
        out.append(tuple(found))
    return out


def select_by_filter(devices: DataFrame, text: str) -> DataFrame:
    """The best device of the first alternative that matches any; numbers count from 0 among matches."""
    choices = None
    for k, (b, t, n) in enumerate(parse_selector(text)):
        found = get_devices(devices, b or "all", t or "all").withColumn("nth", F.row_number().over(Window.orderBy("enum_order")) - 1)
        found = (found if n is None else found.where(F.col("nth") == n)).drop("nth").withColumn("choice", F.lit(k))
        choices = found if choices is None else choices.unionByName(found)
    return choices.orderBy("choice", F.col("score").desc(), "enum_order").limit(1).drop("choice")


def ordinals(devices: DataFrame) -> DataFrame:
    """``devices`` with each one's position among all, of its backend, of its type, and of both, and its filter string."""
    nth = lambda *by: (F.row_number().over(Window.partitionBy(*by).orderBy("enum_order")) - 1).cast("bigint")
    out = devices.where("score >= 0").withColumns({"n": nth(F.lit(1)), "n_backend": nth("backend"), "n_type": nth("device_type"), "n_both": nth("backend", "device_type")})
    return out.withColumn("filter_string", F.concat_ws(":", "backend", "device_type", F.col("n_both").cast("string")))


def roots(devices: DataFrame) -> DataFrame:
    """(device_id, root_id, depth): parents are followed until there is none."""
    return devices.sparkSession.sql(
        """WITH RECURSIVE up(device_id, at, depth) AS (
             SELECT device_id, device_id, 0 FROM {devices}
             UNION ALL
             SELECT up.device_id, d.parent_id, up.depth + 1 FROM up JOIN {devices} d ON d.device_id = up.at WHERE d.parent_id IS NOT NULL)
           SELECT device_id, max_by(at, depth) AS root_id, max(depth) AS depth FROM up GROUP BY device_id""",
        devices=devices,
    )


def device_numbers(devices: DataFrame) -> DataFrame:
    """(device_id, number): a device's position among the listed ones without a parent; a sub-device has its root's."""
    listed = devices.where("score >= 0 AND parent_id IS NULL").select(F.col("device_id").alias("root_id"), (F.row_number().over(Window.orderBy("enum_order")) - 1).cast("bigint").alias("number"))
    return roots(devices).join(listed, "root_id").select("device_id", "number")


def composites(devices: DataFrame) -> DataFrame:
    """(device_id, component_ids): the devices that others are parts of, with their direct parts in order."""
    parts = devices.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("device_id"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("enum_order", "device_id"))), lambda x: x["device_id"]).alias("component_ids"))


def device_property(properties: DataFrame, name: str) -> DataFrame:
    """(device_id, value) of a property: scalar, or a list for sizes by dimension and for sub-groups."""
    if name not in properties.columns or name == "device_id":
        raise AttributeError(f"unknown property {name!r}")
    return properties.select("device_id", F.col(name).alias("value"))


def max_work_items(properties: DataFrame, dims: int) -> DataFrame:
    """(device_id, sizes, total): the largest range of ``dims`` dimensions that a work-group can have."""
    if dims not in (1, 2, 3):
        raise ValueError("a range has one to three dimensions")
    sizes = F.slice("max_work_item_sizes", 1, dims)
    total = F.least(F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, x: a * x), F.col("max_work_group_size").cast("bigint"))
    return properties.select("device_id", sizes.alias("sizes"), total.alias("total"))


def fitting(devices: DataFrame, properties: DataFrame, local_bytes: int, group: int) -> DataFrame:
    """The listed devices on which a kernel with so much local memory and such a work-group runs, the best first."""
    able = properties.where((F.col("local_mem_size") >= local_bytes) & (F.col("max_work_group_size") >= group)).select("device_id")
    return devices.where("score >= 0").join(able, "device_id", "left_semi").orderBy(F.col("score").desc(), "enum_order")


def has_aspect(devices: DataFrame, aspect: str) -> DataFrame:
    """(device_id, has)."""
    return devices.select("device_id", F.array_contains("aspects", aspect).alias("has"))


def sub_devices(devices: DataFrame, parent: int) -> DataFrame:
    return devices.where(F.col("parent_id") == parent).orderBy("enum_order")


def peer_pairs(devices: DataFrame) -> DataFrame:
    """(device_id, peer_id) that can reach each other: an equi-join on a peer backend, different devices."""
    left = devices.where(F.col("backend").isin(*PEERS)).select("backend", "device_id")
    return left.join(left.withColumnRenamed("device_id", "peer_id"), "backend").where("device_id <> peer_id").select("device_id", "peer_id")


def peer_error(a: dict, b: dict) -> str | None:
    """Why two devices can't be peers: backends differ, then an unsupported backend, then one device."""
    if a["backend"] != b["backend"]:
        return "the backends differ"
    if a["backend"] not in PEERS:
        return "the backend does not support peer access"
    return "a device is not its own peer" if a["device_id"] == b["device_id"] else None


def platform_listing(platforms: DataFrame, devices: DataFrame, verbosity: int = 1) -> DataFrame:
    """A row for each platform; 1 adds vendor, backend and the count, 2 a row for each device."""
    if verbosity not in (0, 1, 2):
        import warnings

        warnings.warn("verbosity must be 0, 1 or 2; 0 is used", stacklevel=2)
        verbosity = 0
    if verbosity == 0:
        return platforms.select("platform_id", "platform_name").orderBy("platform_id")
    if verbosity == 1:
        counts = devices.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n_devices"))
        return platforms.join(counts, "platform_id", "left").withColumn("n_devices", F.coalesce("n_devices", F.lit(0).cast("bigint"))).orderBy("platform_id")
    return platforms.join(devices.drop("backend"), "platform_id", "left").orderBy("platform_id", "enum_order")


def partition_equally(devices: DataFrame, count: int) -> DataFrame:
    """(device_id, sub, compute_units): as many sub-devices of ``count`` units as fit; the remainder is dropped."""
    if count == 0:
        raise ValueError("count must be positive")
    subs = F.expr(f"compute_units div {count}")
    return devices.where(subs > 0).select("device_id", F.explode(F.sequence(F.lit(0).cast("bigint"), subs - 1)).alias("sub"), F.lit(count).alias("compute_units"))


def partition_by_counts(devices: DataFrame, counts: Sequence[int]) -> DataFrame:
    """One sub-device for each count; zeros are rejected.  A device with fewer units in all has one row with nulls, as it can't be cut."""
    if not counts or any(c <= 0 for c in counts):
        raise ValueError("counts must be positive")
    fits = F.col("compute_units") >= sum(counts)
    devices = devices.select("device_id", F.when(fits, F.array(*[F.lit(int(c)) for c in counts])).alias("cut"))
    return devices.select("device_id", F.posexplode_outer("cut").alias("sub", "compute_units"))


def create_sub_devices(devices: DataFrame, partition: int | str | Sequence[int]) -> DataFrame:
    if isinstance(partition, str):
        if partition not in AFFINITIES:
            raise ValueError(f"unknown affinity domain {partition!r}")
        raise NotImplementedError("affinity domains are hardware topology, which a catalog doesn't have")
    if isinstance(partition, int):
        if partition < 0:
            raise TypeError("a count must not be negative")
        return partition_equally(devices, partition)
    return partition_by_counts(devices, list(partition)) if hasattr(partition, "__len__") else partition_equally(devices, int(partition))


def info(props: dict) -> dict:
    """Device information without what isn't supported."""
    return {k: v for k, v in props.items() if v is not None}
