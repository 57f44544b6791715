"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints have ``BITS`` bits.  They are cut into b blocks; two that differ in at most ``DISTANCE`` bits agree
on b - DISTANCE blocks at least, so rows that agree on some choice of that many blocks are the only candidates,
and their Hamming distance is checked.  b grows with the number of different fingerprints so that chance
collisions stay rare; every b finds the same links.

Equal fingerprints are one node, so copies are never paired.  A bucket is searched from one node outwards over the
nodes not yet reached, which yields a spanning tree of its links, not all pairs.  A bucket of more than ``HOT`` different
fingerprints never enters memory: its fingerprints are linked through all values within half the distance, which
is exact too and linear in their number.

Defined cases: null or blank text has fingerprint zero, which links like any other; a null doc_id gets a row, and
is only a component's id if no other is there; rows that repeat a doc_id each get a row; an empty table gives an
empty result; a text of any length is hashed ``STEP`` shingles at a time; further columns are ignored by
``near_duplicates`` and pass through ``deduplicated`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import discard, small, written
from lattice.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket that one task compares at most.
HOT = 50_000
#: Shingles that are turned into bits at once.
STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text (UTF-8), as a signed 64-bit number."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, ones, digest = len(starts), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, STEP):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + STEP].tolist(), ends[k : k + STEP].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) for each row; ``key`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(n: int) -> list[int]:
    """Masks, as signed numbers, such that two fingerprints within DISTANCE agree under one of them.

    The fewest blocks whose masks have enough bits for ``n`` different fingerprints.
    """
    for b in range(DISTANCE + 1, BITS + 1):
        edges = [round(k * BITS / b) for k in range(b + 1)]
        blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(blocks, b - DISTANCE)]
        if min(m.bit_count() for m in masks) >= max(1, n).bit_length() or b == DISTANCE + 8:
            return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    raise AssertionError


def bucket_links(group: np.ndarray, fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever is within DISTANCE in each run of equal ``group``."""
    out_u: list[np.ndarray] = []
    out_v: list[np.ndarray] = []
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    few = np.repeat(sizes, sizes) <= 16
    for d in range(1, min(16, int(sizes.max(initial=0)))):
        at = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]))
        at = at[np.bitwise_count((fps[at] ^ fps[at + d]).view(np.uint64)) <= DISTANCE]
        out_u.append(fps[at])
        out_v.append(fps[at + d])
    for k in np.flatnonzero(sizes > 16):
        rest = fps[bounds[k] : bounds[k + 1]]
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                near = np.bitwise_count((rest ^ frontier[-1]).view(np.uint64)) <= DISTANCE
                hub = frontier.pop()
                if near.any():
                    found, rest = rest[near], rest[~near]
                    out_u.append(found)
                    out_v.append(np.full(len(found), hub))
                    frontier.extend(found)
    return out_u, out_v


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by mask and key, to links (u, v); v is null for the members of a hot bucket."""

    def made(u: list[np.ndarray], v: list[np.ndarray] | None) -> pa.RecordBatch:
        left = np.concatenate(u) if u else np.zeros(0, np.int64)
        right = pa.nulls(len(left), pa.int64()) if v is None else pa.array(np.concatenate(v) if v else left)
        return pa.RecordBatch.from_arrays([pa.array(left), right], ["u", "v"])

    held = [np.zeros(0, np.int64)] * 3
    hot: tuple[int, int] | None = None
    for batch in batches:
        mask, key, fp = (np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, h in enumerate(held))
        if not len(fp):
            continue
        if hot is not None:
            same = (mask == hot[0]) & (key == hot[1])
            if same.any():
                yield made([fp[same]], None)
                mask, key, fp = mask[~same], key[~same], fp[~same]
            if not len(fp):
                continue
            hot = None
        group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        last = int(np.searchsorted(group, group[-1]))
        yield made(*bucket_links(group[:last], fp[:last]))
        held = [mask[last:], key[last:], fp[last:]]
        if len(held[0]) > HOT:
            hot = (int(held[0][0]), int(held[1][0]))
            yield made([held[2]], None)
            held = [np.zeros(0, np.int64)] * 3
    if len(held[0]):
        yield made(*bucket_links(np.zeros(len(held[0]), np.int64), held[2]))


def _through_neighbours(fps: DataFrame) -> DataFrame:
    """Links (u, v) between ``fps`` (fp): two within DISTANCE have a value within half of it in common, and vice versa."""
    flips = [0] + [sum(1 << b for b in c) for k in range(1, DISTANCE // 2 + 1) for c in combinations(range(BITS), k)]
    flips = [m - (1 << BITS) if m >> (BITS - 1) else m for m in flips]
    around = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("flip")).select("fp", F.expr("fp ^ flip").alias("value"))
    hubs = around.groupBy("value").agg(F.min("fp").alias("hub"))
    return around.join(hubs, "value").where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, masks: list[int] | None = None) -> DataFrame:
    """Links (u, v) that connect all of the different fingerprints ``fps`` (fp) within DISTANCE."""
    masks = masks or block_masks(fps.count())
    keys = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask", "bits"))
    keys = keys.select(F.col("mask").cast("long").alias("mask"), F.expr("fp & bits").alias("key"), "fp")
    found = written(keys.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_search, "u long, v long"), "simhash-links")
    hot = found.where("v IS NULL").select(F.col("u").alias("fp")).distinct()
    plain = found.where("v IS NOT NULL")
    return plain if hot.isEmpty() else plain.unionByName(_through_neighbours(hot))


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, component_id, first): of each row; ``first`` is the place of the first row of its component."""
    rows = written(fingerprints(docs), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("first")), "nodes")
    found = links(nodes.select("fp"))
    reached = components(found).withColumnRenamed("id", "of")
    rooted = nodes.join(reached, F.col("fp") == F.col("of"), "left").select("fp", "least", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    ids = written(rooted.drop("first").join(least, "root").select(F.col("fp").alias("of"), "component_id", "first"), "components")
    discard(nodes, reached)
    return rows.join(ids, F.col("fp") == F.col("of")).select("doc_id", "key", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    return _placed(docs).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: by doc_id (null last), then by a hash of the text.

    Rows that share the doc_id but not the text are documents of their own; of rows that repeat both, one stays.
    """
    placed = written(_placed(docs).select("doc_id", "key", "first"), "placed")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = written(placed.where(~is_first).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).distinct(), "gone")
    repeated = written(placed.where(is_first).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).count().where("count > 1").drop("count"), "repeated")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    matched = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    kept = packed.join(small(gone), matched, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(small(repeated), matched, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row", "id", "key")
        kept = kept.join(small(repeated), matched, "left_anti").unionByName(once)
    discard(placed)
    return kept.select("row.*")
