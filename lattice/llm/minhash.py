"""Document fingerprints by MinHash.

A word is a stretch without white space, A-Z lower-cased; a shingle is ``SHINGLE`` of them in a row (of a shorter
text, all of it).  Words are hashed in numpy over the bytes of many texts at once (a polynomial over random values of the bytes);
shingle hashes go through ``SLOTS`` members of a universal family (x -> a*x + b modulo 2^64, top 32 bits), and each slot keeps the
least.  The share of equal slots estimates the Jaccard similarity.

``cluster`` joins signature bands in Spark.  ``banding`` picks the longest bands that still find a pair at the threshold with
probability ``RECALL``.  Equal texts are one node.  A bucket of up to ``HOT`` different texts is searched in memory: what shares too few of its
shingles with all the others is out at once, the rest is compared unless it is connected already, and the links of a spanning tree go
out, never pairs.  Larger buckets are searched in rounds of joins with a few hubs, which Spark can split.  The Jaccard similarity of
whatever is compared is exact, on the sets of 64-bit shingle hashes.

Defined cases: null text is empty; an empty text has no shingles, all slots at their maximum, and equals only texts
without words; in ``successors`` rows go by doc_id (null first), rows of one doc_id by a hash of the text, and the last is followed by
the first (one row: by itself); an empty table gives an empty result; a text of any length is hashed in pieces of ``PIECE``
bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.llm._shared import buckets, discard, written
from lattice.llm.components import components

SHINGLE, SLOTS, SIMILAR = 5, 64, 0.8
#: A pair at the threshold meets in a band at least with this probability.
RECALL = 0.99
#: Shingles hashed at once; characters of texts hashed together; bytes of one text whose words are hashed together.
STEP, BLOCK, PIECE = 2048, 1 << 17, 1 << 20
#: Members, and shingles of all of them, of a bucket that is searched in memory.
HOT, HOT_SHINGLES = 4096, 1 << 20
#: Hubs with which the members of a larger bucket are compared in the first round, and the growth of their number.
HUBS, GROWTH = 2, 4
_RNG = np.random.default_rng(6)
_A = _RNG.integers(0, 2**63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SLOTS, np.uint64)
_MIX = _RNG.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
#: Values of the bytes, capitals as small letters; white space; the base of the polynomial and its inverse modulo 2^64.
_BYTES = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = int(_RNG.integers(0, 2**62)) * 4 + 3


class _Powers:
    """Powers of the base and of its inverse, as far as a text has asked for them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                x = np.full(max(n, BLOCK), base, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end between words."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and _INSIDE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _INSIDE[values]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.r_[0, turns] if inside[0] else turns
    turns = np.r_[turns, len(values)] if inside[-1] else turns
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(len(values))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[values] * up, dtype=np.uint64)]
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return starts, h ^ (h >> np.uint64(29))


def shingled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, repeats included; and how many each text has."""
    bodies = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    if len(bodies) == 1 and lengths[0] > PIECE:
        h = np.concatenate([_hashed(p)[1] for p in _pieces(bodies[0])])
        own = np.array([len(h)])
    else:
        starts, h = _hashed(b" ".join(bodies))
        own = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(lengths + 1)]))
    filled = np.where(own > 0, np.maximum(own, SHINGLE), 0)  # a text with fewer words has one shingle
    counts = np.where(own > 0, filled - SHINGLE + 1, 0)
    if not len(h):
        return np.zeros(0, np.uint64), counts
    if (filled != own).any():
        wide = np.zeros(filled.sum(), np.uint64)
        wide[np.arange(len(h)) + np.repeat(np.cumsum(filled - own) - (filled - own), own)] = h
        h = wide
    x = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        x += h[k : k + len(x)] * _MIX[k]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    if len(counts) > 1:  # without the stretches across two texts
        some = counts[counts > 0]
        x = x[np.arange(some.sum()) + np.repeat(np.arange(len(some)) * (SHINGLE - 1), some)]
    return x, counts


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    return shingled([text])[0]


def signature(text: str | None) -> np.ndarray:
    """SLOTS 32-bit minima."""
    x = shingles(text)
    if not len(x):
        return _EMPTY
    least = np.full(SLOTS, 2**64 - 1, np.uint64)
    for k in range(0, len(x), STEP):
        np.minimum(least, (x[k : k + STEP, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(texts: Iterable[str | None]) -> np.ndarray:
    """A row for each text, as ``signature`` has it; about ``BLOCK`` characters go through the slots together."""
    out = [np.zeros((0, SLOTS), np.uint32)]
    held: list[str | None] = []

    def flush() -> None:
        x, sizes = shingled(held)
        rows = np.tile(_EMPTY, (len(held), 1))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            for k in range(SLOTS):
                rows[full, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts) >> np.uint64(32)
        out.append(rows)

    n = 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= BLOCK:
            flush()
            held, n = [], 0
    flush()
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def jaccard(a: str | None, b: str | None) -> float:
    """Exact similarity of two texts' sets of shingles; 1 for two without words."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _cuts(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ord, key) of about ``n`` rows that start a bucket, in order, the first row of all among them.

    Quantiles of ord; an ord that fills several of them is cut anew by quantiles of its keys, so no bucket is bound to one ord.
    """
    none = np.zeros(0, np.int64)
    seen = rows.agg(F.percentile_approx("ord", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts"), F.min("ord").alias("first")).first()
    if seen["first"] is None:
        return none, none
    spark = rows.sparkSession
    asked = Counter([*(seen["cuts"] or []), seen["first"]])
    wanted = spark.createDataFrame([(o, m) for o, m in asked.items()], "of long, m int")  # n rows at most
    found = rows.join(F.broadcast(wanted), F.col("ord") == F.col("of")).groupBy("ord", "m")
    parts = found.agg(F.min("key").alias("least"), F.percentile_approx("key", [k / 64 for k in range(1, 64)], 1000).alias("keys")).collect()
    cuts = sorted({(r["ord"], x) for r in parts for x in [r["least"], *(r["keys"][63 * j // r["m"]] for j in range(1, r["m"]))]})
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def successors(docs: DataFrame) -> DataFrame:
    """(bucket, tail, ord, key, doc_id, text), dealt and sorted so that each row's successor in the table follows it.

    Cut points are rows of the table, so a bucket starts with its cut's row; that row also closes the bucket before
    as its ``tail``, and the first row of all closes the last bucket.  Only a bucket number is shuffled with each text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("key", F.shiftright(F.xxhash64("text"), 12))  # quantiles are exact up to 2^53
    ords, keys = _cuts(rows, buckets(docs.sparkSession))

    @F.pandas_udf("array<int>")
    def deal(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own, key = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        low, high = np.searchsorted(ords, own, side="left"), np.searchsorted(ords, own, side="right")
        to, starts = high - 1, np.zeros(len(own), bool)
        for k in np.flatnonzero(low < high).tolist():
            at = low[k] + np.searchsorted(keys[low[k] : high[k]], key[k], side="right") - 1
            to[k], starts[k] = at, at >= low[k] and keys[at] == key[k]
        return pd.Series([[b, (b - 1) % len(ords)] if s else [b] for b, s in zip(to.tolist(), starts.tolist(), strict=True)])

    dealt = rows.select("*", F.posexplode(deal("ord", "key")).alias("tail", "bucket"))
    return dealt.select("bucket", "tail", "ord", "key", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "tail", "ord", "key", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, and that of the text whose last half is replaced by the start of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for bucket, tail, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if held is None and tail:
                    continue
                text = text.as_py()
                sig = signature(text)
                if held is not None:
                    assert held[0] == bucket, "a bucket without its tail"
                    _, before, body, own = held
                    half = len(body) // 2
                    edited = body[: len(body) - half] + text[:half]
                    changed = signature(edited)
                    out.append((before, len(body), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, sig)))
                held = None if tail else (bucket, doc_id, text, sig)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return successors(docs).drop("ord", "key").mapInArrow(run, schema)


def banding(slots: int = SLOTS, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bands, slots of each): the longest bands, so the fewest chance meetings, with which a pair at ``similar`` meets with ``recall``."""
    fits = [(slots // r, r) for r in range(1, slots + 1) if 1 - (1 - similar**r) ** (slots // r) >= recall]
    return max(fits, key=lambda x: x[1], default=(slots, 1))


def keyed(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, byte by byte."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")


def _signed(texts: DataFrame, similar: float) -> DataFrame:
    """(k1, k2, bands): the band hashes of each row."""
    bands, width = banding(similar=similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch.column(2).to_pylist())[:, : bands * width]
            h = np.zeros((len(sig), bands), np.uint64)
            for k in range(width):
                h = (h ^ sig[:, k::width]) * _A[k]
                h ^= h >> np.uint64(32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k1", "k2", "bands"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, bands array<long>")


def _with_shingles(texts: DataFrame) -> DataFrame:
    """(k1, k2, s): each row's set of shingle hashes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t)).view(np.int64) for t in batch.column(2).to_pylist()]
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k1", "k2", "s"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, s array<long>")


def _alike(pairs: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts' exact similarity is ``similar`` or more, as links (u, v)."""
    left = bodies.select(F.col("id").alias("a"), F.col("s").alias("x"))
    right = bodies.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.where(F.col("n") >= similar * (F.col("all") - F.col("n"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def bucket_links(ids: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that connect whatever is similar among the members of a bucket: a spanning tree of each group, never its pairs."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(member, weights=counts[inverse] > 1, minlength=len(sets))
    some = np.flatnonzero((sizes > 0) & (shared >= similar * sizes))  # the others share too little with all the rest
    if len(some) < 2:
        return []
    keep = np.zeros(len(sets), bool)
    keep[some] = True
    flat, sizes, ids, roots = inverse[keep[member]], sizes[some], ids[some], np.arange(len(some))
    starts = np.cumsum(sizes) - sizes
    has = np.zeros(len(counts), np.int64)
    out: list[tuple[int, int]] = []
    for i in range(len(some) - 1):
        later = roots[i + 1 :] != roots[i]
        if not later.any():
            if (roots == roots[0]).all():
                break
            continue
        has[flat[starts[i] : starts[i] + sizes[i]]] = 1
        both = np.add.reduceat(has[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        has[flat[starts[i] : starts[i] + sizes[i]]] = 0
        near = np.flatnonzero(later & (both >= similar * (sizes[i] + sizes[i + 1 :] - both))) + i + 1
        for j in near.tolist():
            if roots[j] != roots[i]:
                out.append((int(ids[i]), int(ids[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def _search(similar: float):
    """Rows (bucket, id, s) sorted by bucket, to links (u, v)."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        return bucket_links(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], similar) if len(rows) > 1 else []

    def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            s = batch.column(2)
            values, ends = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
            out = []
            for k, (b, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if b != bucket:
                    out += links(held)
                    held, bucket = [], b
                held.append((i, values[ends[k] : ends[k + 1]]))
            yield made(out)
        yield made(links(held))

    return run


def _in_rounds(members: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """Links between members (bucket, id, root) of buckets of any size.

    Members that share less than ``similar`` of their shingles with all others of the bucket leave at once.  Of the rest the first few
    are compared with the later ones that aren't connected to them yet, and are then done with; their number grows with each round.
    """
    flat = members.join(bodies.select("id", "s"), "id").select("bucket", "id", F.explode("s").alias("x"))
    shared = flat.groupBy("bucket", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "x")
    counted = flat.join(shared, ["bucket", "x"]).groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n"))
    reach = counted.join(bodies.select("id", F.size("s").alias("size")), "id").where(F.col("n") >= similar * F.col("size"))
    members = written(members.join(reach.select("bucket", "id"), ["bucket", "id"]), "reach")
    links, hubs = None, HUBS
    while not members.isEmpty():
        ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))
        first = ranked.where(F.col("rank") <= hubs).select("bucket", F.col("id").alias("a"), F.col("root").alias("a_root"))
        pairs = first.join(members.withColumnRenamed("id", "b"), "bucket").where("a < b AND a_root <> root").select("a", "b").distinct()
        found = written(_alike(pairs, bodies, similar), "alike")
        links = found if links is None else links.unionByName(found)
        # What was connected before goes on being so through the old roots.
        known = links.unionByName(members.select(F.col("root").alias("u"), F.col("id").alias("v")).where("u <> v"))
        roots = components(known)
        left = ranked.where(F.col("rank") > hubs).select("bucket", "id").join(roots, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("root"))
        mixed = left.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        after = written(left.join(mixed, "bucket", "left_semi"), "members")
        discard(members)
        members, hubs = after, GROWTH * hubs
    return links


def cluster(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(k1, k2, c1, c2): of rows ``texts`` (k1, k2, text), see ``keyed``, the different texts that have a similar one, and the key that
    stands for their component.  Equal texts are one node; a text that is not listed is its own component, as any without words is."""
    signed = _signed(texts, similar)
    nodes = written(signed.groupBy("k1", "k2").agg(F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("k1", "k2", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "k1", "k2")
    # Merge joins by hint: at every size of the corpus the same plan, and one whose large keys Spark can split.
    crowded = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "crowded")
    met = written(banded.join(crowded.hint("merge"), "bucket", "left_semi"), "met")
    discard(nodes, crowded)
    different = texts.select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    bodies = different.join(met.select("k1", "k2").distinct().hint("merge"), ["k1", "k2"], "left_semi")
    bodies = written(_with_shingles(bodies).withColumn("id", F.monotonically_increasing_id()), "bodies")
    members = written(met.join(bodies.select("k1", "k2", "id", F.size("s").alias("size")), ["k1", "k2"]).select("bucket", "id", "size"), "members")
    discard(met)
    sized = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    large = written(sized.where((F.col("n") > HOT) | (F.col("all") > HOT_SHINGLES)).select("bucket"), "large")
    cold = members.join(large, "bucket", "left_anti").select("bucket", "id").join(bodies.select("id", "s"), "id").select("bucket", "id", "s")
    found = alike = written(cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(similar), "u long, v long").distinct(), "alike")
    if not large.isEmpty():
        hot = members.join(large, "bucket", "left_semi").select("bucket", "id", F.col("id").alias("root"))
        if (last := _in_rounds(hot, bodies, similar)) is not None:
            found = found.unionByName(last)
    grouped = components(found)
    of = bodies.select("id", "k1", "k2")
    out = grouped.join(of, "id").join(of.select(F.col("id").alias("component"), F.col("k1").alias("c1"), F.col("k2").alias("c2")), "component")
    out = written(out.select("k1", "k2", "c1", "c2"), "clusters")
    discard(bodies, members, large, alike, grouped)
    return out


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) for each row: the least doc_id of the documents it is linked to by similarity, itself included."""
    text = F.col("text").cast("string")
    text = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))  # texts without words are equal
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *keyed(text))
    found = rows.select("doc_id", "k1", "k2").join(cluster(rows.select("k1", "k2", "text"), similar), ["k1", "k2"], "left")
    found = written(found.select("doc_id", F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2")), "found")
    least = found.groupBy("c1", "c2").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, ["c1", "c2"]).select("doc_id", "component_id")
