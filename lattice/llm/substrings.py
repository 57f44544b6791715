"""Exact removal of repeated substrings: suffix arrays over what can repeat.

Each string of ``LENGTH`` bytes is named by the least hash of the ``GRAM``-byte strings in it, so equal strings have equal names, and
consecutive positions mostly share theirs (a run).  Names bring equal strings together without shipping every suffix:

1. A row's names go to buckets; those of two documents or more are told back to their rows.  Names that repeat within a task's
   unit of texts are sent once for the unit.
2. Runs with a repeated name are shipped, a text that repeats within a unit once; what repeats there is known to be covered.
3. A bucket's different run texts are one string, whose suffixes are sorted by the blockwise difference-cover construction
   (suffixes.py).  In each class of equal prefixes the least doc_id keeps its bytes.
4. The covered bytes return to their rows.

Only buckets of bounded expected size are in memory, as their number follows the bytes of the input; a name or a run that a third of all rows share is combined in each task
before it is sent, and the steps are written tables, so lost executors cost a step's missing tasks.

Defined cases: null text is empty; a text below LENGTH bytes keeps all; a null doc_id counts as the largest; rows of one doc_id
take nothing from each other, each has its own result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import buckets, written
from lattice.llm.suffixes import DEPTH as LENGTH
from lattice.llm.suffixes import equal_prefixes

GRAM = 20
#: Bytes of text after which a task sends what it has gathered.
UNIT = 24 << 20
#: Bytes of text for each bucket at most, on average; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
NO_ID = 2**63 - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each run, name of each run) over the positions at which a string of LENGTH bytes starts."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", buffer=data, strides=(1,))
    h = eight[:grams] * _C[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + grams]
    h *= _C[1]
    h ^= h >> np.uint64(32)
    h += four[16 : 16 + grams]
    h *= _C[2]
    h ^= h >> np.uint64(29)
    h *= _C[3]
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        h = np.minimum(h[: len(h) - reach], h[reach:])
        reach *= 2
    h = np.minimum(h[:n], h[width - reach : width - reach + n])
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return first, h[first]


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each name; names are minima, so they are mixed anew."""
    x = names * _C[0]
    return ((x >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _pack(*arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps([a if isinstance(a, bytes) else np.ascontiguousarray(a) for a in arrays]))


def _unpack(blob: bytes) -> list:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


class _Out:
    """Rows (bucket, kind, ord, body) on their way out."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, bytes]] = []

    def add(self, bucket: int, kind: int, body: bytes) -> None:
        self.rows.append((bucket, kind, body))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "body"]
        )


BLOBS = "bucket int, kind int, body binary"


def _split(out: _Out, kind: int, to: np.ndarray, *columns: np.ndarray) -> None:
    """One blob of ``columns`` for each bucket in ``to``."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    bounds = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else np.zeros(1, int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out.add(int(to[a]), kind, _pack(*[c[order[a:b]] for c in columns]))


def _repeats(group: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """Whether each entry's group has two different ords or more."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    g, o = group[order], ords[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
    out = np.zeros(len(group), bool)
    out[order] = np.repeat(several, np.diff(np.r_[first, len(g)]))
    return out


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, ord, key, body): a row's own bucket, its order and the hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64(text).alias("key"), text.cast("binary").alias("body"))
    return rows.select(F.pmod(F.xxhash64("ord", "key"), F.lit(n)).cast("int").alias("bucket"), "ord", "key", "body")


def _ask(n: int):
    """Step 1, from texts: names to their buckets (kind 0), and runs known to repeat to their rows' buckets (kind 1)."""

    def flush(held: list, out: _Out) -> None:
        if not held:
            return
        counts = [len(names) for *_, names in held]
        ords, keys, homes = (np.repeat(np.array([h[k] for h in held], np.int64), counts) for k in (1, 2, 0))
        names, number = np.concatenate([h[3] for h in held]), np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
        several = _repeats(names, ords)
        _split(out, 1, homes[several], ords[several], keys[several], number[several])
        once = np.flatnonzero(~several)
        again = np.flatnonzero(several)
        if len(again):  # the least and the greatest ord of each name are enough to tell others
            order = again[np.lexsort((ords[again], names[again]))]
            new = names[order][1:] != names[order][:-1]
            again = np.unique(np.r_[order[np.r_[True, new]], order[np.r_[new, True]]])
        sent = np.sort(np.r_[once, again])
        _split(out, 0, _bucket(names[sent], n), names[sent].astype(np.uint32), ords[sent], keys[sent], homes[sent].astype(np.int32), number[sent].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = _Out(), [], 0
        for batch in batches:
            for home, ord_, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = body.as_py()
                if len(data) >= LENGTH:
                    held.append((home, ord_, key, runs(data)[1]))
                    size += len(data)
                if size >= UNIT:
                    flush(held, out)
                    held, size = [], 0
                    yield out.batch()
        flush(held, out)
        yield out.batch()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Buckets of rows that come sorted by bucket; columns after the first make up the rows."""
    bucket, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != bucket:
                if held:
                    yield bucket, held
                bucket, held = row[0], []
            held.append(row[1:])
    if held:
        yield bucket, held


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, in a bucket of names: runs whose name another document has, to their rows' buckets (kind 1)."""
    out = _Out()
    for bucket, rows in _grouped(batches):
        asked = [_unpack(body) for kind, body in rows if kind == 0]
        for kind, body in rows:
            if kind == 1:
                out.add(bucket, 1, body)
        if asked:
            names, ords, keys, homes, number = (np.concatenate(c) for c in zip(*asked, strict=True))
            found = _repeats(names, ords)
            _split(out, 1, homes[found].astype(np.int64), ords[found], keys[found], number[found].astype(np.int64))
        yield out.batch()


def _told(rows: list[tuple]) -> tuple[dict[tuple[int, int], list[np.ndarray]], list[tuple]]:
    """What the blobs (kind 1) say by (ord, key), and the texts (kind 2) in order of ord."""
    said: dict[tuple[int, int], list[np.ndarray]] = {}
    for kind, _, _, body in rows:
        if kind == 1:
            ords, keys, *more = _unpack(body)
            order = np.lexsort((keys, ords))
            ords, keys, more = ords[order], keys[order], [m[order] for m in more]
            bounds = np.r_[np.flatnonzero(np.r_[True, (ords[1:] != ords[:-1]) | (keys[1:] != keys[:-1])]), len(ords)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                said.setdefault((int(ords[a]), int(keys[a])), []).append(np.stack([m[a:b] for m in more], axis=1))
    return said, sorted((r[1:] for r in rows if r[0] == 2), key=lambda r: r[:2])


def _ship(n: int):
    """Step 2, in a bucket of rows: runs that may repeat to their names' buckets (kind 0), bytes known to be covered (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _grouped(batches):
            out = _Out()
            said, texts = _told(rows)
            seen: dict[bytes, int] = {}
            sent: list[tuple] = []
            bodies: list[bytes] = []
            cut: list[tuple] = []
            done: set[tuple[int, int]] = set()
            for ord_, key, data in texts:
                if (ord_, key) not in said or (ord_, key) in done:
                    continue
                done.add((ord_, key))  # rows that repeat share their result
                first, names = runs(data)
                last = np.r_[first[1:], len(data) - LENGTH + 1]
                which = np.unique(np.concatenate(said[ord_, key])[:, 0])
                for a, b, name in zip(first[which].tolist(), last[which].tolist(), names[which].tolist(), strict=True):
                    piece = data[a : b + LENGTH - 1]
                    digest = xxhash.xxh3_128_digest(piece)
                    least = seen.setdefault(digest, ord_)
                    if least < ord_:
                        cut.append((ord_, key, a, b + LENGTH - 1))
                    else:
                        sent.append((name, ord_, key, a))
                        bodies.append(piece)
            if cut:
                c = np.array(cut, np.int64)
                out.add(home, 1, _pack(*c.T))
            if sent:
                names = np.array([s[0] for s in sent], np.uint64)
                ords, keys, at = (np.array([s[k] for s in sent], np.int64) for k in (1, 2, 3))
                sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
                to = _bucket(names, n)
                order = np.argsort(to, kind="stable")
                bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]), len(order)]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = order[a:b]
                    out.add(int(to[own[0]]), 0, _pack(names[own], ords[own], keys[own], at[own].astype(np.int32), sizes[own].astype(np.int32), np.full(1, home), b"".join([bodies[k] for k in own.tolist()])))
            yield out.batch()

    return run


def covered(names: np.ndarray, ords: np.ndarray, sizes: np.ndarray, text: bytes) -> list[tuple[int, int, int]]:
    """(run, from, to): bytes of each run (pieces of ``text``) covered by a string that a run of a smaller ord has as well."""
    ends = np.cumsum(sizes)
    offset = ends - sizes
    found: list[tuple[int, int, int]] = []
    # Runs with the same text: the least ord stands for all.
    least: dict[bytes, int] = {}
    order = np.argsort(ords, kind="stable")
    stands = np.zeros(len(ords), bool)
    for k in order.tolist():
        piece = text[offset[k] : ends[k]]
        other = least.setdefault(piece, k)
        if other == k:
            stands[k] = True
        elif ords[other] < ords[k]:
            found.append((k, 0, int(sizes[k])))
        else:
            stands[k] = True
    use = np.flatnonzero(stands)
    use = use[_repeats(names[use], ords[use])]
    if not len(use):
        return found
    joined = b"".join([text[offset[k] : ends[k]] for k in use.tolist()])
    size, count = sizes[use], sizes[use] - LENGTH + 1
    base = np.cumsum(size) - size
    run = np.repeat(np.arange(len(use)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, group = equal_prefixes(joined, base[run] + inside)
    owner = np.searchsorted(base, at, side="right") - 1
    own = ords[use][owner]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.r_[first, len(group)]))
    hit = own > low
    owner, start = owner[hit], (at - base[owner])[hit]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if len(owner):
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] - start[:-1] > LENGTH)])
        stop = np.r_[new[1:], len(owner)] - 1
        found += zip(use[owner[new]].tolist(), start[new].tolist(), (start[stop] + LENGTH).tolist(), strict=True)
    return found


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, in a bucket of runs: covered bytes to their rows' buckets (kind 1)."""
    for bucket, rows in _grouped(batches):
        out = _Out()
        parts = [_unpack(body) for kind, body in rows if kind == 0]
        for kind, body in rows:
            if kind == 1:
                out.add(bucket, 1, body)
        rows = []
        if parts:
            names, ords, keys, at, sizes = (np.concatenate([p[k] for p in parts]) for k in range(5))
            homes = np.concatenate([np.full(len(p[0]), p[5][0]) for p in parts])
            text = b"".join([p[6] for p in parts])
            parts = []
            if cut := covered(names, ords, sizes.astype(np.int64), text):
                k, a, b = np.array(cut, np.int64).T
                _split(out, 1, homes[k], ords[k], keys[k], at[k] + a, at[k] + b)
        yield out.batch()


def _strip(with_text: bool):
    """Step 4, in a bucket of rows: what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            said, texts = _told(rows)
            out = []
            for ord_, key, data in texts:
                spans: list[list[int]] = []
                if (ord_, key) in said:
                    cut = np.concatenate(said[ord_, key])
                    for a, b in cut[np.lexsort((cut[:, 1], cut[:, 0]))].tolist():
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if ord_ == NO_ID else ord_, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept, the bytes that stay, only ``with_text``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(buckets(spark), size // BUCKET_BYTES)
    rows = _rows(docs, n)
    told = written(rows.mapInArrow(_ask(n), BLOBS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tell, BLOBS), "told")

    def with_texts(blobs: DataFrame) -> DataFrame:
        none = F.lit(None).cast("long")
        both = blobs.select("bucket", "kind", none.alias("ord"), none.alias("key"), "body").unionByName(rows.select("bucket", F.lit(2).alias("kind"), "ord", "key", "body"))
        return both.repartition("bucket").sortWithinPartitions("bucket")

    shipped = with_texts(told).mapInArrow(_ship(n), BLOBS)
    cuts = written(shipped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort, BLOBS), "cuts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_texts(cuts).mapInArrow(_strip(with_text), schema)
