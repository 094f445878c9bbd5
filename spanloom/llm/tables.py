"""Key tables gathered by Spark and stored as sorted arrays that workers map into memory.

A pass over the corpus adds rows of (64-bit key, columns) to a Gather in each task. The
task combines rows of equal keys, and sends what is left as one row for each table and
range of keys: sorted keys as differences, and columns, byte by byte and compressed. The
reducing tasks combine them again; each takes successive ranges and writes one file a
table to the shared folder. So a key that holds much of the corpus costs one entry a task,
and no row of the corpus passes through the JVM.

A file holds a sorted array of what the keys have beyond the place that an offset table
gives them: all 64 bits of a key, or the next 32, which finds a key that is not there
with a probability of some 1e-9 however many keys there are. The commonest rows of columns
are kept as one byte that names them.
"""

from __future__ import annotations

import collections
import os
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

BLOBS = "t int, bucket int, blob binary"
#: Numbers that a task holds before it sends them on.
HELD = 6_000_000
#: Files that a worker keeps mapped.
MAPS = 4096
#: Keys for each entry of a file's offset table, about.
NEAR = 10

Columns = list[np.ndarray]
Combine = Callable[[np.ndarray, Columns], tuple[np.ndarray, Columns]]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal entries start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, cols: Columns) -> tuple[np.ndarray, Columns]:
    """Sorted distinct keys, and the sums of each column."""
    order = np.argsort(keys)
    keys = keys[order]
    new = firsts(keys)
    return keys[new], [np.add.reduceat(v[order], new) if len(new) else v for v in cols]


def each_of(x, widths: list[int]) -> list:
    """x for each table, if it is not a list of them."""
    return x if isinstance(x, list) else [x] * len(widths)


def buckets_for(spark: SparkSession) -> tuple[int, int]:
    """(reducing tasks, ranges of keys): ranges follow the shuffle partitions, as a power of two."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts, 1 << max(8, (4 * parts - 1).bit_length())


def shift_of(buckets: int) -> np.uint64:
    return np.uint64(64 - buckets.bit_length() + 1)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal place together."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def blob(pack, keys: np.ndarray, cols: Columns, drop: int) -> bytes:
    """Sorted keys, without their last `drop` bits, and their columns. A column of fractions with
    few values is sent as codes."""
    head, out = [len(keys), drop], [planes(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0)))]
    for c in cols:
        few = tx.uniq(c) if c.dtype.kind == "f" else c[:0]
        coded = 0 < len(few) < min(1 << 16, len(c))
        head.append(len(few) if coded else 0)
        out += [few.tobytes(), planes(np.searchsorted(few, c).astype("<u2"))] if coded else [planes(c)]
    return struct.pack(f"<{len(head)}I", *head) + pack(b"".join(out))


def unblob(unpack, raw: bytes, width: int, kind: str) -> tuple[np.ndarray, Columns]:
    n, drop, *few = struct.unpack_from(f"<{width + 2}I", raw)
    data, at = unpack(raw[4 * (width + 2) :]), 8 * n
    keys, cols = np.cumsum(unplanes(data[:at], "<u8"), dtype=np.uint64) << np.uint64(drop), []
    for k in few:
        if k:
            values = np.frombuffer(data, kind, k, at)
            at += 8 * k
            cols.append(values[unplanes(data[at : at + 2 * n], "<u2")])
            at += 2 * n
        else:
            cols.append(unplanes(data[at : at + 8 * n], kind))
            at += 8 * n
    return keys, cols


class Gather:
    """Rows of a task by table. widths: columns of each table; combine: of all tables or each; whole:
    integers, else fractions; drop: last bits of keys that are left out; most: numbers held before they are sent."""

    def __init__(self, buckets: int, widths: list[int], combine: Combine | list[Combine] = summed, whole: bool = True, drop: int = 0, most: int = HELD):
        self.most, self.shift, self.widths, self.combine, self.drop = most, shift_of(buckets), widths, each_of(combine, widths), np.uint64(drop)
        self.kind = np.int64 if whole else np.float64
        self.held, self.size = [[] for _ in widths], 0

    def add(self, table: int, keys: np.ndarray, cols: Columns) -> None:
        got = self.combine[table](keys >> self.drop << self.drop, [c.astype(self.kind, copy=False) for c in cols])
        self.held[table].append(got)
        self.size += len(got[0]) * (1 + self.widths[table])

    def whole(self, table: int, held: list) -> tuple[np.ndarray, Columns]:
        """All rows of a table, combined; what is held is let go, sums a column at a time."""
        keys, parts = np.concatenate([k for k, _ in held]), [v for _, v in held]
        held.clear()
        if self.combine[table] is not summed:
            return self.combine[table](keys, [np.concatenate(c) for c in zip(*parts)])
        order = np.argsort(keys)
        keys, cols = keys[order], []
        new = firsts(keys)
        for i in range(len(parts[0]) if parts else 0):
            one = np.concatenate([p[i] for p in parts])[order]
            for p in parts:
                p[i] = None
            cols.append(np.add.reduceat(one, new) if len(new) else one)
        return keys[new], cols

    def full(self) -> bool:
        """Whether rows() should be sent; equal keys are combined first."""
        if self.size > self.most:
            self.size = 0
            for t, held in enumerate(self.held):
                if held:
                    self.held[t] = [self.whole(t, held)]
                    self.size += len(self.held[t][0][0]) * (1 + self.widths[t])
        return self.size > 0.7 * self.most

    def rows(self):
        pack = zstandard.ZstdCompressor(level=1).compress
        for t, held in enumerate(self.held):
            if held:
                keys, cols = self.whole(t, held) if len(held) > 1 else held.pop()
                which = (keys >> self.shift).astype(np.int64)
                cut = firsts(which)
                blobs = [blob(pack, keys[a:b], [v[a:b] for v in cols], int(self.drop)) for a, b in zip(cut, np.append(cut[1:], len(keys)).astype(int))]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(blobs), pa.int32()), pa.array(which[cut], pa.int32()), pa.array(blobs, pa.binary())], names=["t", "bucket", "blob"])
        self.held, self.size = [[] for _ in self.widths], 0


def by_bucket(batches, widths: list[int], combine: list[Combine], whole: bool = True):
    """(table, bucket, keys, columns) of successive equal (t, bucket) in sorted blobs. Parts of a
    bucket are combined as they come, so that what many tasks have takes room once."""
    unpack = zstandard.ZstdDecompressor().decompress
    kind, held, key, size, done = "<i8" if whole else "<f8", [], None, 0, 0

    def one():
        return combine[key[0]](np.concatenate([k for k, _ in held]), [np.concatenate(c) for c in zip(*[v for _, v in held])])

    for b in batches:
        for t, bucket, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held and key != (t, bucket):
                yield (*key, *one())
                held, size, done = [], 0, 0
            key = (t, bucket)
            held.append(unblob(unpack, raw, widths[t], kind))
            size += len(held[-1][0])
            if size > max(2 * done, 1 << 20):
                held = [one()]
                size = done = len(held[0][0])
    if held:
        yield (*key, *one())


class File:
    """Writes one table's file from successive buckets; it appears under its name when complete."""

    def __init__(self, path: str, first: int, shift: int, width: int, exact: bool):
        self.path, self.first, self.shift, self.width, self.exact = path, first, shift, width, exact
        self.n, self.next, self.bits, self.common, self.small = 0, first, None, None, True
        self.parts = {name: open(f"{path}.{name}.{os.getpid()}.tmp", "wb") for name in ("offsets", "keys", "codes", "at", "rest")}

    def add(self, bucket: int, keys: np.ndarray, cols: Columns) -> None:
        rows = np.stack([c.astype("<i8", copy=False) for c in cols], 1) if cols else np.zeros((len(keys), 0), "<i8")
        if self.bits is None:
            self.bits = min(int(max(1, len(keys) // NEAR)).bit_length(), self.shift - 32)
            self.common = common_rows(rows)
        put = lambda name, x: self.parts[name].write(x.tobytes())
        per = 1 << self.bits
        put("offsets", np.full((bucket - self.next) * per, self.n, "<u4"))
        place = (keys & np.uint64((1 << self.shift) - 1)) >> np.uint64(self.shift - self.bits)
        put("offsets", (self.n + np.searchsorted(place, np.arange(per, dtype=np.uint64))).astype("<u4"))
        put("keys", keys if self.exact else rests(keys, self.shift - self.bits))
        if len(self.common):
            codes = codes_of(rows, self.common)
            odd = np.flatnonzero(codes == 255)
            put("codes", codes)
            put("at", (self.n + odd).astype("<u4"))
            rows = rows[odd]
        put("rest", rows)
        self.small &= not len(rows) or (0 <= int(rows.min(initial=0)) and int(rows.max(initial=0)) < 1 << 32)
        self.n, self.next = self.n + len(keys), bucket + 1

    def close(self) -> None:
        self.parts["offsets"].write(np.array([self.n], "<u4").tobytes())
        sizes = []
        for f in self.parts.values():
            f.close()
            sizes.append(os.path.getsize(f.name))
        head = struct.pack("<12q", self.first, self.next, self.shift, self.bits, self.width, self.exact, len(self.common), self.small, *sizes[:4])
        temp = f"{self.path}.{os.getpid()}.tmp"
        with open(temp, "wb") as out:
            out.write(head + self.common.tobytes())
            for name, f in self.parts.items():
                out.write(b"\0" * (-out.tell() % 8))
                with open(f.name, "rb") as part:
                    while chunk := part.read(1 << 22):
                        out.write(np.frombuffer(chunk, "<i8").astype("<u4").tobytes() if name == "rest" and self.small else chunk)
                os.remove(f.name)
        os.replace(temp, self.path)


def rests(keys: np.ndarray, bits: int) -> np.ndarray:
    """The uppermost 32 of a key's last `bits` bits."""
    return (keys << np.uint64(64 - bits) >> np.uint64(32)).astype("<u4")


def common_rows(rows: np.ndarray) -> np.ndarray:
    """The rows that one byte may name: up to 255, if most are of them."""
    u, n = np.unique(rows, axis=0, return_counts=True) if rows.shape[1] > 1 else (lambda x: (x[0][:, None], x[1]))(np.unique(rows.ravel(), return_counts=True)) if rows.shape[1] else (rows[:1], np.array([len(rows)]))
    top = np.sort(np.argsort(-n, kind="stable")[:255])
    return u[top] if n[top].sum() > 0.6 * len(rows) else u[:0]


def codes_of(rows: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The place of each row in the sorted rows `common`, or 255."""
    key = lambda x: tx.mix(sum((x[:, i].astype(np.uint64) * np.uint64(2 * i + 1) << np.uint64(i * 5) for i in range(x.shape[1])), np.zeros(len(x), np.uint64)))
    names = key(common)
    order = np.argsort(names)
    k = order[np.minimum(np.searchsorted(names, key(rows), sorter=order), len(order) - 1)]
    return np.where((common[k] == rows).all(1), k, 255).astype(np.uint8)


class Mapped:
    """A file of a table, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        self.first, self.next, self.shift, self.bits, self.width, self.exact, n, small, *sizes = struct.unpack("<12q", raw[:96].tobytes())
        at = 96 + n * self.width * 8
        self.common = np.frombuffer(raw[96:at].tobytes(), "<i8").reshape(n, self.width)
        out = []
        for size, kind in zip([*sizes, None], ["<u4", "<u8" if self.exact else "<u4", "u1", "<u4", "<u4" if small else "<i8"]):
            at += -at % 8
            out.append(raw[at : len(raw) if size is None else at + size].view(kind))
            at += size or 0
        self.offsets, self.keys, self.codes, self.at, rest = out
        self.rest = rest.reshape(-1, self.width) if self.width else rest

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each sorted key is there, its columns)."""
        below, size = self.shift - self.bits, np.uint64(self.shift)
        where = ((u >> size) - np.uint64(self.first) << np.uint64(self.bits)) | ((u & np.uint64((1 << self.shift) - 1)) >> np.uint64(below))
        known = where < len(self.offsets) - 1
        where = np.where(known, where, 0).astype(np.int64)
        want = u if self.exact else rests(u, below)
        lo, hi = self.offsets[where].astype(np.int64), self.offsets[where + 1].astype(np.int64)
        last, top = hi, len(self.keys) - 1
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = np.minimum((lo + hi) >> 1, top)
            less = (lo < hi) & (self.keys[mid] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        at = np.minimum(lo, top)
        hit = known & (lo < last) & (self.keys[at] == want)
        rows = np.zeros((len(u), self.width), np.int64)
        if len(self.common):
            code = self.codes[at]
            odd = hit & (code == 255)
            plain = hit & (code != 255)
            rows[plain] = self.common[code[plain]]
            rows[odd] = self.rest[np.searchsorted(self.at, at[odd].astype("<u4"))]
        elif self.width:
            rows[hit] = self.rest[at[hit]]
        return hit, rows


def stored(blobs: DataFrame, widths: list[int], folder: str, combine: Combine | list[Combine] = summed, finish: Combine | list[Combine] | None = None, whole: bool = True, exact: list[bool] | bool = True) -> list[list[dict]]:
    """Combines the blobs of a pass and writes its tables; the index of each table.

    One index row per table and reducing task reaches the driver: its file, and how many values
    of the first column are 1, 2, 3 and 4, with their number and sum. whole: columns are
    integers, else sums of fractions that add up to integers. exact: of each table, whether
    keys are kept whole.
    """
    schema = "t int, part int, path string, n1 long, n2 long, n3 long, n4 long, n long, total double"
    parts, buckets = buckets_for(blobs.sparkSession)
    exact = [exact] * len(widths) if isinstance(exact, bool) else exact
    combine, finish = each_of(combine, widths), each_of(finish, widths)
    shift = int(shift_of(buckets))

    def write(batches):
        part, outs, sums = TaskContext.get().partitionId(), {}, {}
        for t, bucket, keys, cols in by_bucket(batches, widths, combine, whole):
            cols = [c if whole else np.rint(c).astype(np.int64) for c in cols]
            if finish[t] is not None:
                keys, cols = finish[t](keys, cols)
            if not len(keys):
                continue
            if t not in outs:
                os.makedirs(folder, exist_ok=True)
                outs[t] = File(f"{folder}/t{t}-{part:06d}", bucket, shift, len(cols), exact[t])
                sums[t] = np.zeros(6)
            outs[t].add(bucket, keys, cols)
            few = np.bincount(np.clip(cols[0], 0, 5), minlength=6)[1:5] if cols else np.zeros(4)
            sums[t] += [*few, len(keys), float(cols[0].sum()) if cols else 0.0]
        for f in outs.values():
            f.close()
        if outs:
            cols = [[t for t in outs], [part] * len(outs), [f.path for f in outs.values()], *([int(sums[t][i]) for t in outs] for i in range(5)), [float(sums[t][5]) for t in outs]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=pa.schema([("t", pa.int32()), ("part", pa.int32()), ("path", pa.string()), *[(x, pa.int64()) for x in ("n1", "n2", "n3", "n4", "n")], ("total", pa.float64())]))

    part = (F.col("bucket").cast("long") * parts / buckets).cast("int")
    rows = [r.asDict() for r in blobs.repartitionById(parts, part).sortWithinPartitions("t", "bucket").mapInArrow(write, schema).collect()]
    return [[r for r in rows if r["t"] == t] for t in range(len(widths))]


class Table:
    """Sorted arrays of one table, mapped into memory. drop: as it was gathered."""

    def __init__(self, index: list[dict], parts: int, buckets: int, width: int, drop: int = 0):
        self.drop = np.uint64(drop)
        self.shift, self.parts, self.buckets, self.width = shift_of(buckets), parts, buckets, width
        self.files = {r["part"]: r["path"] for r in index}

    def lookup(self, keys: np.ndarray, kind=np.float64) -> tuple[np.ndarray, Columns]:
        """Whether each key is there, and its columns (0 where it is not)."""
        keys = keys >> self.drop << self.drop
        order = np.argsort(keys)
        own = keys[order]
        new = firsts(own)
        u = own[new]
        there, rows = np.zeros(len(u), bool), np.zeros((len(u), self.width), np.int64)
        part = (u >> self.shift).astype(np.int64) * self.parts // self.buckets
        cut = firsts(part)
        for a, b in zip(cut, np.append(cut[1:], len(u)).astype(int)):
            if (path := self.files.get(int(part[a]))) is not None:
                there[a:b], rows[a:b] = opened(path).find(u[a:b])
        at = np.empty(len(keys), np.int64)
        at[order] = np.repeat(np.arange(len(u)), np.diff(np.append(new, len(own))))
        return there[at], [rows[at, i].astype(kind) for i in range(self.width)]


def opened(path: str) -> Mapped:
    """A mapped file of this worker; the ones that were not used for longest are let go."""
    maps = tx.store().__dict__.setdefault("maps", collections.OrderedDict())
    if path not in maps:
        if len(maps) >= MAPS:
            maps.popitem(last=False)
        maps[path] = Mapped(path)
    maps.move_to_end(path)
    return maps[path]
