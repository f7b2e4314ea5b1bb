"""Recurring passages: the search that substring and suffix-array removal share.

A window is ``window`` consecutive units (words or bytes). Every window names one of the grams of
``gram`` units inside it, its anchor: the one with the smallest hash, the leftmost if equal. Equal
windows have equal anchors, so windows need only be compared where anchors recur:

1. count anchors over all documents, summed before the shuffle, and keep those that recur;
2. list for each document the runs of windows whose anchors recur;
3. cut those runs' texts out as segments, dealt by anchor; equal segments are merged before the
   shuffle, and every one but the first (smallest document, then place) is marked whole. Runs
   with an anchor above ``hot`` occurrences, and above a RAREth of all, are dealt by single
   windows instead, whose equal texts merge, so that no anchor gathers its documents in one task;
4. a ``resolve`` function compares the distinct segments of a shard exactly, and marks the windows
   of first occurrences that start earlier elsewhere; an anchor whose segments alone are more than
   a shard is settled by its windows' hashes and bytes;
5. marks go back to their documents.

Hashes only choose what is compared; what is removed has been compared text by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Window starts handled at once; positions inside take the low bits of a sort key.
STRETCH, PLACE = 1 << 20, np.uint64((1 << 21) - 1)
#: Bytes of documents whose single windows are compared at once, and distinct segments held at once.
HELD, PIECES = 1 << 20, 400_000
#: Anchors are hot by their share of all occurrences: a fixed number alone would make more and more
#: anchors hot as tables grow, each of whose runs turns into a row for every window.
RARE = 16_384
#: Windows of one anchor that are sorted at once.
SORTED = 1 << 20
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
POWER = np.cumprod(np.full(4096, MULTIPLIER))


def byte_units(body: bytes) -> tuple[np.ndarray, None]:
    return BYTE[np.frombuffer(body, np.uint8)], None


def word_units(body: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A hash for each word, and where words start and end."""
    raw = np.frombuffer(body, np.uint8)
    inside = np.r_[False, ~BLANK[raw], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), (starts, ends)
    sizes = ends - starts
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = BYTE[raw[inside[1:-1]]] * POWER[offset & 4095]
    return mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes)), (starts, ends)


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    units: Callable[[bytes], tuple]

    def grams(self, units: np.ndarray) -> np.ndarray:
        """A hash of every ``gram`` consecutive units; gram is a power of two."""
        g, k, by = units, 1, MULTIPLIER
        with np.errstate(over="ignore"):
            while k < self.gram:
                g = g[:-k] * by + g[k:]
                k, by = 2 * k, by * by
        return mixed(g)

    def windows(self, units: np.ndarray) -> np.ndarray:
        """A hash of every ``window`` consecutive units."""
        names, k = units, 1
        with np.errstate(over="ignore"):
            while 2 * k <= self.window:
                names, k = mixed(names[:-k] * MULTIPLIER + names[k:]), 2 * k
            return names[: len(names) - self.window + k] * MULTIPLIER + names[self.window - k :]

    def runs(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first window and number of windows of each run of windows with one anchor place."""
        parts = []
        width = self.window - self.gram + 1
        for at in range(0, len(units) - self.window + 1, STRETCH):
            g = self.grams(units[at : at + STRETCH + self.window - 1])
            least, k = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64), 1
            while 2 * k <= width:
                least, k = np.minimum(least[:-k], least[k:]), 2 * k
            if k < width:
                least = np.minimum(least[: k - width], least[width - k :])
            place = (least & PLACE).astype(np.int64)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            parts.append((g[place[first]], first + at, np.diff(np.r_[first, len(place)])))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        h, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return h.view(np.int64), first, n

    def cut_out(self, body: bytes, where, first: int, n: int) -> bytes:
        """The text of ``n`` windows from ``first``, words joined by one space."""
        last = first + n - 1 + self.window
        if where is None:
            return body[first:last]
        starts, ends = where
        return b" ".join(body[starts[first] : ends[last - 1]].split())


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def spread(values: np.ndarray) -> np.ndarray:
    return mixed(values.astype(np.int64).view(np.uint64)).view(np.int64)


def anchor_counts(rows: DataFrame, shape: Shape, text: str) -> DataFrame:
    """Anchors that occur twice or more: h, n."""

    def run(batches):
        for b in batches:
            found = [shape.runs(shape.units(encoded(t))[0])[0] for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([*found, np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    each = rows.select(text).mapInArrow(run, "h long, n long")
    return each.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def candidate_runs(rows: DataFrame, again: DataFrame, shape: Shape, text: str, hot: int) -> DataFrame:
    """For each document with recurring anchors: _rid, and runs of (first, n, h, hot)."""

    def run(batches):
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False)
            found = [shape.runs(shape.units(encoded(t))[0]) for t in b.column(1).to_pylist()]
            h, first, n = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (zip(*found, strict=True) if found else ([], [], [])))
            own = np.repeat(rid, [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(own), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "_rid", "first", "n"])

    each = rows.select("_rid", text).mapInArrow(run, "h long, _rid long, first int, n int")
    total = again.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = max(hot, total // RARE)
    known = again.select(F.col("h").alias("_h"), F.col("n").alias("_n"), (F.col("n") > hot).alias("hot"))
    joined = spread_join(each, known, "h", "_h", "_n", total, F.hash("_rid", "first"), least=hot)
    return joined.groupBy("_rid").agg(F.collect_list(F.struct("first", "n", "h", "hot")).alias("runs"))


SEGMENT = "key long, segment binary, _rid long, first int, n int"


def segments(rows: DataFrame, runs: DataFrame, shape: Shape, text: str) -> DataFrame:
    """Distinct segments of each task (key, segment, first place), and marked runs (segment null)."""

    def run(batches):
        for b in batches:
            best: dict[bytes, tuple] = {}
            gone: list[tuple] = []

            def mark(rid, first, n, gone=gone):
                """Runs that follow each other in a document become one."""
                if gone and gone[-1][0] == rid and gone[-1][1] + gone[-1][2] == first:
                    gone[-1] = (rid, gone[-1][1], gone[-1][2] + n)
                else:
                    gone.append((rid, first, n))

            def meet(key, piece, rid, first, n, best=best, mark=mark):
                new, old = (rid, first, n, key), best.get(piece)
                if old is None:
                    best[piece] = new
                elif new[:2] < old[:2]:
                    best[piece] = new
                    mark(*old[:3])
                else:
                    mark(rid, first, n)

            bytewise: list[tuple] = []
            ends = b.column(2).offsets.to_numpy()
            flat = b.column(2).values
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "h", "hot")]
            for i, (rid, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                body = encoded(t.as_py())
                where = shape.units(body)[1]
                found = list(zip(*(c[ends[i] : ends[i + 1]].tolist() for c in columns), strict=True))
                if where is None and any(r[3] for r in found):
                    bytewise.append((rid, body, [r[:2] for r in found if r[3]]))
                    found = [r for r in found if not r[3]]
                    if sum(len(x[1]) for x in bytewise) > HELD:
                        single(bytewise, meet, gone)
                        bytewise = []
                for first, n, h, single_windows in sorted(found):
                    if single_windows:
                        for at in range(first, first + n):
                            piece = shape.cut_out(body, where, at, 1)
                            meet(xxhash.xxh64_intdigest(piece) - (1 << 63), piece, rid, at, 1)
                    else:
                        meet(h, shape.cut_out(body, where, first, n), rid, first, n)
                if len(best) + len(gone) > PIECES:
                    yield from packed(best, gone)
                    best.clear()
                    gone.clear()
            single(bytewise, meet, gone)
            yield from packed(best, gone)

    def single(held, meet, gone) -> None:
        """Single windows of some documents at once: one of each kind goes on, others are marked."""
        if not held:
            return
        buffer = np.frombuffer(b"".join(x[1] for x in held), np.uint8)
        base = np.cumsum([0, *[len(x[1]) for x in held]])
        first = np.concatenate([np.arange(f, f + n) for x in held for f, n in x[2]])
        owner = np.repeat(np.arange(len(held)), [sum(n for _, n in x[2]) for x in held])
        rid, at = np.array([x[0] for x in held], np.int64)[owner], base[owner] + first
        names = shape.windows(BYTE[buffer])[at]
        order = np.lexsort((first, rid, names))
        rid, first, at, names = rid[order], first[order], at[order], names[order]
        new = np.r_[True, names[1:] != names[:-1]]
        chief = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        view = np.lib.stride_tricks.sliding_window_view(buffer, shape.window)
        for part in np.array_split(np.flatnonzero(~new), len(new) // 50_000 + 1):
            new[part] = (view[at[part]] != view[at[chief[part]]]).any(1)
        for i in np.flatnonzero(new).tolist():
            piece = view[at[i]].tobytes()
            meet(xxhash.xxh64_intdigest(piece) - (1 << 63), piece, int(rid[i]), int(first[i]), 1)
        rid, first = rid[~new], first[~new]
        order = np.lexsort((first, rid))
        rid, first = rid[order], first[order]
        if len(rid):
            start = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (first[1:] != first[:-1] + 1)])
            gone.extend(zip(rid[start].tolist(), first[start].tolist(), np.diff(np.r_[start, len(rid)]).tolist(), strict=True))

    def packed(best, gone) -> Iterator[pa.RecordBatch]:
        if gone:
            rid, first, n = zip(*gone, strict=True)
            key = spread(np.array(rid, np.int64) * 31 + np.array(first))
            yield batch(key, pa.nulls(len(gone), pa.binary()), rid, first, n)
        pieces = list(best)
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            rid, first, n, key = zip(*(best[p] for p in some), strict=True)
            yield batch(np.array(key, np.int64), pa.array(some, pa.binary()), rid, first, n)

    def batch(key, pieces, rid, first, n):
        columns = [pa.array(key), pieces, pa.array(rid, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "segment", "_rid", "first", "n"])

    joined = rows.select("_rid", text).join(runs.withColumnRenamed("_rid", "_r"), F.col("_rid") == F.col("_r"))
    return joined.select("_rid", text, "runs").mapInArrow(run, SEGMENT)


def joined_runs(rid: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Single windows as runs (rid, first, n)."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    start = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1)]) if len(rid) else np.empty(0, np.int64)
    return list(zip(rid[start].tolist(), at[start].tolist(), np.diff(np.r_[start, len(rid)]).tolist(), strict=True))


def later_windows(pieces: list[tuple], shape: Shape) -> list[tuple]:
    """Marks for the segments of one anchor: (piece, rid, first, n) -> (rid, first, n).

    Windows are hashed some segments at a time, and sorted a share of the hashes at a time; windows of
    one hash are compared with the first of them, and those that differ among themselves again.
    """
    names, owner, inside, starts, sizes = [], [], [], [], []
    body, at = b" ".join(p[0] for p in pieces), 0
    held, begin = 0, 0
    for i, p in enumerate(pieces):
        held += len(p[0]) + 1
        if held < HELD and i + 1 < len(pieces):
            continue
        units, where = shape.units(body[at : at + held])
        # Words are found anew in the joined text; bytes have a separator between segments.
        some = np.array([x[3] for x in pieces[begin : i + 1]], np.int64)
        step = some + shape.window - (where is not None)
        first = np.repeat(np.cumsum(step) - step, some)
        offset = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        unit = first + offset
        names.append(shape.windows(units)[unit])
        owner.append(np.repeat(np.arange(begin, i + 1, dtype=np.int32), some))
        inside.append(offset.astype(np.int32))
        low, high = (unit, unit + shape.window) if where is None else (where[0][unit], where[1][unit + shape.window - 1])
        starts.append(low + at)
        sizes.append((high - low).astype(np.int32))
        at, held, begin = at + held, 0, i + 1
    names, owner, inside, starts, sizes = (np.concatenate(x) for x in (names, owner, inside, starts, sizes))
    rid, first = (np.array([p[k] for p in pieces], np.int64) for k in (1, 2))
    raw = np.frombuffer(body, np.uint8)

    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if shape.units is byte_units:
            view = np.lib.stride_tricks.sliding_window_view(raw, shape.window)
            parts = [(view[starts[x[k : k + 50_000]]] == view[starts[y[k : k + 50_000]]]).all(1) for k in range(0, len(x), 50_000)]
            return np.concatenate([*parts, np.empty(0, bool)])
        return np.fromiter((body[starts[i] : starts[i] + sizes[i]] == body[starts[j] : starts[j] + sizes[j]] for i, j in zip(x, y, strict=True)), bool, len(x))

    shares = np.uint64(len(names) // SORTED + 1)
    gone = []
    for share in range(int(shares)):
        left = np.flatnonzero(names % shares == share)
        left = left[np.lexsort((first[owner[left]] + inside[left], rid[owner[left]], names[left]))]
        while len(left):
            new = np.r_[True, names[left[1:]] != names[left[:-1]]]
            chief = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
            same = equal(left[~new], chief[~new])
            gone.append(left[~new][same])
            left = left[~new][~same]
    late = np.concatenate([*gone, np.empty(0, np.int64)])
    return joined_runs(rid[owner[late]], first[owner[late]] + inside[late])


def marks(dealt: DataFrame, shape: Shape, resolve: Callable, shard_bytes: int) -> DataFrame:
    """(_rid, first, n): the runs of windows that start earlier elsewhere."""

    def run(batches):
        key, best, read = None, {}, 0  # distinct segments of the last key, which may go on
        shard: list[tuple] = []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            if len(best) < 2:
                return
            pieces = [(piece, *place) for piece, place in best.items()]
            if sum(map(len, best)) > shard_bytes:
                out.extend(later_windows(pieces, shape))
            else:
                shard.extend(pieces)

        for b in batches:
            gone = np.array(b.column(1).is_null())
            if gone.any():
                rest = b.filter(pa.array(gone))
                yield marked(rest.column(2), rest.column(3), rest.column(4))
            for k, piece, *place in zip(*(c.to_pylist() for c in b.filter(pa.array(~gone)).columns), strict=True):
                if k != key:
                    close()
                    size += read
                    key, best, read = k, {}, 0
                    if size >= shard_bytes:
                        yield settle(shard, out)
                        shard, out, size = [], [], 0
                read += len(piece)
                new, old = tuple(place), best.get(piece)
                if old is not None:
                    new, old = min(new, old), max(new, old)
                    out.append(old)
                best[piece] = new
        close()
        yield settle(shard, out)

    def settle(shard, out):
        found = out + resolve(shard) if shard else out
        rid, first, n = zip(*found, strict=True) if found else ((), (), ())
        return marked(pa.array(rid, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()))

    def marked(rid, first, n):
        return pa.RecordBatch.from_arrays([rid, first, n], names=["_rid", "first", "n"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "_rid long, first int, n int")


def marked_runs(rows: DataFrame, shape: Shape, resolve: Callable, text: str = "text", hot: int = 2000, shard_bytes: int = 4 << 20) -> DataFrame:
    """_rid and runs (first, n) of windows to be removed, for documents that have any."""
    scratch = Scratch(rows.sparkSession)
    again = scratch.keep(anchor_counts(rows, shape, text), "anchors")
    runs = scratch.keep(candidate_runs(rows, again, shape, text, hot), "runs")
    scratch.drop(again)
    found = marks(segments(rows, runs, shape, text), shape, resolve, shard_bytes)
    out = scratch.keep(found.groupBy("_rid").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "marks")
    scratch.drop(runs)
    return out


def covered(runs: list, n_units: int, window: int) -> np.ndarray:
    """Which units lie in a window of the runs."""
    step = np.zeros(n_units + 1, np.int64)
    for r in runs or ():
        step[r["first"]] += 1
        step[min(n_units, r["first"] + r["n"] - 1 + window)] -= 1
    return np.cumsum(step[:-1]) > 0


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]
