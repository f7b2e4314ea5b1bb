"""Byte-level removal of repeats through external induced suffix sorting.

A shard's distinct segments are joined, each ended by a separator, and their suffixes are sorted
by induction: suffixes of type S* are ordered first (their substrings named by one induction, and
the names ordered by a recursive call), and all others follow from them bucket by bucket. The
buckets are a monotone priority queue keyed by the first byte; what is pushed is a run of suffix
places, kept in memory up to ``memory`` bytes and on the worker's disk beyond. Places are handled a
wave at a time in numpy.

Equal windows are neighbours in suffix order; whether neighbours share ``window`` bytes is compared
directly, and the earliest of each group stays.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, with_row_ids
from .recurring import BYTE, Shape, byte_units, covered, encoded, intervals, marked_runs

WINDOW, GRAM = 100, 32


class BucketQueue:
    """Runs of suffix places by bucket, first in first out; beyond ``memory`` bytes in a file."""

    def __init__(self, buckets: int, memory: int):
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.memory, self.size, self.file = memory, 0, None

    def push(self, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(at, np.r_[at[1:], len(keys)], strict=True):
            self.runs[keys[a]].append(places[a:b])
        self.size += places.nbytes
        if self.size > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs:
            held = [r for r in runs if isinstance(r, np.ndarray)]
            if held:
                whole = np.concatenate(held)
                at = self.file.tell()
                self.file.write(whole.tobytes())
                runs[:] = [r for r in runs if not isinstance(r, np.ndarray)] + [(at, len(whole), whole.dtype)]
        self.size = 0

    def pop(self, bucket: int) -> np.ndarray:
        out = []
        for r in self.runs[bucket]:
            if isinstance(r, np.ndarray):
                self.size -= r.nbytes
                out.append(r)
            else:
                at, n, kind = r
                self.file.seek(at)
                out.append(np.frombuffer(self.file.read(n * kind.itemsize), kind))
        self.runs[bucket] = []
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def types_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are of type S, and the places of S* suffixes; the last is the smallest."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    after = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    s = np.r_[t[after + 1] > t[after], True]
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def induce(t: np.ndarray, s: np.ndarray, stars: np.ndarray, size: int, memory: int) -> np.ndarray:
    """All suffixes in order, given S* suffixes in order (by bucket at least)."""
    ls, ss = BucketQueue(size, memory), BucketQueue(size, memory)
    fixed = BucketQueue(size, memory)
    fixed.push(t[stars], stars)
    low: list[np.ndarray] = []

    def before(wave: np.ndarray, kind: bool) -> np.ndarray:
        p = wave[wave > 0] - 1
        return p[s[p] == kind]

    for c in range(size):
        done = []
        wave = ls.pop(c)
        while len(wave):
            done.append(wave)
            p = before(wave, False)
            same = t[p] == c
            if same.any():
                # Places pushed by one wave come before those of the next one.
                ls.push(t[p[~same]], p[~same])
                wave = p[same]
            else:
                ls.push(t[p], p)
                wave = p[:0]
        p = before(fixed.pop(c), False)
        ls.push(t[p], p)
        low.append(np.concatenate(done) if done else np.empty(0, np.int64))
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done = []
        wave = ss.pop(c)
        while len(wave):
            done.append(wave)
            p = before(wave, True)
            same = t[p] == c
            ss.push(t[p[~same]], p[~same])
            wave = p[same]
        back = low[c][::-1]
        p = before(back, True)
        ss.push(t[p], p)
        # A suffix S of this bucket that follows an L suffix of it would be of type L: none is.
        out.append(np.concatenate([*done, back]) if done else back)
    for q in (ls, ss, fixed):
        q.close()
    order = np.concatenate(out)[::-1]
    return order if len(order) == len(t) else np.r_[len(t) - 1, order]


def named(t: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A rank for each S* place (by place): equal where the substrings up to the next S* are equal."""
    n = len(t)
    ends = np.r_[stars[1:] + 1, n]
    size_at = np.zeros(n, np.int64)
    size_at[stars] = ends - stars
    star = np.zeros(n, bool)
    star[stars] = True
    sorted_stars = order[star[order]]
    a, b = sorted_stars[:-1], sorted_stars[1:]
    new = np.r_[True, size_at[a] != size_at[b]]
    same = np.flatnonzero(~new[1:])
    step = 0
    while len(same):
        same = same[size_at[a[same]] > step]
        differ = t[a[same] + step] != t[b[same] + step]
        new[1:][same[differ]] = True
        same, step = same[~differ], step + 1
    rank = np.zeros(n, np.int64)
    rank[sorted_stars] = np.cumsum(new) - 1
    return rank[stars]


def doubled(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet, by ranks of doubled prefixes."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1]
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


def suffix_order(t: np.ndarray, memory: int = 256 << 20, buckets: int = 4096) -> np.ndarray:
    """Places of the suffixes of ``t`` in order; the last value must be smaller than all others.

    The recursion goes on while the names make at most ``buckets`` buckets; with more names (most
    of them unique by then) it ends by prefix doubling.
    """
    size = int(t.max()) + 1
    if len(t) < 3 or size > buckets:
        return doubled(t)
    s, stars = types_of(t)
    if len(stars) > 1:
        names = named(t, stars, induce(t, s, stars, size, memory))
        stars = stars[np.argsort(names) if names.max() == len(names) - 1 else suffix_order(names, memory, buckets)]
    return induce(t, s, stars, size, memory)


def resolver(window: int):
    """Marks for the segments of one shard: (piece, rid, first, n) -> (rid, first, n)."""

    def resolve(pieces: list[tuple]) -> list[tuple]:
        sizes = np.array([len(p[0]) for p in pieces])
        body = np.frombuffer(b"\x00".join(p[0] for p in pieces) + b"\x00", np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        t = body.astype(np.int64) + 2
        t[starts + sizes] = 1
        order = suffix_order(np.r_[t, 0])[1:]
        # Windows that a segment holds whole; neighbours are compared byte by byte.
        owner = np.repeat(np.arange(len(pieces)), sizes + 1)
        whole = np.arange(len(t)) + window <= (starts + sizes)[owner]
        order = order[whole[order]]
        values = BYTE[body]
        near, k = values, 1
        with np.errstate(over="ignore"):
            while k < 64 and 2 * k <= window:
                near, k = near[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + near[k:], 2 * k
        a, b = order[:-1], order[1:]
        same = (near[a] == near[b]) & (near[a + window - k] == near[b + window - k])
        sure = np.flatnonzero(same)
        view = np.lib.stride_tricks.sliding_window_view(body, window)
        for at in range(0, len(sure), 1 << 16):
            part = sure[at : at + (1 << 16)]
            same[part] = (view[a[part]] == view[b[part]]).all(1)
        group = np.cumsum(np.r_[True, ~same])
        many = np.bincount(group)[group] > 1
        place, group = order[many], group[many]
        rid = np.array([p[1] for p in pieces], np.int64)[owner[place]]
        at = np.array([p[2] for p in pieces], np.int64)[owner[place]] + place - starts[owner[place]]
        by = np.lexsort((at, rid, group))
        # No row at all where the segments share anchors alone.
        later = by[1:][group[by[1:]] == group[by[:-1]]]
        rid, at = rid[later], at[later]
        by = np.lexsort((at, rid))
        rid, at = rid[by], at[by]
        first = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1)]) if len(rid) else np.empty(0, np.int64)
        return list(zip(rid[first].tolist(), at[first].tolist(), np.diff(np.r_[first, len(rid)]).tolist(), strict=True))

    return resolve


def shape(window: int) -> Shape:
    gram = GRAM
    while 2 * gram > window:
        gram //= 2
    return Shape(window, gram, byte_units)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", digest: bool = False, **how) -> DataFrame:
    """``docs`` without bytes covered by a string of ``window`` bytes that starts earlier somewhere.

    Earlier means a smaller doc_id, or an earlier byte of the same document. What stays is decoded
    with characters that were cut dropped; unaffected texts, null included, are unchanged. Repeated
    rows, and rows with equal or null ids, are documents in the order of id (nulls last) and text.
    With ``digest`` the result is doc_id, n_bytes, n_removed, n_spans, kept_sha256 instead.
    """
    rows = with_row_ids(docs, docs.columns)
    runs = marked_runs(rows, shape(window), resolver(window), text, **how)
    if digest:
        rows = rows.select("_rid", "doc_id", text)
    names = [c for c in rows.columns if c != "_rid"]
    place = names.index(text)

    def trimmed(t, r) -> tuple[int, int, int, bytes]:
        body = encoded(t)
        if not r:
            return len(body), 0, 0, body
        flags = covered(r, len(body), window)
        return len(body), int(flags.sum()), len(intervals(flags)[0]), np.frombuffer(body, np.uint8)[~flags].tobytes()

    def run(batches):
        for b in batches:
            texts, found = b.column(place).to_pylist(), b.column(len(names)).to_pylist()
            out = [trimmed(t, r) for t, r in zip(texts, found, strict=True)]
            if digest:
                size, gone, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
                numbers = [pa.array(x, pa.int64()) for x in (size, gone, spans)]
                yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                new = [o[3].decode("utf-8", "ignore") if o[1] else t for t, o in zip(texts, out, strict=True)]
                columns = list(b.columns[: len(names)])
                columns[place] = pa.array(new, b.column(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = rows.join(runs.withColumnsRenamed({"_rid": "_r", "runs": "_runs"}), F.col("_rid") == F.col("_r"), "left").select(*names, "_runs")
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([rows.schema["doc_id"], *fields] if digest else [rows.schema[c] for c in names])
    return joined.mapInArrow(run, schema)


def op9_induced_suffix_sorting(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
