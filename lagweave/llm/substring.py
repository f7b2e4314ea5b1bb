"""Substring removal by repeated-phrase automata.

A shard holds the distinct segments whose anchors it was dealt. Windows whose hash is met twice or
more in it are the confirmed phrases; they are compiled into an Aho-Corasick automaton over word
numbers, and every segment is streamed through it, which alone tells where each phrase occurs.
Any occurrence but the earliest is marked.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, with_row_ids
from .recurring import MULTIPLIER, Shape, covered, encoded, intervals, marked_runs, mixed, word_units

WINDOW = 20


def confirmed(texts: list[list[int]], window: int) -> list[tuple[int, ...]]:
    """Windows whose hash is met twice or more in the texts: the phrases to compile. Two different
    windows of one hash only add a phrase; what occurs where is found by the automaton."""
    sizes = np.array([len(t) for t in texts])
    flat = np.array([n for t in texts for n in t], np.uint64)
    starts = np.cumsum(sizes) - sizes
    if len(flat) < window:
        return []
    names, k = mixed(flat * MULTIPLIER), 1
    with np.errstate(over="ignore"):
        while 2 * k <= window:
            names, k = mixed(names[:-k] * MULTIPLIER + names[k:]), 2 * k
        left = len(flat) - window + 1
        names = names[:left] * MULTIPLIER + names[window - k : window - k + left]
    whole = np.flatnonzero(np.arange(left) + window <= np.repeat(starts + sizes, sizes)[:left])
    _, first, n = np.unique(names[whole], return_index=True, return_counts=True)
    numbers = flat.tolist()
    return [tuple(numbers[at : at + window]) for at in whole[first[n > 1]].tolist()]


def resolver(window: int):
    """Marks for the segments of one shard: (piece, rid, first, n) -> (rid, first, n)."""

    def resolve(pieces: list[tuple]) -> list[tuple]:
        numbers: dict[bytes, int] = {}
        texts = [[numbers.setdefault(w, len(numbers) + 1) for w in p[0].split()] for p in pieces]
        phrases = confirmed(texts, window)
        if not phrases:
            return []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, phrase in enumerate(phrases):
            automaton.add_word(phrase, k)
        automaton.make_automaton()
        met = [(k, pieces[s][1], pieces[s][2] + end - window + 1) for s, t in enumerate(texts) for end, k in automaton.iter(tuple(t))]
        earliest: dict[int, tuple] = {}
        for k, rid, at in met:
            if k not in earliest or (rid, at) < earliest[k]:
                earliest[k] = (rid, at)
        return [(rid, at, 1) for k, rid, at in met if (rid, at) != earliest[k]]

    return resolve


def shape(window: int) -> Shape:
    gram = 1
    while 4 * gram <= window:
        gram *= 2
    return Shape(window, gram * 2 if 3 * gram < window else gram, word_units)


def repeated_passages(docs: DataFrame, window: int = WINDOW, text: str = "text", **how) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with _rid, and the runs of windows to be removed by _rid."""
    rows = with_row_ids(docs, docs.columns)
    return rows, marked_runs(rows, shape(window), resolver(window), text, **how)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", digest: bool = False, **how) -> DataFrame:
    """``docs`` without words covered by a window whose words start earlier somewhere.

    Earlier means a smaller doc_id, or an earlier word of the same document. Where something is
    removed the words that stay are joined by one space; other texts are unchanged, null included.
    Repeated rows, and rows with equal or null ids, are documents in the order of id (nulls last)
    and text. With ``digest`` the result is doc_id, n_words, n_removed, kept_sha256 instead.
    """
    rows, runs = repeated_passages(docs, window, text, **how)
    if digest:
        rows = rows.select("_rid", "doc_id", text)
    names = [c for c in rows.columns if c != "_rid"]
    place = names.index(text)

    def run(batches):
        for b in batches:
            texts, found = b.column(place).to_pylist(), b.column(len(names)).to_pylist()
            out = [trimmed(t, r) for t, r in zip(texts, found, strict=True)]
            if digest:
                words, gone, kept = zip(*out, strict=True) if out else ((), (), ())
                sums = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = [k.decode("utf-8", "surrogatepass") if g else t for t, (_, g, k) in zip(texts, out, strict=True)]
                columns = list(b.columns[: len(names)])
                columns[place] = pa.array(new, b.column(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def trimmed(t, r) -> tuple[int, int, bytes]:
        words = encoded(t).split()
        if not r:
            return len(words), 0, b" ".join(words) if digest else b""
        flags = covered(r, len(words), window)
        a, b = intervals(~flags)
        kept = [w for x, y in zip(a.tolist(), b.tolist(), strict=True) for w in words[x:y]]
        return len(words), int(flags.sum()), b" ".join(kept)

    joined = rows.join(runs.withColumnsRenamed({"_rid": "_r", "runs": "_runs"}), F.col("_rid") == F.col("_r"), "left").select(*names, "_runs")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([rows.schema["doc_id"], *fields] if digest else [rows.schema[c] for c in names])
    return joined.mapInArrow(run, schema)


def op8_repeated_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
