"""Quality rules and an isolation forest over their statistics.

Rule statistics are counted for every whole text. A forest of random splits, grown on a bounded
sample of the statistics and scaled by quantiles of all rows, gives each document its expected path
length; short paths are anomalies. The threshold is set on all labelled rows: the one that best
separates poor from good documents among those that keep at least ``keep_good`` of the good ones. A
bounded sample of labelled rows chooses which of the statistics the forest splits on.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Bytes of the classes that statistics count.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)
BLANKS = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)


def _repeated(words: list[bytes], size: int = 3) -> tuple[int, int]:
    """Words inside windows of ``size`` words that occur twice or more; distinct words."""
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)
    if n <= size:
        return 0, len(seen)
    code = ids[: n - size + 1]
    for k in range(1, size):
        if k > 1 and n > 2_000_000:
            code = np.unique(code, return_inverse=True)[1]
        code = code * n + ids[k : n - size + 1 + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[k : n - size + 1 + k] |= again
    return int(covered.sum()), len(seen)


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; zeros for null."""
    if not text:
        return (0,) * len(COUNTS)
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()
    by = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    lines, dup = set(), 0
    for line in body.split(b"\n"):
        if line and not line.isspace():
            dup += line in lines
            lines.add(line)
    repeat, distinct = _repeated(words)
    chars = len(text) - int(by[BLANKS].sum())
    return (len(words), chars, int(by[SYMBOLS].sum()), dup, repeat, int(by[65:91].sum()), int(by[48:58].sum()), int(by[MARKS].sum()), distinct)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and COUNTS (long) for each row."""

    def run(batches):
        for b in batches:
            rows = np.array([text_counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in rows.T]], names=[id_col, *COUNTS])

    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return docs.select(id_col, text).mapInArrow(run, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that don't depend on length, from rows of COUNTS."""
    words, chars, symbols, dups, repeats, upper, _, marks, _ = counts.astype(float).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    # Where a few good words vary much, the divisor is raised, so that short texts don't stand out.
    return np.column_stack([symbols / w, dups / (5 + w / 20), repeats / (w + 50), upper / (c + 300), marks / (w + 50)])


def feature_columns() -> list:
    """``features`` as columns."""
    w, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.col("n_symbols") / w, F.col("n_dup_lines") / (5 + w / 20), F.col("n_repeat_words") / (w + 50), F.col("n_upper") / (c + 300), F.col("n_marks") / (w + 50)]


class Forest:
    """Isolation trees as arrays of split feature, split value, children and path length."""

    def __init__(self, rows: np.ndarray, columns: list[int] | None = None, trees: int = 100, sample: int = 256, seed: int = 7, spread: np.ndarray | None = None):
        """``spread``: the quantiles 0.1, 0.5 and 0.9 of each column, by default those of ``rows``."""
        rng = np.random.default_rng(seed)
        self.columns = list(range(rows.shape[1])) if columns is None else columns
        low, self.middle, high = (np.quantile(rows, (0.1, 0.5, 0.9), axis=0) if spread is None else spread)[:, self.columns]
        rows = rows[:, self.columns]
        self.width = np.maximum(high - low, 1e-9)
        rows = self._beyond(rows)
        self.size = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _beyond(self, rows: np.ndarray) -> np.ndarray:
        """How far rows lie outside the usual range, in its widths, by sign; 0 inside of it."""
        off = (rows - self.middle) / self.width
        return np.sign(off) * np.maximum(np.abs(off) - 1, 0)

    @staticmethod
    def usual(n) -> np.ndarray:
        """The mean path length of a search that fails among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, child, length = [0], [0.0], [0], [0.0]
        waiting = [(0, rows, 0)]
        while waiting:
            at, x, depth = waiting.pop()
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < self.depth else ()
            if not len(spread):
                length[at], feature[at] = depth + float(self.usual(len(x))), -1
                continue
            f = int(rng.choice(spread))
            v = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            feature[at], value[at], child[at] = f, v, len(feature)
            for side in (x[x[:, f] < v], x[x[:, f] >= v]):
                waiting.append((len(feature), side, depth + 1))
                feature.append(0), value.append(0.0), child.append(0), length.append(0.0)
        return np.array(feature), np.array(value), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for anomalies, 0.5 and less for usual rows."""
        if not len(rows):
            return np.empty(0)
        rows = self._beyond(rows[:, self.columns])
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                step = child[at] + (rows[every, np.maximum(f, 0)] >= value[at])
                at = np.where(f < 0, at, step)
            total += length[at]
        return 2.0 ** -(total / len(self.trees) / max(float(self.usual(self.size)), 1e-9))


def separation(scores: np.ndarray, good: np.ndarray, limit: float) -> float:
    """Share of poor rows above the limit less the share of good ones."""
    return float((scores[~good] > limit).mean() - (scores[good] > limit).mean())


def fitted(sample: np.ndarray, marked: np.ndarray, good: np.ndarray, keep_good: float, trees: int, spread: np.ndarray | None = None) -> tuple[Forest, float]:
    """The forest over those statistics that, added one by one, best tell labelled rows apart."""
    if not good.any() or good.all():
        return Forest(sample, trees=trees, spread=spread), 1.0
    chosen: list[int] = []
    best = (-1.0, None, 1.0)
    while len(chosen) < sample.shape[1]:
        tried = []
        for f in set(range(sample.shape[1])) - set(chosen):
            forest = Forest(sample, [*chosen, f], trees, spread=spread)
            scores = forest.score(marked)
            limit = calibrate(scores, good, keep_good)
            tried.append((separation(scores, good, limit), -f, forest, limit))
        found = max(tried, key=lambda x: x[:2])
        if found[0] <= best[0]:
            break
        best = (found[0], found[2], found[3])
        chosen = found[2].columns
    return best[1], best[2]


def calibrate(scores: np.ndarray, good: np.ndarray, keep_good: float, n: np.ndarray | None = None) -> float:
    """The threshold with the most poor rows above it that keeps ``keep_good`` of the good ones.

    ``n`` counts the rows of each score. The threshold lies in the middle of the gap above it.
    """
    if not good.any() or good.all():
        return 1.0
    n = np.ones(len(scores), np.int64) if n is None else n
    tries = np.unique(scores)
    at = np.searchsorted(tries, scores)
    goods, poors = np.bincount(at, n * good, len(tries)), np.bincount(at, n * ~good, len(tries))
    kept = np.cumsum(goods) / goods.sum()
    gain = np.cumsum(goods) / goods.sum() - np.cumsum(poors) / poors.sum()
    allowed = np.flatnonzero(kept >= keep_good)
    first = allowed[int(np.argmax(gain[allowed]))]
    return float((tries[first] + tries[min(first + 1, len(tries) - 1)]) / 2)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", fit_rows: int = 10_000, label_rows: int = 5_000, keep_good: float = 0.99, trees: int = 100) -> DataFrame:
    """``id_col``, COUNTS, anomaly, base_failed, kept: a row for each row.

    Trees grow on about ``fit_rows`` rows, and about ``label_rows`` labelled rows choose the
    statistics, drawn by the hash of the id: these are the bounded samples. The statistics' scales
    are quantiles of all rows that pass the base rules, and the threshold is calibrated on all of
    these that are labelled, by counts of scores of four digits. A null or empty text has counts of
    0 and fails the base rules. Without labels of both kinds nothing is rejected beyond the base
    rules. Repeated rows are judged alike; null ids are judged, but not fitted on.
    """
    counts = cut(rule_counts(docs, id_col, text))
    passed = counts.filter(~base_failed())

    def drawn(df: DataFrame, n: int) -> DataFrame:
        rate = min(1.0, n / max(1, df.count()))
        draw = F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30)) / float(1 << 30)
        return df.filter((draw < rate) & F.col(id_col).isNotNull()).dropDuplicates([id_col, *COUNTS])

    order = F.xxhash64(id_col)
    sample = np.array(drawn(passed, fit_rows).orderBy(order, id_col).select(*COUNTS).collect(), np.int64).reshape(-1, len(COUNTS))
    marks = labels.select(F.col("doc_id").alias("_label_id"), "quality").filter(F.col("quality").isNotNull())
    named = passed.join(marks, F.col(id_col) == F.col("_label_id"))
    marked = np.array(drawn(named, label_rows).orderBy(order, id_col).select(*COUNTS, "quality").collect(), np.int64).reshape(-1, len(COUNTS) + 1)
    forest = None
    if len(sample) > 1:
        found = passed.agg(*[F.percentile_approx(c, [0.1, 0.5, 0.9], 10_000).alias(f"q{i}") for i, c in enumerate(feature_columns())]).first()
        spread = np.array([found[f"q{i}"] for i in range(len(found))], float).T
        forest = fitted(features(sample), features(marked[:, :-1]), marked[:, -1] == 1, keep_good, trees, spread)[0]
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        tool = model.value
        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS]).reshape(-1, len(COUNTS))
            score = tool.score(features(rows)) if tool else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "anomaly"])

    schema = T.StructType([*counts.schema.fields, T.StructField("anomaly", T.DoubleType())])
    scored = cut(counts.mapInArrow(run, schema))
    # At most 10,001 scores of four digits, for each kind of label.
    known = scored.filter(~base_failed()).join(marks, F.col(id_col) == F.col("_label_id"))
    tally = known.groupBy(F.round("anomaly", 4).alias("s"), (F.col("quality") == 1).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()
    scores, good, n = (np.array([r[c] for r in tally]) for c in ("s", "good", "n"))
    limit = calibrate(scores, good.astype(bool), keep_good, n) if len(tally) else 1.0
    judged = scored.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.round("anomaly", 4) <= float(limit)))


def op10_isolation_forest_quality(spark, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
