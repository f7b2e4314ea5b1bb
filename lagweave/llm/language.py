"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded sample of labelled
texts. A text is compressed with every dictionary, as lower-case words, in pieces of ``piece``
bytes that each start afresh from it, and the language with the smallest total wins. Where the
runner-up is closer than ``min_margin`` the prediction is marked as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, with_row_ids

UNKNOWN = "und"
GAPS = re.compile(r"[\W\d_]+")
#: Bytes of known text before a short one; texts that count as short; margins that count as narrow.
LEAD, SHORT, NARROW = 1000, 400, 0.01


def plain(text: str) -> bytes:
    """Lower-case words, each between single spaces."""
    return f" {GAPS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_docs: int = 400, dict_bytes: int = 64 << 10, max_langs: int = 256) -> dict[str, bytes]:
    """Dictionaries by language, the language with most rows first (it wins ties).

    About ``sample_docs`` labelled documents of a language are drawn by the hash of their id, once
    for each id, and read whole. A dictionary holds ``dict_bytes`` of their words, drawn and
    shuffled by hash, so that words and their parts are matched, but no passage that documents of
    several languages share. These two bounds are the only things here that don't grow with the
    input. Rows with a null text or language are not learned from; over ``max_langs`` languages raise.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    found = known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()
    if len(found) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    counts = {r[lang]: r["n"] for r in found}
    if not counts:
        return {}

    def table(values: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col(lang))

    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(draw < table({k: min(1.0, sample_docs / n) for k, n in counts.items()}))
    # A language whose draw left nothing is still learned, from its first row by hash.
    least = known.groupBy(lang).agg(F.min_by(F.struct(F.xxhash64(id_col).alias("h"), F.col(text).alias("t")), F.xxhash64(id_col)).alias("s")).select(lang, "s.h", "s.t")
    texts = picked.groupBy(lang, F.xxhash64(id_col).alias("h")).agg(F.min(text).alias("t")).union(least).dropDuplicates([lang, "h"])
    words = cut(texts.select(lang, "h", F.posexplode(F.split("t", r"[^\p{L}]+")).alias("i", "w")).filter("w <> ''"))
    sizes = {r[lang]: r["b"] for r in words.groupBy(lang).agg(F.sum(F.octet_length("w") + 1).alias("b")).collect()}
    wanted = dict_bytes + LEAD
    order = F.xxhash64(F.lit("word"), "h", "i")
    some = words.filter(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < table({k: min(1.0, 1.2 * wanted / b) for k, b in sizes.items()}))
    held: dict[str, list] = {}
    for r in some.select(lang, order.alias("o"), F.lower("w").alias("w")).collect():
        held.setdefault(r[lang], []).append((r["o"], r["w"]))
    names = sorted((k for k in held), key=lambda k: (-counts[k], k))
    return {k: b" " + " ".join(w for _, w in sorted(held[k])).encode("utf-8", "surrogatepass")[:wanted] + b" " * 8 for k in names}


class Classifier:
    """Compressors of all languages; made once in each Python worker's task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece: int):
        self.names, self.piece = list(dictionaries), piece
        self.tools, self.leads, self.bases = [], [], []
        for body in dictionaries.values():
            lead, rest = body[:LEAD], body[LEAD:] if len(body) > 2 * LEAD else body
            d = zstandard.ZstdCompressionDict(rest, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            tool = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.tools.append(tool)
            self.leads.append(lead)
            self.bases.append(len(tool.compress(lead)))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (how much larger the runner-up is, relative to the best)."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        body = plain(text)
        parts = [body[i : i + self.piece] for i in range(0, len(body), self.piece)]
        found = [sum(len(c.compress(p)) for p in parts) for c in self.tools]
        over, best = self._over(found)
        if len(body) < SHORT or min((x for i, x in enumerate(over) if i != best), default=1.0) < NARROW:
            # Too little to tell apart by itself: what it adds to a known text of each language.
            known = zip(self.tools, self.leads, self.bases, strict=True)
            found = [max(1, sum(len(c.compress(lead + p)) - base for p in parts)) for c, lead, base in known]
            over, best = self._over(found)
        margin = min((x for i, x in enumerate(over) if i != best), default=1.0)
        return self.names[best], 1.0 / sum(2.0 ** (-50 * x) for x in over), margin

    @staticmethod
    def _over(found: list[int]) -> tuple[list[float], int]:
        best = min(range(len(found)), key=lambda i: (found[i], i))
        return [(x - found[best]) / found[best] for x in found], best


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str, text: str = "text", level: int = 6, piece: int = 1024, min_margin: float = 0.002) -> DataFrame:
    """``id_col``, lang_pred, score, margin, rejected: a row for each row.

    A null text, and one without a letter, is ``und`` with score 0 and rejected, as is any text
    where no language was learned. Texts are used whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        tool = Classifier(shared.value, level, piece)
        for b in batches:
            rows = [tool.predict(t.as_py()) for t in b.column(1)]
            names, scores, margins = zip(*rows, strict=True) if rows else ((), (), ())
            rejected = [n == UNKNOWN or m < min_margin for n, m in zip(names, margins, strict=True)]
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "lang_pred", "score", "margin", "rejected"])

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType())]
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, t) for n, t in fields]])
    return docs.select(id_col, text).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """A quarter of the documents, by the checksum of their id; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    dictionaries = learn(docs.filter(~held_out()))
    rows = with_row_ids(docs, docs.columns)
    gone = cut(predict(rows, dictionaries, "_rid").filter("rejected").select("_rid"))
    return rows.join(gone, "_rid", "left_anti").select(*docs.columns)


def op6_compression_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    dictionaries = learn(docs.filter(~held_out()))
    found = predict(docs, dictionaries, "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
