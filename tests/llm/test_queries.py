"""Whole queries on a small table against plain Python."""

import heapq
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lagweave.llm import common, language, mixing, oracles, pii, registry, sharding, simhash, suffixes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in common.documents(spark, DATA).collect()}


def test_shards_by_hand(spark, rows):
    out = {r["doc_id"]: r for r in registry.QUERIES["op3_label_propagation_shards"](spark, DATA).collect()}
    assert set(out) == set(rows)
    slots = {}
    for i, r in out.items():
        body = (rows[i]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = np.bincount([r["shard"] for r in out.values()], minlength=40)
    assert len(counts) == 40 and counts.max() - counts.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def schedule_by_hand(counts, block_rows, weights):
    """The earliest deadline among released blocks, slot by slot, with exact fractions."""
    left = {s: -(-n // block_rows) for s, n in counts.items()}
    done, now, slot_of = dict.fromkeys(left, 0), 0, {}
    while left:
        total, begun, base = sum(Fraction(weights[s]) for s in left), dict.fromkeys(left, 0), now
        while all(left[s] for s in left):
            ready = []
            for s in left:
                w, k = Fraction(weights[s]) / total, begun[s]
                if (k / w).__floor__() <= now - base:
                    heapq.heappush(ready, (-(-(k + 1) // w), s))
            s = heapq.heappop(ready)[1]
            slot_of[s, done[s]] = now
            begun[s], done[s], left[s], now = begun[s] + 1, done[s] + 1, left[s] - 1, now + 1
        left = {s: n for s, n in left.items() if n}
    return slot_of


def test_mix_by_hand(spark, rows):
    out = registry.QUERIES["op4_pfair_mix"](spark, DATA).collect()
    counts = {}
    for r in rows.values():
        counts[mixed(r["source"])] = counts.get(mixed(r["source"]), 0) + 1
    want = schedule_by_hand(counts, 32, {s: n**0.5 for s, n in counts.items()})
    assert {(mixed(r["source"]), r["block"]): r["slot"] for r in out} == want
    assert sorted(r["position"] for r in out) == list(range(len(rows))) and {r["doc_id"] for r in out} == set(rows)
    by_place = sorted(out, key=lambda r: r["position"])
    assert [r["slot"] for r in by_place] == sorted(r["slot"] for r in out)


def mixed(source):
    return "-" if source is None else "=" + source


def test_languages_by_hand(spark, rows):
    docs = common.documents(spark, DATA)
    tool = language.Classifier(language.learn(docs.filter(~language.held_out())), 6, 1024)
    out = {r["doc_id"]: r for r in registry.QUERIES["op6_compression_language"](spark, DATA).collect()}
    assert set(out) == set(rows)
    right = []
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == tool.predict(rows[i]["text"])[0]
        if not any(c.isalpha() for c in rows[i]["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and rows[i]["lang"]:
            right.append(r["lang_pred"] == rows[i]["lang"])
    assert np.mean(right) > 0.95


def test_signs_that_are_no_letters(spark):
    texts = ["½ ²", "①", "12", "_", "ª", "", None]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate([*texts, "kop tar min"])], SCHEMA)
    got = [r["lang_pred"] for r in language.predict(docs, language.learn(docs.filter("doc_id = 7")), "doc_id").orderBy("doc_id").collect()]
    assert got == ["aa" if t and any(map(str.isalpha, t)) else "und" for t in [*texts, "kop"]]


def test_pseudonyms_of_all_documents(spark, rows):
    out = {r["doc_id"]: r for r in registry.QUERIES["op2_feistel_pseudonyms"](spark, DATA).collect()}
    found, address = re.compile(pii.ANY), re.compile(pii.IPV4)
    for i, r in out.items():
        old = rows[i]["text"]
        assert (r["text"] is None) == (old is None)
        if old is not None:
            # An address may get longer or shorter; everything else keeps its length.
            assert (len(r["text"]) == len(old) or address.search(old)) and r["n_matched"] == sum(1 for _ in found.finditer(old))
            assert r["n_changed"] <= r["n_matched"] and (r["n_matched"] or r["text"] == old)
    other = {r["doc_id"]: r["text"] for r in pii.op2_feistel_pseudonyms(spark, DATA, key="another").collect()}
    assert any(other[i] != r["text"] for i, r in out.items())


def test_own_columns_stay_in_mixed_order(spark):
    docs = spark.createDataFrame([(i, "a", "KEEP", 7.5, -1) for i in range(50)], "doc_id long, source string, slot string, position double, block int")
    assert sorted(tuple(r) for r in mixing.in_mixed_order(docs).collect()) == sorted(tuple(r) for r in docs.collect())


def test_ids_of_any_kind_are_told_apart(spark):
    for kind, ids in (("string", ["b", "a", "c", None]), ("decimal(5,1)", None), ("double", [1.2, 1.7, 1.2, 3.0])):
        ids = ids or [__import__("decimal").Decimal(x) for x in ("1.2", "1.7", "2.0", "2.0")]
        docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
        got = common.with_row_ids(docs, ["doc_id", "text"]).collect()
        assert len({r["_rid"] for r in got}) == 4
        ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["_rid"])]
        assert ordered == sorted((x for x in ids if x is not None)) + [x for x in ids if x is None]


def test_the_manhattan_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 9)).tolist())) for _ in range(3000)], np.uint64)
    b = a ^ flips
    counts = lambda x: np.array([[(int(v) >> k & 3).bit_count() for k in range(0, 64, 2)] for v in x])
    bound = np.bitwise_count(simhash.count_codes(a) ^ simhash.count_codes(b))
    assert (bound == np.abs(counts(a) - counts(b)).sum(1)).all() and (bound <= np.bitwise_count(flips)).all()
    assert (simhash.near(a, b, simhash.count_codes(a), simhash.count_codes(b), 4) == (np.bitwise_count(flips) <= 4)).all()


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT", 4)
    rows_ = spark.createDataFrame([(k, i) for i in range(300) for k in ([0] if i % 3 else [i])], "k long, i long")
    table = rows_.groupBy("k").count().withColumnsRenamed({"k": "key", "count": "n"}).filter("n > 1")
    for how in ("inner", "left"):
        got = common.spread_join(rows_, table, "k", "key", "n", 300, __import__("pyspark.sql.functions", fromlist=["col"]).col("i"), how, least=10)
        assert sorted((r["k"], r["i"], r["n"]) for r in got.collect()) == sorted((r["k"], r["i"], r["n"]) for r in rows_.join(table, rows_["k"] == table["key"], how).collect()) if how == "inner" else got.count() == 300


def test_shards_with_long_and_equal_texts(spark):
    texts = ["é" * 50_000, None, "", "x", "x", "x"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sharding.shard_documents(docs, n_shards=3).collect():
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body)


def test_byte_repeats_are_those_of_sql(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé\n ") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    texts = [*base, base[3], base[4] + base[5], None, "", "z" * 500, base[6][:150] + "q" + base[6]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    duck = duckdb.connect()
    duck.register("t", docs.toPandas())
    duck.sql("CREATE VIEW documents AS SELECT doc_id, text FROM t")
    want = {r[0]: r[1:] for r in duck.sql(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({oracles.OP9})").fetchall()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, digest=True).collect()}
    assert got == want
