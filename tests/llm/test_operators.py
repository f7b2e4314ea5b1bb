"""Training-data operators against brute force, with nulls, blanks, repeats and odd columns."""

import random
import zlib

import numpy as np
import pytest

from lagweave.llm import common, decontamination, language, mixing, pii, quality, recurring, sharding, simhash, substring, suffixes, tokens
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, slot string, score string"


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    for k in range(0, n, 9):
        texts[k] = texts[k][:40] + " " + passage + " " + texts[k][40:]
    for k in range(5, n, 20):
        texts[k] = texts[k - 1]
    near = texts[7].split()
    texts[8] = " ".join([*near[:-1], "zzz"])
    texts += [None, "", " \n\t ", "Word", None, "la " * 300, texts[3], "A" * 500, "!!! 123", "x" * 30_000 + " " + passage]
    return [(i, t, ["en", "fr", None][i % 3], ["a", "a", "b", None][i % 4], None, "r", "s", "q") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, null and equal ids."""
    more = [*rows[:30], rows[4], rows[4], (None, *rows[9][1:]), (None, *rows[9][1:]), (3, "another text", None, None, 1, None, None, None)]
    return spark.createDataFrame(more, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_removed_as_brute_force_does(docs, rows):
    for hot in (2000, 2):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs, digest=True, hot=hot).collect()}
        assert got == brute.repeated_words([r[:2] for r in rows], 20)


def test_bytes_are_removed_as_brute_force_does(docs, rows):
    for hot in (2000, 2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, digest=True, hot=hot).collect()}
        assert got == brute.repeated_bytes([r[:2] for r in rows], 100)


@pytest.mark.parametrize("module,window,expected", [(substring, 20, brute.repeated_words), (suffixes, 100, brute.repeated_bytes)])
def test_anchors_larger_than_a_shard_are_settled_in_bounds(spark, docs, rows, module, window, expected):
    """One anchor in many contexts: its segments don't come to the shard's sort, and the marks are the same."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abc ") for _ in range(300))
    tails = ["".join(rng.choice("xyz ") for _ in range(60)) for _ in range(12)]
    many = [(1000 + k, rng.choice(tails) + passage[: rng.choice((90, 200))] + rng.choice(tails), *r[2:]) for k, r in enumerate(rows * 2)]
    more = docs.union(spark.createDataFrame(many, SCHEMA))
    bound, inner = 1500, module.resolver(window)

    def resolve(pieces):
        assert sum(len(p[0]) for p in pieces) <= 2 * bound
        return inner(pieces)

    found = recurring.marked_runs(common.with_row_ids(more, more.columns), module.shape(window), resolve, shard_bytes=bound)
    runs = {r["_rid"]: r["runs"] for r in found.collect()}
    for (doc, text, *_), want in zip([*rows, *many], expected([r[:2] for r in [*rows, *many]], window).values(), strict=True):
        units = recurring.encoded(text) if module is suffixes else recurring.encoded(text).split()
        assert recurring.covered(runs.get(doc), len(units), window).sum() == want[1]


def test_hot_anchors_are_a_share_of_all(spark, docs, monkeypatch):
    """An anchor above the fixed number is dealt by single windows only if it is a share of all occurrences too."""
    rows, shape = common.with_row_ids(docs, docs.columns), suffixes.shape(100)
    again = recurring.anchor_counts(rows, shape, "text").cache()
    most = again.agg({"n": "max"}).first()[0]
    for rare, some in ((1, False), (1 << 30, True)):
        monkeypatch.setattr(recurring, "RARE", rare)
        found = [r["hot"] for x in recurring.candidate_runs(rows, again, shape, "text", 2).collect() for r in x["runs"]]
        assert most > 2 and any(found) is some


def test_shards_without_equal_windows_are_settled(spark):
    """Texts that share an anchor, but no window: nothing goes, and nothing fails."""
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = [(k, "".join(rng.choice("stuvwxyz") for _ in range(40)) + shared + "".join(rng.choice("stuvwxyz") for _ in range(40))) for k in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert recurring.anchor_counts(docs, suffixes.shape(100), "text").count()
    got = suffixes.remove_repeats(docs, digest=True).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(k, 170, 0, 0) for k in range(6)]
    assert suffixes.resolver(100)([(t.encode(), k, 0, 71) for k, t in texts]) == []


def test_removal_keeps_columns_and_rows(odd, none):
    for operator in (substring.remove_repeats, suffixes.remove_repeats):
        out = operator(odd)
        assert out.columns == odd.columns and out.count() == odd.count()
        assert operator(none).count() == 0


def test_suffix_order_is_sorting():
    rng = np.random.default_rng(1)
    for k in range(60):
        t = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0]
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffixes.suffix_order(t, memory=64, buckets=4096 if k % 2 else 2).tolist() == want


def test_long_texts_are_anchored_in_stretches(monkeypatch):
    monkeypatch.setattr(recurring, "STRETCH", 64)
    shape = substring.shape(20)
    units = recurring.mixed(np.arange(1, 500, dtype=np.uint64))
    _, first, n = shape.runs(units)
    assert n.sum() == 480 and (np.diff(first) == n[:-1]).all()


def test_simhash_components_are_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute.simhash(r[1]) for r in rows]
    assert [got[r[0]]["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    assert {i: r["component_id"] for i, r in got.items()} == brute.linked([r[0] for r in rows], prints)


def test_simhash_cells_hold_all_links_even_when_hot(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = {int(b) for b in base}
    while len(prints) < 300:
        p = int(rng.choice(list(prints)))
        for bit in rng.integers(0, 63, rng.integers(1, 6)):
            p ^= 1 << int(bit)
        prints.add(p)
    ids = sorted(prints)
    nodes = spark.createDataFrame([(p,) for p in ids], "fp long")
    want = brute.linked(ids, [p % (1 << 64) for p in ids])
    for most in (4096, 16):
        labels = {r["u"]: r["label"] for r in simhash.components(simhash.links(nodes, max_cell=most)).collect()}
        assert {p: labels.get(p, p) for p in ids} == want


def test_deduplication_keeps_one_of_each_group(odd, none, docs):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len({brute.simhash(t) for t in texts})
    assert simhash.deduplicate(none).count() == 0


def test_counts_are_brute_force(docs, rows):
    for _, text, *_ in rows:
        assert quality.text_counts(text)[:5] == brute.rule_counts(text)


def test_quality_verdicts(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == docs.count() and all(not r["kept"] for r in out if r["base_failed"])
    unlabelled = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)
    assert quality.judge(none, labels).count() == 0


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 2)), [[40.0, 40.0]]]
    scores = quality.Forest(x).score(x)
    assert scores.argmax() == 500


def test_language_of_held_out_texts(spark, none):
    rng = random.Random(2)
    make = {"aa": "kop tar min dul".split(), "bb": "zez fiw gyx quv".split()}
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(make[lang]) + rng.choice(make[lang]) for _ in range(40)), lang, "s", 1, None, None, None))
    rows += [(900, None, "aa", None, None, None, None, None), (901, "12 !!", None, None, None, None, None, None), (None, "koptar", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in language.predict(docs, language.learn(docs.filter(~language.held_out())), "doc_id").collect()}
    assert all(out[i]["lang_pred"] == ("aa", "bb")[i % 2] and 0 <= out[i]["score"] <= 1 for i in range(200))
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[None]["lang_pred"] in ("aa", "bb")
    assert language.predict(none, {}, "doc_id").count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (900, 901)").count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_pieces_equal_whole_texts(tokenizer):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "'s", "é", "1", "!", "\x85", "　", "<|endoftext|>"]) for _ in range(14)) for _ in range(2000)]
    texts += ["".join(rng.choice(["a", " ", "\n", "\r\n", "\0", "日本", "x" * 22, "y" * 23, "z" * 24, "\n\n"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    # A table of 16 pieces is emptied again and again.
    for encoder in (tokens.Encoder.at(tokens.default_path()), tokens.Encoder(tokens.default_path(), 4)):
        assert encoder.encode([None, "", *texts]) == [b"", b""] + [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_images_round_trip_and_show_damage():
    rng = np.random.default_rng(0)
    for n in (1, 255, 257, 5000):
        ids = rng.geometric(0.02, n).astype(np.uint32)
        image = tokens.write_image(np.arange(2), np.array([n, 0]), ids)
        assert (tokens.read_image(image)[2] == ids).all()
    head = tokens.Head(image)
    for k in range(len(head.sizes)):
        assert (tokens.read_block(image, k) == ids[k * head.block : (k + 1) * head.block]).all()
    for at in (9, 40, 80):
        broken = bytearray(image)
        broken[at] ^= 1
        with pytest.raises(tokens.DamagedBlock):
            tokens.read_image(bytes(broken))
    broken = bytearray(image)
    broken[-300] ^= 255
    with pytest.raises(tokens.DamagedBlock):
        tokens.read_image(bytes(broken))


def test_token_files_hold_all_ids(docs, rows, none, tokenizer):
    got = {r["doc_id"]: r for r in tokens.output_of(common.with_row_ids(docs, ["doc_id", "text"]), tokens.default_path()).collect()}
    start = 0
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.output_of(common.with_row_ids(none, ["doc_id", "text"]), tokens.default_path()).count() == 0


def test_mixing_follows_weights(docs, odd, none):
    out = mixing.mix_sources(docs, block_rows=4, slots=50).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(out))) and len(out) == docs.count()
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0
    assert mixing.in_mixed_order(odd).columns == odd.columns


def test_schedule_deviates_by_less_than_a_block():
    blocks, weights = {"a": 700, "b": 150, "c": 40}, {"a": 0.5, "b": 0.3, "c": 0.2}
    plan = mixing.schedule(blocks, weights, 100)
    slots = {s: [p["base"] + k // p["share"] * p["period"] + p["places"][k % p["share"]] for q, p in enumerate(ps) for k in range((ps[q + 1]["first"] if q + 1 < len(ps) else blocks[s]) - p["first"])] for s, ps in plan.items()}
    assert sorted(x for v in slots.values() for x in v) == list(range(890))
    end = min(p[1]["base"] for p in plan.values() if len(p) > 1)
    for s, v in slots.items():
        share = plan[s][0]["share"] / plan[s][0]["period"]
        assert all(abs(sum(x < t for x in v) - share * t) < 1 for t in range(end + 1))


def test_shards_are_even_and_keep_groups(spark, docs, odd, none):
    for frame in (docs, odd):
        out = sharding.shard_documents(frame, n_shards=7).collect()
        counts = np.bincount([r["shard"] for r in out], minlength=7)
        assert len(out) == frame.count() and counts.max() - counts.min() <= 1
        for s in range(7):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    hot = spark.createDataFrame([(i, "same" if i < 300 else str(i)) for i in range(900)], "doc_id long, text string")
    shards = {r["shard"] for r in sharding.shard_documents(hot, n_shards=9).filter("text_crc32 = " + str(zlib.crc32(b"same"))).collect()}
    assert len(shards) <= 5
    assert sharding.shard_documents(none).count() == 0


def test_benchmark_windows_are_found(spark, docs, odd, none):
    bench = spark.createDataFrame([(1, "Alpha beta GAMMA delta eps zeta eta theta iota kappa lambda"), (2, "One two"), (2, "One two"), (3, None), (4, "..."), (None, "solo")], "item_id long, text string")
    texts = [(1, "x ALPHA beta gamma. delta eps zeta eta theta iota, kappa LAMBDA y"), (2, "one TWO three one-two"), (3, None), (4, "alpha beta"), (5, "SOLO"), (5, "SOLO")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_hit int")
    for block in (32 << 20, 100):
        out = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.find_hits(frame, bench, block_bytes=block).collect())
        assert out == [(1, 13, 11, ["1"]), (2, 5, 4, ["2"]), (3, 0, 0, []), (4, 2, 0, []), (5, 1, 1, []), (5, 1, 1, [])]
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4]
    spans = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(frame, bench, remove="spans").collect()}
    assert spans == {1: "x y", 2: "three ", 3: None, 4: "alpha beta", 5: ""}
    assert decontamination.find_hits(none, bench).count() == 0
    assert decontamination.find_hits(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_pseudonyms_keep_format_and_links(spark, none):
    text = "a@b.example.com 4111 1111 1111 1111, (635) 555-6187 10.1.2.3 2020-02-29; ssn 123-45-6789 999.1.1.1 password=abc12345X"
    frame = spark.createDataFrame([(1, text), (2, text), (3, "clean text"), (4, None), (5, "4111111111111112 1.2.3")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(frame, "k").collect()}
    assert out[1]["text"] == out[2]["text"] and out[3]["text"] == "clean text" and out[4]["text"] is None
    assert out[5]["text"] == "4111111111111112 1.2.3" and out[1]["n_changed"] == 7
    for old in ("a@b.example", "4111 1111 1111 1111", "555-6187", "10.1.2.3", "2020-02-29", "123-45-6789", "abc12345X"):
        assert old not in out[1]["text"]
    card = [int(c) for c in out[1]["text"].split(",")[0][-19:] if c.isdigit()]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(card))) % 10 == 0
    assert pii.pseudonymize(none, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    for a, b in ((7, 11), (10, 100)):
        got = spark.range(a * b).select(pii.feistel(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), a, b, "k", "t").alias("v")).collect()
        assert sorted(r["v"] for r in got) == list(range(a * b))
