"""The pipeline's near-duplicate stage against all pairs of texts."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from lagweave.llm import decontamination, language, mixing, resemblance, simhash
from lagweave.llm.common import documents

DATA = "/root/testdata/sf0.001"


def jaccard(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (x, y)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def planted():
    """Texts, copies with one to eight words changed, groups of many near copies, blanks and repeats."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 220))) for _ in range(40)]
    for k in range(40):
        for changes in (1, 2, 4, 8):
            w = texts[k].split()
            for at in rng.sample(range(len(w)), changes):
                w[at] = rng.choice(words)
            texts.append(" ".join(w))
    base = [rng.choice(words) for _ in range(64)]
    for _ in range(60):
        w = list(base)
        w[rng.randrange(64)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [None, "", " \n", "One word", "one WORD", texts[3], texts[3].upper()]
    return texts


@pytest.mark.parametrize("small,block", [(16, 512), (2, 8)])
def test_near_copies_go_as_all_pairs_say(spark, small, block):
    texts = planted()
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in resemblance.deduplicate(docs, small=small, block=block).collect())
    assert kept == sorted(set(label))
    if small == 16:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept
    assert resemblance.deduplicate(docs.limit(0)).count() == 0


def test_pipeline_drops_what_resembles(spark):
    rows = {r["doc_id"]: r for r in documents(spark, DATA).collect()}
    docs = documents(spark, DATA)
    found = language.predict(docs, language.learn(docs.filter(~language.held_out())), "doc_id").collect()
    label = {r["doc_id"]: r["doc_id"] for r in found if not r["rejected"]}
    for i in label:
        for j in label:
            if j < i and label[i] != label[j] and jaccard(rows[i]["text"], rows[j]["text"]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    hit = {r["doc_id"] for r in decontamination.find_hits(docs, documents(spark, DATA, "benchmark")).filter("n_hit > 0").collect()}
    kept = sorted(set(label.values()) - hit)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(out) == kept
    order = [r["doc_id"] for r in mixing.mix_sources(spark.createDataFrame([rows[i] for i in kept], docs.schema)).orderBy("position").collect()]
    assert sorted(out, key=lambda i: out[i]["start"]) == order


def test_pairs_meet_in_cells_of_segment_counts(spark):
    sets = [resemblance.shingles(t) for t in planted()]
    m = 3
    prints, cells = zip(*(resemblance.sketch(s, m) for s in sets), strict=True)
    seen = 0
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if not shared or not resemblance.alike(shared, len(sets[i]) + len(sets[j])):
                continue
            a, b = prints[i].view(np.uint64), prints[j].view(np.uint64)
            apart = np.bitwise_count(a ^ b).sum(dtype=int)
            assert np.bitwise_count(simhash.count_codes(a) ^ simhash.count_codes(b)).sum(dtype=int) <= apart <= resemblance.MOST
            assert set(cells[i].tolist()) & set(cells[j].tolist())
            seen += 1
    assert seen > 100
    rows = {s.tobytes(): [k, len(s), cells[k].tolist(), *prints[k].tolist()] for k, s in reversed(list(enumerate(sets))) if len(s)}
    schema = "node long, n long, cells array<int>, w0 long, w1 long, w2 long, w3 long"
    nodes = spark.createDataFrame([tuple(r) for r in rows.values()], schema)
    whole = {(r["u"], r["label"]) for r in simhash.components(resemblance.links(nodes, m)).collect()}
    assert {(r["u"], r["label"]) for r in simhash.components(resemblance.links(nodes, m, max_cell=8)).collect()} == whole


def test_bits_differ_as_reckoned():
    """Of all pairs of sizes that may be alike, up to 24, none differs in more bits than the number of cells is set for."""
    odds = [np.array([math.comb(n, k) / 2**n for k in range(n + 1)]) for n in range(25)]
    for a in range(2, 25):
        for b in range(a, 25):
            for s in range(1, a + 1):
                if not resemblance.alike(s, a + b) or s == b:
                    continue
                up = [np.array([sum(odds[n - s][k] for k in range(n - s + 1) if 2 * (c + k) > n) for c in range(s + 1)]) for n in (a, b)]
                differ = (odds[s] * (up[0] * (1 - up[1]) + up[1] * (1 - up[0]))).sum()
                assert differ <= (resemblance.DIFFER_FEW if b <= resemblance.FEW else resemblance.DIFFER)
