"""The mixing schedule against the target weights themselves."""

from fractions import Fraction

from lagweave.llm import mixing


def sent_slots(plan, blocks):
    """The slots of each source's blocks."""
    out = {}
    for s, phases in plan.items():
        ends = [*(p["first"] for p in phases[1:]), blocks[s]]
        out[s] = [p["base"] + k // p["share"] * p["period"] + p["places"][k % p["share"]] for p, end in zip(phases, ends, strict=True) for k in range(end - p["first"])]
    return out


def test_hot_source_among_hundreds_stays_within_a_block():
    blocks = {"hot": 1500, **{f"s{i}": 12 for i in range(300)}}
    weights = {"hot": 150.0, **{f"s{i}": 1.0 + i % 2 * 0.1 for i in range(300)}}
    plan = mixing.schedule(blocks, weights, 1000)
    slots = sent_slots(plan, blocks)
    assert sorted(x for v in slots.values() for x in v) == list(range(sum(blocks.values())))
    end = min(p[1]["base"] for p in plan.values() if len(p) > 1)
    total = sum(map(Fraction, weights.values()))
    for s, v in slots.items():
        share, sent, taken = Fraction(weights[s]) / total, 0, set(v)
        for t in range(end + 1):
            assert abs(sent - share * t) < 1
            sent += t in taken


def test_rows_follow_the_weights(spark, monkeypatch):
    rows = [(i, "hot" if i < 900 else f"s{i % 40}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    outs = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", most)
        outs.append([tuple(r) for r in mixing.mix_sources(docs, block_rows=4).orderBy("position").collect()])
    assert outs[0] == outs[1] and [r[-1] for r in outs[0]] == list(range(2100))
    # doc_id, source, block, phase, slot, release, deadline, position
    assert [r[4] for r in outs[0]] == sorted(r[4] for r in outs[0])
    hot = 900**0.5 / (900**0.5 + 40 * 30**0.5)
    for r in outs[0]:
        assert r[5] <= r[4] < r[6]
        if r[1] == "hot" and r[3] == 0:
            assert abs(r[2] - hot * r[4]) < 1
    late = mixing.mix_sources(docs, weights={"hot": 0, **{f"s{i}": 1 for i in range(40)}}, block_rows=4).orderBy("position").collect()
    assert [r["source"] for r in late[1200:]] == ["hot"] * 900
