"""What is shuffled and joined on the way, by Spark's own counts."""

import random

import numpy as np
import pytest

from lagweave.llm import common, resemblance, simhash, tokens


@pytest.fixture
def joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def wait(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def stages(spark):
    wait(spark)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def join_rows(spark, after):
    """Rows out of all joins of executions after ``after``; the last execution."""
    wait(spark)
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    all_runs = store.executionsList()
    for k in range(all_runs.size()):
        run = all_runs.apply(k).executionId()
        if run <= after:
            continue
        last, nodes, values = max(last, run), store.planGraph(run).allNodes(), store.executionMetrics(run)
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if "Join" in n.name() else ():
                value = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and value.isDefined():
                    rows += int(value.get().replace(",", ""))
    return rows, last


def test_components_read_the_links_of_a_group_once(joined_by_shuffle):
    """Near copies, each linked with five others: a later round must not read their links again."""
    spark, rng = joined_by_shuffle, random.Random(5)
    links = sorted({tuple(sorted(rng.sample(range(600), 2))) for _ in range(3000)})
    edges = common.cut(spark.createDataFrame(links, "a long, b long"))
    _, before = join_rows(spark, -1)
    found = simhash.components(edges).collect()
    assert {(r["u"], r["label"]) for r in found} == {(x, 0) for pair in links for x in pair}
    rows, _ = join_rows(spark, before)
    # Both ends of each link are named once; the rest are pointers, a few for each node.
    assert 0 < rows <= 2 * len(links) + 10 * 600


def test_texts_without_copies_are_not_shuffled(joined_by_shuffle):
    """Only ids, cells and the texts of a few rows move; a join of all texts would move them all."""
    spark, rng = joined_by_shuffle, random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(2000)) for _ in range(120)]
    texts += [texts[0] + " more", texts[1]]
    docs = common.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    first = max(s.stageId() for s in stages(spark))
    assert sorted(r["doc_id"] for r in resemblance.deduplicate(docs).collect()) == list(range(120))
    moved = sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > first)
    assert 0 < moved < 0.5 * sum(map(len, texts))


def test_among_is_exact_for_any_ids(joined_by_shuffle):
    spark, rng = joined_by_shuffle, random.Random(7)
    for ids in ([], [-1], [rng.randrange(-(2**63), 2**63) for _ in range(5000)], range(0, 6000, 2)):
        keys = {*ids, *range(3000), 2**63 - 1, -(2**63)}
        rows = spark.createDataFrame([(k, str(k)) for k in keys], "k long, t string")
        inside, outside = common.among(rows, "k", spark.createDataFrame([(i,) for i in ids], "id long"))
        assert sorted(r["k"] for r in inside.collect()) == sorted(ids)
        assert sorted(r["k"] for r in outside.collect()) == sorted(keys - {*ids})


def test_new_words_of_letters_go_to_the_model_alone():
    """The pre-tokenizer leaves them as they are; what it may divide still passes through it."""
    texts = ["Some newword cafés, don't ÀÐÿ × ÷ ab12 日本 À Āa ªµ \t\n x.", "a b", "\x1cq", "<|endoftext|>"]
    encoder, passed = tokens.Encoder(tokens.default_path(), 8), []
    tool = encoder.tool

    class Seen:
        def encode_batch_fast(self, pieces, **how):
            passed.extend(pieces)
            return tool.encode_batch_fast(pieces, **how)

        def encode(self, text, **how):
            return tool.encode(text, **how)

    encoder.tool = Seen()
    assert encoder.encode(texts) == [np.array(tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not {"Some", " newword", " cafés", " ÀÐÿ"} & set(passed)
    assert {" ab12", " 日本"} <= set(passed)
