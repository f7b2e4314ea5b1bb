"""Secrets in any case, and every date of 1900 to 2099."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from lagweave.llm import pii


def test_secret_names_match_in_any_case(spark):
    texts = ['TOKEN = "ABCDEFGHij"', "PASSWORD=abcdEFGHx", "Token: qwertyuiop", "Api_Key=zxcvbnmasd", "secret: asdfghjklq"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pseudonymize(frame, "k").collect():
        old = texts[r["doc_id"]]
        name = old[: max(old.find("="), old.find(":")) + 1]
        assert r["n_matched"] == r["n_changed"] == 1 and r["text"].startswith(name) and len(r["text"]) == len(old)
        assert r["text"] != old


def test_dates_are_permuted_up_to_the_last_day(spark):
    days = [str(date(1900, 1, 1) + timedelta(n)) for n in range(73_049)]
    assert days[-1] == "2099-12-31"
    frame = spark.createDataFrame([(d,) for d in days], "d string")
    out = [r["v"] for r in frame.repartition(4).select(pii._date(F.col("d"), "k").alias("v")).collect()]
    assert sorted(out) == days
    last = spark.createDataFrame([(n, d) for n, d in enumerate(days[-150:])], "doc_id long, text string")
    got = pii.pseudonymize(last, "k").collect()
    assert sum(r["n_changed"] for r in got) >= 149
