"""Words meet a dictionary without being shuffled, and a dictionary too large for that finds the same."""

from spanforge.operators import feeds


def test_words_are_not_shuffled_for_a_small_dictionary(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the Old Keeper of the Grey Tower saw Iron, iron ring"), (2, "the the THE GREY tower")], "id long, text string")
    names = spark.createDataFrame([("the Grey Tower",), ("Grey Tower",), ("Iron",), ("Iron Ring",), ("the",)], "name string")
    found = feeds.mentions(texts, names, ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    want = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(feeds, "BROADCAST_NAMES", 0)
    assert sorted(tuple(r) for r in feeds.mentions(texts, names, ["id"]).collect()) == want
    assert (1, "the Grey Tower", 5) in want and (2, "the Grey Tower", 3) in want and (1, "Iron Ring", 10) in want
