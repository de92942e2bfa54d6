"""Joins of near-dedup stay on the executors: a table below the broadcast threshold would be built in the driver's memory."""

from test_text_operators import docs_of

from knnscore.llm import simhash

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def plans(spark):
    """Final physical plans of all queries run so far, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(i).executionId(): runs.apply(i).physicalPlanDescription() for i in range(runs.size())}


def test_joins_of_near_dedup_are_not_built_on_the_driver(spark):
    before = spark.conf.get(THRESHOLD)
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    docs = docs_of(spark, [*texts, *(f"{t} more" for t in texts), *texts])
    old = plans(spark)
    try:
        spark.conf.set(THRESHOLD, "10MB")
        prints = simhash.table(simhash.fingerprints(docs), "prints")
        assert simhash.near_components(prints).count() == 18
        assert simhash.keep_one_of_each(docs).count() == 6
    finally:
        spark.conf.set(THRESHOLD, before)
    new = [p for k, p in plans(spark).items() if k not in old]
    assert any("SortMergeJoin" in p for p in new)
    assert not [p for p in new if "BroadcastExchange" in p]
