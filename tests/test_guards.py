from cohortscope.operators.skew import salted_semi_join
from cohortscope.plans.guards import plan_violations
from cohortscope.session import checkpoint_dir, configure_once
from conftest import rows


def test_checkpoint_dir_comes_from_the_session(spark):
    current = checkpoint_dir(spark)
    assert current and current == spark.sparkContext.getCheckpointDir()


def test_session_is_configured_once(spark):
    configure_once(spark)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    configure_once(spark)
    kept = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert kept == "false"


def test_salted_semi_join_gives_distinct_pairs(spark):
    facts = spark.createDataFrame(
        [(1, 10), (1, 10), (1, 11), (2, 10), (None, 10), (3, None)], "user_id long, item long")
    members = spark.createDataFrame([(1,), (3,), (None,)], "user_id long")
    out = salted_semi_join(facts, members, "user_id", "item")
    assert sorted(rows(out), key=str) == [(1, 10), (1, 11), (3, None)]
    assert plan_violations(out) == []
