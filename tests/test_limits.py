"""Results without default limits."""

from lodestone.operators.aggregate import Agg, aggregate


def test_set_holds_all_members(spark):
    (row,) = aggregate(spark.range(1500), [], [Agg("ids", "set", "id")]).collect()
    assert row.ids == list(range(1500))
