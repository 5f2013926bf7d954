"""What the lineage query moves."""

from loglake.plans import catalog


def test_paths_are_digested_before_they_move(spark, sf_dir):
    lines = catalog.QUERIES["lineage"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [n for n, line in enumerate(lines) if "Join LeftOuter" in line]
    assert min(n for n, line in enumerate(lines) if "md5(" in line) > max(joins[:2])
