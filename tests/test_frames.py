"""Frames of exported lines."""

from loglake.plans.service import export_rows
from loglake.sources import exports


def test_a_frame_writes_its_line_once(spark, sf_dir):
    frames = exports.syslog(export_rows(spark, sf_dir), "c", "g", octets=True)
    assert frames._jdf.queryExecution().optimizedPlan().toString().count("date_format") == 1
