"""Relations that must hold between the tables, on the small data."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from wakeline.plans import capture, life
from wakeline.sources import bindings as b


@pytest.fixture(scope="module")
def tables(spark):
    t = b.Tables(spark, SMALL)
    history = life.life_history(b.life_table(t), b.captures(t)).cache()
    return t, b.captures(t).cache(), history


def test_discovery_totals(tables):
    t, _, history = tables
    daily = capture.daily_captures(b.photos(t), life.alive_at(history, 1998)).cache()
    curve = capture.discovery_curve(daily, daily.select("date")).cache()
    n = daily.select("name").distinct().count()
    got = curve.agg(F.sum("ui"), F.sum("vi"), F.max("disc")).first()
    assert tuple(got) == (n, n, n)
    running = [r.disc for r in curve.orderBy("date").collect()]
    assert running == sorted(running)
    assert capture.capture_frequency(daily).agg(F.sum("fi")).first()[0] == n


def test_estimate_is_at_least_each_sample(tables):
    t, _, _ = tables
    rows = capture.two_sample_abundance(capture.season_flags(b.captures_by_segment(t), after_year=1994)).collect()
    assert rows and all(r.nhat >= max(r.n1, r.n2) and r.m2 <= min(r.n1, r.n2) for r in rows)


def test_filling_gaps_only_adds_individuals(tables):
    """Inside an individual's own span every captured year is in the filled table."""
    _, caps, history = tables
    years = {"after": 1994, "until": 2001}
    present = capture.presence_years(caps, history, **years).select("id_name", "calfyear")
    span = history.withColumns({"id_name": F.col("name"), "start": life.first_calf_year(history)})
    seen = capture.known_captures(caps, history, "calfyear", **years).select("id_name", F.col("year").alias("calfyear"))
    seen = seen.distinct().join(span.select("id_name", "start", "last_year"), "id_name")
    inside = seen.where("calfyear BETWEEN start AND last_year").where("id_name NOT LIKE '%D-2%'")
    assert inside.count() > 0
    assert inside.join(present, ["id_name", "calfyear"], "left_anti").count() == 0
    assert present.distinct().count() == present.count()


def test_age_class_has_one_row_per_individual_and_year(tables):
    _, _, history = tables
    rows = life.age_class(history, 1995, 2001)
    assert rows.count() == history.count() * 7
    assert rows.select("name", "year").distinct().count() == rows.count()
