"""Trip, annual, regional and permit reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.functions.dates import (
    date_range_text,
    parse_ts,
    season,
    shift_years,
    trip_month,
)
from wakeline.functions.text import contains, join_words, title_case
from wakeline.operators.joins import latest_by
from wakeline.plans.life import NOT_YET, DEAD, age_class_of

# Fiords of the timeline in coast order, and days before 1 September.
FIORDS = ("CHARLES", "NANCY", "DOUBTFUL", "DAGG", "DUSKY", "CHALKY", "PRESERVATION")
SEPTEMBER_OFFSET = 244

# Survey areas of each region, and who counts as not identified.
REGION_AREAS = {
    "northern": ("GEORGE", "NANCY"),
    "middle": ("DOUBTFUL",),
    "southern": ("DAGG", "DUSKY", "CHALKY", "PRESERVATION"),
}
NOT_IDENTIFIED = ("CULL", "UNMA", "")

# Latitudes and longitude that bound the regions' survey tracks.
NORTH_POINT = -45.1062
MIDDLE_NORTH, MIDDLE_SOUTH = -45.1851, -45.3809
INNER_SOUTH, INNER_WEST = -45.4835, 166.9169
SOUTH_POINT = -45.31667


def trip_summary(
    survey: DataFrame, photos: DataFrame, daily: DataFrame, distance: DataFrame, periods: DataFrame
) -> DataFrame:
    """One row per trip: dates, survey and encounter days, sightings, photos, animals, miles."""
    mark = contains(F.col("event_type"), "Encounter")
    base = survey.agg(
        F.countDistinct("date").alias("survey_days"),
        F.countDistinct(F.when(mark, F.col("date"))).alias("encounter_days"),
        F.max("sighting_number").alias("sightings"),
    )
    last = periods.agg(F.max("end_date")).scalar()
    text = lambda d: F.date_format(d, "dd MMM yyyy")
    return base.withColumns(
        {
            "trip_start": text(periods.agg(F.min("start_date")).scalar()),
            "trip_end": text(last),
            "recent": text(shift_years(last, -1)),
            "older": text(shift_years(last, -2)),
            "photos": photos.agg(F.countDistinct("filename")).scalar(),
            "individuals": daily.agg(F.countDistinct("name")).scalar(),
            "track_dist": distance.agg(F.bround(F.sum("dist_nm"), 0)).scalar(),
        }
    )


def crew_lines(crew: DataFrame) -> DataFrame:
    return crew.withColumn(
        "crew_line",
        F.concat(F.col("first"), F.lit(" "), F.col("last"), F.lit(", "), F.col("organization")),
    )


def population_text(estimates: DataFrame, pod: str) -> DataFrame:
    """Sentence with the newest estimate of a pod."""
    newest = latest_by(estimates, "year").where(F.col("pod") == pod)
    sentence = F.format_string(
        "%d: %d (95%% CI = %d--%d)", F.col("year"), F.col("est"), F.col("lcl"), F.col("ucl")
    )
    return newest.select("year", "pod", sentence.alias("popsent"))


def place_list(names: Column) -> Column:
    """``a, b, and c`` for an array of places; two read ``a, and b``."""
    return join_words(names, ", ", ", and ")


def timeline(
    log: DataFrame,
    since: int | None = None,
    fiords: Sequence[str] | None = None,
    exclude_vessels: Sequence[str] = (),
) -> DataFrame:
    """Start and end rows of every trip with ordinal day, label and calf-year."""
    keys = ["fiord", "year", "season", "folder", "photos"]
    rows = log if fiords is None else log.where(F.col("fiord").isin(*fiords))
    if exclude_vessels:
        rows = rows.where(~F.col("vessel").isin(*exclude_vessels))
    if since is not None:
        rows = rows.where(F.col("year") >= since)
    rows = rows.unpivot(keys, ["start_date", "end_date"], "start_end", "date_text")
    date = parse_ts(F.col("date_text"), "d-M-yyyy").cast("date")
    rows = rows.withColumn("date", date).drop("date_text")
    september = (F.month("date") >= 9).cast("int")
    return rows.withColumns(
        {
            "ordinal": F.dayofyear("date"),
            "moda": F.date_format("date", "dd-MMM"),
            "tripid": F.concat("fiord", "folder"),
            "calfyear": F.col("year") + F.coalesce(september, F.lit(0)),
            "sep_start": F.dayofyear("date") - SEPTEMBER_OFFSET,
        }
    )


def effort_table(
    survey_days: DataFrame, trips: DataFrame, captures: DataFrame, year: int
) -> DataFrame:
    """Per area and trip of a year: season, dates, effort and sighting days, individuals."""
    first, last = (F.lit(f"{y}-01-01").cast("date") for y in (year, year + 1))
    days = survey_days.where((F.col("date") >= first) & (F.col("date") < last))
    days = days.select("date").distinct()
    effort = (
        days.join(trips.select("date", "survey_area", "trip"), "date")
        .where(F.col("survey_area").isNotNull())
        .groupBy("survey_area", "trip")
        .agg(
            date_range_text(F.min("date"), F.max("date")).alias("date_range"),
            F.count(F.lit(1)).alias("effort_days"),
        )
    )
    seen = captures.where(F.col("year") == year).groupBy("survey_area", "trip").agg(
        F.countDistinct("date").alias("sighting_days"),
        F.countDistinct("id_name").alias("individuals"),
    )
    return effort.join(seen, ["survey_area", "trip"], "left").select(
        title_case(F.col("survey_area")).alias("survey_area"),
        "trip",
        title_case(season(trip_month("trip"))).alias("season"),
        "date_range",
        "effort_days",
        "sighting_days",
        "individuals",
    )


def abundance_table(estimates: DataFrame, subset: str = "Calendar") -> DataFrame:
    rows = estimates.where(F.col("n1").isNotNull() & (F.col("subset") == subset))
    ci = F.concat(F.col("lcl").cast("string"), F.lit("–"), F.col("ucl").cast("string"))
    return rows.select(
        title_case(F.col("pod")).alias("pod"), "year", "n1", "n2", "m2", "nhat", ci.alias("ci95"), "n"
    )


def individuals(captures: DataFrame, year: int) -> DataFrame:
    rows = captures.where(F.col("year") == year)
    return rows.select("survey_area", "id_name").distinct()


def _region_of_area() -> Column:
    region = None
    for name, areas in REGION_AREAS.items():
        hit = F.col("survey_area").isin(*areas)
        region = (F if region is None else region).when(hit, name)
    return region


def _regions_of_position(southern: str) -> Column:
    """Regions a survey position counts for. ``southern='reference'`` keeps the published
    inequality (north of the southern point), ``'south'`` the documented meaning."""
    lat, lon = F.col("latitude"), F.col("longitude")
    middle = ((lat < MIDDLE_NORTH) & (lat > MIDDLE_SOUTH)) | (
        (lat < MIDDLE_SOUTH) & (lat > INNER_SOUTH) & (lon > INNER_WEST)
    )
    south = lat > SOUTH_POINT if southern == "reference" else lat < SOUTH_POINT
    hits = {"northern": lat > NORTH_POINT, "middle": middle, "southern": south}
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in hits.items()]))


def _year_range(year: int):
    return F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))


def identified_in_regions(captures: DataFrame, year: int) -> DataFrame:
    rows = captures.where(_year_range(year) & ~F.col("id_name").isin(*NOT_IDENTIFIED))
    return rows.withColumn("region", _region_of_area()).where(F.col("region").isNotNull())


def regional_report(
    captures: DataFrame, survey: DataFrame, year: int, southern: str = "reference"
) -> DataFrame:
    """Survey days, encounter days and sightings (group, date) per region."""
    seen = identified_in_regions(captures, year)
    encountered = seen.groupBy("region").agg(F.countDistinct("date").alias("encounter_days"))
    sightings = (
        seen.select("region", "group", "date")
        .distinct()
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("sightings"))
    )
    days = (
        survey.where(_year_range(year))
        .select("date", F.explode(_regions_of_position(southern)).alias("region"))
        .groupBy("region")
        .agg(F.countDistinct("date").alias("survey_days"))
    )
    table = days.join(encountered, "region", "full").join(sightings, "region", "full")
    return table.fillna(0, subset=["survey_days", "encounter_days", "sightings"])


def regional_demography(captures: DataFrame, life: DataFrame, year: int) -> DataFrame:
    """Individuals per region by age class and by sex; southern areas are pooled."""
    seen = identified_in_regions(captures, year)
    area = F.when(F.col("region") != "southern", F.col("survey_area"))
    seen = seen.select("region", area.alias("survey_area"), "id_name").distinct()
    details = life.select(
        F.col("name").alias("id_name"), "pod", "sex", age_class_of(year).alias("ageclass")
    )
    return _two_rollups(seen.join(details, "id_name", "left"), ["region", "survey_area", "pod"])


def _two_rollups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by (keys, ageclass) and by (keys, sex) from one pass."""
    k = [F.col(c) for c in keys]
    by_age = F.grouping("ageclass") == 0
    grouped = rows.groupingSets(
        [[*k, F.col("ageclass")], [*k, F.col("sex")]], *k, F.col("ageclass"), F.col("sex")
    ).agg(F.count(F.lit(1)).alias("n"), by_age.alias("__age"))
    return grouped.select(
        *keys,
        F.when(F.col("__age"), "ageclass").otherwise("sex").alias("kind"),
        F.when(F.col("__age"), F.col("ageclass")).otherwise(F.col("sex")).alias("value"),
        "n",
    )


def permit_tables(captures: DataFrame, life: DataFrame, year: int) -> DataFrame:
    """Individuals per area and year by permit age class (A, U, J) and by sex.

    ``life`` needs survey_area. The class is next year's for animals born after the
    permit year, else this year's; everything but A and U reads J.
    """
    now, then = age_class_of(year), age_class_of(year + 1)
    known = life.withColumns({"__now": now, "__then": then}).where(
        (F.col("__then") != NOT_YET) & (F.col("__now") != DEAD)
    )
    known = known.select(
        "survey_area", F.col("name").alias("id_name"), "sex", "birth_year", "__now", "__then"
    )
    seen = captures.select("survey_area", "year", "id_name").distinct()
    rows = seen.join(known, ["survey_area", "id_name"], "left")
    age = F.when(F.lit(year) < F.col("birth_year"), F.col("__then")).otherwise(F.col("__now"))
    rows = rows.withColumn("__age", age)
    young = ~F.col("__age").isin("A", "U")
    rows = rows.withColumn("ageclass", F.when(young, "J").otherwise(F.col("__age")))
    return _two_rollups(rows, ["survey_area", "year"])


