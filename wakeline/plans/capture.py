"""Capture histories: discovery, seasons, two-sample abundance and censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.dates import SEASON_OVERRIDES, season, shift_years, trip_month
from wakeline.functions.estimators import chapman, chapman_interval
from wakeline.functions.text import contains, title_case
from wakeline.operators.shape import level_rank, pivot_counts, with_group_stats
from wakeline.plans.life import age_class_of, first_calf_year

# Order and labels of the age classes, sexes, seasons.
AGE_LEVELS = ("A", "S-A", "J", "C", "U")
AGE_LABELS = {"A": "Adult", "S-A": "Sub-Adult", "J": "Juvenile", "C": "Calf*", "U": "Unknown"}
SEXES = ("F", "M", "X")
NOT_SURVEYED = 999
OUTSIDE_PODS = "NORTHERN"
PROVISIONAL_NAME = "D-2"

# Days that a display matrix may have.
MATRIX_DAYS = 100


def age_label(ageclass: Column) -> Column:
    label = None
    for code, text in AGE_LABELS.items():
        label = (F if label is None else label).when(ageclass == code, text)
    return label


def identified(name: Column) -> Column:
    """True for a certain individual; NULL names are out."""
    junk = name.rlike(r"\?|_|CULL|^UK") | name.isin("", "CALF", "UNMA")
    return F.coalesce(~junk, F.lit(False))


def daily_captures(photos: DataFrame, alive: DataFrame) -> DataFrame:
    """(individual, date) presence with life-history columns.

    Photos collapse to distinct (name, date) map-side before the life-history join.
    """
    days = photos.where(identified(F.col("id_name"))).select(
        F.col("id_name").alias("name"), "date"
    )
    details = alive.select("name", "sex", "birth_year", "first_year", "ageclass")
    return days.distinct().join(details, "name", "left")


def trip_days(daily: DataFrame, most: int = MATRIX_DAYS) -> list[str]:
    """Dates of a trip's daily captures, in order: a first pass that brings ``most`` + 1 rows at most.

    A trip of more days has no display form and is refused.
    """
    found = daily.select("date").where("date IS NOT NULL").distinct().orderBy("date").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"captures on more than {most} days are too many columns for one trip's matrix")
    return [str(r.date) for r in found]


def capture_matrix(
    daily: DataFrame, dates: Sequence[str] | None = None, most: int = MATRIX_DAYS
) -> DataFrame:
    """Presence (0/1) per individual with one column per day of the trip, for display.

    ``daily`` holds the captures of one trip; its days become the columns (see `trip_days`)
    where no ``dates`` are given. Counting is one aggregation that combines map-side.
    """
    keys = ["name", "sex", "birth_year", "first_year", "ageclass"]
    days = trip_days(daily, most) if dates is None else list(dates)
    wide = daily.withColumn("date", F.col("date").cast("string")).groupBy(*keys).pivot("date", days)
    return wide.agg(F.max(F.lit(1))).fillna(0, subset=days)


def age_sex_table(daily: DataFrame) -> DataFrame:
    """Age class × sex counts; every sex column present, rows in age order."""
    animals = daily.select("name", "sex", "ageclass").distinct()
    table = pivot_counts(animals, ["ageclass"], "sex", SEXES)
    rank = level_rank(F.col("ageclass"), AGE_LEVELS)
    return table.select(age_label(F.col("ageclass")).alias("age_class"), *SEXES, rank.alias("rank"))


def discovery_curve(daily: DataFrame, survey_days: DataFrame) -> DataFrame:
    """Individuals per day, new ones, last ones and the cumulative count.

    Everything is reduced to one row per day before the running sum, whose single
    window therefore sees calendar days only.
    """
    seen = daily.select("date", "name").distinct()
    # an individual's rows are its days; first and last are flags on them, so one pass counts all three
    own = Window.partitionBy("name")
    flags = {"ui": F.min("date").over(own), "vi": F.max("date").over(own)}
    rows = seen.withColumns({c: (F.col("date") == end).cast("bigint") for c, end in flags.items()})
    rows = rows.withColumn("ni", F.lit(1).cast("bigint"))
    rows = rows.unionByName(survey_days.select("date").distinct(), allowMissingColumns=True)
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ni", "ui", "vi")]
    days = rows.groupBy("date").agg(*counts)
    by_day = Window.orderBy("date")
    return days.withColumns(
        {
            "survey": F.dayofyear("date"),
            "disc": F.sum("ui").over(by_day),
            "order": F.row_number().over(by_day),
            "year": F.year("date"),
        }
    )


def capture_frequency(daily: DataFrame) -> DataFrame:
    """How many individuals were captured on 1, 2, … days."""
    per_id = daily.groupBy("name").agg(F.countDistinct("date").alias("times"))
    return per_id.groupBy("times").agg(F.count(F.lit(1)).alias("fi"))


def not_seen_recently(alive: DataFrame, daily: DataFrame, as_of: Column) -> DataFrame:
    """Individuals last seen one to two years before ``as_of`` and not on this trip."""
    absent = alive.join(daily.select("name").distinct(), "name", "left_anti")
    gone = absent.where(
        (F.col("last_date") < shift_years(as_of, -1))
        & (F.col("last_date") >= shift_years(as_of, -2))
    )
    shown = F.when(F.length("name") > 2, title_case(F.col("name"))).otherwise(F.col("name"))
    return gone.withColumns(
        {
            "last_year": F.year("last_date"),
            "name_sex": F.concat(shown, F.lit(" ("), F.col("sex"), F.lit(")")),
        }
    )


def not_seen_table(unseen: DataFrame) -> DataFrame:
    table = pivot_counts(unseen, ["last_year", "ageclass"], "sex", SEXES)
    return table.select("last_year", age_label(F.col("ageclass")).alias("age_class"), *SEXES)


# --- seasons and abundance ---------------------------------------------------------------


def season_flags(
    captures: DataFrame, scheme: str = "calendar", after_year: int | None = None, overrides=SEASON_OVERRIDES
) -> DataFrame:
    """0/1 per season for each (year, pod, individual).

    ``captures`` needs id_name, pod, trip and the scheme's year. The aggregation
    combines map-side, so an individual with a third of the captures is one row
    per task before the shuffle.
    """
    if scheme not in ("calendar", "calfyear"):
        raise ValueError(f"unknown scheme {scheme!r}")
    year = "year" if scheme == "calendar" else "calfyear"
    rows = within(captures, year, after_year).select(
        F.col(year).alias("year"),
        "pod",
        "id_name",
        season(trip_month("trip"), year, overrides).alias("season"),
    )
    flags = [
        F.max((F.col("season") == s).cast("int")).alias(s.lower())
        for s in ("WINTER", "SPRING", "AUTUMN", "SUMMER")
    ]
    table = rows.groupBy("year", "pod", "id_name").agg(*flags)
    return table.fillna(0, subset=["winter", "spring", "autumn", "summer"])


def _initial(spring, summer, summer_surveyed):
    return (summer == 1) | (~summer_surveyed & (spring == 1))


def season_captures(flags: DataFrame, scheme: str = "calendar") -> DataFrame:
    """Season flags with 999 where a pod-year was not surveyed, and the recapture flag."""
    names = ("winter", "spring", "autumn", "summer")
    surveyed = {f"__{c}": F.max(c) for c in names}
    rows = with_group_stats(flags, ["year", "pod"], surveyed)
    has = {c: F.col(f"__{c}") == 1 for c in names}
    hit = {c: F.col(c) == 1 for c in names}
    if scheme == "calendar":
        both = (
            F.when(has["winter"] & has["spring"], hit["winter"] & hit["spring"])
            .when(has["spring"] & has["autumn"], hit["autumn"] & hit["spring"])
            .when(has["winter"] & has["autumn"], hit["autumn"] & hit["winter"])
            .otherwise(False)
        )
        extra = {}
    else:
        initial = _initial(F.col("spring"), F.col("summer"), has["summer"])
        second = hit["winter"] | (~has["winter"] & hit["autumn"])
        extra = {"initial": initial.cast("int"), "second": second.cast("int")}
        both = initial & second
    # 'both' reads the 0/1 flags, so it is computed together with their masking
    masked = {c: F.when(has[c], F.col(c)).otherwise(NOT_SURVEYED) for c in names}
    return rows.withColumns({**masked, **extra, "both": both.cast("int")}).select(
        "year", "pod", "id_name", *names, *extra, "both"
    )


def two_sample_abundance(
    flags: DataFrame, scheme: str = "calendar", ci: str = "reference"
) -> DataFrame:
    """Chapman estimate per pod and year from season flags.

    One aggregation gives every season total and overlap, so whether a season was
    surveyed, the samples and the recaptures follow without joining back.
    """
    w, s, a, u = (F.col(c) for c in ("winter", "spring", "autumn", "summer"))
    total = lambda c: F.sum(c).cast("bigint")
    sums = flags.groupBy("year", "pod").agg(
        total(w).alias("w"), total(s).alias("s"), total(a).alias("a"), total(u).alias("u"),
        total(w * s).alias("ws"), total(a * s).alias("as_"), total(u * w).alias("uw"),
        total(u * a).alias("ua"), total(s * w).alias("sw"), total(s * a).alias("sa"),
        F.count(F.lit(1)).alias("n"),
    )
    c = {k: F.col(k) for k in ("w", "s", "a", "u", "ws", "as_", "uw", "ua", "sw", "sa")}
    if scheme == "calendar":
        winter = c["w"] > 0
        n1 = F.when(winter, c["w"]).when(c["a"] > 0, c["a"])
        n2 = F.when(c["s"] > 0, c["s"])
        m2 = F.when(winter, c["ws"]).otherwise(c["as_"])
        label = F.when(winter, "Winter Spring").otherwise("Autumn Spring")
        subset = "Calendar"
    else:
        summer, winter = c["u"] > 0, c["w"] > 0
        n1 = F.when(summer, c["u"]).otherwise(c["s"])
        n2 = F.when(winter, c["w"]).otherwise(c["a"])
        m2 = F.when(summer, F.when(winter, c["uw"]).otherwise(c["ua"])).otherwise(
            F.when(winter, c["sw"]).otherwise(c["sa"])
        )
        label, subset = F.lit(str(NOT_SURVEYED)), "Calfyear"
    table = sums.select(
        "year", "pod", n1.alias("n1"), n2.alias("n2"), m2.alias("m2"), label.alias("season"), "n"
    ).where(F.col("n1").isNotNull() & F.col("n2").isNotNull())
    d1, d2, dm = (F.col(k).cast("double") for k in ("n1", "n2", "m2"))
    low, high = chapman_interval(d1, d2, dm, ci)
    whole = lambda x: x.cast("bigint")  # noqa: E731  (cast truncates toward zero)
    return table.select(
        "year", "pod", "n1", "n2", "m2",
        whole(chapman(d1, d2, dm)).alias("nhat"), whole(low).alias("lcl"), whole(high).alias("ucl"),
        F.lit(subset).alias("subset"), "season", "n",
    )


def combine_estimates(estimates: DataFrame, stored: DataFrame) -> DataFrame:
    """Append stored estimates, drop those without a census and exact repeats."""
    both = estimates.unionByName(stored, allowMissingColumns=True)
    return both.where(F.col("n").isNotNull()).distinct()


# --- censuses ----------------------------------------------------------------------------


def excluded(name: Column, year: Column, exclude: Sequence[tuple[str, int]], provisional: bool = True):
    """Hand-listed (name, year) exclusions and provisional names."""
    out = contains(name, PROVISIONAL_NAME) if provisional else F.lit(False)
    for who, when in exclude:
        out = out | ((name == who) & (year == when))
    return out


def within(rows: DataFrame, year: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Rows with ``after`` < year <= ``until``; None is no bound, and a bound drops NULL years."""
    rows = rows if after is None else rows.where(F.col(year) > after)
    return rows if until is None else rows.where(F.col(year) <= until)


def known_captures(
    captures: DataFrame,
    life: DataFrame,
    year: str,
    after: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Distinct (year, individual, trip) captures with their pod, within the years, if given.

    Captures collapse before the join, so its input is individuals × trips.
    """
    rows = within(captures, year, after, until)
    rows = rows.select(F.col(year).alias("year"), "trip", "id_name").distinct()
    pods = life.select(F.col("name").alias("id_name"), "pod").where(F.col("pod") != OUTSIDE_PODS)
    return rows.join(pods, "id_name")


def census(
    captures: DataFrame,
    life: DataFrame,
    exclude: Sequence[tuple[str, int]] = (),
    after: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Individuals per pod by calf-year, with the same number by calendar year."""

    both = captures.select(
        "id_name",
        F.explode(
            F.array(
                F.struct(F.lit("n_calfyear").alias("kind"), F.col("calfyear").alias("year")),
                F.struct(F.lit("n_year").alias("kind"), "year"),
            )
        ).alias("at"),
    ).select("id_name", "at.kind", "at.year")
    rows = within(both, "year", after, until).distinct()
    rows = rows.where(~excluded(F.col("id_name"), F.col("year"), exclude))
    pods = life.select(F.col("name").alias("id_name"), "pod").where(F.col("pod") != OUTSIDE_PODS)
    counted = rows.join(pods, "id_name").groupBy(F.col("year").alias("calfyear"), "pod")
    # rows are distinct individuals by now unless the life table repeats one
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("id_name")))
    table = counted.agg(of("n_calfyear").alias("n_calfyear"), of("n_year").alias("n_year"))
    return table.where("n_calfyear > 0").withColumn("n_year", F.expr("nullif(n_year, 0)"))


def trip_census(captures: DataFrame, life: DataFrame, after: int | None = None, until: int | None = None):
    """Individuals per pod, year and trip."""
    rows = known_captures(captures, life, "year", after, until)
    return rows.groupBy("pod", "year", "trip").agg(F.countDistinct("id_name").alias("n"))


def adult_census(
    captures: DataFrame,
    life: DataFrame,
    exclude: Sequence[tuple[str, int]] = (),
    exclude_areas: Sequence[tuple[str, int]] = (),
    after: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Known adults and unknowns per pod and calf-year.

    The class is computed for the captured year only; no individual × year table.
    """
    rows = within(captures, "calfyear", after, until)
    for area, year in exclude_areas:
        rows = rows.where(~((F.col("survey_area") == area) & (F.col("calfyear") == year)))
    rows = rows.select("id_name", "calfyear").distinct()
    rows = rows.where(~excluded(F.col("id_name"), F.col("calfyear"), exclude))
    details = life.where(F.col("pod") != OUTSIDE_PODS).withColumnRenamed("name", "id_name")
    rows = rows.join(details, "id_name").withColumn("ageclass", age_class_of("calfyear"))
    rows = rows.where(F.col("ageclass").isin("A", "U"))
    return rows.groupBy("pod", "calfyear").agg(F.countDistinct("id_name").alias("n"))


def presence_years(
    captures: DataFrame,
    life: DataFrame,
    exclude: Sequence[tuple[str, int]] = (),
    after: int | None = None,
    until: int | None = None,
    drop_years: Sequence[int] = (),
) -> DataFrame:
    """(individual, calf-year) pairs counted as present once gaps are filled.

    Years run from birth (or first calf-year) to the last year, among years with
    any capture; the starting year itself counts only when captured.
    """
    rows = known_captures(captures, life, "calfyear", after, until)
    seen = rows.select("id_name", F.col("year").alias("calfyear")).distinct()
    # years are bounded by the calendar: one array instead of a join on a handful of values
    years = seen.agg(F.collect_set("calfyear")).scalar()
    details = life.withColumns({"id_name": F.col("name"), "first_birth": first_calf_year(life)})
    known = seen.select("id_name").distinct().join(details, "id_name")
    span = F.when(
        F.col("first_birth") <= F.col("last_year"),
        F.array_intersect(F.sequence("first_birth", "last_year"), years),
    )
    spread = known.withColumn("calfyear", F.explode(span))
    spread = spread.where(~F.col("calfyear").isin(*drop_years)) if drop_years else spread
    spread = spread.where(~excluded(F.col("id_name"), F.col("calfyear"), exclude))
    marked = spread.join(seen.withColumn("captured", F.lit(1)), ["id_name", "calfyear"], "left")
    counted = F.col("captured").isNotNull() | (F.col("calfyear") != F.col("first_birth"))
    return marked.where(counted).drop("captured")


def gap_filled_census(presence: DataFrame) -> DataFrame:
    """Individuals known alive per pod and calf-year."""
    return presence.groupBy("pod", "calfyear").agg(F.count(F.lit(1)).alias("calfyear_ng"))


def compare_census(gap_filled: DataFrame, counted: DataFrame) -> DataFrame:
    return gap_filled.join(counted, ["pod", "calfyear"], "left")


def gap_filled_by_sex(presence: DataFrame) -> DataFrame:
    """Known alive adults and unknowns by sex group (F against everything else)."""
    sex = F.when(F.col("sex") == "F", "F").when(F.col("sex") != "F", "M_U")
    rows = presence.withColumns(
        {"ageclass": age_class_of("calfyear"), "sex_assume": sex}
    ).where(F.col("ageclass").isin("A", "U"))
    return rows.groupBy("pod", "sex_assume", "calfyear", "ageclass").agg(
        F.count(F.lit(1)).alias("n")
    )


def photo_effort(
    captures: DataFrame,
    areas: Sequence[str] | None = None,
    before: int | None = None,
    exclude: Sequence[tuple[str, int]] = (),
) -> DataFrame:
    """Distinct photographs per area and calf-year; all areas and years unless told otherwise."""
    rows = captures.where(F.col("id_name") != "CULL")
    rows = rows if areas is None else rows.where(F.col("survey_area").isin(*areas))
    rows = rows if before is None else rows.where(F.col("calfyear") < before)
    for area, year in exclude:
        rows = rows.where(~((F.col("survey_area") == area) & (F.col("calfyear") == year)))
    shots = rows.select("survey_area", "calfyear", "date", "filename", "photographer").distinct()
    return shots.groupBy(F.col("survey_area").alias("pod"), "calfyear").agg(
        F.count(F.lit(1)).alias("n")
    )


def photo_effort_range(effort: DataFrame) -> DataFrame:
    return effort.groupBy("pod").agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n")
    )
