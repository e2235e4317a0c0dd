"""Individual life histories: pods, first and last dates, age classes, births."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.dates import calf_year
from wakeline.functions.text import basename, join_words
from wakeline.operators.joins import asof_join, complete, expand_years
from wakeline.operators.shape import blank_to_null, normalise_schema, share_of_total

YEAR_DAYS = 366 * 86_400

# Entry-number ranges of the pods (from, below, pod).
POD_RANGES = ((None, 2000, "DOUBTFUL"), (2000, 3000, "DUSKY"), (3000, 4000, "NORTHERN"))

# Age-class limits in years.
ADULT_AGE, ADULT_YEARS_KNOWN, SUBADULT_AGE = 9, 8, 3

NOT_YET, DEAD = "NA", "D"
NO_IMAGE = "noimageavail.jpg"

# Calves that a catalogue card names.
CALVES_SHOWN = 20


def with_pod(life: DataFrame) -> DataFrame:
    """Pod from the entry number; numbers outside every range give NULL."""
    n, pod = F.col("entryno"), None
    for low, high, name in POD_RANGES:
        hit = (n < high) if low is None else (n >= low) & (n < high)
        pod = (F if pod is None else pod).when(hit, name)
    return life.withColumn("pod", pod)


def normalise_life(life: DataFrame) -> DataFrame:
    """Blank text to NULL and text years to numbers."""
    years = {c: "int" for c in ("birth_year", "first_year", "death_year")}
    return normalise_schema(blank_to_null(life), casts=years)


def with_first_calf(life: DataFrame) -> DataFrame:
    """Birth year of each mother's first calf."""
    first = (
        life.where(F.col("mom").isNotNull())
        .groupBy(F.col("mom").alias("name"))
        .agg(F.min("birth_year").alias("first_calf"))
    )
    return life.join(first, "name", "left")


def first_last_seen(captures: DataFrame) -> DataFrame:
    return captures.groupBy(F.col("id_name").alias("name")).agg(
        F.max("calfyear").alias("last_calfyear"),
        F.max("date").alias("last_date"),
        F.min("date").alias("first_date"),
    )


def inutero_dates(life: DataFrame, captures: DataFrame) -> DataFrame:
    """Last date each calf's mother was photographed before the calf's own first date.

    A strict backward as-of lookup on (mother, date): pairs of captures and calves
    are never enumerated.
    """
    calves = life.where(F.col("mom").isNotNull() & F.col("first_date").isNotNull()).select(
        "name", "mom", F.col("first_date").cast("timestamp_ntz").alias("ts")
    )
    seen = captures.select(
        F.col("id_name").alias("mom"), F.col("date").cast("timestamp_ntz").alias("ts")
    ).distinct()
    found = asof_join(calves, seen, "ts", ["mom"], allow_exact=False, span_seconds=YEAR_DAYS)
    return found.select("name", F.col("matched.ts").cast("date").alias("inutero")).where(
        F.col("inutero").isNotNull()
    )


def life_history(
    life: DataFrame, captures: DataFrame, last_date_overrides: DataFrame | None = None
) -> DataFrame:
    """Pod, first calf, first and last dates, last year (a death year wins), in-utero date."""
    table = with_pod(with_first_calf(normalise_life(life)))
    table = table.join(first_last_seen(captures), "name", "left")
    table = table.withColumn("last_year", F.coalesce("death_year", "last_calfyear"))
    if last_date_overrides is not None:
        fixed = last_date_overrides.select("name", F.col("last_date").alias("__fixed"))
        table = table.join(fixed, "name", "left").withColumn(
            "last_date", F.coalesce("__fixed", "last_date")
        )
    table = table.join(inutero_dates(table, captures), "name", "left")
    return table.select(
        "pod", "name", "code", "sex", "mom", "first_calf", "birth_year", "inutero",
        "first_year", "first_date", "death_year", "last_year", "last_date",
    )


def age_class_of(year: int | str) -> Column:
    """Age class in ``year`` (a number or column name) from birth_year, first_year,
    first_calf and death_year."""
    return F.expr(
        f"""CASE
          WHEN {year} < first_year OR {year} < birth_year THEN '{NOT_YET}'
          WHEN {year} > death_year THEN '{DEAD}'
          WHEN {year} - birth_year >= {ADULT_AGE} OR {year} >= first_calf
            OR (birth_year IS NULL AND {year} - first_year >= {ADULT_YEARS_KNOWN}) THEN 'A'
          WHEN {year} - birth_year >= {SUBADULT_AGE} THEN 'S-A'
          WHEN {year} - birth_year > 0 THEN 'J'
          WHEN {year} - birth_year = 0 THEN 'C'
          ELSE 'U' END"""
    )


def age_class(life: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Every individual in every year with its age class, in long form."""
    return expand_years(life, first, last).withColumn("ageclass", age_class_of("year"))


def age_class_at(life: DataFrame, year: int) -> DataFrame:
    """Individuals with their class in one year; no expansion."""
    return life.withColumns({"year": F.lit(year), "ageclass": age_class_of(year)})


def alive_at(life: DataFrame, year: int, pod: str | None = None) -> DataFrame:
    """Individuals born or known by ``year`` and not dead, optionally of one pod."""
    table = age_class_at(life, year).where(~F.col("ageclass").isin(NOT_YET, DEAD))
    return table if pod is None else table.where(F.col("pod") == pod.upper())


def primiparity(life: DataFrame) -> DataFrame:
    """Age of each mother at her first calf with the overall mean, minimum and maximum."""
    aged = life.withColumn("primo_age", F.col("first_calf") - F.col("birth_year"))
    aged = aged.where(F.col("primo_age").isNotNull())
    overall = {f"{n}_primo_age": f("primo_age") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))}
    # one subquery for the three figures
    figures = aged.agg(*[c.alias(n) for n, c in overall.items()]).select(F.struct(*overall)).scalar()
    return aged.select("pod", "name", "first_calf", "birth_year", "inutero", "primo_age").withColumns(
        {n: figures[n] for n in overall}
    )


def last_seen(life_long: DataFrame, min_year: int, by: str = "last_year") -> DataFrame:
    """Individuals per pod, last year and class in that year.

    ``by='last_date'`` uses the year of the last date instead of ``last_year``; only
    the ``last_year`` form shows individuals not yet born or known as calves.
    """
    last = F.year("last_date") if by == "last_date" else F.col("last_year")
    ended = life_long.withColumn("last_seen_year", last).where(
        (F.col("last_seen_year") == F.col("year")) & (F.col("last_seen_year") >= min_year)
    )
    counted = ended.groupBy("pod", "last_seen_year", "ageclass").agg(F.countDistinct("name").alias("n"))
    if by == "last_date":
        return counted
    return counted.replace(NOT_YET, "C", subset=["ageclass"])


def last_seen_list(life_long: DataFrame, reporting_year: int) -> DataFrame:
    """Individuals last dated in the year before the report, with age and minimum age."""
    year = F.year("last_date")
    rows = life_long.where((year == F.col("year")) & (year == reporting_year - 1))
    return rows.select(
        "pod",
        "name",
        "sex",
        (reporting_year - F.col("birth_year")).alias("age"),
        (reporting_year - F.col("first_year")).alias("at_least_age"),
        "first_year",
        "last_date",
        "ageclass",
    )


def composition(life: DataFrame, captures: DataFrame, year: int, by: str = "ageclass") -> DataFrame:
    """Numbers and proportions per pod of the individuals captured in ``year``.

    Individuals first known in that very year count as calves.
    """
    seen = captures.where(F.col("year") == year).select(F.col("id_name").alias("name")).distinct()
    known = age_class_at(life, year).withColumnRenamed("ageclass", "__class")
    rows = seen.join(known, "name", "left")
    calf = (F.col("__class") == NOT_YET) & (F.col("first_year") == year)
    rows = rows.withColumns(
        {"ageclass": F.when(calf, "C").otherwise(F.col("__class")), "year": F.lit(year)}
    )
    return share_of_total(rows, ["pod", "year", by], ["pod"])


def births(life: DataFrame, since: int) -> DataFrame:
    """Calves per pod and birth year; pod-years without any are zero."""
    counted = (
        life.where(F.col("birth_year") >= since)
        .groupBy("pod", "birth_year")
        .agg(F.countDistinct("name").alias("n"))
    )
    return complete(counted, ["pod", "birth_year"], {"n": 0})


def catalogue_size(life: DataFrame, by: str = "pod", until: int | None = None) -> DataFrame:
    rows = life if until is None else life.where(F.col("first_year") <= until)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def first_calf_year(life: DataFrame) -> Column:
    """Calf-year an individual starts: birth year, else first year by September rule."""
    start = F.col("first_year") + F.coalesce(
        calf_year(F.col("first_date")) - F.year("first_date"), F.lit(0)
    )
    return F.coalesce(F.col("birth_year"), start)


def catalogue_images(paths: DataFrame) -> DataFrame:
    """Catalogue pictures as (name, part, type, path), from the path alone."""
    path = F.col("path")
    token = lambda n: F.nullif(F.regexp_extract(path, rf"\b\w{{{n}}}\b", 0), F.lit(""))
    rows = paths.select(
        F.nullif(F.regexp_extract(basename(path), "^[^_]+", 0), F.lit("")).alias("name"),
        token(2).alias("part"),
        token(5).alias("type"),
        "path",
    )
    return rows.where(F.col("name").isNotNull())


def calves_of(life: DataFrame, shown: int = CALVES_SHOWN) -> DataFrame:
    """(name, calves, n_calves) per mother: her calves in words, the first ``shown`` by name.

    Ranks above ``shown`` leave before the shuffle (window group limit) and calves are counted
    map-side, so a placeholder mother of a third of all rows is ``shown`` rows per task.
    """
    pairs = life.where(F.col("mom").isNotNull()).select("mom", "name").distinct()
    rank = F.row_number().over(Window.partitionBy("mom").orderBy("name"))
    listed = pairs.where(F.col("name").isNotNull()).withColumn("__rank", rank).where(F.col("__rank") <= shown)
    listed = listed.groupBy("mom").agg(F.array_sort(F.collect_list("name")).alias("__calves"))
    counted = pairs.groupBy("mom").agg(F.count("name").alias("n_calves"))
    more = F.col("n_calves") - F.size("__calves")
    said = F.when(more > 0, F.concat(F.array_join("__calves", ", "), F.lit(" and "), more.cast("string"), F.lit(" more")))
    return counted.join(listed, "mom").select(
        F.col("mom").alias("name"), said.otherwise(join_words(F.col("__calves"))).alias("calves"), "n_calves"
    )


def catalogue_cards(life: DataFrame, images: DataFrame, year: int) -> DataFrame:
    """One row per pictured individual: details, mother, calves, one picture per side.

    An individual with several pictures of a side shows the first by path and their
    number; ``catalogue_images`` lists them all. So with calves: the first `CALVES_SHOWN`
    by name and how many more there are.
    """
    full = F.col("part").isNotNull() & F.col("type").isNotNull()
    side = lambda p: F.when(full & (F.col("part") == p), F.col("path"))
    cards = images.groupBy("name").agg(
        F.min(side("LD")).alias("left_image"),
        F.count(side("LD")).alias("n_left"),
        F.min(side("RD")).alias("right_image"),
        F.count(side("RD")).alias("n_right"),
    )
    details = age_class_at(life, year).join(calves_of(life), "name", "left")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
            ("code", "sex", "ageclass", "mom", "birth_year", "first_year", "last_year")}
    said = F.when(F.col("sex") == "F", F.coalesce("calves", F.lit("NA"))).otherwise("")
    card = cards.join(details, "name", "left")
    picture = {c: F.coalesce(F.col(c), F.lit(NO_IMAGE)) for c in ("left_image", "right_image")}
    return card.withColumn("calves", said).withColumns({**text, **picture}).select(
        "name", *text, "calves", "left_image", "n_left", "right_image", "n_right"
    )
