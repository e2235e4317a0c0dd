"""The whole trip compilation with its shared tables written once.

Six later tables read the survey table, and each ordered operator reads its input
twice; staging between the steps keeps every raw row to one read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wakeline.plans.survey import (
    TRACK_SPAN,
    clean_tracks,
    effort_marks,
    effort_periods,
    encounter_marks,
    encounter_state,
    encounters,
    locate_sightings,
    on_effort,
    survey_table,
    thin_tracks,
)
from wakeline.sources.staging import stage, stage_together


@dataclass(frozen=True)
class CompiledSurvey:
    survey: DataFrame
    """Thinned fixes interleaved with located sightings."""
    periods: DataFrame
    """Effort periods."""
    effort: DataFrame
    """Rows inside effort periods."""
    encounters: DataFrame
    """Numbered encounter marks."""
    state: DataFrame
    """Final survey table: encounter type in force, platform carried forward."""


def compile_to_effort(
    tracks: DataFrame,
    sightings: DataFrame,
    seconds: int = 10,
    same_date: bool = True,
    span_seconds: int = TRACK_SPAN,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    fixes, logs = stage_together(tracks=clean_tracks(tracks), sightings=sightings)
    located = locate_sightings(logs, fixes, span_seconds=span_seconds)
    thinned = thin_tracks(fixes, seconds, span_seconds)
    survey = stage(survey_table(thinned, located), "survey")
    periods = stage(effort_periods(stage(effort_marks(survey), "marks")), "periods")
    return survey, periods, stage(on_effort(survey, periods, same_date, span_seconds), "effort")


def compile_survey(
    tracks: DataFrame,
    sightings: DataFrame,
    seconds: int = 10,
    same_date: bool = True,
    span_seconds: int = TRACK_SPAN,
) -> CompiledSurvey:
    survey, periods, effort = compile_to_effort(tracks, sightings, seconds, same_date, span_seconds)
    enc = stage(encounters(stage(encounter_marks(effort), "marks")), "encounters")
    state = stage(encounter_state(effort, enc, span_seconds), "state")
    return CompiledSurvey(survey, periods, effort, enc, state)
