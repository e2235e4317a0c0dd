"""Declared schemas and the names that drift between device versions."""

from __future__ import annotations

SIGHTINGS = """
    device_id string, date string, time string, event_type string, effort string,
    deployment string, platform string, crew string, beaufort string, swell string,
    glare string, visibility string, overall string, species string, group_size string,
    calves string, behaviours string, encounter_type string, permit string, sst string,
    depth double, note string, tawaki string
"""

TRACKS = "device_id string, date string, time string, latitude double, longitude double, sst string, depth double"

# Position columns changed name between versions of the logging app.
TRACK_ALIASES = {"lat": "latitude", "lon": "longitude", "LAT": "latitude", "LON": "longitude"}
TRACK_CASTS = {"sst": "string", "depth": "double"}

PHOTO_SHEET = "date string, filename string, id_name string, part string, quality string, photographer string, comments string"

LIFE_HISTORY = """
    entryno int, name string, code string, sex string, mom string,
    birth_year string, first_year string, death_year string
"""

CAPTURES = """
    survey_area string, trip string, date date, year int, calfyear int,
    filename string, photographer string, id_name string, group bigint
"""

DATA_LOG = """
    fiord string, year int, season string, folder string, start_date string,
    end_date string, photos string, vessel string
"""

CREW = "first string, last string, organization string"
POPEST = "year int, pod string, est int, lcl int, ucl int"
