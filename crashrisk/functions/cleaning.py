"""Text, number and category cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashrisk.operators.joins import lookup

# Wind direction text -> sector.
WIND_SECTORS = {
    "N": "N", "NNE": "N", "NNW": "N", "NORTH": "N",
    "S": "S", "SSE": "S", "SSW": "S", "SOUTH": "S",
    "E": "E", "ENE": "E", "ESE": "E", "EAST": "E",
    "W": "W", "WNW": "W", "WSW": "W", "WEST": "W",
    "CALM": "CALM", "VAR": "VAR", "VARIABLE": "VAR",
}

# Weather groups and their words, in the order they are tried.
WEATHER_GROUPS = {
    "rain": ["rain", "drizzle"],
    "snow": ["snow", "sleet", "ice"],
    "storm": ["storm", "thunder"],
    "fog": ["fog", "mist", "haze"],
    "clear": ["clear", "fair"],
    "cloudy": ["cloud", "overcast"],
}

# Fixed pattern: street type at a word border.
STREET_TYPE = r"\b(St|Ave|Rd|Blvd|Dr|Ln|Hwy)\b"

# Live weather code -> training column, and the fallback.
LIVE_WEATHER = {
    "Clear": "weath_cond_descr_Clear",
    "Clouds": "weath_cond_descr_Cloudy",
    "Rain": "weath_cond_descr_Rain",
    "Drizzle": "weath_cond_descr_Rain",
    "Snow": "weath_cond_descr_Snow",
    "Fog": "weath_cond_descr_Fog__smog__smoke",
    "Mist": "weath_cond_descr_Fog__smog__smoke",
    "Haze": "weath_cond_descr_Fog__smog__smoke",
    "Smoke": "weath_cond_descr_Fog__smog__smoke",
    "Dust": "weath_cond_descr_Fog__smog__smoke",
    "Sand": "weath_cond_descr_Fog__smog__smoke",
    "Ash": "weath_cond_descr_Fog__smog__smoke",
    "Thunderstorm": "weath_cond_descr_Severe_crosswinds",
    "Squall": "weath_cond_descr_Severe_crosswinds",
    "Tornado": "weath_cond_descr_Severe_crosswinds",
}
LIVE_WEATHER_FALLBACK = "weath_cond_descr_Not_Reported"


def wind_sector(text: Column) -> Column:
    tidy = F.trim(F.upper(text))
    return lookup(tidy, WIND_SECTORS, tidy)


def weather_group(text: Column) -> Column:
    lower = F.lower(text)
    group = F.when(text.isNull(), "unknown")
    for name, words in WEATHER_GROUPS.items():
        group = group.when(lower.rlike("|".join(words)), name)
    return group.otherwise("other")


def live_weather_feature(code: Column, keep: Column | None = None) -> Column:
    """Training column for a live weather code; pruned columns fall back as well."""
    name = lookup(code, LIVE_WEATHER, F.lit(LIVE_WEATHER_FALLBACK))
    return name if keep is None else F.when(F.array_contains(keep, name), name).otherwise(F.lit(LIVE_WEATHER_FALLBACK))


def tidy_lower(text: Column) -> Column:
    return F.trim(F.lower(text))


def tidy_upper(text: Column) -> Column:
    return F.trim(F.upper(text))


def street_type(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, STREET_TYPE, 1), F.lit(""))


def zip5(zipcode: Column) -> Column:
    return F.substring_index(zipcode, "-", 1)


def zip3(zipcode: Column) -> Column:
    return F.substring(zip5(zipcode), 1, 3)


def yes_no(text: Column) -> Column:
    """True/False in either spelling -> 1/0, else null."""
    return F.when(F.lower(text.cast("string")) == "true", 1).when(F.lower(text.cast("string")) == "false", 0)


def to_number(text: Column, kind: str = "double") -> Column:
    """Number or null, never an error."""
    return text.try_cast(kind)


def clip_upper(value: Column, upper: Column | float) -> Column:
    """Upper clip that leaves null as null (``least`` would give the bound)."""
    upper = upper if isinstance(upper, Column) else F.lit(float(upper))
    return F.when(value > upper, upper).otherwise(value)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def without_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))
