"""Features of pairs of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_features(a: str, b: str, fields: list[str]) -> Column:
    """Entries of 1 for the fields that are equal, and none for the others."""
    each = F.array(*(F.when(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), F.lit(f"IS_SAME_{f}")) for f in fields))
    return F.map_from_entries(F.transform(F.array_compact(each), lambda k: F.struct(k, F.lit(1.0))))


def difference_features(a: str, b: str, fields: list[str]) -> Column:
    return F.create_map(*(x for f in fields for x in (F.lit(f"ABS_DIFFERENCE_{f}"), F.abs(F.col(f"{a}.{f}") - F.col(f"{b}.{f}")).cast("double"))))


def sphere_distance(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Angle between two places on the unit sphere, from degrees; rounding beyond 1 is clipped."""
    p1, p2 = F.radians(90.0 - lat1), F.radians(90.0 - lat2)
    cos = F.sin(p1) * F.sin(p2) * F.cos(F.radians(long1) - F.radians(long2)) + F.cos(p1) * F.cos(p2)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def both(a: Column, b: Column, value: str) -> Column:
    return ((a == b) & (b == value)).cast("double")


def both_features(a: str, b: str) -> dict[str, Column]:
    """Languages, sex and birth that both students have, each a column."""
    la, lb = (F.col(f"{x}.Language") for x in (a, b))
    found = {
        "BOTH_ENGLISH": both(la, lb, "English"),
        "BOTH_SPANISH": both(la, lb, "Spanish"),
        "BOTH_MALE": both(F.col(f"{a}.Gender"), F.col(f"{b}.Gender"), "Male"),
        "BOTH_BORN_OUTSIDE": 1.0 - both(F.col(f"{a}.BirthCountry"), F.col(f"{b}.BirthCountry"), "United States"),
        "BOTH_SPANISH_AT_HOME": both(F.col(f"{a}.HomeLanguage"), F.col(f"{b}.HomeLanguage"), "Spanish"),
    }
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in found.items()}


def other_features(a: str, b: str, zip_code: str = "ZipCode", school: str = "ThisGradeSchoolKey") -> Column:
    """:func:`both_features`, and which zip codes and school the pair is of, as one map."""
    one_hot = F.array_distinct(F.array(*(F.concat(F.lit("ZIPCODE_"), F.col(f"{x}.{zip_code}").cast("string")) for x in (a, b)), F.concat(F.lit("SCHOOL_KEY_"), F.col(f"{b}.{school}").cast("string"))))
    named = F.create_map(*(x for k, v in both_features(a, b).items() for x in (F.lit(k), v)))
    return F.map_concat(named, F.map_from_entries(F.transform(F.array_compact(one_hot), lambda k: F.struct(k, F.lit(1.0)))))


def n_other_features(a: str, b: str, zip_code: str = "ZipCode", school: str = "ThisGradeSchoolKey") -> Column:
    """How many entries :func:`other_features` has, without making them: a map for each pair costs most of what a pair costs."""
    za, zb, s = F.col(f"{a}.{zip_code}"), F.col(f"{b}.{zip_code}"), F.col(f"{b}.{school}")
    one_hot = za.isNotNull().cast("int") + (zb.isNotNull() & ~za.eqNullSafe(zb)).cast("int") + s.isNotNull().cast("int")
    return one_hot + len(both_features(a, b))


def cast_or(c: Column, kind: str, default: object) -> Column:
    """The value as ``kind``; ``default`` where it is none."""
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))
