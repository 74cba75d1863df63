"""Small tables for examples and tests; the values are this library's own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.frame import Frame

_RAIN = [("Jan", 61.5, 4.0), ("Feb", 48.0, 5.5), ("Mar", 52.25, 9.0), ("Apr", 40.0, 13.0), ("May", 35.5, 18.5), ("Jun", 22.0, 23.0), ("Jul", 12.5, 27.0), ("Aug", 15.0, 26.5), ("Sep", 33.0, 21.0), ("Oct", 58.5, 15.0), ("Nov", 71.0, 9.5), ("Dec", 66.0, 5.0)]
_PEOPLE = [(11, "Ines", 55, 6, "Porto"), (12, "Bela", 40, 2, "Gyor"), (13, "Omar", 70, 9, "Fez"), (14, "Kaya", 40, 4, "Izmir"), (15, "Lena", 65, 7, "Graz")]
_SKILLS = [(11, "SQL"), (11, "Java"), (12, "C"), (13, "SQL"), (13, "Scala"), (13, "C"), (15, "Java"), (99, "Ada")]


def rainfall(spark: SparkSession) -> Frame:
    return Frame.create(spark, [("Month", "string"), ("Rainfall", "double"), ("Temperature", "double")], _RAIN)


def freelancers(spark: SparkSession) -> Frame:
    return Frame.create(spark, [("Id", "int"), ("Name", "string"), ("Rate", "int"), ("Experience", "int"), ("City", "string")], _PEOPLE)


def freelancer_skills(spark: SparkSession) -> Frame:
    return Frame.create(spark, [("Id", "int"), ("Language", "string")], _SKILLS)
