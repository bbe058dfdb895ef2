"""Amounts, leads and directions as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The points of the compass.
POINTS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def format_mm(mm: Column) -> Column:
    """One digit below ten, none from there on."""
    return F.when(mm < 10, F.format_string("%.1f mm/h", mm)).otherwise(F.format_string("%d mm/h", F.floor(mm + 0.5)))


def format_lead(minutes: Column) -> Column:
    """Minutes below an hour, hours and minutes from there on."""
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(minutes < 60, F.format_string("%d min", minutes)).when(rest == 0, F.format_string("%d h", hours)).otherwise(F.format_string("%d h %d min", hours, rest))


def compass(dx: Column, dy: Column) -> Column:
    """The point that a vector (dy to the south) heads for."""
    sector = F.floor((F.degrees(F.atan2(dx, -dy)) + 360 + 22.5) / 45) % 8
    return F.element_at(F.array(*map(F.lit, POINTS)), (sector + 1).cast("int"))
