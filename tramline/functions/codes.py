"""Codes of the schedule format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Basic route types.
TRAM, SUBWAY, RAIL, BUS, FERRY, CABLE_TRAM, AERIAL_LIFT, FUNICULAR, TROLLEYBUS, MONORAIL = 0, 1, 2, 3, 4, 5, 6, 7, 11, 12

# Extended route types by the basic type that stands for them.
EXTENDED = {
    RAIL: [*range(100, 116), 117, 1503],
    FUNICULAR: [116, 1400],
    BUS: [*range(200, 210), 700, 701, 702, *range(704, 717), 1500, 1501, 1504, 1505, 1506, 1507, 1700, 1702],
    TRAM: [400, 401, 404, 405, *range(900, 907)],
    SUBWAY: [402],
    TROLLEYBUS: [800],
    FERRY: [1000, 1200, 1502],
    AERIAL_LIFT: [1100, *range(1300, 1308)],
}

# Travel modes by basic type.
MODES = {
    BUS: "BUS",
    TROLLEYBUS: "BUS",
    TRAM: "TRAM",
    CABLE_TRAM: "TRAM",
    RAIL: "RAIL",
    MONORAIL: "RAIL",
    FERRY: "SHIP",
    SUBWAY: "SUBWAY",
    AERIAL_LIFT: "AERIAL_LIFT",
    FUNICULAR: "FUNICULAR",
}

ADDED, REMOVED = 1, 2
MINIMUM_TIME = 2
YES = 1


def basic_type(code: Column) -> Column:
    """The basic type of a basic or extended route type; null if unknown."""
    out = F.when(code.isin(*MODES), code)
    for basic, codes in EXTENDED.items():
        out = out.when(code.isin(codes), F.lit(basic))
    return out


def travel_mode(code: Column) -> Column:
    """The travel mode of a basic or extended route type; null if unknown."""
    basic, out = basic_type(code), None
    for kind, mode in MODES.items():
        out = (F if out is None else out).when(basic == kind, F.lit(mode))
    return out
