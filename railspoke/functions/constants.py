"""Fixed values of the route model: tag weights, speeds, limits and labels."""

from __future__ import annotations

#: Rolling-resistance coefficient of each allowed surface.
SURFACE_CRR = {
    "asphalt": 0.005,
    "concrete": 0.0055,
    "concrete:plates": 0.007,
    "concrete:lanes": 0.007,
    "asphalt:lanes": 0.005,
    "paved": 0.0055,
    "paving_stones": 0.011,
    "sett": 0.020,
    "cobblestone": 0.030,
    "unhewn_cobblestone": 0.040,
    "chipseal": 0.008,
    "bricks": 0.012,
    "wood": 0.006,
    "metal": 0.006,
    "compacted": 0.008,
    "fine_gravel": 0.009,
    "gravel": 0.010,
    "pebblestone": 0.017,
    "unpaved": 0.013,
    "grass_paver": 0.016,
    "stone": 0.020,
    "metal_grid": 0.008,
    "shells": 0.013,
    "ground": 0.015,
    "dirt": 0.017,
    "earth": 0.017,
    "grass": 0.035,
    "woodchips": 0.050,
}
#: Extra km that cyclists ride to avoid a km of each road class.
ROAD_WEIGHT = {
    "cycleway": 0.0,
    "path": 0.05,
    "footway": 0.05,
    "bridleway": 0.1,
    "steps": 0.1,
    "pedestrian": 0.1,
    "living_street": 0.1,
    "residential": 0.15,
    "service": 0.2,
    "track": 0.2,
    "unclassified": 0.2,
    "road": 0.2,
    "tertiary": 0.45,
    "tertiary_link": 0.45,
    "secondary": 0.65,
    "secondary_link": 0.65,
    "primary": 0.85,
    "primary_link": 0.85,
    "trunk": 1.0,
    "trunk_link": 1.0,
}
CRR_ASPHALT = 0.005
ROLLING_SHARE = 0.4
CRR_UNTAGGED = 0.013
ROAD_UNTAGGED = 1.0


def crr_weight(crr: float) -> float:
    """Equivalent extra km per km of a rolling resistance."""
    return max(0.0, ROLLING_SHARE * (crr / CRR_ASPHALT - 1.0))


SURFACE_WEIGHT = {name: crr_weight(crr) for name, crr in SURFACE_CRR.items()}
SURFACE_UNTAGGED = crr_weight(CRR_UNTAGGED)

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
TILE_DEG = 0.5

#: Preferences in extra km: per 100 m climb, unpaved km, main-road km, rail km, boarding.
PREFERENCES = {"uphill": 12.0, "unpaved": 3.0, "main": 1.0, "rail": 1.0, "boarding": 20.0}
MAX_PREFERENCE = 100.0

RAIL_KMH = 80.0
BOARDING_WAIT_S = 1800.0
STATION_RADIUS_M = 200.0
STATION_ENTRANCES = 5
DOMINANCE_M = 10_000.0
PROMINENCE_M = 100.0

BIKE_HALF_WIDTH_KM, BIKE_EXTEND_KM = 30.0, 5.0
RAIL_HALF_WIDTH_KM, RAIL_EXTEND_KM = 80.0, 50.0
MIN_TRIP_KM, MAX_TRIP_KM = 5.0, 300.0
MAX_CORRIDOR_EDGES = 1_100_000

BASE_KMH, ROUGH_KMH, WALK_KMH, WALK_GRADE = 25.0, 15.0, 5.0, 0.12
GRADE_MARGIN = 0.02
CLIMB_WINDOW_M = 200.0

MAX_VERTEX_GAP_M, Z_BAND_M = 100.0, 30.0
MIN_BIKE_COMPONENT_M = 50_000.0
COORD_DIGITS = 6
MERGE_TOLERANCE_M = 25.0

GMAPS_POINTS, GMAPS_INTERIOR, GMAPS_SPACING_KM = 10, 9, 5.0
GMAPS_BASE = "https://www.google.com/maps/dir/?api=1"

RIBBON_WIDTH_M, RIBBON_KMH = 40.0, 20.0

#: Display labels, in display order.
QUALITY_LABELS = ["good", "unpaved", "main road"]
GRADE_LABELS = ["flat", "uphill", "downhill"]
MODE_LABELS = ["bike route", "train path"]
UNNAMED_STOP = "(unnamed stop)"
