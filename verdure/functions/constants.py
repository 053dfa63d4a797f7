"""Fixed values of the field-analytics domain."""

# Native resolution of each band in metres.
BAND_RESOLUTION = {"B02": 10, "B03": 10, "B04": 10, "B08": 10, "B05": 20, "B06": 20, "B07": 20, "B8A": 20, "B11": 20, "B12": 20, "SCL": 20}
# Scene classes that count as clear.
CLEAR_CLASSES = (4, 5, 6, 7)
# Valid range of each index.
INDEX_RANGE = {"ndvi": (-1.0, 1.0), "evi2": (-1.0, 1.0), "savi": (-1.5, 1.5), "ndre": (-1.0, 1.0), "ndmi": (-1.0, 1.0)}
FORMULA_VERSION = "1"
# Upper edges (inclusive) of the bands, by index and crop; None: any other crop.
VIGOUR_EDGES = {None: (0.2, 0.4, 0.6, 0.8), "maize": (0.2, 0.35, 0.55, 0.8), "tobacco": (0.2, 0.4, 0.6, 0.82), "sorghum": (0.2, 0.35, 0.5, 0.7), "cotton": (0.2, 0.35, 0.55, 0.75)}
NITROGEN_EDGES = {None: (0.1, 0.3, 0.5), "maize": (0.15, 0.35, 0.5), "tobacco": (0.25, 0.4, 0.55)}
MOISTURE_EDGES = {None: (0.0, 0.2, 0.4), "sorghum": (-0.1, 0.15, 0.35)}
VIGOUR = ("bare", "sparse", "developing", "vigorous", "dense")
BANDS = {
    "ndvi": (VIGOUR, VIGOUR_EDGES),
    "evi2": (VIGOUR, VIGOUR_EDGES),
    "savi": (VIGOUR, VIGOUR_EDGES),
    "ndre": (("low", "moderate", "good", "high"), NITROGEN_EDGES),
    "ndmi": (("dry", "moderate", "adequate", "wet"), MOISTURE_EDGES),
}
# Health status of a vigour label, and stress level of a status.
STATUS = {"dense": "healthy", "vigorous": "healthy", "developing": "moderate", "sparse": "stressed", "bare": "critical"}
STRESS = {"healthy": "none", "moderate": "low", "stressed": "moderate", "critical": "high"}
# Display ranges.
COLOUR_RANGE = {"ndvi": (-0.2, 0.9), "evi2": (-0.1, 0.8), "savi": (-0.1, 0.7), "ndre": (-0.1, 0.6), "ndmi": (-0.3, 0.5)}
# Colour ramps, low to high.
VEGETATION_RAMP = ("#a50026", "#d73027", "#f46d43", "#fdae61", "#fee08b", "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850", "#006837")
MOISTURE_RAMP = ("#8c510a", "#bf812d", "#dfc27d", "#f6e8c3", "#f5f5f5", "#c7eae5", "#80cdc1", "#35978f", "#01665e")
DIVERGING_RAMP = ("#a50026", "#d73027", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850", "#006837")
# Bands of the composites and the reflectances they are stretched over.
COMPOSITES = {"rgb": (("B04", 0.3), ("B03", 0.3), ("B02", 0.3)), "fcc": (("B08", 0.45), ("B04", 0.3), ("B03", 0.3))}
# Longest side of a preview in pixels, and of a fetched grid.
PREVIEW_PIXELS = 512
GRID_PIXELS = 2500
# Alert thresholds.
MIN_CLEAR = 0.5
DROP_WARNING = 0.15
DROP_CRITICAL = 0.30
BASELINE_WINDOW = 5
BASELINE_LEAST = 3
DRY_AT = 0.0
Z_LIMIT = 2.0
Z_LEAST = 4
WATER_RATIO = 0.5
# Clear fractions from which confidence is high or medium.
HEALTH_HIGH = 0.8
HEALTH_MEDIUM = 0.5
# Planning, snapping and degree days.
BACKFILL_MONTHS = 18
CADENCE_DAYS = 5
SNAP_DAYS = 7
GDD_BASE = 10.0
# Regions and projections.
EDGE_TOLERANCE_M = 250.0
SLIVER = 0.01
UTM_SPLIT = 30.0
UTM_EAST = 32736
UTM_WEST = 32735
# Share of a field that may lie outside its farm, share by which equal boundaries may differ, decimals of a boundary's key.
NESTING_TOLERANCE = 0.02
EQUAL_TOLERANCE = 0.001
KEY_DECIMALS = 6
LEAST_AREA_M2 = 1.0
# Columns of the results' CSV export.
CSV_COLUMNS = ("canonical_field_id", "index_name", "pass_date", "mean", "min", "max", "std", "p10", "p90", "clear_fraction", "confidence", "resolution_m")
# Columns of the client's CSV export.
CLIENT_CSV_COLUMNS = ("requested_date", "pass_date", "before_pass_date", "after_pass_date", "status", "mean", "min", "max", "p10", "p90", "clear_fraction", "confidence", "resolution_m", "pixels", "scene_id")
# Activities that a reading's context names, and days that it looks back.
CONTEXT_ACTIVITIES = ("planting", "fertilizer", "spray", "irrigation")
ACTIVITY_DAYS = 30
# The farms' clocks; page of the activity feed.
LOCAL_OFFSET = "+02:00"
FEED_ROWS = 14
# Comparison groups (planned in the domain, an extension here).
GROUP_QUORUM = 0.5
GROUP_WINDOW_DAYS = 14
GROUP_LEAST = 5
MAD_LIMIT = 2.0
# Dates of a request at most, and degrees that its area may span.
REQUEST_DATES = 24
AREA_SPAN_DEGREES = 2.0
