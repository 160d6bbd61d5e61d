"""Fixed values of the data model: lattice, projection, channel and threshold lists."""

# ---- fixed values: tile lattice (metres, EPSG:3347) ----
GRID_SIZE = 256
PIXEL_SIZE = 90

# ---- fixed values: EPSG:3347 definition (GRS80, two standard parallels) ----
GRS80_A = 6378137.0
GRS80_E = 0.0818191910428158
PARALLEL_1_DEG = 49.0
PARALLEL_2_DEG = 77.0
ORIGIN_LAT_DEG = 63.390675
ORIGIN_LON_DEG = -91.86666666666666
FALSE_EASTING = 6200000.0
FALSE_NORTHING = 3000000.0

# ---- fixed values: burn-point CSV columns ----
BURN_POINT_COLUMNS = (
    "ID", "lon", "lat", "fireday", "year", "DOB", "firearea", "cumuarea",
    "prec", "tmax", "ws", "rh", "dem", "slope", "aspect", "Biomass", "Closure", "prcB", "prcC",
)

# ---- fixed values: sample channels, in storage order ----
WEATHER_FEATURES = ("tmax", "rh", "ws", "prec", "u10", "v10")
VEGETATION_FEATURES = ("evi", "ndvi")
SATELLITE_FEATURES = ("s2_b02", "s2_b03", "s2_b04", "s2_b08", "s2_b11", "s2_b12", "s2_scl")
STATIC_FEATURES = ("dem", "slope", "aspect", "biomass", "closure", "prcb", "prcc")
DYNAMIC_FEATURES = WEATHER_FEATURES + VEGETATION_FEATURES + SATELLITE_FEATURES
STATIC_CHANNELS = ("dem", "slope", "aspect_sin", "aspect_cos", "biomass", "closure", "prcb", "prcc")
MASK_CHANNELS = ("previous_burn_mask", "fireday_grid")
CHANNELS = DYNAMIC_FEATURES + STATIC_CHANNELS + MASK_CHANNELS

FEATURE_SETS = {
    "all_channels": CHANNELS,
    "no_satellite": tuple(c for c in CHANNELS if c not in SATELLITE_FEATURES),
    "environment_only": DYNAMIC_FEATURES + STATIC_CHANNELS,
}

# Features never normalised: they have no statistics.
UNNORMALISED = VEGETATION_FEATURES
# Layers the quality gate looks at (the scene classification is not checked).
QUALITY_DYNAMIC = WEATHER_FEATURES + VEGETATION_FEATURES + SATELLITE_FEATURES[:-1]
QUALITY_STATIC = STATIC_FEATURES

# ---- fixed values: satellite selection ----
CLOUD_TIERS = (40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0)
LOOKBACK_DAYS = 30
SCL_BAND = "SCL"

# ---- fixed values: vegetation grid and composite schedule ----
VEGETATION_LON0 = -141.0
VEGETATION_LAT0 = 83.0
VEGETATION_CELLS_PER_DEGREE = 240.0
COMPOSITE_DAYS = 16
COMPOSITE_LOOKBACK_DAYS = 33

# ---- fixed values: split ----
SIZE_QUANTILES = (0.5, 0.8, 0.95)
SIZE_LABELS = ("Small", "Med", "Large", "Mega")
LAT_LABELS = ("South", "North")
LON_LABELS = ("West", "East")
MIN_STRATUM = 15
FALLBACK_STRATUM = "Large"

TERRAIN_NODATA = -9999.0
