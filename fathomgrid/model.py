"""Names of the data model: which axes each model variable lives on."""

# Variable -> (x axis, y axis, z axis) of the staggered grid.
GRID = {
    "UVEL": ("XG", "YC", "Z"),
    "VVEL": ("XC", "YG", "Z"),
    "THETA": ("XC", "YC", "Z"),
    "SALT": ("XC", "YC", "Z"),
    "WVEL": ("XC", "YC", "Zl"),
}

# Variable -> short name used in every result.
ALIAS = {"UVEL": "U", "VVEL": "V", "THETA": "T", "SALT": "S", "WVEL": "W"}

# The model grid is 1/24 degree; a box around an array gets three cells of margin.
BOX_MARGIN_DEG = 3 / 24
EARTH_RADIUS_M = 6371000.0

FILL_VALUE = -999.0
CELL_KEYS = ("iz", "iy", "ix")
TRACERS = ("T", "S", "U", "V")
HIST_BINS = 60
HIST_PROBS = (0.005, 0.995)


def levels_in(max_depth, dz):
    """Number of layers of thickness dz above max_depth."""
    return int(max_depth / dz)
