"""Small analytic and random fields, as DataFrames and as numpy arrays."""

import math

import numpy as np

from fathomgrid.grid import Grid

R = 6371000.0
M_PER_DEG = math.pi / 180 * R


def hexagon(lat, lon, radius, config="hex"):
    return [(config, g, lat + radius * math.sin(g * math.pi / 3), lon + radius * math.cos(g * math.pi / 3))
            for g in range(6)]


def positions_df(spark, rows):
    return spark.createDataFrame(rows, "config string, glider int, lat double, lon double")


def linear_samples(spark, rows, div, times=3, levels=10, dz=2.0):
    """u = div/2 * x, v = div/2 * y about the centroid of the array."""
    lat_c = sum(r[2] for r in rows) / len(rows)
    lon_c = sum(r[3] for r in rows) / len(rows)
    out = []
    for t in range(times):
        for config, g, lat, lon in rows:
            x = (lon - lon_c) * math.cos(math.radians(lat_c)) * M_PER_DEG
            y = (lat - lat_c) * M_PER_DEG
            for k in range(levels):
                out.append((config, t, g, k, -(k * dz + dz / 2), div / 2 * x, div / 2 * y))
    return spark.createDataFrame(
        out, "config string, time int, glider int, k int, obs_depth double, U double, V double")


class Cube:
    """A random cube on a 10 x 12 grid with uneven levels, some cells missing."""

    def __init__(self, spark, seed=0, times=4, missing=0.02):
        rng = np.random.default_rng(seed)
        self.ny, self.nx, self.nz, self.nt = 10, 12, 6, times
        self.pos = {
            "XC": 220 + (np.arange(self.nx) - 5.5) / 24, "XG": 220 + (np.arange(self.nx) - 6) / 24,
            "YC": (np.arange(self.ny) - 4.5) / 24, "YG": (np.arange(self.ny) - 5) / 24,
            "Z": -np.array([0.5, 2.0, 4.5, 7.0, 10.5, 14.0]), "Zl": -np.array([0.0, 1.2, 3.1, 6.0, 9.0, 12.0])}
        shape = (self.nt, self.nz, self.ny, self.nx)
        self.data = {v: rng.normal(size=shape) for v in ("UVEL", "VVEL", "THETA", "SALT", "WVEL")}
        self.data["THETA"] = 25 + self.data["THETA"]
        self.data["SALT"] = 35 + 0.1 * self.data["SALT"]
        for a in self.data.values():
            a[rng.random(shape) < missing] = np.nan
        self.dxg = np.broadcast_to((M_PER_DEG / 24 * np.cos(np.radians(self.pos["YG"])))[:, None], (self.ny, self.nx))
        self.dyg = np.full((self.ny, self.nx), M_PER_DEG / 24)
        self.ra = np.broadcast_to(((M_PER_DEG / 24) ** 2 * np.cos(np.radians(self.pos["YC"])))[:, None], (self.ny, self.nx))
        rows = []
        for t, z, y, x in np.ndindex(shape):
            rows.append((36 * (t + 1), z, y, x, *(
                -999.0 if np.isnan(a[t, z, y, x]) else float(a[t, z, y, x]) for a in self.data.values())))
        names = ", ".join(f"{v} double" for v in self.data)
        self.raw = spark.createDataFrame(rows, f"iter int, iz int, iy int, ix int, {names}")
        axes = [(a, i, float(p)) for a, ps in self.pos.items() for i, p in enumerate(ps)]
        metrics = [(y, x, float(self.dxg[y, x]), float(self.dyg[y, x]), float(self.ra[y, x]))
                   for y in range(self.ny) for x in range(self.nx)]
        self.grid = Grid(spark.createDataFrame(axes, "axis string, idx int, pos double"),
                         spark.createDataFrame(metrics, "iy int, ix int, dxG double, dyG double, rA double"))

    def interp(self, var, lon, lat, z):
        """Trilinear value per time; NaN outside or next to a missing cell."""
        from fathomgrid.model import GRID
        xa, ya, za = GRID[var]
        out = np.zeros(self.nt)
        parts = []
        for axis, p in ((za, z), (ya, lat), (xa, lon)):
            nodes = self.pos[axis]
            order = np.argsort(nodes)
            s = nodes[order]
            if p < s[0] or p > s[-1]:
                return np.full(self.nt, np.nan)
            i = min(np.searchsorted(s, p, side="right") - 1, len(s) - 2)
            f = (p - s[i]) / (s[i + 1] - s[i])
            parts.append([(order[j], w) for j, w in ((i, 1 - f), (i + 1, f)) if w != 0])
        for iz, wz in parts[0]:
            for iy, wy in parts[1]:
                for ix, wx in parts[2]:
                    out = out + wz * wy * wx * self.data[var][:, iz, iy, ix]
        return out


def inside_convex(points, lon, lat):
    """Brute force: strictly left of every directed edge that has all points on its left."""
    pts = [(p[3], p[2]) for p in points]
    ok, found = True, False
    for a in pts:
        for b in pts:
            if a == b:
                continue
            cross = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in pts]
            if min(cross) >= -1e-12:
                found = True
                ok &= (b[0] - a[0]) * (lat - a[1]) - (b[1] - a[1]) * (lon - a[0]) > 0
    return ok and found
