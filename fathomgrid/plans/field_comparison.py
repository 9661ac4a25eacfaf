"""What the sensors saw against the full field inside the array, for many arrays in one job."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.columns import sigma0
from ..grid import Grid
from ..model import levels_in
from ..operators import distributions as D
from ..operators import eddies as E
from ..operators import interpolation as I
from ..operators import velocity as V
from ..operators.geometry import box_spans, hull_cells

FIELDS = ("T", "S", "U", "V", "sigma0")


def add_density(df: DataFrame) -> DataFrame:
    """df with sigma0, the density of the water at surface pressure less 1000 kg/m3."""
    return df.withColumn("sigma0", sigma0(F.col("S"), F.col("T")))


@dataclass
class FieldComparison:
    """All results for a set of arrays, at one depth range or at several nested ones.

    Sensor samples and the hull population each feed several results, so they are written
    once to the shared folder; every result is then a grouped aggregate keyed by config.

    depths: several depths down to max_depth, e.g. (70, 120). Statistics of fields and divergence, the
    correlation, flux integrals and records then have a row for each, under max_depth: a layer is
    counted in the class of the shallowest depth that holds it, and counts of classes add up, so all
    depths share each pass. times: the model's times, if known without reading cells.
    fields: those compared; the others are not computed. digits: decimals that compared values are rounded to. Sums
    come out differently in their last bits with every order of addition; without it, which copies of a value lie
    inside limits that fall on that value is left to chance.
    """

    cells: DataFrame
    grid: Grid
    positions: DataFrame
    max_depth: float = 70
    dz: float = 2
    depths: tuple = ()
    times: DataFrame | None = None
    fields: tuple = (*FIELDS, "divergence")
    digits: int | None = None

    def __post_init__(self):
        self.depths = tuple(sorted(self.depths))
        if self.depths and self.depths[-1] != self.max_depth:
            raise ValueError("max_depth must be the deepest of depths")
        if self.times is not None:
            I.known_times(self.cells, self.grid, self.times)

    @property
    def levels(self) -> int:
        return levels_in(self.max_depth, self.dz)

    @property
    def record_keys(self) -> list[str]:
        return ["config", *(["max_depth"] if self.depths else [])]

    def classed(self, df: DataFrame) -> DataFrame:
        """df with the number of the shallowest depth that holds layer k."""
        if not self.depths:
            return df
        deeper = [(F.col("k") >= levels_in(d, self.dz)).cast("int") for d in self.depths[:-1]]
        return df.withColumn("depth_class", sum(deeper, F.lit(0)))

    def at_depth(self, max_depth: float) -> FieldComparison:
        """The same comparison down to a smaller depth, from the tables of this one: no further scan."""
        if max_depth > self.max_depth:
            raise ValueError("only a smaller depth is contained in the tables")
        self.prepare()
        other = replace(self, max_depth=max_depth, depths=(), times=None)
        other.__dict__["hull"] = self.hull
        for name in ("obs_raw", "true_raw", "div_obs", "div_true"):
            other.__dict__[name] = getattr(self, name).where(F.col("k") < other.levels)
        return other

    @cached_property
    def hull(self) -> DataFrame:
        return hull_cells(self.grid, self.positions)

    @cached_property
    def obs_raw(self) -> DataFrame:
        return I.sample_fields(self.cells, self.grid, self.positions, max_depth=self.max_depth, dz=self.dz,
                               finish=add_density)

    @cached_property
    def true_raw(self) -> DataFrame:
        return I.model_region(self.cells, self.grid, self.positions, ("WVEL", "UVEL", "VVEL", "THETA", "SALT"),
                              self.max_depth, self.dz, self.hull, finish=add_density)

    def prepare(self) -> "FieldComparison":
        """Write the tables that do not depend on each other at the same time.

        Their jobs share the cluster instead of each leaving its tail idle.
        """
        # what the three share is made first, by one thread
        _ = self.hull, self.grid.spans, I.all_times(self.cells, self.grid)
        with ThreadPoolExecutor(3) as pool:
            list(pool.map(lambda name: getattr(self, name), ("true_raw", "obs_raw", "div_true")))
        return self

    @cached_property
    def obs(self) -> DataFrame:
        return E.eddy_anomalies(self.obs_raw, ["config", "glider", "k"])

    @cached_property
    def true(self) -> DataFrame:
        return E.eddy_anomalies(self.true_raw, ["config", "iy", "ix", "k"])

    @cached_property
    def div_obs(self) -> DataFrame:
        return durable(V.planefit_divergence(self.obs_raw, self.positions, levels_in(self.max_depth, self.dz)),
                       "div-obs")

    @cached_property
    def div_true(self) -> DataFrame:
        return V.model_divergence(self.cells, self.grid, self.positions, self.max_depth, self.dz, self.hull)

    @cached_property
    def w_est(self) -> DataFrame:
        return V.w_from_divergence(self.div_obs, self.dz)

    @cached_property
    def population(self) -> DataFrame:
        """(config, side, field, v[, depth_class]) of the fields and of divergence."""
        own = [f for f in self.fields if f != "divergence"]
        keys = ["config", *(["depth_class"] if self.depths else [])]
        parts = []
        if own and "divergence" in self.fields:
            self.prepare()
        if own:
            wide = D.pooled(self.classed(self.obs_raw), self.classed(self.true_raw), [*keys, *own])
            parts.append(D.field_population(wide, own, keys))
        if "divergence" in self.fields:
            div = D.pooled(self.classed(self.div_obs), self.classed(self.div_true), [*keys, F.col("div").alias("divergence")])
            parts.append(D.field_population(div, ["divergence"], keys))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if self.digits is None:
            return whole
        unit = F.lit(10.0 ** self.digits)
        return whole.withColumn("v", F.rint(F.col("v") * unit) / unit)

    @cached_property
    def ranks(self) -> D.Ranks:
        return D.rank_table(self.population, ["config", "field"], self.depths)

    @cached_property
    def limits(self) -> DataFrame:
        return D.pooled_limits(self.ranks)

    def field_stats(self) -> DataFrame:
        return D.dist_stats(self.population, ["config", "field"], self.ranks, self.limits)

    def field_pdfs(self) -> DataFrame:
        return D.histogram_density(D.histogram(self.ranks, self.limits), self.limits, self.ranks.result_keys)

    @cached_property
    def pairs(self) -> DataFrame:
        cols = ["config", "obs_depth", "U", "V", "T", "S", "Up", "Vp", "Tp"]
        return D.pair_population(D.pooled(self.obs, self.true, cols), extra=["obs_depth"])

    def joint(self) -> DataFrame:
        return D.joint_compare(self.pairs)

    @cached_property
    def array_flux(self) -> DataFrame:
        return durable(E.array_vertical_flux(self.w_est, self.obs_raw), "array-flux")

    @cached_property
    def model_flux(self) -> DataFrame:
        return durable(E.model_vertical_flux(self.true_raw), "model-flux")

    def fluxes(self) -> DataFrame:
        return E.flux_compare(self.array_flux, self.model_flux, self.dz, self.levels)

    def flux_integrals(self) -> DataFrame:
        """Per array and flux, and per depth if there are several: profiles have a row per layer, so they are cut again."""
        def down_to(depth):
            n = levels_in(depth, self.dz)
            cut = [f.where(F.col("k") < n) for f in (self.array_flux, self.model_flux)]
            return E.flux_integrals(*cut, self.dz, n)
        if not self.depths:
            return down_to(self.max_depth)
        parts = [down_to(d).withColumn("max_depth", F.lit(d)) for d in self.depths]
        return reduce(DataFrame.unionByName, parts)

    def flux_stats(self) -> DataFrame:
        return E.flux_profile_stats(self.array_flux, E.areamean_vertical_flux(self.true_raw),
                                    self.model_flux, self.dz)

    def div_corr(self) -> DataFrame:
        sides = [D.by_depth(self.classed(d), self.depths) for d in (self.div_obs, self.div_true)]
        return V.divergence_correlation(*sides, self.record_keys)

    def counts(self) -> DataFrame:
        """(config, n_glider, n_point, n_hull, n_time): n_point counts the box, n_hull the hull."""
        # an array off the grid has no box, hull or time, and counts of 0
        gliders = self.positions.groupBy("config").agg(F.count(F.lit(1)).alias("n_glider"))
        box = box_spans(self.grid, self.positions).select("config", "n_point")
        hull = self.hull.groupBy("config").agg(F.count(F.lit(1)).alias("n_hull"))
        times = self.obs_raw.select("config", "time").distinct().groupBy("config").agg(
            F.count(F.lit(1)).alias("n_time"))
        return (gliders.join(box, "config", "left").join(hull, "config", "left").join(times, "config", "left")
                .fillna(0, ["n_point", "n_hull", "n_time"]))

    def stats_record(self, tstep: int = 1) -> DataFrame:
        """One nested record per array (and depth), the shape the JSON sink writes."""
        self.prepare()
        keys, stats = self.record_keys, self.field_stats()
        fields = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
            "field", F.struct(*[c for c in stats.columns if c not in (*keys, "field")])))).alias("fields"))
        flux = self.flux_integrals()
        fluxes = flux.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
            "flux", F.struct("total_integral", "glider_integral", "recovered_frac")))).alias("flux"))
        counts = self.counts()
        if self.depths:
            counts = counts.withColumn("max_depth", F.explode(F.array(*[F.lit(d) for d in self.depths])))
        else:
            counts = counts.withColumn("max_depth", F.lit(self.max_depth))
        return (counts.join(self.div_corr(), keys, "left").join(fields, keys, "left").join(fluxes, keys, "left")
                .select(F.col("config").alias("name"), "max_depth", F.lit(tstep).alias("tstep"), "n_glider", "n_point",
                        "n_hull", "n_time", "div_corr", "fields", "flux"))


def write_stats(records: DataFrame, path: str) -> None:
    """Store records as JSON below <path>/max_depth=<m>/config=<name>/, in place of an earlier record there.

    Only folders of arrays and depths among the records are replaced; all others stay.
    """
    (records.withColumn("config", F.col("name")).repartition("max_depth", "config")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("max_depth", "config").json(path))
