"""Every registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.durable import durable, scratch
from fathomgrid.functions.columns import sigma0
from fathomgrid.operators import distributions as D
from fathomgrid.operators import eddies as E
from fathomgrid.operators import geometry as G
from fathomgrid.operators import interpolation as I
from fathomgrid.operators import summaries as S
from fathomgrid.operators import velocity as V
from fathomgrid.plans.domain_mean import velocity_map as array_map
from fathomgrid.plans.field_comparison import FIELDS as MODEL_FIELDS
from fathomgrid.plans.field_comparison import FieldComparison, write_stats
from fathomgrid.plans.vertical_velocity import bias_tables, w_comparison, w_comparison_tables
from fathomgrid.plans.vertical_velocity import w_limits as limits_of
from fathomgrid.sources import arrays, cells as C

from . import fixtures as X
from .spec import shape

QUERIES = {}
DEPTH = dict(max_depth=X.MAX_DEPTH, dz=X.DZ)


def query(fn):
    """Register a function under its name; its result columns come from the spec."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(fn.__name__, fn(spark, sf_dir))
    QUERIES[fn.__name__] = run
    return fn


# ---------------------------------------------------------------- arrays and axes

@query
def positions_explode(spark, d):
    """Array configurations written as nested JSON and read back by the source."""
    centers = X.sql(spark, d, X.CENTERS, "customer")
    path = scratch(spark, "arrays")
    (centers.select(
        F.col("config").alias("name"), F.lit("circle of six").alias("description"),
        F.struct("lat", "lon").alias("center"), F.col("diameter").alias("diameter_deg"),
        F.transform(arrays.hexagon(), lambda p: F.array(p["lat"], p["lon"])).alias("positions"))
     .write.json(path))
    read = arrays.read_arrays(spark, path, multi_line=False)
    return arrays.positions(read, F.col("diameter_deg").alias("diameter"))


@query
def hexagon_positions(spark, d):
    return arrays.hexagon_positions(X.sql(spark, d, X.CENTERS, "customer"))


@query
def project_to_metres(spark, d):
    return G.project_to_metres(X.sql(spark, d, X.SCATTERED, "orders"))


@query
def hull_bbox(spark, d):
    return G.hull_bbox(X.sql(spark, d, X.SCATTERED, "orders"))


@query
def depth_axes(spark, d):
    return G.depth_axes(X.sql(spark, d, X.DEPTHS, "part"))


@query
def hull_edges(spark, d):
    return G.hull_edges(X.sql(spark, d, X.IRREGULAR, "orders"))


@query
def hull_mask(spark, d):
    grid = X.wide_grid(spark)
    positions = arrays.hexagon_positions(X.sql(spark, d, X.CENTERS, "customer"))
    inside = G.hull_cells(grid, positions).groupBy("config").agg(
        F.count(F.lit(1)).alias("n_hull"), F.sum("iy").alias("sum_iy"), F.sum("ix").alias("sum_ix"))
    return G.box_spans(grid, positions).join(inside, "config")


@query
def interp_brackets(spark, d):
    return G.brackets(X.grid(spark), X.sql(spark, d, X.TARGETS, "orders"))


# ---------------------------------------------------------------- cells

@query
def load_mask_fill(spark, d):
    return X.cells(spark, d)


def _per_time(cells):
    return cells.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum("SALT").alias("total"))


@query
def time_slice(spark, d):
    return _per_time(C.time_slice(X.cells(spark, d), "2012-10-01T12", "2012-10-02"))


@query
def time_stride(spark, d):
    return _per_time(C.time_stride(C.time_slice(X.cells(spark, d), "2012-10-01T06"), 3))


@query
def density_sigma0(spark, d):
    return X.cells(spark, d).withColumn("sigma0", sigma0(F.col("SALT"), F.col("THETA")))


@query
def domain_mean_map(spark, d):
    grid = X.grid(spark)
    return S.map_rows(S.domain_mean(X.cells(spark, d), grid, 8), grid)


@query
def crop_window(spark, d):
    grid = X.grid(spark)
    maps = S.map_rows(S.domain_mean(X.cells(spark, d), grid, 8), grid)
    return C.crop(maps, lon=(219.9, 220.1), lat=(-0.1, 0.05))


@query
def velocity_map(spark, d):
    return array_map(X.cells(spark, d), X.grid(spark), X.positions(spark), 8, margin=0.01)


@query
def finite_filter(spark, d):
    return D.finite_rows(X.sql(spark, d, X.MESSY, "events"), "x", "y")


# ---------------------------------------------------------------- interpolation

def _samples(spark, d, variables=("UVEL", "VVEL", "THETA", "SALT")):
    return I.sample_fields(X.cells(spark, d), X.grid(spark), X.positions(spark), variables, **DEPTH)


def _region(spark, d):
    return I.model_region(X.cells(spark, d), X.grid(spark), X.positions(spark),
                          ("WVEL", "UVEL", "VVEL", "THETA", "SALT"), **DEPTH)


@query
def sample_points(spark, d):
    return _samples(spark, d)


@query
def model_region(spark, d):
    return _region(spark, d)


@query
def vertical_interp(spark, d):
    return I.interp_levels(X.cells(spark, d), X.grid(spark), ["WVEL"], levels=G.interface_levels, **DEPTH)


@query
def w_at_centroid(spark, d):
    return V.model_w(X.cells(spark, d), X.grid(spark), X.positions(spark), spatial_mean=False, **DEPTH)


# ---------------------------------------------------------------- velocity

@query
def array_divergence(spark, d):
    return V.array_divergence(X.cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH)


def _event_samples(spark, d):
    return X.sql(spark, d, X.EVENT_SAMPLES, "events")


@query
def planefit_divergence(spark, d):
    return V.planefit_divergence(_event_samples(spark, d), X.circle(spark))


@query
def planefit_missing(spark, d):
    return V.planefit_divergence(X.sql(spark, d, X.EVENT_SERIES, "events"), X.circle(spark))


@query
def planefit_baroclinic(spark, d):
    return V.planefit_divergence(_event_samples(spark, d), X.circle(spark), 5, remove_barotropic=True)


@query
def w_from_div(spark, d):
    # the layer thickness is read off the observation depths
    samples = _event_samples(spark, d).withColumn("obs_depth", -(F.col("k") * X.DZ + X.DZ / 2))
    return V.planefit_w(samples, X.circle(spark))[0]


def _model_w(spark, d, **kw):
    return V.model_w(X.cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH, **kw)


@query
def model_w_hull_mean(spark, d):
    return _model_w(spark, d)


@query
def w_debarotropic(spark, d):
    return _model_w(spark, d, remove_barotropic=True)


@query
def hull_mean(spark, d):
    return V.hull_mean(I.model_region(X.cells(spark, d), X.grid(spark), X.positions(spark), ("THETA", "SALT"),
                                      **DEPTH), ["T", "S"])


@query
def cgrid_divergence(spark, d):
    return V.model_divergence(X.cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH)


def _comparison(spark, d):
    return w_comparison(X.cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH)


@query
def w_bias(spark, d):
    return _comparison(spark, d)


@query
def w_hovmoller(spark, d):
    return w_comparison(X.cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH, depth_range=(-1, -9),
                        time_range=("2012-10-01T06", "2012-10-02"))


@query
def w_at_point_depth(spark, d):
    return w_comparison_tables(_comparison(spark, d), point_depth=-5.5)["point"]


@query
def w_limits(spark, d):
    return limits_of(_comparison(spark, d))


@query
def w_profile_stats(spark, d):
    return S.profile_stats(_comparison(spark, d))


@query
def w_depth_mean_series(spark, d):
    return S.depth_mean_series(_comparison(spark, d))


@query
def w_error_summary(spark, d):
    return S.error_summary(_comparison(spark, d))


@query
def bias_series(spark, d):
    return bias_tables(_comparison(spark, d), point_depth=-5.5)


# ---------------------------------------------------------------- eddies and fluxes

@query
def eddy_anomalies(spark, d):
    return E.eddy_anomalies(durable(_samples(spark, d), "samples"), ["config", "glider", "k"])


@query
def vertical_eddy_flux(spark, d):
    return E.vertical_eddy_flux(_region(spark, d), ["config", "iy", "ix", "k"])


@query
def model_vertical_flux(spark, d):
    return E.model_vertical_flux(_region(spark, d))


def fields(spark, d, cells=X.cells, **kw) -> FieldComparison:
    return FieldComparison(cells(spark, d), X.grid(spark), X.positions(spark), **DEPTH, **kw)


def beyond(spark, d) -> FieldComparison:
    """Deeper than the grid, with an array over its edge and one outside it."""
    return FieldComparison(X.full_cells(spark, d), X.grid(spark), X.wide_positions(spark), max_depth=X.DEEP, dz=X.DZ)


@query
def array_vertical_flux(spark, d):
    return fields(spark, d).array_flux


@query
def flux_integrals(spark, d):
    return fields(spark, d, X.full_cells).flux_integrals()


@query
def flux_profile_stats(spark, d):
    return fields(spark, d).flux_stats()


@query
def flux_compare(spark, d):
    return fields(spark, d, X.full_cells).fluxes()


# ---------------------------------------------------------------- distributions

KEYS = ["config", "field"]
FIELDS = ("T", "S", "U", "V")
PAIR_LIST = (("TS", "T", "S"), ("UV", "U", "V"))


def _population(spark, d):
    return D.field_population(X.sql(spark, d, X.POPULATIONS, "lineitem"), FIELDS)


def _ranks(spark, d):
    return D.rank_table(_population(spark, d), KEYS)


def _pairs(spark, d, extra=()):
    return D.pair_population(X.sql(spark, d, X.POPULATIONS, "lineitem"), PAIR_LIST, extra=extra)


@query
def abs_p98(spark, d):
    return S.abs_limit(_population(spark, d).withColumn("v", F.col("v") - F.lit(0.05)), KEYS)


@query
def pooled_percentiles(spark, d):
    return D.pooled_limits(_ranks(spark, d))


def _histogram(spark, d):
    ranks = _ranks(spark, d)
    limits = D.pooled_limits(ranks)
    return D.histogram(ranks, limits), limits


@query
def pdf_histogram(spark, d):
    return D.histogram_density(*_histogram(spark, d), KEYS)


@query
def ecdf_pair(spark, d):
    return D.ecdf(_ranks(spark, d))


@query
def ks_distance(spark, d):
    return D.ecdf_distances(_ranks(spark, d))


@query
def wasserstein_distance(spark, d):
    return D.ecdf_distances(_ranks(spark, d))


@query
def js_distance(spark, d):
    return D.js_distance(_histogram(spark, d)[0], KEYS)


@query
def dist_moments(spark, d):
    return D.moments(_population(spark, d), KEYS)


@query
def dist_stats(spark, d):
    return D.dist_stats(_population(spark, d))


@query
def dist_summary(spark, d):
    return D.dist_stats(_population(spark, d)).orderBy("config", "field")


def _joint_histogram(spark, d):
    pairs = _pairs(spark, d)
    return D.joint_histogram(pairs, durable(D.joint_limits(pairs), "joint-limits"))


@query
def joint_histogram(spark, d):
    return _joint_histogram(spark, d)


@query
def joint_js_distance(spark, d):
    return D.js_distance(_joint_histogram(spark, d), ["config", "pair"])


@query
def joint_cov_corr(spark, d):
    return D.covariances(_pairs(spark, d))


@query
def joint_pairs(spark, d):
    return _pairs(spark, d).groupBy("config", "pair", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query
def joint_sample(spark, d):
    rows = _pairs(spark, d, ["l_orderkey", "l_linenumber", "depth"])
    identity = F.expr("(l_orderkey * 7919 + l_linenumber * 104729) % 1000003 / 1000003D")
    return D.thin(rows, identity, 0.1)


@query
def joint_compare(spark, d):
    return D.joint_compare(_pairs(spark, d))


# ---------------------------------------------------------------- whole comparison

@query
def field_pdfs(spark, d):
    """Histograms of values rounded to nine decimals, so that copies of a value on a limit are all counted."""
    return fields(spark, d, fields=MODEL_FIELDS, digits=X.DIGITS).field_pdfs()


@query
def field_stats(spark, d):
    return fields(spark, d, fields=MODEL_FIELDS).field_stats()


@query
def field_joint(spark, d):
    return fields(spark, d).joint()


@query
def divergence_pdf(spark, d):
    done = fields(spark, d, fields=("divergence",))
    distances = done.field_stats().select("config", "field", "ks", "js", "wasserstein")
    return done.field_pdfs().join(distances, ["config", "field"])


@query
def divergence_corr(spark, d):
    return fields(spark, d, X.full_cells).div_corr()


def _flat(r):
    return r.select("*", F.expr("fields['T'].ks as ks_T"), F.expr("fields['S'].js as js_S"),
                    F.expr("fields['divergence'].wasserstein as wasserstein_divergence"),
                    F.expr("fields['sigma0'].true_std as true_std_sigma0"),
                    F.expr("flux['wT'].total_integral as wT_total"),
                    F.expr("flux['wS'].recovered_frac as wS_recovered"))


@query
def stats_record(spark, d):
    return _flat(fields(spark, d, X.full_cells).stats_record())


@query
def stats_record_depths(spark, d):
    """Two nested depths from the same passes."""
    return _flat(fields(spark, d, X.full_cells, depths=(X.SHALLOW, X.MAX_DEPTH)).stats_record())


@query
def stats_sink(spark, d):
    """Records of two depths, written twice into the same folder and read back."""
    path = scratch(spark, "stats")
    records = durable(fields(spark, d, X.full_cells, depths=(X.SHALLOW, X.MAX_DEPTH)).stats_record(), "records")
    for _ in range(2):
        write_stats(records, path)
    return _flat(spark.read.schema(records.schema).json(path))


# ---------------------------------------------------------------- beyond the grid and its levels

@query
def divergence_corr_beyond(spark, d):
    return beyond(spark, d).div_corr()


@query
def array_divergence_beyond(spark, d):
    return V.array_divergence(X.full_cells(spark, d), X.grid(spark), X.wide_positions(spark), X.DEEP, X.DZ)


@query
def sample_points_beyond(spark, d):
    return I.sample_fields(X.full_cells(spark, d), X.grid(spark), X.wide_positions(spark), max_depth=X.DEEP, dz=X.DZ)


@query
def w_debarotropic_beyond(spark, d):
    return V.model_w(X.full_cells(spark, d), X.grid(spark), X.wide_positions(spark), X.DEEP, X.DZ, remove_barotropic=True)


@query
def flux_integrals_beyond(spark, d):
    return beyond(spark, d).flux_integrals()


@query
def stats_record_beyond(spark, d):
    return _flat(beyond(spark, d).stats_record())


# ---------------------------------------------------------------- from storage

@query
def stored_slice_stride(spark, d):
    """Cells written in the storage layout, read back, sliced and strided on their snapshots."""
    path = scratch(spark, "stored")
    C.write_cells(X.raw_cells(spark, d), path, 360)
    stored = C.load_model(C.read_cells(spark, path), start="2012-10-01T06", end="2012-10-03", stride=3, every=36)
    return _per_time(stored)


@query
def stored_irregular_stride(spark, d):
    """Every third of the stored snapshots of some numbers, from the snapshot index."""
    path = scratch(spark, "stored")
    C.write_cells(X.raw_cells(spark, d).where("iter % 5 <> 0"), path, 360)
    kept = C.select_snapshots(C.read_snapshots(spark, path), iters=range(72, 2 ** 31, 36), stride=3)
    return _per_time(C.load_model(C.read_cells(spark, path), snapshots=kept))


@query
def stored_divergence_corr(spark, d):
    """The comparison from stored cells, whose times come from the snapshot index."""
    path = scratch(spark, "stored")
    C.write_cells(X.full_raw_cells(spark, d), path, 360)
    kept = C.select_snapshots(C.read_snapshots(spark, path), stride=2)
    model = C.load_model(C.read_cells(spark, path), snapshots=kept).drop("iter")
    run = FieldComparison(model, X.grid(spark), X.positions(spark), **DEPTH, times=C.snapshot_times(kept))
    return run.div_corr().join(run.counts(), "config")


@query
def velocity_map_range(spark, d):
    return array_map(X.cells(spark, d), X.grid(spark), X.positions(spark), 8, ("2012-10-01T06", "2012-10-02"), margin=0.01)
