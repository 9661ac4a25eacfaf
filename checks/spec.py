"""Result columns of every query, applied alike to the Spark result and to the SQL.

A token is a column name with an optional form: `k:int`, `n:long`, `U:9` (rounded), or
`div:1e6:6` (scaled, then rounded). Times become text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ("name max_depth:int tstep:int n_glider:long n_point:long n_hull:long n_time:long div_corr:9 "
          "ks_T:9 js_S:9 wasserstein_divergence:1e6:5 true_std_sigma0:7 wT_total:9 wS_recovered:1e3:6")

SPECS = {
    "positions_explode": "config diameter:9 glider:int lat:9 lon:9",
    "hexagon_positions": "config glider:int lat:9 lon:9",
    "project_to_metres": "config glider:int x_m:2 y_m:2",
    "hull_bbox": "config lon_min:9 lon_max:9 lat_min:9 lat_max:9",
    "depth_axes": "part:long k:int obs_depth:6 depth:6",
    "hull_edges": "config x0:9 y0:9 x1:9 y1:9",
    "hull_mask": "config n_point:long n_hull:long sum_iy:long sum_ix:long",
    "interp_brackets": "o_orderkey:long axis idx:int w:9",
    "load_mask_fill": "time iz:int iy:int ix:int UVEL:10 VVEL:10 THETA:10 SALT:10 WVEL:10",
    "time_slice": "time n:long total:6",
    "time_stride": "time n:long total:6",
    "crop_window": "variable iy:int ix:int lat:9 lon:9 value:9",
    "domain_mean_map": "variable iy:int ix:int lat:9 lon:9 value:9",
    "velocity_map": "config variable iy:int ix:int lat:9 lon:9 value:9 bound:9",
    "density_sigma0": "time iz:int iy:int ix:int sigma0:7",
    "finite_filter": "event_id:long x:6 y:6",
    "sample_points": "config glider:int time k:int lat:9 lon:9 obs_depth:6 U:9 V:9 T:9 S:9",
    "model_region": "config iy:int ix:int time k:int lat:9 lon:9 obs_depth:6 U:9 V:9 T:9 S:9 W:9",
    "vertical_interp": "iy:int ix:int time k:int W:9",
    "w_at_centroid": "config time k:int depth:6 w_model:9",
    "array_divergence": "config time k:int div:1e6:6",
    "planefit_divergence": "config time k:int div:1e6:6",
    "planefit_missing": "config time k:int div:1e6:6",
    "planefit_baroclinic": "config time k:int div:1e6:6",
    "w_from_div": "config time k:int depth:6 w_est:1e6:6",
    "model_w_hull_mean": "config time k:int depth:6 w_model:9",
    "w_debarotropic": "config time k:int depth:6 w_model:9",
    "hull_mean": "config time k:int T:9 S:9",
    "cgrid_divergence": "config time k:int div:1e6:6",
    "eddy_anomalies": "config glider:int time k:int Up:9 Vp:9 Tp:9 Sp:9",
    "vertical_eddy_flux": "config iy:int ix:int k:int wT:9 wS:9 wU:9 wV:9",
    "array_vertical_flux": "config k:int wT:1e6:6 wS:1e6:6 wU:1e6:6 wV:1e6:6",
    "model_vertical_flux": "config k:int wT:9 wS:9 wU:9 wV:9",
    "flux_integrals": "config flux total_integral:9 glider_integral:1e6:6 recovered_frac:1e3:6",
    "flux_profile_stats": "config flux array_dmean:1e6:6 areamean_dmean:9 total_dmean:9 r_array_areamean:7",
    "flux_compare": "config flux k:int obs_depth:6 total:9 glider:1e6:6 recovered_frac:1e3:6",
    "w_bias": "config time k:int depth:6 w_est:1e6:6 w_model:9 bias:9",
    "w_hovmoller": "config time k:int depth:6 w_est:1e6:6 w_model:9 bias:9",
    "w_at_point_depth": "config time k:int depth:6 w_est:1e6:6 w_model:9 bias:9",
    "w_profile_stats": "config k:int w_est_mean:1e6:6 w_est_std:1e6:6 w_model_mean:9 w_model_std:9 bias_mean:9 bias_std:9",
    "w_depth_mean_series": "config time w_est_mean:1e6:6 w_est_std:1e6:6 w_model_mean:9 w_model_std:9 bias_mean:9 bias_std:9",
    "w_error_summary": "config rms:9 mean_bias:9 abs_mean_bias:9 w_est_std:1e6:6 w_model_std:9",
    "bias_series": "config series time k:int bias:9",
    "abs_p98": "config field bound:9",
    "w_limits": "config what bound:9",
    "pooled_percentiles": "config field lo:9 hi:9",
    "pdf_histogram": "config field bin:int edge:9 n_obs:long n_true:long density_obs:9 density_true:9",
    "ecdf_pair": "config field v:9 f_obs:9 f_true:9",
    "ks_distance": "config field ks:9",
    "wasserstein_distance": "config field wasserstein:5",
    "js_distance": "config field js:9",
    "joint_histogram": "config pair bin_x:int bin_y:int n_obs:long n_true:long",
    "joint_js_distance": "config pair js:9",
    "joint_cov_corr": "config pair cov_obs:6 cov_true:6 corr_obs:9 corr_true:9",
    "joint_pairs": "config pair side n:long sum_x:4 sum_y:4",
    "joint_sample": "config pair side l_orderkey:long l_linenumber:int x:6 y:6 depth:3",
    "joint_compare": "config pair cov_obs:6 cov_true:6 corr_obs:9 corr_true:9 js:9 x_lo:4 x_hi:4 y_lo:4 y_hi:4",
    "dist_moments": "config field obs_mean:4 true_mean:4 obs_std:4 true_std:4 obs_skew:6 true_skew:6",
    "dist_stats": "config field obs_mean:4 true_mean:4 obs_std:4 true_std:4 obs_skew:6 true_skew:6 ks:9 wasserstein:5 js:9",
    "dist_summary": "config field js:9 ks:9 wasserstein:5",
    "field_pdfs": "config field bin:int edge:7 n_obs:long n_true:long density_obs:6 density_true:6",
    "field_stats": "config field obs_mean:7 true_mean:7 obs_std:7 true_std:7 obs_skew:6 true_skew:6 ks:9 wasserstein:7 js:9",
    "field_joint": "config pair cov_obs:9 cov_true:9 corr_obs:7 corr_true:7 js:7",
    "divergence_pdf": "config bin:int edge:1e6:5 n_obs:long n_true:long density_obs:1e-6:5 density_true:1e-6:5 ks:9 js:9 "
                      "wasserstein:1e6:5",
    "divergence_corr": "config div_corr:9",
    "divergence_corr_beyond": "config div_corr:9",
    "array_divergence_beyond": "config time k:int div:1e6:6",
    "sample_points_beyond": "config glider:int time k:int lat:9 lon:9 obs_depth:6 U:9 V:9 T:9 S:9",
    "w_debarotropic_beyond": "config time k:int depth:6 w_model:9",
    "flux_integrals_beyond": "config flux total_integral:9 glider_integral:1e6:6 recovered_frac:1e3:6",
    "stored_slice_stride": "time n:long total:6",
    "stored_irregular_stride": "time n:long total:6",
    "stored_divergence_corr": "config div_corr:9 n_glider:long n_point:long n_hull:long n_time:long",
    "velocity_map_range": "config variable iy:int ix:int lat:9 lon:9 value:9 bound:9",
    "stats_record": RECORD, "stats_record_depths": RECORD, "stats_sink": RECORD, "stats_record_beyond": RECORD,
}


def _parts(name):
    for token in SPECS[name].split():
        yield (token.split(":") + [None, None])[:3]


def shape(name: str, df: DataFrame) -> DataFrame:
    """Select a query's result columns in Spark."""
    cols = []
    for c, form, digits in _parts(name):
        col = F.col(c)
        if c == "time":
            col = F.date_format(col, "yyyy-MM-dd HH:mm")
        elif form == "int":
            col = col.cast("int")
        elif form == "long":
            col = col.cast("bigint")
        elif digits is not None:
            col = F.round(col * F.lit(float(form)), int(digits)) + F.lit(0.0)
        elif form is not None:
            col = F.round(col, int(form)) + F.lit(0.0)
        cols.append(col.alias(c))
    return df.select(*cols)


def shaped_sql(name: str, source: str) -> str:
    """The same select list as SQL over a named query."""
    cols = []
    for c, form, digits in _parts(name):
        e = c
        if c == "time":
            e = f"strftime({c}, '%Y-%m-%d %H:%M')"
        elif form in ("int", "long"):
            e = f"cast({c} as {'int' if form == 'int' else 'bigint'})"
        elif digits is not None:
            e = f"round({c} * {form}, {digits}) + 0e0"
        elif form is not None:
            e = f"round({c}, {form}) + 0e0"
        cols.append(f"{e} as {c}")
    return f"select {', '.join(cols)} from {source}"
