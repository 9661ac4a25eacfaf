"""The same results as plain SQL, from named subqueries that each oracle picks from."""

from __future__ import annotations

import math
import re

from . import fixtures as X
from .spec import SPECS, shaped_sql

H, DZ = X.MAX_DEPTH, X.DZ
N = int(H / DZ)
STEP = 2 * math.pi / 6
PER_M = math.pi / 180 * 6371000.0
CTE: dict[str, str] = {}


def loaded(source: str) -> str:
    masked = ", ".join(f"nullif({v}, -999e0) as {v}" for v in ("UVEL", "VVEL", "THETA", "SALT", "WVEL"))
    return f"select timestamp '2012-10-01' + to_seconds(iter * 300) as time, iz, iy, ix, {masked} from {source}"


def circle_sql(centers: str) -> str:
    return (f"select config, cast(g as int) as glider, lat + diameter / 2 * sin(g * {STEP!r}) as lat, "
            f"lon + diameter / 2 * cos(g * {STEP!r}) as lon from {centers}, range(6) as r(g)")


CTE["raw_cells"] = X.RAW_CELLS
CTE["filled_cells"] = X.FILLED_CELLS
CTE["coarse_cells"] = X.FULL_CELLS
CTE["cells"] = loaded("filled_cells")
CTE["long_cells"] = " union all ".join(
    f"select time, iz, iy, ix, '{v}' as var, {v} as val from cells" for v in ("UVEL", "VVEL", "THETA", "SALT", "WVEL"))
CTE["axes"] = " union all ".join(
    [f"select '{a}' as axis, cast(i as int) as idx, {base} + (i - {off}) / 24 as pos from range(8) as r(i)"
     for a, base, off in (("XC", "220e0", "3.5e0"), ("XG", "220e0", "4e0"), ("YC", "0e0", "3.5e0"), ("YG", "0e0", "4e0"))]
    + ["select 'Z', cast(i as int), 0.9e0 - i * 1.7e0 from range(1, 8) as r(i)",
       "select 'Zl', cast(i as int), (1 - i) * 1.7e0 from range(1, 8) as r(i)"])
CTE["spans"] = """select axis, idx as i0, pos as x0, lead(idx) over (partition by axis order by pos) as i1,
    lead(pos) over (partition by axis order by pos) as x1, max(pos) over (partition by axis) as top from axes"""
CTE["var_grid"] = """select * from (values ('UVEL', 'U', 'XG', 'YC', 'Z'), ('VVEL', 'V', 'XC', 'YG', 'Z'),
    ('THETA', 'T', 'XC', 'YC', 'Z'), ('SALT', 'S', 'XC', 'YC', 'Z'), ('WVEL', 'W', 'XC', 'YC', 'Zl'))
    as v(var, alias, xa, ya, za)"""
CTE["metrics"] = f"""select cast(y as int) as iy, cast(x as int) as ix,
    {X.CELL_EDGE!r} * cos(radians((y - 4) / 24e0)) as dxG, {X.CELL_EDGE!r} as dyG,
    {X.CELL_EDGE!r} * {X.CELL_EDGE!r} * cos(radians((y - 3.5e0) / 24e0)) as rA
    from range(8) as a(y), range(8) as b(x)"""
CTE["centre"] = "select 'hexagon' as config, 0e0 as lat, 220e0 as lon, 0.2e0 as diameter"
CTE["sensors"] = circle_sql("centre") + """ union all select 'rect', cast(g as int), lat, lon from (values
    (0, 0e0, 219.9e0), (1, 0e0, 220.1e0), (2, -0.1e0, 219.9e0), (3, -0.1e0, 220.1e0), (4, 0.1e0, 219.9e0),
    (5, 0.1e0, 220.1e0)) as p(g, lat, lon)"""
CTE["event_centre"] = "select 'circle' as config, 0e0 as lat, 220e0 as lon, 0.25e0 as diameter"
CTE["event_sensors"] = circle_sql("event_centre")
CTE["centers"] = X.CENTERS
CTE["circles"] = circle_sql("centers")
CTE["irregular"] = X.IRREGULAR
CTE["scattered"] = X.SCATTERED
CTE["requests"] = X.DEPTHS
CTE["targets"] = X.TARGETS
CTE["layers"] = f"select cast(k as int) as k, -(k * {float(DZ)} + {DZ / 2}) as z from range({N}) as r(k)"
CTE["interfaces"] = f"select cast(k as int) as k, 0e0 - k * {float(DZ)} as z from range({N + 1}) as r(k)"


def bracket(source: str) -> str:
    inside = f"{source} as t join spans as s on t.axis = s.axis and t.pos >= s.x0 and (t.pos < s.x1 or (s.x1 = s.top and t.pos = s.x1))"
    return f"""select * exclude (pos) from (
        select t.*, s.i0 as idx, 1 - (t.pos - s.x0) / (s.x1 - s.x0) as w from {inside}
        union all select t.*, s.i1, (t.pos - s.x0) / (s.x1 - s.x0) from {inside}) where w <> 0"""


CTE["layer_lines"] = "select axis, k, z as pos from layers, (values ('Z'), ('Zl')) as a(axis)"
CTE["layer_w"] = bracket("layer_lines")
CTE["interface_lines"] = "select 'Zl' as axis, k, z as pos from interfaces"
CTE["interface_w"] = bracket("interface_lines")
CTE["times"] = "select distinct time from cells"
LEVEL_LIST = {"layer_w": "layers", "interface_w": "interfaces"}


def interpolate(name: str, points: str, ids: list[str], levels: str) -> None:
    """Subqueries that interpolate every variable to points and levels: <name>."""
    i = ", ".join(ids)
    on = " and ".join(f"x.{c} = y.{c}" for c in ids)
    CTE[f"{name}_lines"] = " union all ".join(
        f"select {i}, '{a}' as axis, {c} as pos from {points}"
        for a, c in (("XC", "lon"), ("XG", "lon"), ("YC", "lat"), ("YG", "lat")))
    CTE[f"{name}_brackets"] = bracket(f"{name}_lines")
    xi = ", ".join(f"x.{c}" for c in ids)
    CTE[f"{name}_weights"] = f"""select {xi}, v.var, v.alias, z.k, x.idx as ix, y.idx as iy, z.idx as iz, x.w * y.w * z.w as w
        from var_grid as v join {name}_brackets as x on x.axis = v.xa join {name}_brackets as y on y.axis = v.ya and {on}
        join {levels} as z on z.axis = v.za"""
    CTE[f"{name}_expected"] = f"select {i}, var, k, count(*) as n from {name}_weights group by all"
    CTE[f"{name}_values"] = f"""select {', '.join('w.' + c for c in ids)}, w.alias, w.k, c.time,
        case when count(c.val) = max(e.n) then sum(w.w * c.val) end as v
        from {name}_weights as w join long_cells as c using (var, iz, iy, ix)
        join {name}_expected as e on e.var = w.var and e.k = w.k and {' and '.join(f'e.{c} = w.{c}' for c in ids)}
        group by all"""
    CTE[f"{name}_frame"] = f"select {i}, time, k from (select distinct {i} from {points}), times, {LEVEL_LIST[levels]}"
    CTE[name] = f"select {i}, time, k, " + ", ".join(
        f"max(case when alias = '{a}' then v end) as {a}" for a in "UVTSW"
    ) + f" from {name}_frame left join {name}_values using ({i}, time, k) group by {i}, time, k"


SIGMA0 = """case when S >= 0 then 999.842594e0 + 6.793952e-2 * T - 9.095290e-3 * T ** 2 + 1.001685e-4 * T ** 3
    - 1.120083e-6 * T ** 4 + 6.536332e-9 * T ** 5
    + S * (8.24493e-1 - 4.0899e-3 * T + 7.6438e-5 * T ** 2 - 8.2467e-7 * T ** 3 + 5.3875e-9 * T ** 4)
    + S ** 1.5e0 * (-5.72466e-3 + 1.0227e-4 * T - 1.6546e-6 * T ** 2) + 4.8314e-4 * S ** 2 - 1000 end"""


def edges(points: str) -> str:
    """Directed pairs with every other point on the left or, if in line, between them."""
    cross = "(b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon)"
    along = "(b.lon - a.lon) * (c.lon - a.lon) + (b.lat - a.lat) * (c.lat - a.lat)"
    whole = "(b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)"
    return f"""select a.config, a.lon as x0, a.lat as y0, b.lon as x1, b.lat as y1
        from {points} as a join {points} as b on a.config = b.config and (a.lon <> b.lon or a.lat <> b.lat)
        join {points} as c on c.config = a.config
        group by a.config, a.lon, a.lat, b.lon, b.lat
        having bool_and({cross} >= -1e-12 and (abs({cross}) > 1e-12 or ({along} >= -1e-15 and {along} <= {whole} + 1e-15)))"""


def inside(edge_table: str, boxes: str, xs: str, ys: str) -> str:
    return f"""select b.config, y.idx as iy, x.idx as ix, any_value(y.pos) as lat, any_value(x.pos) as lon
        from {boxes} as b join {xs} as x on x.pos between b.lon_min and b.lon_max
        join {ys} as y on y.pos between b.lat_min and b.lat_max join {edge_table} as e on e.config = b.config
        group by b.config, y.idx, x.idx
        having bool_and((x1 - x0) * (y.pos - y0) - (y1 - y0) * (x.pos - x0) > 0)"""


def box(points: str, margin: str = "0.125e0") -> str:
    return f"""select config, min(lon) - {margin} as lon_min, max(lon) + {margin} as lon_max,
        min(lat) - {margin} as lat_min, max(lat) + {margin} as lat_max from {points} group by config"""


CTE["sensor_box"] = box("sensors")
CTE["sensor_edges"] = edges("sensors")
CTE["xc"] = "select idx, pos from axes where axis = 'XC'"
CTE["yc"] = "select idx, pos from axes where axis = 'YC'"
CTE["hull"] = inside("sensor_edges", "sensor_box", "xc", "yc")
CTE["hull_points"] = "select config, iy as ty, ix as tx, lat, lon from hull"
interpolate("samples_raw", "sensors", ["config", "glider", "lat", "lon"], "layer_w")
interpolate("region_raw", "hull_points", ["config", "ty", "tx", "lat", "lon"], "layer_w")
CTE["centroids"] = "select config, avg(lat) as lat, avg(lon) as lon from sensors group by config"
interpolate("centroid_values", "centroids", ["config"], "interface_w")
CTE["samples"] = f"select *, z as obs_depth, {SIGMA0} as sigma0 from samples_raw join layers using (k)"
CTE["region"] = f"""select * exclude (ty, tx), ty as iy, tx as ix, z as obs_depth, {SIGMA0} as sigma0
    from region_raw join layers using (k)"""


def planefit(name: str, sensors: str, samples: str) -> None:
    CTE[f"{name}_xy"] = f"""select config, glider, {PER_M!r} * (lon - lon_c) * cos(radians(lat_c)) as x,
        {PER_M!r} * (lat - lat_c) as y from (select *, avg(lat) over (partition by config) as lat_c,
        avg(lon) over (partition by config) as lon_c from {sensors})"""
    CTE[f"{name}_fit"] = f"""select config, glider, n, (syy * x - sxy * y) / (sxx * syy - sxy * sxy) as wx,
        (sxx * y - sxy * x) / (sxx * syy - sxy * sxy) as wy from {name}_xy join (select config, count(*) as n,
        sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from {name}_xy group by config) using (config)"""
    CTE[name] = f"""select config, time, k, case when count(U) = max(n) and count(V) = max(n)
        then sum(wx * U + wy * V) end as div from {samples} join {name}_fit using (config, glider) group by all"""


def integrate(div: str) -> str:
    return f"""select config, time, cast(k + 1 as int) as k, -{DZ} * (k + 1e0) as depth,
        case when count(div) over w = k + 1 then sum(div * {float(DZ)}) over w end as w_est
        from {div} window w as (partition by config, time order by k)
        union all select distinct config, time, 0, 0e0, 0e0 from {div}"""


planefit("div_obs", "sensors", "samples")
CTE["w_est"] = integrate("div_obs")
CTE["events_in"] = X.EVENT_SAMPLES
CTE["series_in"] = X.EVENT_SERIES
CTE["baroclinic_in"] = """select config, time, glider, k, case when count(U) over w = 5 then U - avg(U) over w end as U,
    case when count(V) over w = 5 then V - avg(V) over w end as V from events_in
    window w as (partition by config, time, glider)"""
planefit("div_events", "event_sensors", "events_in")
planefit("div_series", "event_sensors", "series_in")
planefit("div_baroclinic", "event_sensors", "baroclinic_in")
CTE["w_events"] = integrate("div_events")

CTE["w_found"] = """select c.iy, c.ix, c.time, z.k, case when count(c.WVEL) = max(n.n) then sum(z.w * c.WVEL) end as W
    from cells as c join interface_w as z on z.idx = c.iz
    join (select k, count(*) as n from interface_w group by k) as n on n.k = z.k group by all"""
CTE["w_cells"] = """select iy, ix, time, k, W from (select * from (select distinct iy, ix, time from cells), interfaces)
    left join w_found using (iy, ix, time, k)"""
CTE["w_model"] = f"""select config, time, k, -{float(DZ)} * k as depth, avg(W) as w_model
    from (select config, iy, ix, time, k from hull, times, interfaces) left join w_found using (iy, ix, time, k) group by all"""
CTE["w_shear"] = """select config, time, k, depth, w_model + max(w_model) filter (where k = deepest) over
    (partition by config, time) / (deepest * {step}) * depth as w_model
    from w_model, (select max(k) as deepest from interfaces)""".replace("{step}", repr(float(DZ)))
CTE["w_centroid"] = f"select config, time, k, -{float(DZ)} * k as depth, W as w_model from centroid_values"
CTE["bias"] = "select *, w_est - w_model as bias from w_est join (select config, time, k, w_model from w_model) using (config, time, k)"
CTE["div_cells"] = """select c.time, c.iz, c.iy, c.ix, ((case when c.ix = 7 then 0 else e.UVEL * me.dyG end) - c.UVEL * m.dyG
    + (case when c.iy = 7 then 0 else n.VVEL * mn.dxG end) - c.VVEL * m.dxG) / m.rA as d
    from cells as c join metrics as m on m.iy = c.iy and m.ix = c.ix
    left join cells as e on e.time = c.time and e.iz = c.iz and e.iy = c.iy and e.ix = c.ix + 1
    left join metrics as me on me.iy = c.iy and me.ix = c.ix + 1
    left join cells as n on n.time = c.time and n.iz = c.iz and n.iy = c.iy + 1 and n.ix = c.ix
    left join metrics as mn on mn.iy = c.iy + 1 and mn.ix = c.ix"""
CTE["div_true"] = """select config, time, k, avg(d) as div from (select config, iy, ix, time, k from hull, times, layers)
    left join (
    select h.config, c.iy, c.ix, c.time, z.k, case when count(c.d) = max(n.n) then sum(z.w * c.d) end as d
    from div_cells as c join hull as h on h.iy = c.iy and h.ix = c.ix
    join layer_w as z on z.idx = c.iz and z.axis = 'Z'
    join (select k, count(*) as n from layer_w where axis = 'Z' group by k) as n on n.k = z.k group by all)
    using (config, iy, ix, time, k) group by all"""

CTE["samples_p"] = "select *, " + ", ".join(
    f"{v} - avg({v}) over w as {v}p" for v in "UVTS") + " from samples window w as (partition by config, glider, k)"
CTE["region_p"] = "select *, " + ", ".join(
    f"{v} - avg({v}) over w as {v}p" for v in "UVTSW") + " from region window w as (partition by config, iy, ix, k)"
CTE["cell_flux"] = "select config, iy, ix, k, " + ", ".join(
    f"avg(Wp * {v}p) as w{v}" for v in "TSUV") + " from region_p group by all"
CTE["model_flux"] = "select config, k, " + ", ".join(f"avg(w{v}) as w{v}" for v in "TSUV") + " from cell_flux group by all"


def mean_flux(name: str, rows: str, w: str) -> None:
    CTE[f"{name}_p"] = f"select config, time, k, {w} - avg({w}) over q as wp, " + ", ".join(
        f"{v} - avg({v}) over q as {v}p" for v in "TSUV") + f" from {rows} window q as (partition by config, k)"
    CTE[name] = "select config, k, " + ", ".join(
        f"avg(wp * {v}p) as w{v}" for v in "TSUV") + f" from {name}_p group by all"


CTE["w_layers"] = """select config, time, k, (w_est + below) / 2 as w from (select *, lead(w_est) over q as below,
    lead(k) over q as next_k from w_est window q as (partition by config, time order by k)) where next_k = k + 1"""
CTE["array_mean"] = """select * from (select config, time, k, avg(T) as T, avg(S) as S, avg(U) as U, avg(V) as V
    from samples group by all) left join w_layers using (config, time, k)"""
CTE["area_mean"] = """select config, time, k, avg(W) as W, avg(T) as T, avg(S) as S, avg(U) as U, avg(V) as V
    from region group by all"""
mean_flux("array_flux", "array_mean", "w")
mean_flux("area_flux", "area_mean", "W")
CTE["flux_rows"] = " union all ".join(
    f"""select config, k, z as obs_depth, 'w{v}' as flux, m.w{v} as total, a.w{v} as glider, r.w{v} as area
        from array_flux as a left join model_flux as m using (config, k) left join area_flux as r using (config, k)
        join layers using (k)""" for v in "TSUV")
CTE["integrals"] = """select config, flux, case when count(total) = count(*) then coalesce(sum(pt), 0) end as total_integral,
    case when count(glider) = count(*) then coalesce(sum(pg), 0) end as glider_integral from (
    select *, 0.5e0 * (total + lead(total) over q) * (lead(obs_depth) over q - obs_depth) as pt,
    0.5e0 * (glider + lead(glider) over q) * (lead(obs_depth) over q - obs_depth) as pg
    from flux_rows window q as (partition by config, flux order by k)) group by all"""
CTE["recovered"] = "select *, glider_integral / nullif(total_integral, 0) as recovered_frac from integrals"

# ---------------------------------------------------------------- distributions


def long_form(source: str, keys: str, columns) -> str:
    return " union all ".join(
        f"select {keys}, '{c}' as field, cast({c} as double) as v from {source} where isfinite({c})" for c in columns)


def distributions(p: str, pop: str, keys: str = "config, field") -> None:
    """Subqueries over a population (keys, side, v), named <p>_..."""
    CTE[f"{p}_limits"] = f"""select {keys}, quantile_cont(v, 0.005) as lo, quantile_cont(v, 0.995) as hi
        from {pop} group by {keys}"""
    CTE[f"{p}_binned"] = f"""select {keys}, side, case when g < 0 or (v < g * st + lo) then g - 1
        when g < 59 and v >= (g + 1) * st + lo then g + 1 else g end as bin from (
        select {keys}, side, v, lo, hi, (hi - lo) / 60e0 as st, least(floor((v - lo) / ((hi - lo) / 60e0)), 59) as g
        from {pop} join {p}_limits using ({keys}) where v >= lo and v <= hi)"""
    CTE[f"{p}_hist"] = f"""select {keys}, bin, count(*) filter (side = 'obs') as n_obs,
        count(*) filter (side = 'true') as n_true from {p}_binned group by {keys}, bin"""
    CTE[f"{p}_full_hist"] = f"""select {keys}, b.bin, b.bin * ((hi - lo) / 60e0) + lo as edge,
        coalesce(n_obs, 0) as n_obs, coalesce(n_true, 0) as n_true, (hi - lo) / 60e0 as st
        from (select l.*, r.bin from {p}_limits as l, range(60) as r(bin)) as b left join {p}_hist as h using ({keys}, bin)"""
    CTE[f"{p}_density"] = f"""select *, n_obs / (sum(n_obs) over q * st) as density_obs,
        n_true / (sum(n_true) over q * st) as density_true from {p}_full_hist window q as (partition by {keys})"""
    CTE[f"{p}_js"] = js(f"{p}_hist", keys)
    CTE[f"{p}_steps"] = f"""select {keys}, v, count(*) filter (side = 'obs') as o, count(*) filter (side = 'true') as t
        from {pop} group by {keys}, v"""
    CTE[f"{p}_ecdf"] = f"""select {keys}, v, sum(o) over q / sum(o) over a as f_obs, sum(t) over q / sum(t) over a as f_true,
        lead(v) over q as next_v from {p}_steps window q as (partition by {keys} order by v), a as (partition by {keys})"""
    CTE[f"{p}_dist"] = f"""select {keys}, max(abs(f_obs - f_true)) as ks,
        sum(abs(f_obs - f_true) * (next_v - v)) as wasserstein from {p}_ecdf group by {keys}"""
    CTE[f"{p}_side"] = f"""select {keys}, side, avg(m) as mean, sqrt(avg((v - m) ** 2)) as std,
        avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5e0 as skew from (
        select *, avg(v) over (partition by {keys}, side) as m from {pop}) group by {keys}, side"""
    CTE[f"{p}_moments"] = f"select {keys}, " + ", ".join(
        f"max(case when side = '{s}' then {m} end) as {s}_{m}" for s in ("obs", "true") for m in ("mean", "std", "skew")
    ) + f" from {p}_side group by {keys}"
    CTE[f"{p}_stats"] = f"select * from {p}_moments join {p}_dist using ({keys}) join {p}_js using ({keys})"


def js(hist: str, keys: str) -> str:
    part = "case when {0} > 0 then {0} * log2({0} / ((p + q) / 2)) else 0 end"
    return f"""select {keys}, sqrt(greatest(sum({part.format('p')} + {part.format('q')}) / 2, 0)) as js from (
        select {keys}, n_obs / sum(n_obs) over (partition by {keys}) as p,
        n_true / sum(n_true) over (partition by {keys}) as q from {hist}) group by {keys}"""


def joint(p: str, pairs: str) -> None:
    """Subqueries over pairs (config, pair, side, x, y), named <p>_..."""
    CTE[f"{p}_limits"] = "select config, pair, " + ", ".join(
        f"quantile_cont({a}, {q}) as {a}_{e}" for a in "xy" for e, q in (("lo", "0.005"), ("hi", "0.995"))
    ) + f" from {pairs} group by config, pair"

    def corrected(a):
        st, g = f"(({a}_hi - {a}_lo) / 60e0)", f"g{a}"
        return (f"case when {a} < {g} * {st} + {a}_lo then {g} - 1 "
                f"when {g} < 59 and {a} >= ({g} + 1) * {st} + {a}_lo then {g} + 1 else {g} end")

    guess = ", ".join(f"least(floor(({a} - {a}_lo) / (({a}_hi - {a}_lo) / 60e0)), 59) as g{a}" for a in "xy")
    CTE[f"{p}_hist"] = f"""select config, pair, {corrected('x')} as bin_x, {corrected('y')} as bin_y,
        count(*) filter (side = 'obs') as n_obs, count(*) filter (side = 'true') as n_true
        from (select *, {guess} from {pairs} join {p}_limits using (config, pair)
        where x between x_lo and x_hi and y between y_lo and y_hi) group by all"""
    CTE[f"{p}_js"] = js(f"{p}_hist", "config, pair")
    CTE[f"{p}_cov"] = "select config, pair, " + ", ".join(
        f"{f}(x, y) filter (side = '{s}') as {n}_{s}" for n, f in (("cov", "covar_samp"), ("corr", "corr"))
        for s in ("obs", "true")) + f" from {pairs} group by config, pair"
    CTE[f"{p}_all"] = f"select * from {p}_cov join {p}_js using (config, pair) join {p}_limits using (config, pair)"


CTE["populations"] = X.POPULATIONS
CTE["pop"] = long_form("populations", "config, side", "TSUV")
distributions("p", "pop")
CTE["pairs"] = " union all ".join(
    f"select config, side, l_orderkey, l_linenumber, depth, '{x}{y}' as pair, {x} as x, {y} as y from populations "
    f"where isfinite({x}) and isfinite({y})" for x, y in (("T", "S"), ("U", "V")))
joint("j", "pairs")
CTE["field_pop"] = " union all ".join(
    [long_form(f"(select *, '{s}' as side from {t})", "config, side", ("T", "S", "U", "V", "sigma0"))
     for s, t in (("obs", "samples"), ("true", "region"))]
    + [f"select config, '{s}', 'divergence', div from {t} where isfinite(div)" for s, t in (("obs", "div_obs"), ("true", "div_true"))])
distributions("f", "field_pop")
CTE["field_pairs"] = " union all ".join(
    f"select config, '{s}' as side, '{n}' as pair, {x} as x, {y} as y from {t} where {x} is not null and {y} is not null"
    for s, t in (("obs", "samples_p"), ("true", "region_p")) for n, x, y in (
        ("uv", "U", "V"), ("TS", "T", "S"), ("stress_uv", "Up", "Vp"), ("heatflux_vT", "Vp", "Tp"), ("heatflux_uT", "Up", "Tp")))
joint("fj", "field_pairs")
CTE["div_corr"] = """select config, case when count_if(e.div is null or m.div is null) = 0 then corr(e.div, m.div) end as div_corr
    from div_obs as e left join div_true as m using (config, time, k) group by config"""

# ---------------------------------------------------------------- maps and summaries

CTE["domain"] = "select iy, ix, " + ", ".join(
    f"avg({v}) filter (where {z} >= -8) as {a}" for v, a, z in (("UVEL", "U", "z"), ("VVEL", "V", "z"), ("WVEL", "W", "zl"))
) + """ from cells join (select idx as iz, max(pos) filter (where axis = 'Z') as z, max(pos) filter (where axis = 'Zl') as zl
    from axes group by idx) using (iz) group by iy, ix"""
CTE["maps"] = " union all ".join(
    f"""select '{v}' as variable, d.iy, d.ix, y.pos as lat, x.pos as lon, d.{v} as value from domain as d
        join axes as x on x.axis = '{xa}' and x.idx = d.ix join axes as y on y.axis = '{ya}' and y.idx = d.iy"""
    for v, xa, ya in (("U", "XG", "YC"), ("V", "XC", "YG"), ("W", "XC", "YC")))
CTE["map_limits"] = 'select variable, quantile_cont(abs(value), 0.98) as bound from maps group by variable'
CTE["near_box"] = box("sensors", "0.01e0")
STATS = ", ".join(f"avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std" for c in ("w_est", "w_model", "bias"))
CTE["per_time"] = "select time, count(*) as n, sum(SALT) as total from cells group by time"
CTE["wide_xc"] = "select cast(i as int) as idx, 218e0 + (i + 0.5e0) / 24 as pos from range(96) as r(i)"
CTE["wide_yc"] = "select cast(i as int) as idx, (i + 0.5e0) / 24 - 2e0 as pos from range(96) as r(i)"
CTE["circle_box"] = box("circles")
CTE["circle_edges"] = edges("circles")
CTE["circle_hull"] = inside("circle_edges", "circle_box", "wide_xc", "wide_yc")
CTE["circle_n"] = """select config, count(*) as n_point from circle_box join wide_xc as x on x.pos between lon_min and lon_max
    join wide_yc as y on y.pos between lat_min and lat_max group by config"""
CTE["near_level"] = f"""select k from interfaces order by abs(z + 5.5e0), k limit 1"""

# Every array, with counts of 0 where it lies off the grid.
COUNTED = """select s.config as {name}, s.n_glider, coalesce(b.n_point, 0) as n_point, coalesce(h.n_hull, 0) as n_hull,
    (select count(*) from times) as n_time, {rest}
    from (select config, count(*) as n_glider from sensors group by all) as s left join div_corr as c using (config)
    left join (select config, count(*) as n_point from sensor_box join xc as x on x.pos between lon_min and lon_max
          join yc as y on y.pos between lat_min and lat_max group by all) as b using (config)
    left join (select config, count(*) as n_hull from hull group by all) as h using (config) {joins}"""
RECORD = COUNTED.format(name="name", rest="""{depth} as max_depth, 1 as tstep, c.div_corr, f.*, r.*""", joins="""
    left join (select config, max(ks) filter (field = 'T') as ks_T, max(js) filter (field = 'S') as js_S,
        max(wasserstein) filter (field = 'divergence') as wasserstein_divergence,
        max(true_std) filter (field = 'sigma0') as true_std_sigma0 from f_stats group by config) as f using (config)
    left join (select config, max(total_integral) filter (flux = 'wT') as wT_total,
        max(recovered_frac) filter (flux = 'wS') as wS_recovered from recovered group by config) as r using (config)""")
COUNTED = COUNTED.replace("{name}", "config")

RESULTS = {
    "positions_explode": "select c.config, diameter, glider, c.lat, c.lon from circles as c join centers using (config)",
    "hexagon_positions": "select * from circles",
    "project_to_metres": f"""select config, glider, {PER_M!r} * (lon - avg(lon) over w) * cos(radians(avg(lat) over w)) as x_m,
        {PER_M!r} * (lat - avg(lat) over w) as y_m from scattered window w as (partition by config)""",
    "hull_bbox": box("scattered"),
    "depth_axes": """select part, k, case when k < n then -(k * dz + dz / 2) end as obs_depth, 0e0 - k * dz as depth from (
        select *, floor(max_depth / dz) as n, unnest(range(cast(floor(max_depth / dz) as int) + 1)) as k from requests)""",
    "hull_edges": edges("irregular"),
    "hull_mask": """select config, any_value(n_point) as n_point, count(*) as n_hull, sum(iy) as sum_iy, sum(ix) as sum_ix
        from circle_hull join circle_n using (config) group by config""",
    "interp_brackets": bracket("targets"),
    "load_mask_fill": "select * from cells",
    "time_slice": "select * from per_time where time >= timestamp '2012-10-01 12:00:00' and time < timestamp '2012-10-03 00:00:00'",
    "time_stride": """select * from (select *, row_number() over (order by time) - 1 as i from per_time
        where time >= timestamp '2012-10-01 06:00:00') where i % 3 = 0""",
    "crop_window": "select * from maps where lon between 219.9e0 and 220.1e0 and lat between -0.1e0 and 0.05e0",
    "domain_mean_map": "select * from maps",
    "velocity_map": """select config, m.*, l.bound from maps as m join map_limits as l using (variable) join near_box
        on lon between lon_min and lon_max and lat between lat_min and lat_max""",
    "density_sigma0": f"select time, iz, iy, ix, {SIGMA0} as sigma0 from (select *, SALT as S, THETA as T from cells)",
    "finite_filter": f"select * from ({X.MESSY}) where isfinite(x) and isfinite(y)",
    "sample_points": "select * from samples",
    "model_region": "select * from region",
    "vertical_interp": "select * from w_cells",
    "w_at_centroid": "select * from w_centroid",
    "array_divergence": "select * from div_obs",
    "planefit_divergence": "select * from div_events",
    "planefit_missing": "select * from div_series",
    "planefit_baroclinic": "select * from div_baroclinic",
    "w_from_div": "select * from w_events",
    "model_w_hull_mean": "select * from w_model",
    "w_debarotropic": "select * from w_shear",
    "hull_mean": "select config, time, k, avg(T) as T, avg(S) as S from region group by all",
    "cgrid_divergence": "select * from div_true",
    "eddy_anomalies": "select * from samples_p",
    "vertical_eddy_flux": "select * from cell_flux",
    "array_vertical_flux": "select * from array_flux",
    "model_vertical_flux": "select * from model_flux",
    "flux_integrals": "select * from recovered",
    "flux_profile_stats": """select config, flux, avg(glider) as array_dmean, avg(area) as areamean_dmean,
        avg(total) as total_dmean, corr(glider, area) as r_array_areamean from flux_rows group by all""",
    "flux_compare": "select * from flux_rows join (select config, flux, recovered_frac from recovered) using (config, flux)",
    "w_bias": "select * from bias",
    "w_hovmoller": """select * from bias where depth between -9 and -1 and time >= timestamp '2012-10-01 06:00:00'
        and time < timestamp '2012-10-03 00:00:00'""",
    "w_at_point_depth": "select * from bias where k in (select k from near_level)",
    "w_limits": """select config, what, quantile_cont(abs(v), 0.98) as bound from (
        select config, 'w' as what, w_est as v from bias union all select config, 'w', w_model from bias
        union all select config, 'bias', bias from bias) group by all""",
    "w_profile_stats": f"select config, k, {STATS} from bias group by all",
    "w_depth_mean_series": f"select config, time, {STATS} from bias group by all",
    "w_error_summary": """select config, sqrt(avg(bias * bias)) as rms, avg(bias) as mean_bias, abs(avg(bias)) as abs_mean_bias,
        stddev_pop(w_est) as w_est_std, stddev_pop(w_model) as w_model_std from bias group by config""",
    "bias_series": """select config, 'by_time' as series, time, null as k, avg(bias) as bias from bias group by config, time
        union all select config, 'by_depth', null, k, avg(bias) from bias group by config, k
        union all select config, 'at_level', time, k, bias from bias where k in (select k from near_level)""",
    "abs_p98": 'select config, field, quantile_cont(abs(v - 0.05e0), 0.98) as bound from pop group by all',
    "pooled_percentiles": "select * from p_limits",
    "pdf_histogram": "select * from p_density",
    "ecdf_pair": "select * from p_ecdf",
    "ks_distance": "select * from p_dist",
    "wasserstein_distance": "select * from p_dist",
    "js_distance": "select * from p_js",
    "joint_histogram": "select * from j_hist",
    "joint_js_distance": "select * from j_js",
    "joint_cov_corr": "select * from j_cov",
    "joint_pairs": """select config, pair, side, count(*) as n, sum(x) as sum_x, sum(y) as sum_y from pairs group by all""",
    "joint_sample": "select * from pairs where (l_orderkey * 7919 + l_linenumber * 104729) % 1000003 / 1000003e0 < 0.1e0",
    "joint_compare": "select * from j_all",
    "dist_moments": "select * from p_moments",
    "dist_stats": "select * from p_stats",
    "dist_summary": "select * from p_stats",
    "field_pdfs": "select * from f_density where field <> 'divergence'",
    "field_stats": "select * from f_stats where field <> 'divergence'",
    "field_joint": "select * from fj_all",
    "divergence_pdf": """select * from f_density join (select config, field, ks, js, wasserstein from f_stats)
        using (config, field) where field = 'divergence'""",
    "divergence_corr": "select * from div_corr",
    "divergence_corr_beyond": "select * from div_corr",
    "array_divergence_beyond": "select * from div_obs",
    "sample_points_beyond": "select * from samples",
    "w_debarotropic_beyond": "select * from w_shear",
    "flux_integrals_beyond": "select * from recovered",
    "stored_slice_stride": """select * from (select time, count(*) as n, sum(SALT) as total, (epoch(time) - epoch(timestamp '2012-10-01'))
        / 10800 as i from cells where time >= timestamp '2012-10-01 06:00:00' and time < timestamp '2012-10-04' group by time)
        where (i - 2) % 3 = 0""",
    "stored_irregular_stride": """select time, n, total from (select *, row_number() over (order by time) - 1 as i from (
        select *, (epoch(time) - epoch(timestamp '2012-10-01')) / 300 as step from per_time)
        where step % 5 <> 0 and step >= 72) where i % 3 = 0""",
    "stored_divergence_corr": COUNTED.format(rest="c.div_corr", joins=""),
    "velocity_map_range": """select config, m.*, l.bound from maps as m join map_limits as l using (variable) join near_box
        on lon between lon_min and lon_max and lat between lat_min and lat_max""",
    "stats_record": RECORD.format(depth=10),
    "stats_record_beyond": RECORD.format(depth=14),
    **dict.fromkeys(("stats_record_depths", "stats_sink"), RECORD),  # see NESTED
}

# Queries over the gridding without gaps.
FULL = {"flux_integrals", "flux_compare", "divergence_corr", "stats_record", "stored_divergence_corr"}
# Queries of several depths: the record of each.
NESTED = {"stats_record_depths", "stats_sink"}
# Deeper than the grid, with arrays over its edge and outside it, over the gridding without gaps.
BEYOND = {name for name in RESULTS if name.endswith("_beyond")}
MORE_SENSORS = """ union all select config, cast(g as int), lat, lon from (values
    ('edge', 0, 0.1e0, 220.1e0), ('edge', 1, 0.1e0, 220.3e0), ('edge', 2, -0.05e0, 220.05e0),
    ('far', 0, 5.0e0, 225.0e0), ('far', 1, 5.1e0, 225.2e0), ('far', 2, 4.9e0, 225.1e0)) as p(config, g, lat, lon)"""


def build(name: str) -> str:
    """One self-contained statement: the needed subqueries in order, then the result."""
    if name in NESTED:
        return " union all ".join(f"select * from ({_statement('stats_record', d)})" for d in (X.SHALLOW, X.MAX_DEPTH))
    return _statement(name)


def _statement(name: str, depth: int | None = None) -> str:
    texts, result = dict(CTE), RESULTS[name]
    if name in FULL | BEYOND:
        texts["cells"] = loaded("coarse_cells")
    if name == "stored_divergence_corr":
        texts["cells"] = f"select * from ({texts['cells']}) where dense_rank_of_time % 2 = 1".replace(
            "select timestamp", "select dense_rank() over (order by iter) as dense_rank_of_time, timestamp")
    if name == "velocity_map_range":
        texts["cells"] = (f"select * from ({texts['cells']}) where time >= timestamp '2012-10-01 06:00:00' "
                          "and time < timestamp '2012-10-03 00:00:00'")
    if name == "field_pdfs":  # limits fall on values of which there are many copies, equal but for their last bits
        unit = f"1e{X.DIGITS}"
        texts["field_pop"] = f"select * replace (round_even(v * {unit}, 0) / {unit} as v) from ({texts['field_pop']})"
    if depth is not None:
        result = RECORD.format(depth=depth)
        texts["layers"] = texts["layers"].replace(f"range({N})", f"range({int(depth / DZ)})")
        texts["interfaces"] = texts["interfaces"].replace(f"range({N + 1})", f"range({int(depth / DZ) + 1})")
    if name in BEYOND:
        texts["sensors"] += MORE_SENSORS
        texts["layers"] = texts["layers"].replace(f"range({N})", f"range({int(X.DEEP / DZ)})")
        texts["interfaces"] = texts["interfaces"].replace(f"range({N + 1})", f"range({int(X.DEEP / DZ) + 1})")
    order: list[str] = []

    def need(text: str) -> None:
        words = set(re.findall(r"\b\w+\b", text))
        for cte in texts:
            if cte in words and cte not in order and texts[cte] != text:
                need(texts[cte])
                if cte not in order:
                    order.append(cte)

    need(result)
    parts = [f"{cte} as ({texts[cte]})" for cte in order] + [f"final_rows as ({result})"]
    return f"with {', '.join(parts)} {shaped_sql(name, 'final_rows')}"


def oracle_sql() -> dict[str, str]:
    return {name: build(name) for name in RESULTS if name in SPECS}
