"""Two-sample distribution comparison at scale.

A population is a long table (keys..., side, v) with side 'obs' or 'true'. Everything that needs
order statistics goes through the value cells of `value_cells`: percentiles from mergeable counts and
the few cells that hold their ranks, ECDFs, KS and Wasserstein from ranges of bounded size whose
starting counts are known beforehand. No key's values are ever gathered in one task, however many
rows or ties it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, join_checked
from ..functions.columns import correlation, histogram_bin, is_finite
from ..model import HIST_BINS, HIST_PROBS
from .value_cells import SIDES, Ranks, by_depth, moment_columns, ordered_values, percentiles


def on_side(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named values are all finite; a pair is dropped whole."""
    for c in columns:
        df = df.filter(is_finite(F.col(c)))
    return df


def pooled(obs: DataFrame, true: DataFrame, columns) -> DataFrame:
    """Both populations in one table with a side tag."""
    cols = list(columns)
    return (obs.select(*cols, F.lit("obs").alias("side"))
            .unionByName(true.select(*cols, F.lit("true").alias("side"))))


def field_population(wide: DataFrame, fields, keys=("config",)) -> DataFrame:
    """One row per finite value: (keys..., side, field, v)."""
    return finite_rows(wide.unpivot([*keys, "side"], list(fields), "field", "v"), "v")


# ---------------------------------------------------------------- order statistics

def rank_table(population: DataFrame, keys, depths=()) -> Ranks:
    """The values of (keys..., side, v) in ordered cells; nothing is computed before it is used.

    depths: nested populations, see `value_cells`; the population then has a column depth_class.
    """
    return Ranks(population, tuple(keys), tuple(depths))


def ecdf(ranks: Ranks) -> DataFrame:
    """(keys..., v, f_obs, f_true, next_v): both ECDFs at every distinct value of the whole population."""
    last = ranks.classes[-1]

    def total(prefix, side):
        return sum((F.col(f"{prefix}_n_{side}_{c}") for c in range(1, last + 1)), F.col(f"{prefix}_n_{side}_0"))

    return ordered_values(ranks).select(
        *ranks.keys, "v", *[F.try_divide(total("past", s).cast("double"), total("all", s).cast("double")).alias(f"f_{s}")
                            for s in SIDES], "next_v")


def ecdf_distances(ranks: Ranks) -> DataFrame:
    """(keys..., [max_depth,] ks, wasserstein), both from one pass; NULL if a side is empty.

    A value that a nested population lacks leaves its ECDFs as they were and splits one step of the
    integral in two, so all depths are read off the same ordered values.
    """
    def f(side, d):
        def total(prefix):
            return sum((F.col(f"{prefix}_n_{side}_{c}") for c in range(1, d + 1)), F.col(f"{prefix}_n_{side}_0"))
        return F.try_divide(total("past").cast("double"), total("all").cast("double"))

    gaps = ordered_values(ranks).select(*ranks.keys, "v", "next_v", *[
        F.abs(f("obs", d) - f("true", d)).alias(f"gap_{d}") for d in ranks.classes])
    step = F.col("next_v") - F.col("v")
    sums = gaps.groupBy(*ranks.keys).agg(*[a for d in ranks.classes for a in (
        F.max(f"gap_{d}").alias(f"ks_{d}"),
        F.coalesce(F.sum(F.col(f"gap_{d}") * step), F.max(F.col(f"gap_{d}") * 0)).alias(f"wasserstein_{d}"))])
    rows = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"ks_{d}").alias("ks"), F.col(f"wasserstein_{d}").alias("wasserstein"))
                     for d in ranks.classes])
    return sums.select(*ranks.keys, F.inline(rows)).select(*ranks.keys, *ranks.named_depth(), "ks", "wasserstein")


def rank_percentiles(ranks: Ranks, probs: dict) -> DataFrame:
    """Exact linear-interpolated percentiles of the pooled values: (keys..., [max_depth,] <name>...)."""
    return percentiles(ranks, probs)


def exact_percentiles(values: DataFrame, keys, probs: dict) -> DataFrame:
    """Exact percentiles per key of one population (keys..., v); missing values skipped."""
    tagged = finite_rows(values, "v").withColumn("side", F.lit("true"))
    return rank_percentiles(rank_table(tagged, keys), probs)


def pooled_limits(ranks: Ranks) -> DataFrame:
    """Durable (keys..., [max_depth,] lo, hi): the 0.5 and 99.5 percentiles of both sides together."""
    return durable(rank_percentiles(ranks, {"lo": HIST_PROBS[0], "hi": HIST_PROBS[1]}), "limits")


# ---------------------------------------------------------------- histograms

def histogram(ranks: Ranks, limits: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """(keys..., [max_depth,] bin, n_obs, n_true) inside the limits; rows are counted map-side."""
    keys = ranks.result_keys
    joined = join_checked(by_depth(ranks.population, ranks.depths).select(*keys, "side", "v"), limits, keys)
    return (joined.withColumn("bin", histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins))
            .filter(F.col("bin").isNotNull())
            .groupBy(*keys, "bin").agg(F.count_if(F.col("side") == "obs").alias("n_obs"),
                                       F.count_if(F.col("side") == "true").alias("n_true")))


def histogram_density(hist: DataFrame, limits: DataFrame, keys, bins: int = HIST_BINS) -> DataFrame:
    """All bins of each key with lower edge, counts and densities of both sides.

    The number of bins is fixed, so the grid and the windows over it stay small.
    """
    keys = list(keys)
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / bins
    whole = Window.partitionBy(*keys)
    full = grid.join(hist, [*keys, "bin"], "left").na.fill(0, ["n_obs", "n_true"])
    return full.select(
        *keys, "bin", (F.col("bin") * step + F.col("lo")).alias("edge"), "n_obs", "n_true",
        *[F.try_divide(F.col(f"n_{s}"), F.sum(f"n_{s}").over(whole) * step).alias(f"density_{s}")
          for s in SIDES])


def js_distance(hist: DataFrame, keys) -> DataFrame:
    """(keys..., js): Jensen-Shannon distance (base 2) of binned counts; NULL if a side is empty.

    hist may be binned in one or two dimensions. Bins without counts add nothing.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)  # at most bins, or bins * bins, rows
    p = F.try_divide("n_obs", F.sum("n_obs").over(whole))
    q = F.try_divide("n_true", F.sum("n_true").over(whole))
    m = (F.col("p") + F.col("q")) / 2

    def part(x):
        return F.when(x > 0, x * F.log2(x / m)).when(x == 0, F.lit(0.0))

    return (hist.select(*keys, p.alias("p"), q.alias("q")).groupBy(*keys)
            .agg((F.sum(part(F.col("p")) + part(F.col("q"))) / 2).alias("d"))
            .select(*keys, F.sqrt(F.when(F.col("d") > 0, F.col("d")).when(F.col("d") <= 0, F.lit(0.0))).alias("js")))


# ---------------------------------------------------------------- statistics records

def moments(population: DataFrame, keys) -> DataFrame:
    """Mean, standard deviation (population) and biased skewness of each side, one pass."""
    return population.groupBy(*keys).agg(*moment_columns())


def dist_stats(population: DataFrame, keys=("config", "field"), ranks: Ranks | None = None,
               limits: DataFrame | None = None) -> DataFrame:
    """One record per key (and nested depth): moments of both sides, KS, Wasserstein and Jensen-Shannon distance."""
    ranks = rank_table(population, keys) if ranks is None else ranks
    limits = pooled_limits(ranks) if limits is None else limits
    keys = ranks.result_keys
    return (ranks.summary.drop("lo", "hi")
            .join(ecdf_distances(ranks), keys, "left")
            .join(js_distance(histogram(ranks, limits), keys), keys, "left"))


# ---------------------------------------------------------------- joint distributions

# The pairs whose joint distributions are reported.
PAIRS = (
    ("uv", "U", "V"),
    ("TS", "T", "S"),
    ("stress_uv", "Up", "Vp"),
    ("heatflux_vT", "Vp", "Tp"),
    ("heatflux_uT", "Up", "Tp"),
)


def pair_population(wide: DataFrame, pairs=PAIRS, keys=("config",), extra=()) -> DataFrame:
    """(keys..., extra..., side, pair, x, y): one row per pair that is finite in both values."""
    items = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(x).cast("double").alias("x"),
                               F.col(y).cast("double").alias("y")) for n, x, y in pairs])
    return finite_rows(wide.select(*keys, *extra, "side", F.inline(items)), "x", "y")


def axis_ranks(pairs: DataFrame, keys=("config", "pair")) -> Ranks:
    """Both values of each pair as populations of their own; their first pass takes the co-moments along."""
    sides = F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v"), F.col("y").alias("w")),
                    F.struct(F.lit("y").alias("axis"), F.col("y").alias("v"), F.col("x").alias("w")))
    return Ranks(pairs.select(*keys, "side", F.inline(sides)), (*keys, "axis"), extra=tuple(_co_moments("v", "w")))


def _wide_limits(limits: DataFrame, keys) -> DataFrame:
    return limits.groupBy(*keys).agg(*[
        F.max(F.when(F.col("axis") == a, F.col(e))).alias(f"{a}_{e}") for a in ("x", "y") for e in ("lo", "hi")])


def joint_limits(pairs: DataFrame, keys=("config", "pair")) -> DataFrame:
    """(keys..., x_lo, x_hi, y_lo, y_hi): pooled percentiles of each axis of each pair."""
    return _wide_limits(pooled_limits(axis_ranks(pairs, keys)), list(keys))


def joint_histogram(pairs: DataFrame, limits: DataFrame, keys=("config", "pair"),
                    bins: int = HIST_BINS) -> DataFrame:
    """(keys..., bin_x, bin_y, n_obs, n_true); a pair outside either range is dropped."""
    joined = join_checked(pairs.select(*keys, "side", "x", "y"), limits, keys)
    return (joined.withColumns({
        "bin_x": histogram_bin(F.col("x"), F.col("x_lo"), F.col("x_hi"), bins),
        "bin_y": histogram_bin(F.col("y"), F.col("y_lo"), F.col("y_hi"), bins)})
        .filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy(*keys, "bin_x", "bin_y")
        .agg(F.count_if(F.col("side") == "obs").alias("n_obs"),
             F.count_if(F.col("side") == "true").alias("n_true")))


def _co_moments(x: str, y: str) -> list[Column]:
    return [f(on_side(s, F.col(x)), on_side(s, F.col(y))).alias(f"{n}_{s}")
            for n, f in (("cov", F.covar_samp), ("corr", correlation)) for s in SIDES]


def covariances(pairs: DataFrame, keys=("config", "pair")) -> DataFrame:
    """(keys..., cov_obs, cov_true, corr_obs, corr_true); n - 1 covariance."""
    return pairs.groupBy(*keys).agg(*_co_moments("x", "y"))


def thin(rows: DataFrame, identity: Column, fraction: float) -> DataFrame:
    """About this fraction of the rows, for drawing: those whose identity falls low in [0, 1).

    identity is a number in [0, 1) made from what names a row, so the draw is repeatable. It
    is a filter: no sort and no shuffle.
    """
    return rows.where(identity < F.lit(float(fraction)))


def joint_compare(pairs: DataFrame, keys=("config", "pair"), limits: DataFrame | None = None,
                  bins: int = HIST_BINS) -> DataFrame:
    """One record per pair: limits, covariance and correlation per side, joint distance.

    The pairs are written once, so that what they come from is evaluated once; spans and co-moments come
    from one pass over that table, cells from a second, and the joint counts from the last.
    """
    keys = list(keys)
    pairs = durable(pairs.select(*keys, "side", "x", "y"), "pairs")
    ranks = axis_ranks(pairs, keys)
    limits = durable(_wide_limits(rank_percentiles(ranks, {"lo": HIST_PROBS[0], "hi": HIST_PROBS[1]}), keys),
                     "joint-limits") if limits is None else limits
    js = js_distance(joint_histogram(pairs, limits, keys, bins), keys)
    moments = ranks.summary.where("axis = 'x'").select(*keys, *[f"{n}_{s}" for n in ("cov", "corr") for s in SIDES])
    return moments.join(js, keys, "left").join(limits, keys, "left")
