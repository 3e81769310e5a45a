"""Set-oriented statistical tests.

Each test reduces the rows of a group (keys) to one result row with
built-in aggregates; tail probabilities come from ``functions.tails`` and run
on the result rows only.  Inputs are *long* frames: unpivot first (P10), then
one ``groupBy`` answers every pair / entity / metric at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .ranks import average_rank, average_rank_global, beside, positions

# Significance level and conclusion labels.
ALPHA = 0.05
SIGNIFICANT = "SIGNIFICANT"
NOT_SIGNIFICANT = "NIET SIGNIFICANT"
NO_TEST = "GEEN TEST"
#: The p value of Mann-Whitney is always the normal approximation's.
MANN_WHITNEY_METHOD = "asymptotic"


def conclusion(p, p_adj=None):
    """Adjusted p when present else raw; NULL -> no test."""
    p_use = F.coalesce(p_adj, p) if p_adj is not None else p
    return (F.when(p_use.isNull(), NO_TEST)
            .when(p_use < ALPHA, SIGNIFICANT)
            .otherwise(NOT_SIGNIFICANT))


def _rank_fn(scale: str):
    return average_rank_global if scale == "global" else average_rank


def with_all_keys(src: DataFrame, res: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Give every key of ``src`` a result row (counts 0 when no row qualified)."""
    k = src.select(*keys).distinct()
    out = k.join(res, keys, "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) if c in zero else F.col(c)
                        for c in res.columns])


def correlation_tests(df: DataFrame, keys: list[str], x: str, y: str,
                      min_n: int = 10, rank_scale: str = "group", all_keys: bool = True) -> DataFrame:
    """Pearson r and Spearman rho with two-sided p per ``keys``.

    Pairwise complete rows only; r is NULL unless n >= min_n and both sides
    have at least two distinct values (min < max).  n is always reported.
    """
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rank = _rank_fn(rank_scale)
    d = rank(rank(d, keys, "_x", "_rx"), keys, "_y", "_ry")
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("_x") < F.max("_x")).alias("_vx"),
        (F.min("_y") < F.max("_y")).alias("_vy"),
        F.covar_samp("_x", "_y").alias("_cxy"),
        F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy"),
        F.covar_samp("_rx", "_ry").alias("_crr"),
        F.stddev_samp("_rx").alias("_srx"), F.stddev_samp("_ry").alias("_sry"),
    )
    res = _correlation_row(agg, keys, min_n, F.try_divide(F.col("_crr"), F.col("_srx") * F.col("_sry")))
    return with_all_keys(df, res, keys, ["n"]) if all_keys else res


def _correlation_row(agg: DataFrame, keys: list[str], min_n: int, rho) -> DataFrame:
    """r, rho and their p values from ``n, _vx, _vy`` (sides that vary),
    ``_cxy, _sx, _sy`` and the unguarded ``rho``."""
    ok = (F.col("n") >= min_n) & F.col("_vx") & F.col("_vy")

    def guarded(r):
        return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))

    out = agg.withColumn("pearson_r", guarded(F.try_divide(F.col("_cxy"), F.col("_sx") * F.col("_sy")))) \
             .withColumn("spearman_rho", guarded(rho))
    out = out.withColumn("_nu", F.col("n") - 2.0)
    for r, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p")):
        out = out.withColumn(f"_t_{r}", F.try_divide(F.col(r) * F.sqrt(F.col("n") - 2.0),
                                                     F.sqrt(F.lit(1.0) - F.col(r) * F.col(r))))
        out = tails.with_t_two_sided(out, f"_t_{r}", "_nu", f"_p_{r}")
        out = out.withColumn(p, F.when(F.abs(F.col(r)) >= 1.0, F.lit(0.0)).otherwise(F.col(f"_p_{r}")))
    return out.select(*keys, F.col("n").cast("long").alias("n"), "pearson_r", "pearson_p", "spearman_rho", "spearman_p")


def target_correlations(df: DataFrame, features: list[str], targets: list[str], min_n: int = 10, parts: int | None = None) -> DataFrame:
    """T1/T2 at row grain: (feature, target, n, ...) for every feature column
    against every target column, on their pairwise complete rows.

    Rows with the same value share a rank, so no row is sorted: a target's
    distinct values, each with the number of its rows that have a feature, are
    sorted once for all features (``positions`` with those numbers as weights),
    and rows meet the rank of their target's value in a join.  The feature's own
    ranks come from sums per (feature, value) in the same way.  Moments merge from
    the same sums, centred.  With c = (n + 1) / 2, rho is
    sum((Rx - c) (Ry - c)) over sqrt of both sums of squares, and such a sum is
    (n^3 - n - sum(t^2 - 1 over rows)) / 12 for ties of t rows."""
    base = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
                     *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(targets)])
    count = range(len(features))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    results = []
    for t, target in enumerate(targets):
        y = f"_y{t}"
        rows = base.where(F.col(y).isNotNull()).select(*[f"_x{i}" for i in count], F.col(y).alias("y"))
        per = rows.groupBy("y").agg(*[F.count(f"_x{i}").alias(f"_h{i}") for i in count])
        per = positions(per, [], "y", parts=parts, weights=[f"_h{i}" for i in count])
        per = per.select(F.col("y").alias("_y"), *[f(f"_before{i}", f"_ties{i}").alias(f"{n}{i}") for i in count for n, f in (
            ("_rank", lambda before, ties: F.col(before) + (F.col(ties) + 1) / 2.0), ("_tied", lambda _, ties: F.col(ties).cast("double") * F.col(ties) - 1.0))])
        long = rows.join(per, F.col("y") == F.col("_y")).select("y", F.inline(F.array(*[F.struct(
            F.lit(i).alias("feature"), F.col(f"_x{i}").alias("x"), F.col(f"_rank{i}").alias("rank"), F.col(f"_tied{i}").alias("tied"))
            for i in count]))).where("x IS NOT NULL")
        # all that is needed of the rows, per distinct value of a feature: one pass
        values = long.groupBy("feature", "x").agg(
            F.count(F.lit(1)).alias("k"), F.sum("rank").alias("ranks"), F.sum("tied").alias("ty"),
            F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        values = positions(values, ["feature"], "x", parts=parts, weights=["k"])
        k = F.col("k").cast("double")
        means = values.groupBy("feature").agg(
            F.sum("k").alias("n"), (F.min("x") < F.max("x")).alias("_vx"), (F.min("y0") < F.max("y1")).alias("_vy"),
            (F.sum(k * F.col("x")) / F.sum(k)).alias("_mx"), (F.sum(k * F.col("my")) / F.sum(k)).alias("_my"))
        n, dx, dy, centre = F.col("n").cast("double"), F.col("x") - F.col("_mx"), F.col("my") - F.col("_my"), (F.col("n") + 1) / 2.0
        sums = values.join(F.broadcast(means), "feature").groupBy("feature", "n", "_vx", "_vy").agg(
            F.sum(k * dx * dy).alias("_cxy"), F.sqrt(F.sum(k * dx * dx)).alias("_sx"), F.sqrt(F.sum(k * (F.col("vy") + dy * dy))).alias("_sy"),
            F.sum((F.col("_before0") + (k + 1) / 2.0 - centre) * (F.col("ranks") - k * centre)).alias("_rxy"),
            F.sum(k * (k * k - 1.0)).alias("_tx"), F.sum("ty").alias("_ty"))
        square = lambda ties: (n * n * n - n - F.col(ties)) / 12.0
        one = _correlation_row(sums, ["feature"], min_n,
                               F.try_divide(F.col("_rxy"), F.nullif(F.sqrt(square("_tx")) * F.sqrt(square("_ty")), F.lit(0.0))))
        results.append(one.withColumn("feature", name).withColumn("target", F.lit(target)))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    pairs = df.sparkSession.createDataFrame([(f, t) for f in features for t in targets], "feature string, target string")
    return with_all_keys(pairs, out, ["feature", "target"], ["n"]).select("feature", "target", "n", "pearson_r", "pearson_p", "spearman_rho", "spearman_p")


def _tie_term(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sum(t^3 - t) over tie groups of ``value`` per keys."""
    return (d.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_t"))
            .groupBy(*keys).agg(F.sum(F.pow("_t", 3) - F.col("_t")).alias("_ties")))


def two_group_tests(df: DataFrame, keys: list[str], group_col: str, value: str,
                    group_a: str, group_b: str, rank_scale: str = "group", all_keys: bool = True,
                    mann_whitney: bool = True) -> DataFrame:
    """Welch t, Mann-Whitney U (normal approximation with tie and
    continuity correction; U of side a) and Cohen's d, per ``keys``.
    ``mann_whitney=False`` skips the rank pass (U and its p are NULL)."""
    d = df.select(*keys, F.col(group_col).alias("_g"), F.col(value).cast("double").alias("_v")) \
        .where(F.col("_g").isin(group_a, group_b) & F.col("_v").isNotNull())
    if mann_whitney:
        d = _rank_fn(rank_scale)(d, keys, "_v", "_r")
    else:
        d = d.withColumn("_r", F.lit(None).cast("double"))
    isa, isb = F.col("_g") == group_a, F.col("_g") == group_b
    agg = d.groupBy(*keys).agg(
        F.count_if(isa).alias("n_a"), F.count_if(isb).alias("n_b"),
        F.avg(F.when(isa, F.col("_v"))).alias("_ma"), F.avg(F.when(isb, F.col("_v"))).alias("_mb"),
        F.median(F.when(isa, F.col("_v"))).alias("_meda"), F.median(F.when(isb, F.col("_v"))).alias("_medb"),
        F.var_samp(F.when(isa, F.col("_v"))).alias("_va"), F.var_samp(F.when(isb, F.col("_v"))).alias("_vb"),
        F.sum(F.when(isa, F.col("_r"))).alias("_ra"),
    )
    if mann_whitney:
        agg = agg.join(_tie_term(d, keys, "_v"), keys, "left")
    else:
        agg = agg.withColumn("_ties", F.lit(None).cast("double"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    two = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    sa, sb = F.col("_va") / na, F.col("_vb") / nb
    out = (agg
           .withColumn("mean_a", F.when(both, F.col("_ma"))).withColumn("mean_b", F.when(both, F.col("_mb")))
           .withColumn("median_a", F.when(both, F.col("_meda"))).withColumn("median_b", F.when(both, F.col("_medb")))
           .withColumn("difference_a_minus_b", F.col("mean_a") - F.col("mean_b"))
           .withColumn("_se2", F.when(two, sa + sb))
           .withColumn("_flat", (F.col("_se2") == 0) & (F.col("difference_a_minus_b") != 0))
           .withColumn("welch_t", F.when(F.col("_flat"), F.signum("difference_a_minus_b") * F.lit(float("inf"))).otherwise(
               F.try_divide(F.col("difference_a_minus_b"), F.sqrt(F.nullif(F.col("_se2"), F.lit(0.0))))))
           .withColumn("_df", F.try_divide(F.col("_se2") * F.col("_se2"),
                                           sa * sa / (na - 1.0) + sb * sb / (nb - 1.0)))
           .transform(lambda x: tails.with_t_two_sided(x, "CASE WHEN NOT _flat THEN welch_t END", "_df", "_wp"))
           .withColumn("welch_p", F.when(F.col("_flat"), F.lit(0.0)).when(F.col("welch_t").isNotNull(), F.col("_wp")))
           .withColumn("mannwhitney_u", F.when(two, F.col("_ra") - na * (na + 1.0) / 2.0))
           .withColumn("_n", na + nb)
           .withColumn("_sig", F.sqrt(na * nb / 12.0 * ((F.col("_n") + 1.0)
                                                         - F.try_divide(F.col("_ties"), F.col("_n") * (F.col("_n") - 1.0)))))
           .withColumn("_z", F.try_divide(F.abs(F.col("mannwhitney_u") - na * nb / 2.0) - 0.5, F.nullif(F.col("_sig"), F.lit(0.0))))
           .transform(lambda x: tails.with_norm_two_sided(x, "_z", "_zp"))
           .withColumn("mannwhitney_p", F.when(F.col("_z") <= 0, F.lit(1.0))
                       .when(F.col("_z").isNotNull(), F.col("_zp")))
           .withColumn("_pooled", F.sqrt(((na - 1.0) * F.col("_va") + (nb - 1.0) * F.col("_vb")) / (na + nb - 2.0)))
           .withColumn("cohens_d", F.when(two & (F.col("_pooled") > 0), F.col("difference_a_minus_b") / F.col("_pooled"))))
    res = out.select(*keys, F.lit(group_a).alias("group_a"), F.lit(group_b).alias("group_b"),
                     F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"),
                     "mean_a", "mean_b", "median_a", "median_b", "difference_a_minus_b",
                     "welch_t", "welch_p", "mannwhitney_u", "mannwhitney_p",
                     F.when(F.col("mannwhitney_p").isNotNull(), F.lit(MANN_WHITNEY_METHOD)).alias("mannwhitney_method"), "cohens_d")
    if not all_keys:
        return res
    full = with_all_keys(df, res, keys, ["n_a", "n_b"])
    return full.withColumn("group_a", F.lit(group_a)).withColumn("group_b", F.lit(group_b))


def anova_kruskal(df: DataFrame, keys: list[str], group_col: str, value: str) -> DataFrame:
    """One-way ANOVA F and tie-corrected Kruskal-Wallis H per keys over
    groups with >= 2 rows; n_total and groups count every non-null row/group."""
    d = df.select(*keys, F.col(group_col).alias("_g"), F.col(value).cast("double").alias("_v")) \
        .where(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    sizes = d.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_ng"))
    totals = sizes.groupBy(*keys).agg(F.sum("_ng").cast("long").alias("n_total"),
                                      F.count(F.lit(1)).cast("long").alias("groups"))
    valid = d.join(sizes.where(F.col("_ng") >= 2).select(*keys, "_g"), keys + ["_g"])
    valid = average_rank(valid, keys, "_v", "_r")
    per_group = valid.groupBy(*keys, "_g").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_v").alias("_m"),
        F.var_samp("_v").alias("_var"), F.sum("_r").alias("_R"), F.sum("_v").alias("_s"))
    wk = Window.partitionBy(*keys)
    per_group = per_group.withColumn("_gm", F.sum("_s").over(wk) / F.sum("_n").over(wk))
    stats = per_group.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_k"), F.sum("_n").alias("_N"),
        F.sum(F.col("_n") * (F.col("_m") - F.col("_gm")) * (F.col("_m") - F.col("_gm"))).alias("_ssb"),
        F.sum((F.col("_n") - 1.0) * F.col("_var")).alias("_ssw"),
        F.sum(F.col("_R") * F.col("_R") / F.col("_n")).alias("_r2n"),
    ).join(_tie_term(valid, keys, "_v"), keys, "left")
    ok = F.col("_k") >= 2
    N = F.col("_N")
    out = (stats
           # no variance inside the groups: infinite if their means differ
           .withColumn("_flat", ok & (F.col("_ssw") == 0) & (F.col("_ssb") > 0))
           .withColumn("anova_f", F.when(F.col("_flat"), F.lit(float("inf"))).when(ok, F.try_divide(F.col("_ssb") / (F.col("_k") - 1.0),
                                                            F.nullif(F.col("_ssw"), F.lit(0.0)) / (N - F.col("_k")))))
           .withColumn("_d1", F.col("_k") - 1.0).withColumn("_d2", N - F.col("_k"))
           .transform(lambda x: tails.with_f_upper(x, "CASE WHEN NOT _flat THEN anova_f END", "_d1", "_d2", "_ap"))
           .withColumn("anova_p", F.when(F.col("_flat"), F.lit(0.0)).when(F.col("anova_f").isNotNull(), F.col("_ap")))
           .withColumn("_h0", 12.0 / (N * (N + 1.0)) * F.col("_r2n") - 3.0 * (N + 1.0))
           .withColumn("_c", F.lit(1.0) - F.try_divide(F.col("_ties"), N * N * N - N))
           .withColumn("kruskal_h", F.when(ok, F.try_divide(F.col("_h0"), F.nullif(F.col("_c"), F.lit(0.0)))))
           .transform(lambda x: tails.with_chi2_upper(x, "kruskal_h", "_d1", "_kp"))
           .withColumn("kruskal_p", F.when(F.col("kruskal_h").isNotNull(), F.col("_kp"))))
    res = out.select(*keys, "anova_f", "anova_p", "kruskal_h", "kruskal_p")
    return totals.join(res, keys, "left").select(*keys, "n_total", "groups", "anova_f", "anova_p", "kruskal_h", "kruskal_p")


def bh_adjust(df: DataFrame, family: list[str], p_col: str, out_col: str, buckets: int | None = None) -> DataFrame:
    """Benjamini-Hochberg within ``family`` (NULL p stay NULL).

    BH only depends on the distinct p values: with m tests and end(v) the
    number of p <= v, adj(v) = min(1, min over v' >= v of v' * m / end(v')).
    The rows are sample-sorted by p once (``ranks.positions``), which gives
    end(v); the suffix minimum is taken inside each range and then over the
    minima of the later ones, so no window holds a whole family (millions of
    entity tests stay spread over tasks), and nothing is joined back."""
    rows = positions(df, family, p_col, parts=buckets)
    mine = Window.partitionBy(*family)
    sizes = rows.groupBy(*family, "_part").agg(F.count(p_col).alias("_k")).withColumn("_m", F.sum("_k").over(mine))
    rows = beside(rows, sizes.drop("_k"), [*family, "_part"]).withColumn("_raw", F.col(p_col) * F.col("_m") / (F.col("_before") + F.col("_ties")))
    later = (rows.groupBy(*family, "_part").agg(F.min("_raw").alias("_least"))
             .withColumn("_after", F.min("_least").over(mine.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1))))
    within = Window.partitionBy(*family, "_part").orderBy(F.desc_nulls_first(p_col)).rowsBetween(Window.unboundedPreceding, 0)
    rows = beside(rows.withColumn("_in", F.min("_raw").over(within)), later.drop("_least"), [*family, "_part"])
    adjusted = F.when(F.col(p_col).isNotNull(), F.least(F.lit(1.0), F.col("_in"), F.coalesce("_after", F.lit(1.0))))
    return rows.select(*df.columns, adjusted.alias(out_col))


def bh_adjust_all(df: DataFrame, family: list[str], columns: dict[str, str], buckets: int | None = None) -> DataFrame:
    """T10 for several p columns (p -> adjusted), each a set of families of its
    own: one sort for all of them."""
    names = list(columns)
    whole = df.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*df.columns).alias("_row"), *family, *names)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_p")) for i, c in enumerate(names)]))
    long = bh_adjust(whole.select("_rid", "_row", *family, each), ["_which", *family], "_p", "_adj", buckets)
    back = long.groupBy("_rid").agg(F.any_value("_row").alias("_row"), *[
        F.max(F.when(F.col("_which") == i, F.col("_adj"))).alias(f"_adj{i}") for i in range(len(names))])
    return back.select("_row.*", *[F.col(f"_adj{i}").alias(out) for i, out in enumerate(columns.values())])
