"""Association statistics and classifier reports.

Every statistic is computed from one aggregation pass over the rows (partial
aggregation handles hot keys); the follow-up arithmetic runs on the
aggregated table, whose size is bounded by the product of category counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _r(c, n: int = 6):
    return F.round(c, n)


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """sqrt(chi2 / (n * (min(r, c) - 1))) of one pair of columns."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("o"))
    # written once: four totals are taken of the cells, and their number is bounded by the categories, not by the rows
    cells = cells.select(F.lit(x).alias("col1"), F.lit(y).alias("col2"), "x", "y", "o").checkpoint(eager=True)
    return cramers_of_cells(cells)


def cramers_of_cells(cells: DataFrame) -> DataFrame:
    """A11 for many pairs at once: (col1, col2, n, chi2, cramers_v) from cells (col1, col2, x, y, o).

    chi2 over the full r x c table; cells absent from the data are handled by
    chi2 = n * (sum o^2 / (r_i c_j) - 1).  As in scipy, Yates' correction is
    applied only when dof = 1 (2 x 2), computed from the four counts.  A table
    with a single row or column gives null.  Totals are aggregates joined back,
    so the cells of a pair never meet in one task.
    """
    key = ["col1", "col2"]
    t = (cells.join(cells.groupBy(*key, "x").agg(F.sum("o").alias("ri")), [*key, "x"])
         .join(cells.groupBy(*key, "y").agg(F.sum("o").alias("cj")), [*key, "y"])
         .join(cells.groupBy(*key).agg(F.sum("o").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0")), key))
    agg = t.groupBy(*key).agg(
        F.first("n").alias("n"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c"),
        F.sum(F.col("o") * F.col("o") / (F.col("ri") * F.col("cj"))).alias("s"),
        *[F.sum(F.when((F.col("x") == F.col("x0")) == xa, F.when((F.col("y") == F.col("y0")) == ya,
                                                                 F.col("o")))).alias(f"n{i}{j}")
          for i, xa in enumerate([True, False]) for j, ya in enumerate([True, False])])
    n = F.col("n").cast("double")
    o = {k: F.coalesce(F.col(k), F.lit(0)).cast("double") for k in ["n00", "n01", "n10", "n11"]}
    r0, r1 = o["n00"] + o["n01"], o["n10"] + o["n11"]
    c0, c1 = o["n00"] + o["n10"], o["n01"] + o["n11"]

    def yates(obs, ri, cj):
        e = ri * cj / n
        d = e - obs
        adj = obs + F.signum(d) * F.least(F.lit(0.5), F.abs(d))
        return (adj - e) * (adj - e) / e

    chi_yates = (yates(o["n00"], r0, c0) + yates(o["n01"], r0, c1) + yates(o["n10"], r1, c0)
                 + yates(o["n11"], r1, c1))
    chi_plain = n * (F.col("s") - F.lit(1.0))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), chi_yates).otherwise(chi_plain)
    k = F.least(F.col("r"), F.col("c")) - 1
    return agg.select(*key, F.col("n").cast("long").alias("n"), _r(chi2).alias("chi2"),
                      F.when(k > 0, _r(F.sqrt(chi2 / (n * k)))).alias("cramers_v"))


def pearson_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation for every ordered pair (i < j) in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                   for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stack}) as (col1, col2, corr)") \
        .withColumn("corr", _r(F.col("corr")))


def anova_f(df: DataFrame, cat: str, num: str) -> DataFrame:
    """One-way ANOVA F statistic of ``num`` across the groups of ``cat``."""
    g = df.filter(F.col(cat).isNotNull() & F.col(num).isNotNull()).groupBy(cat).agg(
        F.count(F.lit(1)).alias("ng"), F.avg(num).alias("mg"),
        F.coalesce(F.var_samp(num), F.lit(0.0)).alias("vg"))
    return anova_of_groups(g.select(F.lit(cat).alias("col1"), F.lit(num).alias("col2"), "ng", "mg", "vg"))


def anova_of_groups(groups: DataFrame) -> DataFrame:
    """A13 for many (category, number) pairs at once from group counts, means and variances (col1, col2, ng, mg, vg).

    The grand means are joined back to the groups, so no pair's groups are collected."""
    key = ["col1", "col2"]
    tot = groups.groupBy(*key).agg(F.sum("ng").alias("N"), (F.sum(F.col("ng") * F.col("mg")) / F.sum("ng")).alias("gm"),
                                   F.count(F.lit(1)).alias("k"))
    parts = groups.join(tot, key).groupBy(*key).agg(
        F.first("N").alias("N"), F.first("k").alias("k"), F.sum(F.col("ng") * (F.col("mg") - F.col("gm")) ** 2).alias("ssb"),
        F.sum((F.col("ng") - 1) * F.col("vg")).alias("ssw"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("N") - F.col("k")))
    return parts.select(*key, F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("n"), _r(f).alias("f_stat"))


def mixed_association(df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
    """Long table of associations: num-num Pearson, cat-cat Cramer's V,
    cat-num ANOVA F, num-cat null (as in the source).

    One scan: ``GROUPING SETS`` over all categories, all pairs of them and the whole
    table gives counts, means, variances and correlations; the small result is
    checkpointed and everything else comes from it."""
    width, num_pairs = len(cats), [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    sets = [[a, b] for i, a in enumerate(cats) for b in cats[i + 1:]] + [[c] for c in cats] + [[]]
    aggs = [F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_o")]
    for i, m in enumerate(nums):
        aggs += [F.count(m).alias(f"_n{i}"), F.avg(m).alias(f"_m{i}"), F.coalesce(F.var_samp(m), F.lit(0.0)).alias(f"_v{i}")]
    aggs += [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(num_pairs)]
    small = df.select(*cats, *nums).groupingSets(sets, *cats).agg(*aggs).checkpoint(eager=True)
    of = lambda *names: small.filter(F.col("_gid") == sum(  # noqa: E731  a set bit: the column is not in the set
        1 << (width - 1 - k) for k, c in enumerate(cats) if c not in names))
    label = lambda a, b: [F.lit(a).alias("col1"), F.lit(b).alias("col2")]
    parts = [of().select(*label(a, b), F.lit("pearson").alias("kind"), _r(F.col(f"_c{i}")).alias("value"))
             for i, (a, b) in enumerate(num_pairs)]
    cells = [of(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *label(a, b), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"), F.col("_o").alias("o"))
        for a, b in (s for s in sets if len(s) == 2)]
    if cells:
        parts.append(cramers_of_cells(reduce(DataFrame.unionByName, cells)).select(
            "col1", "col2", F.lit("cramers_v").alias("kind"), F.col("cramers_v").alias("value")))
    groups = [of(c).filter(F.col(c).isNotNull() & (F.col(f"_n{i}") > 0)).select(
        *label(c, m), F.col(f"_n{i}").alias("ng"), F.col(f"_m{i}").alias("mg"), F.col(f"_v{i}").alias("vg"))
        for c in cats for i, m in enumerate(nums)]
    if groups:
        parts.append(anova_of_groups(reduce(DataFrame.unionByName, groups)).select(
            "col1", "col2", F.lit("anova_f").alias("kind"), F.col("f_stat").alias("value")))
    nulls = df.sparkSession.createDataFrame([(m, c) for m in nums for c in cats], "col1 string, col2 string") \
        .select("col1", "col2", F.lit("none").alias("kind"), F.lit(None).cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [*parts, nulls])


def behavior_correlation(df: DataFrame, features: list[str], behavior: str, behaviors: list[str]) -> DataFrame:
    """Correlation of each feature with each behaviour dummy, one aggregate."""
    aggs = []
    for b in behaviors:
        d = (F.col(behavior) == F.lit(b)).cast("double")
        for f in features:
            aggs.append(F.corr(F.col(f).cast("double"), d).alias(f"{b}__{f}"))
    row = df.agg(*aggs)
    stack = ", ".join(f"'{b}', '{f}', `{b}__{f}`" for b in behaviors for f in features)
    out = row.selectExpr(f"stack({len(aggs)}, {stack}) as (behavior, feature, corr)")
    return out.withColumn("corr", _r(F.col("corr"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("behavior").orderBy(
            F.col("corr").desc_nulls_last(), F.col("feature"))))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted
    averages (zero division -> 0), from one confusion aggregate."""
    pc = F.col(p) if isinstance(p, str) else p
    conf = df.groupBy(F.col(y).cast("string").alias("y"), pc.cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    support = conf.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = conf.filter(F.col("y") == F.col("p")).select(F.col("y").alias("label"), F.col("n").alias("tp"))
    per = (support.join(predicted, "label", "full").join(tp, "label", "left")
           .na.fill(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
        .otherwise(0.0))
    tot = per.agg(F.sum("support").alias("N"), F.sum("tp").alias("TP"), F.count(F.lit(1)).alias("K"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    rows = per.select("label", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
                      _r(F.col("f1")).alias("f1"), F.col("support").cast("long").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), _r(F.col("TP") / F.col("N")).alias("f1"),
                     F.col("N").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), _r(F.col("mp")).alias("precision"),
                       _r(F.col("mr")).alias("recall"), _r(F.col("mf")).alias("f1"),
                       F.col("N").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), _r(F.col("wp") / F.col("N")).alias("precision"),
                          _r(F.col("wr") / F.col("N")).alias("recall"), _r(F.col("wf") / F.col("N")).alias("f1"),
                          F.col("N").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)
