"""Quality rules: base text statistics and robust multivariate outliers (DataFrame functions only).

Per (language, source) group a minimum-covariance-determinant estimate is fitted
to transformed statistic vectors: start from the rows nearest the coordinate-wise
medians, then repeat concentration steps (mean and covariance of the h rows with
the smallest distances). A row whose squared Mahalanobis distance exceeds the
cut-off is rejected. Every step is a grouped aggregate with a partial step before
its shuffle; the h-th distance is a mergeable quantile sketch, so the kept half is
h rows up to the sketch's error. No group is gathered in one task.

No group is too small for a verdict: each group's mean, covariance and scale are drawn
toward its language's with the weight of ``prior_rows`` rows, and those of the language
toward all rows'. The weight of a group's own rows grows with their number without a
switch; ten rows or fewer are measured by their language.

Defined cases: a null text has no words; null language or source is a group of its
own; rows of a group where all fail the base rules have no distance (they are not
kept); a coordinate without spread gets
its variance floor, so estimates never turn singular; equal rows each get their
row; other columns pass through, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fresh, shielded, stage

SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: feature -> variance floor (in squared transformed units)
FEATURES = {"f_words": 0.25, "f_wordlen": 0.04, "f_symbols": 0.04, "f_punct": 0.04, "f_repeat": 0.04}
PRIOR_WORDS = 100      # rates of short texts are drawn toward their group's rate with this weight
SUBSET = 0.75          # share of rows that the estimate rests on
STEPS = 4              # concentration steps
MIN_ROWS = 50          # robust_distance alone, without groups above: smaller groups get no distance
PRIOR_ROWS = 50        # weight, in rows, of the estimate of the groups above
MEDIAN_CHI2 = 4.351    # median of chi-squared with 5 degrees of freedom
CUTOFF = 100.0         # far beyond any quantile of a normal group: only gross outliers go


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text plus n_words, word_chars, n_symbols, n_punct, n_dup_lines, n_repeat_words."""
    body, w, h, s, p, lines, glued = fresh(docs, "_body", "_w", "_h", "_s", "_p", "_lines", "_glued")
    col = F.col
    out = docs.withColumn(body, F.coalesce(col(text), F.lit("")))
    out = out.withColumn(w, F.array_remove(F.split(body, SPACE), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                          lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    out = out.withColumns({
        h: F.when(F.size(w) > WINDOW, windows).otherwise(none),
        glued: F.array_join(w, ""),
        lines: F.filter(F.split(body, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
    })
    # only texts with a repeated window sort their windows; places of repeats, in order
    pairs = F.array_sort(F.transform(col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
    places = F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1)),
        lambda j: F.get(s, j)["i"]))
    out = out.withColumn(p, F.when(col(s).isNotNull(), places))
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.least(
        F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW))))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(glued).cast("long"),
        "n_symbols": (F.length(glued) - F.length(F.translate(glued, SYMBOLS, ""))).cast("long"),
        "n_punct": (F.length(glued) - F.length(F.regexp_replace(glued, "[^\\p{L}\\p{N}]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.size(p) > 0, covered), F.lit(0)).cast("long"),
    })
    return out.drop(text, body, w, h, s, p, lines, glued)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _same_group(groups: list[str]):
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return on


def _with_estimate(rows: DataFrame, estimate: DataFrame, groups: list[str]) -> DataFrame:
    named = estimate.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
    return rows.join(named, _same_group(groups), "left").drop(*[f"_g{i}" for i in range(len(groups))])


def _moments(rows: DataFrame, groups: list[str], features: dict[str, float]) -> DataFrame:
    """Per group: rows, means and covariance."""
    names = list(features)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.avg(f).alias(f"_m{i}") for i, f in enumerate(names)]
    aggs += [F.covar_pop(names[i], names[j]).alias(f"_c{i}{j}") for i in range(len(names)) for j in range(i + 1)]
    return rows.groupBy(*groups).agg(*aggs)


def _with_above(own: DataFrame, above: DataFrame, groups: list[str]) -> DataFrame:
    """``own`` with the other columns of ``above`` as _u...; without groups that is one row."""
    named = above.withColumnsRenamed({c: f"_u{c}" for c in above.columns if c not in groups})
    return _with_estimate(own, named, groups) if groups else own.crossJoin(F.broadcast(named))


def _drawn_moments(own: DataFrame, groups: list[str], features: dict[str, float], prior_rows: float) -> DataFrame:
    """The groups' moments, drawn toward those of the groups above. A group counts
    with its rows beyond two a feature, as fewer rows say little of a covariance and one
    far row among them would hide itself. ``own`` should be a stage table."""
    n, col = len(features), F.col
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]

    def pooled(keys: list[str]) -> DataFrame:
        say = F.greatest(col("_n") - 2 * n, F.lit(0)) + 1e-3 * col("_n")  # tiny groups, which are hardly trimmed, speak if no other does
        share = lambda c: F.sum(say * c) / F.sum(say)
        out = own.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[share(col(f"_m{i}")).alias(f"_m{i}") for i in range(n)],
                                     *[share(col(f"_c{i}{j}") + col(f"_m{i}") * col(f"_m{j}")).alias(f"_c{i}{j}") for i, j in pairs])
        return out.withColumns({f"_c{i}{j}": col(f"_c{i}{j}") - col(f"_m{i}") * col(f"_m{j}") for i, j in pairs})

    above = pooled([])
    for k in range(1, len(groups) + 1):
        both = _with_above(own if k == len(groups) else pooled(groups[:k]), above, groups[:k - 1])
        sure = F.greatest(col("_n") - 2 * n, F.lit(0))
        above = both.select(*groups[:k], "_n", *[
            ((sure * col(c) + prior_rows * col(f"_u{c}")) / (sure + prior_rows)).alias(c)
            for c in [f"_m{i}" for i in range(n)] + [f"_c{i}{j}" for i, j in pairs]])
    return above


def _drawn_rates(totals: DataFrame, groups: list[str], counted, prior_rows: float) -> DataFrame:
    """Rates a word per group (``_t_...``), drawn toward those of the groups above, which are
    medians over rows of their groups' rates; a group's own counts with its rows beyond two a feature. ``totals`` should be a stage table."""
    own = totals.select(*groups, "_n", *[(F.col(c) / F.col("n_words")).alias(f"_t_{c}") for c in counted])
    level = lambda keys: own if keys == groups else own.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), *[F.percentile(f"_t_{c}", 0.5, F.col("_n")).alias(f"_t_{c}") for c in counted])
    sure, above = F.greatest(F.col("_n") - 2 * len(FEATURES), F.lit(0)), level([])
    for k in range(1, len(groups) + 1):
        above = _with_above(level(groups[:k]), above, groups[:k - 1]).select(*groups[:k], "_n", *[
            ((sure * F.col(f"_t_{c}") + prior_rows * F.col(f"_u_t_{c}")) / (sure + prior_rows)).alias(f"_t_{c}") for c in counted])
    return above


def _drawn_scale(far: DataFrame, groups: list[str], n_features: int, prior_rows: float) -> DataFrame:
    """Median distance per group (``_mid``), drawn (as its logarithm) toward that of the groups above."""
    sure = F.greatest(F.col("_n") - 2 * n_features, F.lit(0))
    level = lambda keys: far.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.log(F.greatest(F.percentile_approx("_d", 0.5, 1000), F.lit(1e-9))).alias("_mid"))
    above = level([])
    for k in range(1, len(groups) + 1):
        above = _with_above(level(groups[:k]), above, groups[:k - 1]).select(
            *groups[:k], "_n", ((sure * F.col("_mid") + prior_rows * F.col("_u_mid")) / (sure + prior_rows)).alias("_mid"))
    return above.select(*groups, F.exp("_mid").alias("_mid"))


def _factor(out: DataFrame, features: dict[str, float]) -> DataFrame:
    """Moments with the Cholesky factor of the floored covariance in its place."""
    names, col = list(features), F.col
    for j, f in enumerate(names):  # column by column; each entry needs those to its left only
        diag = col(f"_c{j}{j}") + features[f]
        for k in range(j):
            diag = diag - col(f"_l{j}{k}") * col(f"_l{j}{k}")
        out = out.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(diag, F.lit(features[f] * 1e-3))))
        for i in range(j + 1, len(names)):
            rest = col(f"_c{i}{j}")
            for k in range(j):
                rest = rest - col(f"_l{i}{k}") * col(f"_l{j}{k}")
            out = out.withColumn(f"_l{i}{j}", rest / col(f"_l{j}{j}"))
    return out.drop("_n", *[f"_c{i}{j}" for i in range(len(names)) for j in range(i + 1)])


def _distance(rows: DataFrame, name: str, features: dict[str, float]) -> DataFrame:
    """Adds the squared Mahalanobis distance, solving with the Cholesky factor."""
    n, col = len(features), F.col
    for i, f in enumerate(features):
        y = col(f) - col(f"_m{i}")
        for k in range(i):
            y = y - col(f"_l{i}{k}") * col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", y / col(f"_l{i}{i}"))
    rows = rows.withColumn(name, sum((col(f"_y{i}") * col(f"_y{i}") for i in range(1, n)), col("_y0") * col("_y0")))
    return rows.drop(*[f"_y{i}" for i in range(n)], *[f"_m{i}" for i in range(n)],
                     *[f"_l{i}{j}" for i in range(n) for j in range(i + 1)])


def robust_distance(rows: DataFrame, groups: list[str], features: dict[str, float], usable,
                    name: str = "distance", subset: float = SUBSET, steps: int = STEPS,
                    min_rows: int = MIN_ROWS, median_chi2: float = MEDIAN_CHI2, prior_rows: float = 0) -> DataFrame:
    """``rows`` plus ``name``: squared robust distance from the group's estimate,
    scaled so that its median is that of a chi-squared variable. With ``prior_rows``
    the estimates of small groups are drawn toward those of the first key, and these
    toward all rows'; without, the distance is null where the group has under
    ``min_rows`` usable rows. ``rows`` should be a stage table, as each step reads it."""
    if prior_rows:
        min_rows = 1
    fit = rows.where(usable).select(*groups, *features)
    nearest = lambda df, d: df.join(  # noqa: E731 - the h rows of each group with the smallest d
        df.groupBy(*groups).agg(F.percentile_approx(d, subset, 1000).alias("_cut")).withColumnsRenamed(
            {g: f"_g{i}" for i, g in enumerate(groups)}), _same_group(groups)).where(F.col(d) <= F.col("_cut"))
    middle = fit.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000)
                                         .alias(f"_q{i}") for i, f in enumerate(features)]).where(F.col("_n") >= min_rows)
    start = fit.join(middle.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)}), _same_group(groups)) \
        .drop(*[f"_g{i}" for i in range(len(groups))])
    spread = lambda i, floor: F.pow(F.get(f"_q{i}", F.lit(2)) - F.get(f"_q{i}", F.lit(0)), 2) + floor
    start = start.withColumn("_d", sum((F.pow(F.col(f) - F.get(f"_q{i}", F.lit(1)), 2) / spread(i, floor)
                                        for i, (f, floor) in enumerate(features.items())), F.lit(0.0)))
    def fitted(near: DataFrame) -> DataFrame:
        own = _moments(near, groups, features)
        return stage(_factor(_drawn_moments(stage(own, "moments"), groups, features, prior_rows) if prior_rows else own, features), "mcd")

    estimate = fitted(nearest(start.select(*groups, *features, "_d"), "_d"))
    for _ in range(steps):
        far = _distance(_with_estimate(fit, estimate, groups).where(F.col("_m0").isNotNull()), "_d", features)
        estimate = fitted(nearest(far, "_d"))
    far = _distance(_with_estimate(fit, estimate, groups).where(F.col("_m0").isNotNull()), "_d", features)
    scale = _drawn_scale(far, groups, len(features), prior_rows) if prior_rows else \
        far.groupBy(*groups).agg(F.percentile_approx("_d", 0.5, 1000).alias("_mid"))
    estimate = stage(_with_estimate(estimate, scale, groups), "mcd")  # its size is then known when rows are joined
    out = _distance(_with_estimate(rows, estimate, groups), name, features)
    return out.withColumn(name, F.col(name) / F.greatest(F.col("_mid") / median_chi2, F.lit(1e-9))).drop("_mid")


def quality_rules(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"),
                  cutoff: float = CUTOFF, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Statistics, base_failed, ``distance`` and kept for each row of ``docs`` (its text is left behind)."""
    groups = list(groups)
    docs, restore = shielded(docs, text, *groups)
    stats = stage(text_stats(docs, text).withColumn("base_failed", base_failed()), "stats")
    counted = ("word_chars", "n_symbols", "n_punct", "n_repeat_words")
    totals = stage(stats.where(~F.col("base_failed")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in ("n_words", *counted)]), "totals")
    rates = stage(_drawn_rates(totals, groups, counted, prior_rows), "rates")
    at = _with_estimate(stats, rates, groups)
    drawn = lambda c: (F.col(c) + PRIOR_WORDS * F.col(f"_t_{c}")) / (F.col("n_words") + PRIOR_WORDS)
    vectors = at.withColumns({
        "f_words": F.log1p("n_words"), "f_wordlen": drawn("word_chars"),
        "f_symbols": F.log1p(100 * drawn("n_symbols")), "f_punct": F.log1p(10 * drawn("n_punct")),
        "f_repeat": F.log1p(10 * drawn("n_repeat_words")),
    }).drop("_n", *[f"_t_{c}" for c in counted])
    vectors = stage(vectors, "vectors")
    out = robust_distance(vectors, groups, FEATURES, ~F.col("base_failed"), "distance", prior_rows=prior_rows)
    return restore(out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
                   .drop(*FEATURES))
