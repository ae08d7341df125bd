"""Time-series models per product, fitted from grouped sums: ARIMA, trend and season, intervals.

A least-squares fit needs only sums of products of its columns: one aggregate per product, with partial sums before
the shuffle. Each product's small system is solved in its row by higher-order functions, so a fit of any
number of products is one job without Python.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.operators.forecast import last_date
from basketcast.operators.ordering import position_within
from basketcast.session import broadcast_if_small, cut_lineage

TINY = 1e-9  # a pivot below this share of its diagonal value belongs to a column the others explain
YEAR = 365.25
WEEKDAYS = 7


def _nothing(daily: DataFrame, *bounds: str) -> DataFrame:
    """The forecast of no sales: no rows."""
    return daily.select("Date", "ProductID", *[F.lit(0.0).alias(c) for c in ("Predicted_Quantity", *bounds)]).limit(0)


def dense_series(daily: DataFrame, end=None) -> DataFrame:
    """``(ProductID, Date, t, Quantity)``: every calendar day from a product's first sale to the last day of
    all data, 0 on days without sales; ``t`` counts a product's days from 0. Rows without a date are left out.

    A row is stretched over the gap up to the product's next row, so nothing is joined. A product has at
    most one row per day in ``daily``, so the window is bounded by the calendar.
    """
    end = last_date(daily) if end is None else end
    w = Window.partitionBy("ProductID").orderBy("Date")
    dated = daily.where("Date IS NOT NULL").select("ProductID", "Date", F.col("Quantity").cast("double").alias("Quantity"))
    stretched = dated.select("ProductID", F.col("Date").alias("_from"), "Quantity",
                             F.min("Date").over(Window.partitionBy("ProductID")).alias("_first"),
                             F.coalesce(F.date_sub(F.lead("Date").over(w), 1), F.lit(end)).alias("_until"))
    days = stretched.select("ProductID", "_from", "_first", "Quantity",
                            F.explode(F.sequence("_from", "_until")).alias("Date"))
    return days.select("ProductID", "Date", F.datediff("Date", "_first").alias("t"),
                       F.when(F.col("Date") == F.col("_from"), F.col("Quantity")).otherwise(0.0).alias("Quantity"))


def normal_equations(rows: DataFrame, keys: list[str], columns: list[Column], target: Column) -> DataFrame:
    """Per key: ``n`` rows and ``system``, the normal equations row by row with the right side as last column."""
    k = len(columns)
    named = rows.select(*keys, target.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.expr(f"sum(_x{i} * _x{j}) AS _g{i}_{j}") for i, j in pairs],
                                    *[F.expr(f"sum(_x{i} * _y) AS _b{i}") for i in range(k)])
    cells = [f"_g{min(i, j)}_{max(i, j)}" if j < k else f"_b{i}" for i in range(k) for j in range(k + 1)]
    return sums.select(*keys, "n", F.expr(f"array({', '.join(cells)})").alias("system"))


def solve(system: Column, k: int) -> Column:
    """The ``k`` coefficients of a system of normal equations, by elimination inside the row.

    A column that the ones before it explain (its pivot is next to nothing) gets the coefficient 0.
    """
    width = k + 1

    def eliminate(m, p):
        pivot = F.get(m, p * width + p)
        usable = pivot > F.get(system, p * width + p) * F.lit(TINY)

        def cell(value, i):
            row, col = F.floor(i / F.lit(width)).cast("int"), i % F.lit(width)
            scaled = F.get(m, p * width + col) / pivot
            cleared = F.when(row == p, scaled).otherwise(value - F.get(m, row * width + p) * scaled)
            return F.when(usable, cleared).when((row == p) | (col == p), F.lit(0.0)).otherwise(value)
        return F.transform(m, cell)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), system, eliminate)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(done, i * width + F.lit(k)))


def dot(coefficients: str, columns: list[Column]) -> Column:
    """The sum of coefficients times columns, in the order of the columns."""
    total = F.get(F.col(coefficients), F.lit(0)) * columns[0]
    for i, c in enumerate(columns[1:], 1):
        total = total + F.get(F.col(coefficients), F.lit(i)) * c
    return total


def _lags(name: str, count: int, prefix: str) -> dict[str, Column]:
    w = Window.partitionBy("ProductID").orderBy("t")
    return {f"{prefix}{i}": F.lag(name, i).over(w) for i in range(1, count + 1)}


def _fit(rows: DataFrame, names: list[str], target: str) -> DataFrame:
    """``(ProductID, coefficients)`` of a least-squares fit with intercept over the rows without nulls; a product
    with no more rows than coefficients gets zeros."""
    columns = [F.lit(1.0), *[F.col(c) for c in names]]
    k = len(columns)
    sums = normal_equations(rows.dropna(subset=[target, *names]), ["ProductID"], columns, F.col(target))
    zeros = F.array(*[F.lit(0.0)] * k)
    return sums.select("ProductID", F.when(F.col("n") > k, solve(F.col("system"), k)).otherwise(zeros).alias("coefficients"))


def arima_forecast(daily: DataFrame, p: int = 2, d: int = 1, q: int = 1, horizon: int = 30,
                   long_order: int = 7) -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity)`` of an ARIMA(p, d, q) per product, clipped at 0.

    Fitted in two regressions (Hannan and Rissanen): an autoregression of ``long_order`` gives the
    innovations, then the differenced series is regressed on ``p`` of its own lags and ``q`` lagged innovations.
    Future innovations are 0; forecasts feed the later ones. A product whose series is too short for a
    regression has all its coefficients 0: a flat line at its last value for ``d`` = 1, zero for ``d`` = 0.
    """
    if min(p, d, q) < 0 or horizon < 1 or (q and long_order < 1):
        raise ValueError("orders must not be negative, horizon and long_order at least 1")
    end = last_date(daily)
    if end is None:
        return _nothing(daily)
    w = Window.partitionBy("ProductID").orderBy("t")
    series = dense_series(daily, end).withColumn("_d0", F.col("Quantity"))
    for j in range(1, d + 1):
        series = series.withColumn(f"_d{j}", F.col(f"_d{j - 1}") - F.lag(f"_d{j - 1}").over(w))
    target = f"_d{d}"
    lags = _lags(target, max(p, long_order if q else 0), "_w")
    series = cut_lineage(series.withColumns(lags) if lags else series)  # read by both fits and the last states
    own, shocks = [f"_w{i}" for i in range(1, p + 1)], [f"_e{i}" for i in range(1, q + 1)]
    if q:
        long = [f"_w{i}" for i in range(1, long_order + 1)]
        first = broadcast_if_small(_fit(series, long, target).withColumnRenamed("coefficients", "_long"))
        series = series.join(first, "ProductID", "left").withColumn(
            "_e", F.col(target) - dot("_long", [F.lit(1.0), *[F.col(c) for c in long]]))
        series = cut_lineage(series.withColumns(_lags("_e", q, "_e")).drop("_long"))
    model = _fit(series, [*own, *shocks], target)

    # the newest p differences, q innovations and d levels of each product, newest first
    newest = F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("back"), *[F.col(f"_d{j}") for j in range(d + 1)],
                                                  *([F.col("_e")] if q else []))))
    state = series.join(series.groupBy("ProductID").agg(F.max("t").alias("_last")), "ProductID") \
        .where(F.col("t") > F.col("_last") - max(p, q, 1)).groupBy("ProductID").agg(newest.alias("_rows"))

    def recent(name, count):
        known = F.transform(F.slice("_rows", 1, count), lambda r: F.coalesce(r[name], F.lit(0.0)))
        return F.concat(known, F.array_repeat(F.lit(0.0), count))

    empty = F.array().cast("array<double>")
    start = F.struct((recent(target, p) if p else empty).alias("own"), (recent("_e", q) if q else empty).alias("shocks"),
                     F.array(*[F.coalesce(F.get("_rows", F.lit(0))[f"_d{j}"], F.lit(0.0)) for j in range(d)])
                     .cast("array<double>").alias("levels"), empty.alias("out"))

    def step(acc, _):
        value = F.get("coefficients", F.lit(0))
        for i in range(p):
            value = value + F.get("coefficients", F.lit(1 + i)) * F.get(acc["own"], F.lit(i))
        for i in range(q):
            value = value + F.get("coefficients", F.lit(1 + p + i)) * F.get(acc["shocks"], F.lit(i))
        levels, level = [], value
        for j in reversed(range(d)):
            level = F.get(acc["levels"], F.lit(j)) + level
            levels.insert(0, level)
        return F.struct(F.concat(F.array(value), acc["own"]).alias("own"),
                        F.concat(F.array(F.lit(0.0)), acc["shocks"]).alias("shocks"),
                        (F.array(*levels) if d else empty).alias("levels"),
                        F.concat(acc["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["out"]
    paths = state.join(model, "ProductID", "left").withColumn(
        "coefficients", F.coalesce("coefficients", F.array(*[F.lit(0.0)] * (1 + p + q)))).select("ProductID", path.alias("_path"))
    return paths.select("ProductID", F.posexplode("_path").alias("_h", "_v")).select(
        F.date_add(F.lit(end), F.col("_h") + 1).alias("Date"), "ProductID",
        F.greatest(F.col("_v"), F.lit(0.0)).alias("Predicted_Quantity"))


def trend_season_columns(end, harmonics: int = 3, date: str = "Date") -> list[Column]:
    """Intercept, years since ``end``, one mark per weekday, and yearly waves."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    waves = []
    for i in range(1, harmonics + 1):
        angle = day * F.lit(2 * math.pi * i / YEAR)
        waves += [F.sin(angle), F.cos(angle)]
    return [F.lit(1.0), F.datediff(F.col(date), F.lit(end)) / F.lit(YEAR),
            *[F.when(F.weekday(date) == i, 1.0).otherwise(0.0) for i in range(WEEKDAYS)], *waves]


def _calendar_sums(daily: DataFrame, end, origins: list, harmonics: int) -> DataFrame:
    """``(origin, first, cells)``: sums of products of the model's columns over the days from ``first`` to
    ``origin``, for every day of the calendar as first. They depend on no product, so the calendar is summed once,
    from each origin backwards (one row per day and origin; nothing is subtracted)."""
    columns = trend_season_columns(end, harmonics)
    k = len(columns)
    days = daily.agg(F.min("Date").alias("_from")).select(
        F.explode(F.sequence("_from", F.lit(end))).alias("Date"))  # no row without dates
    days = days.withColumn("origin", _origins_after("Date", origins)) \
               .select("origin", "Date", *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    back = "over (PARTITION BY origin ORDER BY Date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cells = ", ".join(f"sum(_x{i} * _x{j}) {back}" for i in range(k) for j in range(i, k))
    return days.select("origin", F.col("Date").alias("first"), F.expr(f"array({cells})").alias("cells"))


def _origins_after(date: str, origins: list) -> Column:
    return F.explode(F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: o >= F.col(date)))


def _trend_season_fits(daily: DataFrame, end, origins: list, harmonics: int, penalty: float) -> DataFrame:
    """``(origin, ProductID, coefficients, scale)``: one fit per origin over the days up to it, all from one pass
    over the daily rows; ``scale`` is the root mean square of the fit's own errors.

    Days without sales add nothing to the right side, and the left side comes from the calendar, so the series is
    never filled up: a product costs one sum per column.
    """
    columns = trend_season_columns(end, harmonics)
    k = len(columns)
    upto = daily.where("Date IS NOT NULL").select("ProductID", "Date", F.col("Quantity").cast("double").alias("_y"),
                                                  _origins_after("Date", origins).alias("origin"))
    sums = upto.groupBy("origin", "ProductID").agg(
        F.min("Date").alias("first"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.array(*[F.sum(c * F.col("_y")) for c in columns]).alias("right"))
    calendar = broadcast_if_small(_calendar_sums(daily, end, origins, harmonics))
    # the square system from its upper triangle (row r starts at r * k - r * (r - 1) / 2), with the right side
    system = F.expr(f"""transform(sequence(0, {k * (k + 1) - 1}), i -> CASE
        WHEN i % {k + 1} = {k} THEN right[int(i div {k + 1})]
        ELSE cells[int(least(i div {k + 1}, i % {k + 1}) * (2 * {k} - 1 - least(i div {k + 1}, i % {k + 1})) div 2
                       + greatest(i div {k + 1}, i % {k + 1}))]
             + IF(i > 0 AND i div {k + 1} = i % {k + 1}, {float(penalty)}D, 0D) END)""")
    solved = sums.join(calendar, ["origin", "first"]).select(
        "origin", "ProductID", "yy", "right", (F.datediff("origin", "first") + 1).alias("n"), system.alias("system")) \
        .withColumn("coefficients", solve(F.col("system"), k))
    # what is left of the squares: yy - b.g - penalty * b.b, the intercept unpenalised
    left = F.expr(f"""yy - aggregate(sequence(0, {k - 1}), 0D, (s, i) -> s + coefficients[i] * right[i]
        + IF(i > 0, {float(penalty)}D * coefficients[i] * coefficients[i], 0D))""")
    return solved.select("origin", "ProductID", "coefficients",
                         F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("n")).alias("scale"))


def trend_season_forecast(daily: DataFrame, horizon: int = 30, harmonics: int = 3, penalty: float = 1.0) -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity)`` of an additive model per product (trend, weekday, yearly waves),
    fitted by ridge regression over all days since its first sale (0 on days without sales), clipped at 0. Any
    length of series has a fit."""
    if horizon < 1 or harmonics < 0 or penalty <= 0:
        raise ValueError("horizon must be at least 1, harmonics not negative and penalty positive")
    end = last_date(daily)
    if end is None:
        return _nothing(daily)
    fits = _trend_season_fits(daily, end, [end], harmonics, penalty)
    return _predicted(fits, end, horizon, harmonics).select("Date", "ProductID", "Predicted_Quantity")


def _predicted(fits: DataFrame, end, horizon: int, harmonics: int) -> DataFrame:
    """The ``horizon`` days after each fit's origin, with the model's value."""
    grid = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) \
               .withColumn("Date", F.date_add("origin", F.col("h")))
    value = dot("coefficients", trend_season_columns(end, harmonics))
    return grid.select("origin", "Date", "ProductID", "h", "scale",
                       F.greatest(value, F.lit(0.0)).alias("Predicted_Quantity"))


def forecast_intervals(daily: DataFrame, horizon: int = 30, origins: int = 6, coverage: float = 0.9,
                       harmonics: int = 3, penalty: float = 1.0) -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity, lower, upper)``: the trend and season forecast with intervals
    that the model earned in the past.

    The model is fitted again at ``origins`` earlier days, ``horizon`` days apart, and each fit forecasts
    the days that followed. An error counts in units of its fit's ``scale``; per day ahead, the
    ``ceil((n + 1) * coverage)``-th smallest of the n errors of all products and origins (split conformal prediction) is
    the half width, times the product's own scale. With too few errors for that rank the upper end is null (unbounded) and
    the lower end 0; products first sold after an origin have no error there.
    """
    if origins < 1 or not 0 < coverage < 1:
        raise ValueError("origins must be at least 1 and coverage between 0 and 1")
    end = last_date(daily)
    if end is None:
        return _nothing(daily, "lower", "upper")
    days = [end - dt.timedelta(days=horizon * i) for i in range(origins + 1)]
    fits = cut_lineage(_trend_season_fits(daily, end, days, harmonics, penalty))
    backtest = _predicted(fits.where(F.col("origin") < F.lit(end)), end, horizon, harmonics)
    # every forecast day is at most one origin's: origins are a horizon apart
    sold = daily.select("ProductID", "Date", F.col("Quantity").cast("double").alias("Quantity"))
    errors = backtest.join(sold, ["ProductID", "Date"], "left").select(
        "h", "ProductID", "origin", (F.abs(F.coalesce("Quantity", F.lit(0.0)) - F.col("Predicted_Quantity"))
                                     / F.greatest(F.col("scale"), F.lit(1e-6))).alias("score"))
    ranked = cut_lineage(position_within(errors, ["h"], ["score", "ProductID", "origin"], out="_pos"))
    counts = ranked.groupBy("h").agg(F.count(F.lit(1)).alias("_n"))  # one row per day ahead
    ranks = F.broadcast(counts.select("h", (F.ceil((F.col("_n") + 1) * F.lit(coverage)) - 1).alias("_at")))
    half = ranked.join(ranks, "h").where("_pos = _at").select("h", F.col("score").alias("_half"))
    out = _predicted(fits.where(F.col("origin") == F.lit(end)), end, horizon, harmonics).join(F.broadcast(half), "h", "left")
    reach = F.col("_half") * F.col("scale")
    return out.select("Date", "ProductID", "Predicted_Quantity",
                      F.coalesce(F.greatest(F.col("Predicted_Quantity") - reach, F.lit(0.0)), F.lit(0.0)).alias("lower"),
                      (F.col("Predicted_Quantity") + reach).alias("upper"))
