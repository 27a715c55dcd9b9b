import datetime as dt
import math

import numpy as np

from tenorlab.operators import research


def series(spark, values):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("s", day + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "series string, ts date, value double")


def test_exact_line(spark):
    rows = research.rolling_trend(series(spark, [3 + 0.5 * i for i in range(150)]), "value").orderBy("ts").collect()
    assert len(rows) == 50
    for i, r in enumerate(rows, 100):
        assert abs(r.trend_slope - 0.5) < 1e-9 and abs(r.residual_oos) < 1e-7 and abs(r.trend_intercept - (3 + 0.5 * (i - 100))) < 1e-7


def test_a_null_empties_every_window_that_holds_it(spark):
    values = [float(i) for i in range(150)]
    values[120] = None
    assert research.rolling_trend(series(spark, values), "value").count() == 20


def test_rolling_fits_match_a_loop(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=420)) + 50
    oos = research.rolling_trend(series(spark, y), "value", lookback=40)
    resid = []
    for i in range(40, len(y)):
        b, a = np.polyfit(np.arange(40), y[i - 40 : i], 1)
        resid.append(y[i] - (a + b * 40))
    got = [r.residual_oos for r in oos.orderBy("ts").collect()]
    assert np.allclose(got, resid, atol=1e-7)
    want = []
    for i in range(120, len(resid)):
        r = np.array(resid[i - 120 : i])
        b, a = np.polyfit(r[:-1], np.diff(r), 1)
        want.append((-b, math.log(2) / -b if b < 0 else None, np.diff(r).std(ddof=1), -a / b))
    fits = research.ou_fit(oos, lookback=120).orderBy("ts").collect()
    assert len(fits) == len(want) and {r.n_pairs for r in fits} == {119}
    for r, (theta, life, sigma, mu) in zip(fits, want, strict=True):
        assert abs(r.theta - theta) < 1e-7 and abs(r.ou_half_life - life) < 1e-5 and abs(r.ou_sigma - sigma) < 1e-7 and abs(r.ou_mu - mu) < 1e-4


def test_ou_needs_its_lookback_and_a_positive_theta(spark):
    oos = series(spark, [1000 * 0.5**min(i, 60) for i in range(302)]).withColumnRenamed("value", "residual_oos")
    rows = research.ou_fit(oos).orderBy("ts").collect()
    assert len(rows) == 2 and all(abs(r.theta - 0.5) < 1e-6 and abs(r.ou_half_life - math.log(2) / 0.5) < 1e-5 for r in rows)


def test_half_life_bounds_are_strict(spark):
    fits = spark.createDataFrame([(252.0, 1.0), (251.9, 1.0), (None, 1.0), (0.0, 1.0)], "ou_half_life double, ou_sigma double")
    assert [r[0] for r in research.plausible(fits).collect()] == [251.9]
