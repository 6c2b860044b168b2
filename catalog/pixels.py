"""Pixel statistics over the embedding vectors taken as 8 × 8 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from seriesloom.operators import pixels


def _rounded(df, digits=6):
    return df.select("image_id", *[F.round(c, digits).alias(c) for c in df.columns if c != "image_id"])


@query(
    "pixel_stats",
    views.oracle(
        """SELECT image_id, round(avg(v), 6) AS image_mean, round(stddev_pop(v), 6) AS image_std,
        round(min(v), 6) AS image_min, round(max(v), 6) AS image_max, round(median(v), 6) AS image_median,
        round(skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS image_skew,
        round(kurtosis_pop(v), 6) AS image_kurtosis, round(sqrt(avg(v * v)), 6) AS image_rms,
        cast(8 AS double) AS image_x, cast(8 AS double) AS image_y FROM v_pixels GROUP BY image_id""",
        "v_pixels",
    ),
)
def pixel_stats(spark, sf_dir):
    return _rounded(pixels.with_stats(views.images(spark, sf_dir), "pixels", 8).drop("pixels"))


@query(
    "pixel_entropy",
    views.oracle(
        """SELECT image_id, round(-sum(n / 64.0 * log2(n / 64.0)), 6) AS image_entropy FROM (
        SELECT image_id, round(v, 1) AS v, count(*) AS n FROM v_pixels GROUP BY ALL) GROUP BY image_id""",
        "v_pixels",
    ),
)
def pixel_entropy(spark, sf_dir):
    levels = F.transform("pixels", lambda v: F.round(v, 1))
    return _rounded(pixels.with_entropy(views.images(spark, sf_dir), levels).drop("pixels"))


# central moments by direct summation around the centroid
_CENTRAL = """SELECT image_id, sum(v) AS mu00, {sums} FROM v_pixels JOIN (
    SELECT image_id, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM v_pixels GROUP BY image_id) USING (image_id)
    GROUP BY image_id"""
_DEGREES = [(r, c) for r in range(4) for c in range(4) if 2 <= r + c <= 3]
_SUMS = ", ".join(f"sum(power(y - cy, {r}) * power(x - cx, {c}) * v) AS mu{r}{c}" for r, c in _DEGREES)
_ETA = "SELECT image_id, " + ", ".join(
    f"mu{r}{c} / power(mu00, {1 + (r + c) / 2}) AS e{r}{c}" for r, c in _DEGREES
) + " FROM central"
_HU = """SELECT image_id, round(e20 + e02, 9) AS image_moment_0,
    round(power(e20 - e02, 2) + 4 * power(e11, 2), 9) AS image_moment_1,
    round(power(e30 - 3 * e12, 2) + power(3 * e21 - e03, 2), 9) AS image_moment_2,
    round(power(e30 + e12, 2) + power(e21 + e03, 2), 9) AS image_moment_3,
    round((e30 - 3 * e12) * (e30 + e12) * (power(e30 + e12, 2) - 3 * power(e21 + e03, 2))
      + (3 * e21 - e03) * (e21 + e03) * (3 * power(e30 + e12, 2) - power(e21 + e03, 2)), 9) AS image_moment_4,
    round((e20 - e02) * (power(e30 + e12, 2) - power(e21 + e03, 2)) + 4 * e11 * (e30 + e12) * (e21 + e03), 9) AS image_moment_5,
    round((3 * e21 - e03) * (e30 + e12) * (power(e30 + e12, 2) - 3 * power(e21 + e03, 2))
      - (e30 - 3 * e12) * (e21 + e03) * (3 * power(e30 + e12, 2) - power(e21 + e03, 2)), 9) AS image_moment_6 FROM eta"""


@query("pixel_hu_moments", views.oracle(_HU, "v_pixels", central=_CENTRAL.format(sums=_SUMS), eta=_ETA))
def pixel_hu_moments(spark, sf_dir):
    return _rounded(pixels.with_hu_moments(views.images(spark, sf_dir), "pixels", 8).drop("pixels"), 9)


_CORNER = "SELECT image_id, " + ", ".join(
    f"sum(CASE WHEN y = {r} AND x = {c} THEN v END) AS e{r}{c}" for r, c in _DEGREES
) + " FROM v_pixels GROUP BY image_id"


@query("pixel_hu_corner", views.oracle(_HU, "v_pixels", eta=_CORNER))
def pixel_hu_corner(spark, sf_dir):
    return _rounded(pixels.with_hu_moments(views.images(spark, sf_dir), "pixels", 8, of="corner").drop("pixels"), 9)


@query(
    "pixel_inertia",
    views.oracle(
        """SELECT image_id, round((a + b) / 2 + sqrt(power((a - b) / 2, 2) + m * m), 6) AS image_inertia_tensor_eigval_0,
        round(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + m * m), 0), 6) AS image_inertia_tensor_eigval_1 FROM (
        SELECT image_id, mu20 / mu00 AS a, mu02 / mu00 AS b, mu11 / mu00 AS m FROM central)""",
        "v_pixels",
        central=_CENTRAL.format(sums=_SUMS),
    ),
)
def pixel_inertia(spark, sf_dir):
    return _rounded(pixels.with_inertia(views.images(spark, sf_dir), "pixels", 8).drop("pixels"))


@query(
    "pixel_rows",
    views.oracle(
        """SELECT image_id, round(avg(v), 6) AS image_mean, round(stddev_pop(v), 6) AS image_std,
        round(min(v), 6) AS image_min, round(max(v), 6) AS image_max, round(median(v), 6) AS image_median,
        round(skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS image_skew,
        round(kurtosis_pop(v), 6) AS image_kurtosis, round(sqrt(avg(v * v)), 6) AS image_rms,
        cast(8 AS double) AS image_x, cast(8 AS double) AS image_y FROM v_pixels GROUP BY image_id""",
        "v_pixels",
    ),
)
def pixel_rows(spark, sf_dir):
    """The same statistics from a table with one row per pixel."""
    return _rounded(pixels.pixel_stats(views.pixels(spark, sf_dir)))
