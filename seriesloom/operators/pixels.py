"""Per-image pixel statistics and moments.

``with_stats``, ``with_entropy``, ``with_hu_moments`` and ``with_inertia`` take an image as one array of its
rows' pixels and add columns to the image's row: nothing is exploded and nothing is shuffled. NULL pixels
are left out of statistics and entropy and weigh nothing in moments; an image without pixels gets NULL.

The other functions take one row per pixel (image_id, x, y, v). Their sums are combined map-side; only the
median and the entropy, which need a histogram, shuffle an image's distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import as_column, let

# ---------------------------------------------------------------- images as arrays


def _fold(values: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """One pass over an array with a struct of named running values."""
    names = list(start)
    first = F.struct(*[start[n].alias(n) for n in names])

    def merge(acc: Column, v: Column) -> Column:
        following = step(acc, v)
        return F.struct(*[following[n].alias(n) for n in names])

    return F.aggregate(values, first, merge)


def _doubles(pixels: Column | str) -> Column:
    return F.transform(as_column(pixels), lambda v: v.cast("double"))


def with_stats(df: DataFrame, pixels: str, width: int | Column) -> DataFrame:
    """``df`` with mean, population deviation, extremes, median, biased skew, excess kurtosis, RMS, rows and columns."""
    zero = F.lit(0.0)

    def of(known: Column) -> Column:
        n = F.nullif(F.size(known), F.lit(0)).cast("double")
        sums = _fold(known, {"v": zero, "vv": zero}, lambda a, v: {"v": a["v"] + v, "vv": a["vv"] + v * v})
        head = F.struct(known.alias("values"), F.array_sort(known).alias("sorted"), n.alias("n"), sums.alias("sums"))
        return let(head, centred)

    def centred(h: Column) -> Column:
        mean = h["sums"]["v"] / h["n"]

        def power(acc: Column, v: Column) -> dict[str, Column]:
            d = v - acc["mean"]
            return {"mean": acc["mean"], "d2": acc["d2"] + d * d, "d3": acc["d3"] + d * d * d, "d4": acc["d4"] + d * d * d * d}

        spread = _fold(h["values"], {"mean": mean, "d2": zero, "d3": zero, "d4": zero}, power)
        return let(F.struct(h.alias("h"), spread.alias("s")), finished)

    def finished(x: Column) -> Column:
        h, s, n = x["h"], x["s"], x["h"]["n"]
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.struct(
            s["mean"].alias("image_mean"),
            F.sqrt(s["d2"] / n).alias("image_std"),
            F.get(h["sorted"], F.lit(0)).alias("image_min"),
            F.get(h["sorted"], n.cast("int") - 1).alias("image_max"),
            ((F.get(h["sorted"], low) + F.get(h["sorted"], high)) / 2).alias("image_median"),
            F.try_divide(F.sqrt(n) * s["d3"], F.pow(s["d2"], 1.5)).alias("image_skew"),
            (F.try_divide(n * s["d4"], s["d2"] * s["d2"]) - 3).alias("image_kurtosis"),
            F.sqrt(h["sums"]["vv"] / n).alias("image_rms"),
        )

    known = F.filter(_doubles(pixels), lambda v: v.isNotNull())
    size = F.nullif(F.size(pixels), F.lit(0))
    stats = df.withColumn("_stats", let(known, of))
    return stats.select(
        *df.columns,
        "_stats.*",
        F.ceil(size / width).cast("double").alias("image_x"),
        F.when(size > 0, F.least(size, F.lit(width) if isinstance(width, int) else width)).cast("double").alias("image_y"),
    )


def with_entropy(df: DataFrame, pixels: str | Column) -> DataFrame:
    """``df`` with the base-2 Shannon entropy of the image's value histogram, from the runs of its sorted values."""

    def term(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def step(acc: Column, v: Column) -> dict[str, Column]:
        same = acc["last"].eqNullSafe(v)
        return {
            "last": v,
            "run": F.when(same, acc["run"] + 1.0).otherwise(1.0),
            "total": acc["total"] + F.when(same, 0.0).otherwise(term(acc["run"])),
        }

    def of(ordered: Column) -> Column:
        start = {"last": F.lit(None).cast("double"), "run": F.lit(0.0), "total": F.lit(0.0)}
        runs = F.struct(_fold(ordered, start, step).alias("a"), F.nullif(F.size(ordered), F.lit(0)).cast("double").alias("n"))
        return let(runs, lambda r: F.greatest(F.log2(r["n"]) - (r["a"]["total"] + term(r["a"]["run"])) / r["n"], F.lit(0.0)))

    ordered = F.array_sort(F.filter(_doubles(pixels), lambda v: v.isNotNull()))
    entropy = let(ordered, of)
    return df.withColumn("image_entropy", F.when(F.size(as_column(pixels)) > 0, entropy))


def _array_moments(pixels: str | Column, width: int | Column, order: int) -> Column:
    """Struct of the raw moments m_rc up to ``order``: sums along every row of the image, then over its rows."""
    degrees = [(r, c) for r in range(order + 1) for c in range(order + 1) if r + c <= order]

    def along(acc: Column, v: Column) -> dict[str, Column]:
        out, weighted = {"x": acc["x"] + 1.0}, F.coalesce(v, F.lit(0.0))
        for c in range(order + 1):
            out[f"s{c}"] = acc[f"s{c}"] + weighted
            weighted = weighted * acc["x"]
        return out

    def down(acc: Column, line: Column) -> dict[str, Column]:
        out = {"y": acc["y"] + 1.0}
        for r, c in degrees:
            weight = line[f"s{c}"]
            for _ in range(r):
                weight = weight * acc["y"]
            out[f"m{r}{c}"] = acc[f"m{r}{c}"] + weight
        return out

    def of(values: Column) -> Column:
        wide = F.lit(width) if isinstance(width, int) else width
        start = {"x": F.lit(0.0), **{f"s{c}": F.lit(0.0) for c in range(order + 1)}}
        ends = F.ceil(F.size(values) / wide).cast("int") - 1
        lines = F.transform(F.sequence(F.lit(0), F.greatest(ends, F.lit(0))), lambda y: _fold(F.slice(values, y * wide + 1, wide), start, along))
        return _fold(lines, {"y": F.lit(0.0), **{f"m{r}{c}": F.lit(0.0) for r, c in degrees}}, down)

    return let(_doubles(pixels), of)


def _of_moments(df: DataFrame, moments: Column, order: int, added: dict[str, Column]) -> DataFrame:
    """``df`` with ``added``, columns made from central moments, which don't stay themselves."""
    names = [f"m{r}{c}" for r in range(order + 1) for c in range(order + 1) if r + c <= order]
    # every column of the image in one, so the moments' names can't meet those of the table
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_image"), moments.alias("_moments"))
    central = _centred(rows.select("_image", *[F.col("_moments")[n].alias(n) for n in names]), "_image", order)
    return central.select("_image", *[value.alias(name) for name, value in added.items()]).select("_image.*", *added)


def with_hu_moments(df: DataFrame, pixels: str, width: int | Column, of: str = "moments") -> DataFrame:
    """``df`` with the seven Hu invariants (see ``pixel_hu_moments``)."""
    if of == "corner":
        at = {(r, c): F.get(_doubles(pixels), F.lit(r) * width + c) for r, c in _HU_DEGREES}
        return df.withColumns(_hu(at))
    return _of_moments(df, _array_moments(pixels, width, 3), 3, _hu(_normalised()))


def with_inertia(df: DataFrame, pixels: str, width: int | Column) -> DataFrame:
    """``df`` with the eigenvalues of the 2 × 2 inertia tensor, descending, never below 0."""
    return _of_moments(df, _array_moments(pixels, width, 2), 2, _eigenvalues())


# ---------------------------------------------------------------- one row per pixel


def explode_pixels(df: DataFrame, key: str, pixels: str, width: int | Column) -> DataFrame:
    """Pixel arrays in row order → (image_id, x, y, v)."""
    flat = df.select(F.col(key).alias("image_id"), F.posexplode(pixels).alias("_at", "v"))
    return flat.select(
        "image_id",
        (F.col("_at") % width).alias("x"),
        F.floor(F.col("_at") / width).cast("int").alias("y"),
        F.col("v").cast("double").alias("v"),
    )


def pixel_stats(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Mean, population deviation, extremes, median, biased skew, excess kurtosis, RMS, rows and columns."""
    v = F.col("v")
    return pixels.groupBy(key).agg(
        F.avg(v).alias("image_mean"),
        F.stddev_pop(v).alias("image_std"),
        F.min(v).alias("image_min"),
        F.max(v).alias("image_max"),
        F.percentile(v, F.lit(0.5)).alias("image_median"),
        F.skewness(v).alias("image_skew"),
        F.kurtosis(v).alias("image_kurtosis"),
        F.sqrt(F.avg(v * v)).alias("image_rms"),
        (F.max("y") + 1).cast("double").alias("image_x"),
        (F.max("x") + 1).cast("double").alias("image_y"),
    )


def pixel_entropy(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Base-2 Shannon entropy of the value histogram."""
    levels = pixels.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    total, n = F.sum("n"), F.col("n")
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    return levels.groupBy(key).agg(F.greatest(entropy, F.lit(0.0)).alias("image_entropy"))


def _power(base: Column, exponent: int) -> Column:
    out = F.lit(1.0)
    for _ in range(exponent):
        out = out * base
    return out


def _central_moments(pixels: DataFrame, key: str, order: int) -> DataFrame:
    """Central moments mu_rc up to ``order``, r counting rows (y) and c columns (x)."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v")

    degrees = [(r, c) for r in range(order + 1) for c in range(order + 1) if r + c <= order]
    raw = pixels.groupBy(key).agg(
        *[F.sum(_power(y, r) * _power(x, c) * v).alias(f"m{r}{c}") for r, c in degrees]
    )
    return _centred(raw, key, order)


def _centred(raw: DataFrame, key: str, order: int) -> DataFrame:
    """key and central moments, from raw moments."""
    degrees = [(r, c) for r in range(order + 1) for c in range(order + 1) if r + c <= order]
    centred = raw.withColumns({"_y": F.try_divide("m10", "m00"), "_x": F.try_divide("m01", "m00")})
    yc, xc = F.col("_y"), F.col("_x")

    def choose(n: int, k: int) -> int:
        return 1 if k in (0, n) else choose(n - 1, k - 1) + choose(n - 1, k)

    def central(r: int, c: int) -> Column:
        terms = [
            choose(r, i) * choose(c, j) * _power(-yc, r - i) * _power(-xc, c - j) * F.col(f"m{i}{j}")
            for i in range(r + 1)
            for j in range(c + 1)
        ]
        return sum(terms[1:], terms[0])

    return centred.select(key, *[central(r, c).alias(f"mu{r}{c}") for r, c in degrees])


def pixel_hu_moments(pixels: DataFrame, key: str = "image_id", of: str = "moments") -> DataFrame:
    """The seven Hu invariants ``image_moment_0..6``.

    ``of="moments"`` takes them from the normalised central moments, which makes them invariant.
    ``of="corner"`` puts the raw pixels of the top-left 4 × 4 corner in the moments' place, as tables
    made by feeding a pixel array straight to the closed forms have it.
    """
    if of == "corner":
        eta = pixels.groupBy(key).agg(
            *[
                F.sum(F.when((F.col("y") == r) & (F.col("x") == c), F.col("v"))).alias(f"e{r}{c}")
                for r, c in _HU_DEGREES
            ]
        )
        hu = _hu({(r, c): F.col(f"e{r}{c}") for r, c in _HU_DEGREES})
    else:
        eta = _central_moments(pixels, key, 3)
        hu = _hu(_normalised())
    return eta.select(key, *[value.alias(name) for name, value in hu.items()])


_HU_DEGREES = [(r, c) for r in range(4) for c in range(4) if 2 <= r + c <= 3]


def _normalised() -> dict[tuple[int, int], Column]:
    """Normalised central moments, of a table with the columns mu_rc."""
    return {(r, c): F.try_divide(F.col(f"mu{r}{c}"), F.pow("mu00", 1 + (r + c) / 2)) for r, c in _HU_DEGREES}


def _hu(e: dict[tuple[int, int], Column]) -> dict[str, Column]:
    a, b = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3]
    p, q = e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
    spread, shear = e[2, 0] - e[0, 2], e[1, 1]
    hu = [
        e[2, 0] + e[0, 2],
        spread * spread + 4 * shear * shear,
        p * p + q * q,
        a * a + b * b,
        p * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b),
        spread * (a * a - b * b) + 4 * shear * a * b,
        q * a * (a * a - 3 * b * b) - p * b * (3 * a * a - b * b),
    ]
    return {f"image_moment_{i}": value for i, value in enumerate(hu)}


def pixel_inertia(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Eigenvalues of the 2 × 2 inertia tensor, descending, never below 0."""
    mu = _central_moments(pixels, key, 2)
    return mu.select(key, *[value.alias(name) for name, value in _eigenvalues().items()])


def _eigenvalues() -> dict[str, Column]:
    """Of the inertia tensor, of a table with the columns mu_rc."""
    rows, columns, mixed = (F.try_divide(c, "mu00") for c in ("mu20", "mu02", "mu11"))
    middle, half = (rows + columns) / 2, F.sqrt(F.pow((rows - columns) / 2, 2) + F.pow(mixed, 2))
    return {
        "image_inertia_tensor_eigval_0": F.greatest(middle + half, F.lit(0.0)),
        "image_inertia_tensor_eigval_1": F.greatest(middle - half, F.lit(0.0)),
    }
