"""Similarity functions of arrays, property metrics, scalers and small utilities, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graph import View


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _paired(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def dot(a, b) -> Column:
    return _sum(_paired(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Of null components a pair counts as 0; 0 if a vector is all 0."""
    a, b = (F.transform(_doubles(x), lambda v: F.coalesce(v, F.lit(0.0))) for x in (a, b))
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def pearson(a, b) -> Column:
    a, b = _doubles(a), _doubles(b)
    n = F.size(a).cast("double")
    ma, mb = _sum(a) / n, _sum(b) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    return cosine(da, db)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(_sum(_paired(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def euclidean(a, b) -> Column:
    return 1 / (1 + euclidean_distance(a, b))


def jaccard(a, b) -> Column:
    """Of multisets: a value counts as often as both lists have it."""
    a, b = _doubles(a), _doubles(b)
    both = F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda s, v: s + F.least(F.size(F.filter(a, lambda x: x == v)), F.size(F.filter(b, lambda x: x == v))),
    )
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(1.0)


def overlap(a, b) -> Column:
    a, b = F.array_distinct(_doubles(a)), F.array_distinct(_doubles(b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def property_metric(kind: str, metric: str, a: Column, b: Column) -> Column:
    """The similarity in [0, 1] of two values of a node property; 0 where it is not finite."""
    metric = metric.upper()
    if not kind.startswith("array"):
        out = 1 / (1 + F.abs(a.cast("double") - b.cast("double")))
    elif kind in ("array<bigint>", "array<int>") and metric in ("DEFAULT", "JACCARD"):
        x, y = F.array_distinct(a), F.array_distinct(b)
        both = F.size(F.array_intersect(x, y))
        out = both / (F.size(x) + F.size(y) - both)
    elif kind in ("array<bigint>", "array<int>") and metric == "OVERLAP":
        out = overlap(a, b)
    elif metric in ("DEFAULT", "COSINE"):
        out = (cosine(a, b) + 1) / 2
    elif metric == "EUCLIDEAN":
        out = euclidean(a, b)
    elif metric == "PEARSON":
        out = (pearson(a, b) + 1) / 2
    else:
        raise ValueError(f"no metric {metric} for {kind}")
    return F.when(F.isnan(out) | out.isNull() | (F.abs(out) == float("inf")), 0.0).otherwise(out)


def one_hot(available: Column, selected: Column) -> Column:
    return F.transform(available, lambda x: F.array_contains(selected, x).cast("long"))


def nan() -> Column:
    return F.lit(float("nan"))


def infinity() -> Column:
    return F.lit(float("inf"))


def is_finite(c: Column | str) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def is_infinite(c: Column | str) -> Column:
    return ~is_finite(c)


SCALERS = ("NONE", "MINMAX", "MAX", "MEAN", "STDSCORE", "CENTER", "LOG", "L1NORM", "L2NORM")


def scalings(rows: DataFrame, columns: list[Column], scaler: str = "NONE", offset: float = 0.0) -> list[Column]:
    """Each column, a number, scaled over all rows; null and NaN are left out of the statistics,
    which are one aggregated row for all columns."""
    scaler = scaler.upper()
    if scaler not in SCALERS:
        raise ValueError(f"no scaler {scaler}; there are {SCALERS}")
    numbers = [c.cast("double") for c in columns]
    if scaler == "NONE":
        return columns
    if scaler == "LOG":
        return [F.log(x + offset) for x in numbers]
    good = [F.when(F.isnan(x), None).otherwise(x) for x in numbers]
    zero = F.lit(0.0)
    # what is taken off, and what is divided by
    less = {"MINMAX": F.min, "MEAN": F.avg, "STDSCORE": F.avg, "CENTER": F.avg}.get(scaler, lambda g: F.min(F.when(g.isNotNull(), zero)))
    by = {
        "MINMAX": lambda g: F.max(g) - F.min(g),
        "MAX": lambda g: F.max(F.abs(g)),
        "MEAN": lambda g: F.max(g) - F.min(g),
        "STDSCORE": F.stddev_pop,
        "CENTER": lambda g: F.max(F.when(g.isNotNull(), 1.0)),
        "L1NORM": lambda g: F.sum(F.abs(g)),
        "L2NORM": lambda g: F.sqrt(F.sum(g * g)),
    }[scaler]
    found = rows.agg(*(f(g) for g in good for f in (less, by))).first()
    out = []
    for k, (c, x) in enumerate(zip(columns, numbers)):
        a, b = found[2 * k], found[2 * k + 1]
        out.append(c if b is None else zero if math.isclose(b, 0, abs_tol=1e-15) else (x - a) / b)
    return out


def scale(rows: DataFrame, column: str, scaler: str = "NONE", offset: float = 0.0) -> DataFrame:
    """rows with the column scaled as scalings() does."""
    [x] = scalings(rows, [F.col(f"`{column}`")], scaler, offset)
    return rows if scaler.upper() == "NONE" else rows.withColumn(column, x)


def scale_properties(view: View, node_properties: list[str] | str, scaler: str = "NONE", offset: float = 0.0) -> DataFrame:
    """(nodeId, scaledProperty): the properties, numbers or arrays of one length, one after another
    in an array, each place scaled over all nodes. The scaler is a name, or a map with `type`
    and, for LOG, `offset`."""
    if isinstance(scaler, dict):
        scaler, offset = scaler["type"], scaler.get("offset", offset)
    names = [node_properties] if isinstance(node_properties, str) else list(node_properties)
    types = dict(view.nodes.dtypes)
    wide = [n for n in names if types[n].startswith("array")]
    sizes = view.nodes.agg(*(F.max(F.size(n)) for n in wide), *(F.min(F.size(n)) for n in wide)).first() if wide else []
    length = {}
    for k, n in enumerate(wide):
        if sizes[k] != sizes[k + len(wide)]:
            raise ValueError(f"arrays of {n!r} differ in length")
        length[n] = sizes[k] or 0
    columns = [x for n in names for x in ([F.get(n, F.lit(j)) for j in range(length[n])] if n in length else [F.col(n)])]
    return view.nodes.select(F.col("id").alias("nodeId"), F.array(*(c.cast("double") for c in scalings(view.nodes, columns, scaler, offset))).alias("scaledProperty"))
