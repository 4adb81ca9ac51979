"""Waypoints of a line: Visvalingam-Whyatt reduction, resampling, thinning of close points."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspoke.functions import columns as C
from railspoke.functions import constants as K


def _reduced(x: np.ndarray, y: np.ndarray, count: int) -> list[int]:
    """Indices of the ``count`` points left when the smallest triangle's middle goes again and again, first on ties."""
    n = len(x)
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    area = lambda a, b, c: abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2
    now = {k: area(k - 1, k, k + 1) for k in range(1, n - 1)}
    heap = [(a, k) for k, a in now.items()]
    heapq.heapify(heap)
    alive = n
    while alive > count and heap:
        a, k = heapq.heappop(heap)
        if now.get(k) != a:
            continue
        del now[k]
        alive -= 1
        p, q = left[k], right[k]
        right[p], left[q] = q, p
        for m in (p, q):
            if m in now:
                now[m] = area(left[m], m, right[m])
                heapq.heappush(heap, (now[m], m))
    return [0, *sorted(now), n - 1]


def _resampled(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    along = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
    if along[-1] == 0:
        return np.full(count, x[0]), np.full(count, y[0])
    at = np.linspace(0.0, along[-1], count)
    return np.interp(at, along, x), np.interp(at, along, y)


def waypoints(lines: DataFrame, key: str, count: int = K.GMAPS_POINTS) -> DataFrame:
    """(key, points): each line's (lon, lat) vertices brought to exactly ``count`` points.

    Longer lines are reduced, shorter ones resampled by arc length in degrees;
    lines of fewer than two points give none.
    """
    kind = dict(lines.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for xs, ys in zip(pdf.pop("xs"), pdf.pop("ys"), strict=True):
                x, y = np.asarray(xs, "float64"), np.asarray(ys, "float64")
                if len(x) > count:
                    keep = _reduced(x, y, count)
                    x, y = x[keep], y[keep]
                else:
                    x, y = _resampled(x, y, count)
                out.append([{"lat": b, "lon": a} for a, b in zip(x.tolist(), y.tolist(), strict=True)])
            pdf["points"] = out
            yield pdf

    xy = [F.transform("line", lambda v: v["lon"]).alias("xs"), F.transform("line", lambda v: v["lat"]).alias("ys")]
    rows = lines.where("size(line) >= 2").select(key, *xy)
    return rows.mapInPandas(run, f"`{key}` {kind}, points array<struct<lat:double,lon:double>>")


def thinned(points: Column, spacing_km: float = K.GMAPS_SPACING_KM) -> Column:
    """Points without inner ones nearer than the spacing to the last kept one; both ends stay."""
    far = lambda kept, p: (
        C.haversine_m(F.element_at(kept, -1)["lat"], F.element_at(kept, -1)["lon"], p["lat"], p["lon"]) >= spacing_km * 1000.0
    )
    inner = F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))
    begun = F.slice(points, 1, 1)
    kept = F.aggregate(inner, begun, lambda acc, p: F.when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return F.concat(kept, F.slice(points, -1, 1))


def joined_lines(hops: DataFrame, *keys: str) -> DataFrame:
    """(keys, line): the vertices of a run of hops in order, a vertex that repeats the one before it left out.

    ``hops`` has seq and verts (as ``hop_vertices``).
    """
    w = Window.partitionBy(*keys).orderBy("seq", "pt")
    each = hops.select(*keys, "seq", F.posexplode("verts").alias("pt", "_v"))
    same = F.lag("_v").over(w)
    kept = each.withColumn("_p", same).where(
        F.col("_p").isNull() | (F.col("_p.lon") != F.col("_v.lon")) | (F.col("_p.lat") != F.col("_v.lat"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("seq", "pt", "_v.lon", "_v.lat")))
    line = F.transform(ordered, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return kept.groupBy(*keys).agg(line.alias("line"))
