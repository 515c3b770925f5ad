"""Points near points, any number on both sides, by cells of a grid in space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GeoConfig
from ..functions import geo

#: Points that are sampled to cut space into tiles, and of them in a tile; rows of a tile that go to one task, and parts it has at most; points compared with at once, pairs of them, and rows that are dealt at once.
SAMPLE, TILE, ROWS, PARTS, SMALL, BLOCK, BATCH = 50_000, 64, 50_000, 1024, 64, 1 << 22, 200_000


def _space(lat: Column, lon: Column, earth: float) -> list[Column]:
    """Metres from the middle of the earth: no seam at the date line or the poles."""
    return [earth * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), earth * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), earth * F.sin(F.radians(lat))]


def near_points(rows: DataFrame, points: DataFrame, radius: float, earth: float = GeoConfig().earth) -> DataFrame:
    """Pairs of a row and a point at most `radius` metres apart, with `metres`. rows: lat, lon and more; points: lat, lon and more (renamed to point_*).

    Cells are as wide as the radius, so whatever is within it (no farther through the earth than along it) lies in the cell or beside it: points are put into
    their 27 cells, rows into one, and cells are joined. Rows or points without coordinates have no pairs.
    """
    cell = lambda: [F.floor(c / radius) for c in _space(F.col("lat"), F.col("lon"), earth)]
    there = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    own = there(rows).withColumn("_cell", F.array(*cell()))
    x, y, z = cell()
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    spread = there(points).withColumn("_cell", F.explode(F.array(*(F.array(x + a, y + b, z + c) for a, b, c in steps))))
    spread = spread.withColumnsRenamed({c: f"point_{c}" for c in points.columns})
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("point_lat"), F.col("point_lon"), earth)
    return own.join(spread, "_cell").withColumn("metres", metres).where(F.col("metres") <= radius).drop("_cell")


def _cuts(places: np.ndarray, leaf: int) -> dict[int, tuple[int, float]]:
    """Cuts across the widest side, until a part holds `leaf` places or all its places are one: axis and place of the cut by node, whose parts are 2i+1 and 2i+2. Other nodes are leaves."""
    nodes, todo = {}, [(0, places)]
    while todo:
        i, some = todo.pop()
        if len(some) <= leaf:
            continue
        axis = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
        at = float(np.median(some[:, axis]))
        below = some[:, axis] <= at
        if below.all():  # half of them or more lie at the end
            at = float(np.nextafter(at, -np.inf))
            below = some[:, axis] <= at
        if below.any():
            nodes[i] = (axis, at)
            todo += [(2 * i + 1, some[below]), (2 * i + 2, some[~below])]
    return nodes


def _reached(nodes: dict[int, tuple[int, float]], xyz: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, and which rows come within `reach` of them."""
    todo = [(0, np.arange(len(xyz)))]
    while todo:
        i, some = todo.pop()
        if i not in nodes:
            if len(some):
                yield i, some
            continue
        axis, at = nodes[i]
        v, r = xyz[some, axis], reach[some]
        todo += [(2 * i + 1, some[v - r <= at]), (2 * i + 2, some[v + r > at])]


def _larger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to BATCH rows: what a tile costs is paid less often."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= BATCH:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _in_tiles(nodes: dict[int, tuple[int, float]], xyz: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves that they come within reach of."""
    found = list(_reached(nodes, xyz, np.zeros(len(xyz)) if reach is None else reach))
    return np.concatenate([w for _, w in found]), np.repeat([i for i, _ in found], [len(w) for _, w in found])


def _squares(xyz: np.ndarray, places: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows and places, and by row how far rounding may put them off; `same` is each row's own place, or -1."""
    middle = places.mean(axis=0)
    q, p = xyz - middle, places - middle
    a, b = (q**2).sum(axis=1), (p**2).sum(axis=1)
    out = a[:, None] + b - 2 * (q @ p.T)
    if same is not None:
        mine = np.flatnonzero(same >= 0)
        out[mine, same[mine]] = np.inf
    return out, 32 * np.finfo(float).eps * (a + b.max()) + 1e-7


def _own_place(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each key stands among ids; -1 where it doesn't."""
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], keys), len(ids) - 1)
    return np.where(ids[order][at] == keys, order[at], -1)


def _closest(xyz: np.ndarray, keys: np.ndarray, places: np.ndarray, ids: np.ndarray, reach: np.ndarray, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and places that are each other's nearest within reach as far as rounding can tell, and by row how far its nearest is at most."""
    nodes = _cuts(places, SMALL)
    inside = dict(_reached(nodes, places, np.zeros(len(places))))
    who, which, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    best = reach.copy()
    for leaf, rows in _reached(nodes, xyz, reach):
        there = inside.get(leaf)
        step = max(1, BLOCK // (len(there) if there is not None else 1))
        for i in range(0, len(rows) if there is not None else 0, step):
            some = rows[i : i + step]
            squares, slack = _squares(xyz[some], places[there], _own_place(keys[some], ids[there]) if others else None)
            best[some] = np.minimum(best[some], np.sqrt(np.maximum(squares.min(axis=1) + slack, 0)))
            a, b = np.nonzero(squares <= (best[some] ** 2 + 2 * slack)[:, None])
            who.append(some[a])
            which.append(there[b])
            far.append(np.sqrt(np.maximum(squares[a, b] - 2 * slack[a], 0)))
    who, which, far = np.concatenate(who), np.concatenate(which), np.concatenate(far)
    kept = far <= best[who] * (1 + 1e-12)
    return who[kept], which[kept], best


def nearest_point(rows: DataFrame, points: DataFrame, key: str, point: str, radius: float, others: bool = False, earth: float = GeoConfig().earth) -> DataFrame:
    """rows' key with the nearest point's `point` and `metres` (ties: the smaller point); null where there is none within the radius. With `others` a row's key is no point for it.

    Space is cut into tiles by a sample of the points, which also says how far a row's nearest is at most, so a row is sent to the few tiles that are within that; crowded rows and points make more
    and smaller tiles, not more pairs. Of points at one place the two smallest count: the others are nobody's nearest. What a tile finds is compared by the exact distance.
    """
    there = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at = {c: v for c, v in zip("xyz", _space(F.col("lat"), F.col("lon"), earth))}
    own = there(rows).select(F.col(key).alias("key"), "lat", "lon").withColumns(at)
    crowd = Window.partitionBy("lat", "lon").orderBy("point")
    places = there(points).select(F.col(point).alias("point"), "lat", "lon").withColumn("_n", F.row_number().over(crowd)).where("_n <= 2").drop("_n").withColumns(at)
    n = places.count()
    some = places.select("point", *"xyz").sample(min(1.0, SAMPLE / max(n, 1)), 7).limit(2 * SAMPLE).toPandas()
    seen, seen_ids = some[[*"xyz"]].to_numpy(float), some["point"].to_numpy()
    nodes = _cuts(seen, TILE)

    def leaves(batches):
        for pdf in _larger(batches):
            leaf, n = np.unique(_in_tiles(nodes, pdf[[*"xyz"]].to_numpy(float))[1], return_counts=True)
            yield pd.DataFrame({"leaf": leaf, "n": n})

    crowded = own.select(*"xyz").mapInPandas(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > ROWS)
    parts = {r["leaf"]: -(-r["n"] // ROWS) for r in crowded.collect()}  # at most a row for each tile

    def deals(leaf):
        kinds, at = np.unique(leaf, return_inverse=True)
        return np.array([min(parts.get(int(i), 1), PARTS) for i in kinds])[at]

    def deal_rows(batches):
        for pdf in _larger(batches):
            xyz, keys = pdf[[*"xyz"]].to_numpy(float), pdf["key"].to_numpy()
            reach = np.full(len(pdf), float(radius))
            if len(seen):
                reach = _closest(xyz, keys, seen, seen_ids, reach, others)[2] if len(nodes) == 0 else _bounded(xyz, keys, reach)
            found, leaf = _in_tiles(nodes, xyz, reach * (1 + 1e-9) + 1e-6)
            turn = (pd.util.hash_array(keys) >> np.uint64(40)).astype(np.int64)[found]
            yield pdf.iloc[found].assign(reach=reach[found], cell=leaf * PARTS + turn % deals(leaf))

    def _bounded(xyz, keys, reach):
        """By the sampled points of the row's own tile."""
        best = reach.copy()
        inside = dict(_reached(nodes, seen, np.zeros(len(seen))))
        for leaf, found in _reached(nodes, xyz, np.zeros(len(xyz))):
            mine = inside.get(leaf)
            for i in range(0, len(found) if mine is not None else 0, 4096):
                part = found[i : i + 4096]
                squares, slack = _squares(xyz[part], seen[mine], _own_place(keys[part], seen_ids[mine]) if others else None)
                best[part] = np.minimum(best[part], np.sqrt(np.maximum(squares.min(axis=1) + slack, 0)))
        return best

    def deal_points(batches):
        for pdf in _larger(batches):
            found, leaf = _in_tiles(nodes, pdf[[*"xyz"]].to_numpy(float))
            times = deals(leaf)
            for p in range(int(times.max())):
                yield pdf.iloc[found[p < times]].assign(cell=leaf[p < times] * PARTS + p)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("key", "lat", "lon", "point", "point_lat", "point_lon")})
        keys, ids = left["key"].to_numpy(), right["point"].to_numpy()
        who, which, _ = _closest(left[[*"xyz"]].to_numpy(float), keys, right[[*"xyz"]].to_numpy(float), ids, left["reach"].to_numpy(float) * (1 + 1e-9) + 1e-6, others)
        a, b = left.iloc[who], right.iloc[which]
        return pd.DataFrame({"key": a["key"].to_numpy(), "lat": a["lat"].to_numpy(), "lon": a["lon"].to_numpy(), "point": b["point"].to_numpy(), "point_lat": b["lat"].to_numpy(), "point_lon": b["lon"].to_numpy()})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((own, "key"), (places, "point"))}
    dealt = own.mapInPandas(deal_rows, f"key {kinds['key']}, lat double, lon double, x double, y double, z double, reach double, cell long")
    spread = places.mapInPandas(deal_points, f"point {kinds['point']}, lat double, lon double, x double, y double, z double, cell long")
    found = dealt.groupBy("cell").cogroup(spread.groupBy("cell")).applyInPandas(search, f"key {kinds['key']}, lat double, lon double, point {kinds['point']}, point_lat double, point_lon double")
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("point_lat"), F.col("point_lon"), earth)
    best = found.withColumn("metres", metres).where(F.col("metres") <= radius).groupBy("key").agg(F.min(F.struct("metres", "point")).alias("_best"))
    return rows.select(key).join(best, F.col(key) == best["key"], "left").select(rows[key], F.col("_best.point").alias("point"), F.col("_best.metres").alias("metres"))
