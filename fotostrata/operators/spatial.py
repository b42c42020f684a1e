"""Points near other points, and points inside regions.

A bounded sample of the points drives a quadtree over longitude and latitude
whose leaves are the join's partitions. Every point goes to its home leaf and to
each leaf its search box touches (boundary replication); per leaf, packed R-trees
bulk-loaded by sort-tile-recursion are joined top down, candidates are refined
by the exact geometry, and a pair is reported only in the home leaf of the point
with the smaller id (its reference point), so none comes twice.

Scale: leaves go down to twice the distance. One that is crowded even so is cut
into blocks of bounded size, and a task joins two of them, whatever the leaf
holds. Where one owner (a camera) fills it, that owner's blocks meet the others
only, and points of a large owner form a tree of their own that is never joined
with itself, so a camera that took a third of all pictures from one spot costs
no candidate pairs. near_links counts partners without writing any pair of
copies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup
from fotostrata.session import materialise

EARTH_M = 6_371_000.0
CAP_LAT = 85.0
NORTH, SOUTH = -1, -2


# ---------------------------------------------------------------- R-tree


class PackedTree:
    """A bulk-loaded R-tree over axis-parallel boxes; children of a node are contiguous."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, fan: int = 16):
        n, dims = lo.shape
        self.fan = fan
        mid = (lo + hi) / 2
        order = np.argsort(mid[:, 0], kind="stable")
        tiles = max(1, math.ceil(n / fan))
        width = math.ceil(n / max(1, math.ceil(tiles ** (1 / dims))))
        for d in range(1, dims):
            slab = np.arange(n) // max(1, width)
            order = order[np.lexsort((mid[order, d], slab))]
            width = math.ceil(width / max(1, math.ceil(tiles ** (1 / dims))))
        self.items = order
        self.levels = [(lo[order], hi[order])]
        while len(self.levels[-1][0]) > 1:
            below_lo, below_hi = self.levels[-1]
            cut = np.arange(0, len(below_lo), fan)
            self.levels.append((np.minimum.reduceat(below_lo, cut), np.maximum.reduceat(below_hi, cut)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``nodes``, child) for every child one level below."""
        size = len(self.levels[level - 1][0])
        counts = np.minimum(self.fan, size - nodes * self.fan)
        which = np.repeat(np.arange(len(nodes)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        return which, nodes[which] * self.fan + np.arange(len(which)) - first


def tree_join(a: PackedTree, b: PackedTree, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of item numbers whose boxes touch, in blocks of bounded size."""
    if not len(a.items) or not len(b.items):
        return
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, ia, ib = stack.pop()
        (alo, ahi), (blo, bhi) = a.levels[la], b.levels[lb]
        meet = ((alo[ia] <= bhi[ib]) & (blo[ib] <= ahi[ia])).all(axis=1)
        ia, ib = ia[meet], ib[meet]
        if not len(ia):
            continue
        if la == lb == 0:
            yield a.items[ia], b.items[ib]
            continue
        step = max(1, chunk // max(a.fan, b.fan))
        for at in range(0, len(ia), step):
            xa, xb = ia[at : at + step], ib[at : at + step]
            if la >= lb:
                which, child = a.children(la, xa)
                stack.append((la - 1, lb, child, xb[which]))
            else:
                which, child = b.children(lb, xb)
                stack.append((la, lb - 1, xa[which], child))


# ---------------------------------------------------------------- quadtree


@dataclass
class Quadtree:
    """Leaves of a quadtree over [-180, 180) x [-90, 90], with a leaf for each polar cap."""

    child: np.ndarray  # first of four children, or minus (leaf number + 10)
    depth: int
    leaves: int
    #: Crowded leaves: blocks of the heavy owner's points, blocks of the others, the heavy owner.
    spread: dict[int, tuple[int, int, str | None]] = field(default_factory=dict)

    def leaf_of(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        x = np.mod((lon + 180.0) / 360.0, 1.0)
        y = np.clip((lat + 90.0) / 180.0, 0.0, np.nextafter(1.0, 0.0))
        node = np.zeros(len(x), np.int64)
        for k in range(self.depth + 1):
            at = self.child[node]
            if (at < 0).all():
                break
            bit = (np.floor(x * 2.0 ** (k + 1)).astype(np.int64) & 1) + 2 * (np.floor(y * 2.0 ** (k + 1)).astype(np.int64) & 1)
            node = np.where(at >= 0, at + bit, node)
        leaf = -self.child[node] - 10
        return np.where(lat > CAP_LAT, NORTH, np.where(lat < -CAP_LAT, SOUTH, leaf))

    def touched(self, lat: np.ndarray, lon: np.ndarray, reach_deg: float) -> tuple[np.ndarray, np.ndarray]:
        """(point number, leaf) of every leaf that the box around a point touches; no leaf twice for a point."""
        wide = reach_deg / np.cos(np.radians(np.minimum(np.abs(lat), CAP_LAT + 2 * reach_deg)))
        found = [
            self.leaf_of(np.clip(lat + s * reach_deg, -90, 90), lon + t * wide) for s in (-1, 0, 1) for t in (-1, 0, 1)
        ]
        leaf = np.concatenate(found)
        who = np.tile(np.arange(len(lat)), len(found))
        both = np.unique(np.stack([who, leaf]), axis=1)
        return both[0], both[1]

    def covering(self, south: float, west: float, north: float, east: float) -> list[int]:
        """Leaves that a box (no wider than the world, not across the date line) touches."""
        out = []
        stack = [(0, -180.0, -90.0, 360.0, 180.0)]
        while stack:
            node, x, y, w, h = stack.pop()
            if x > east or x + w < west or y > north or y + h < south:
                continue
            at = int(self.child[node])
            if at < 0:
                out.append(-at - 10)
                continue
            stack += [(at + i, x + (i & 1) * w / 2, y + (i >> 1) * h / 2, w / 2, h / 2) for i in range(4)]
        return out + [NORTH] * int(north > CAP_LAT) + [SOUTH] * int(south < -CAP_LAT)


def _blocks(owners: list[str | None], weight: float, per_leaf: int) -> tuple[int, int, str | None]:
    """(heavy blocks, other blocks, heavy owner) of a crowded leaf; an owner is heavy with at least half of the sample."""
    name, most = Counter(owners).most_common(1)[0]
    each = max(1, per_leaf // 2)
    if most * 2 < len(owners):
        return 0, math.ceil(len(owners) * weight / each), None
    return math.ceil(most * weight / each), max(1, math.ceil((len(owners) - most) * weight / each)), name


def plan_quadtree(sample: list[tuple[float, float, str | None]], total: int, per_leaf: int, reach_deg: float) -> Quadtree:
    """Split where the sample stands for more than ``per_leaf`` points, never below twice the reach at the leaf's latitude."""
    weight = total / max(1, len(sample))
    lat = np.array([s[0] for s in sample], float)
    lon = np.array([s[1] for s in sample], float)
    owners = [s[2] for s in sample]
    child, leaves, spread, depth = [0], 0, {}, 0
    caps = np.abs(lat) > CAP_LAT
    for cap, mask in ((NORTH, caps & (lat > 0)), (SOUTH, caps & (lat < 0))):
        if mask.sum() * weight > per_leaf:
            spread[cap] = _blocks([owners[i] for i in np.flatnonzero(mask)], weight, per_leaf)
    todo = [(0, 0, np.flatnonzero(~caps), -90.0)]
    x = np.mod((lon + 180.0) / 360.0, 1.0)
    y = np.clip((lat + 90.0) / 180.0, 0.0, np.nextafter(1.0, 0.0))
    while todo:
        node, k, members, south = todo.pop()
        half = 180.0 / 2 ** (k + 1)  # height of the node's quarters, which are twice as wide
        farthest = min(max(abs(south), abs(south + 2 * half)), CAP_LAT) + 2 * reach_deg
        narrow = half < 2 * reach_deg or 2 * half * math.cos(math.radians(farthest)) < 2 * reach_deg
        if len(members) * weight <= per_leaf or narrow or k >= 40:
            child[node] = -(leaves + 10)
            if len(members) * weight > per_leaf:
                spread[leaves] = _blocks([owners[i] for i in members], weight, per_leaf)
            leaves += 1
            continue
        depth = max(depth, k + 1)
        at = len(child)
        child[node] = at
        child += [0] * 4
        bit = (np.floor(x[members] * 2.0 ** (k + 1)).astype(np.int64) & 1) + 2 * (np.floor(y[members] * 2.0 ** (k + 1)).astype(np.int64) & 1)
        todo += [(at + i, k + 1, members[bit == i], south + (i >> 1) * half) for i in range(4)]
    return Quadtree(np.array(child, np.int64), depth, leaves, spread)


def within_range(lat, lon):
    """Condition: both given and within range."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def valid_coordinates(lat, lon):
    """Condition: both given, within range, and not exactly (0, 0)."""
    return within_range(lat, lon) & ~((lat == 0) & (lon == 0))


def sampled_quadtree(points: DataFrame, rows: int, reach_deg: float, per_leaf: int | None, sample_rows: int) -> Quadtree:
    """``points`` has lat, lon, owner. The sample is bounded by about ``sample_rows``, whatever the table's size."""
    fraction = min(1.0, sample_rows / max(1, rows))
    sample = [tuple(r) for r in points.select("lat", "lon", "owner").sample(fraction=fraction, seed=7).limit(2 * sample_rows).collect()]
    total = int(len(sample) / fraction)
    return plan_quadtree(sample, total, per_leaf or min(50_000, max(500, total // 64)), reach_deg)


# ---------------------------------------------------------------- near


def haversine_m(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _unit(lat, lon):
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


def near_in_leaf(ids, lat, lon, owner, home, side, leaf: int, within_m: float, large: int = 256):
    """Pairs (smaller id, larger id) of different owners within the distance, in the home leaf of the smaller id.

    ``home`` is each point's home leaf. ``side`` (0 or 1) tells the two blocks of
    a crowded leaf apart: then only pairs of one point of each are made.
    """
    xyz = _unit(lat, lon)
    pad = 2 * math.sin(min(math.pi, within_m / EARTH_M) / 2) * (1 + 1e-9) + 1e-12
    names, owner_no = np.unique(owner.astype(str), return_inverse=True)
    groups, whose, sides = [], [], []
    for block in (None,) if side is None else (0, 1):
        here = np.arange(len(ids)) if block is None else np.flatnonzero(side == block)
        counts = np.bincount(owner_no[here], minlength=len(names))
        found = [(k, here[owner_no[here] == k]) for k in np.flatnonzero(counts > large)] + [(-1, here[counts[owner_no[here]] <= large])]
        for k, members in found:
            if len(members):
                groups.append(members)
                whose.append(k)
                sides.append(block)
    trees = [PackedTree(xyz[g] - pad / 2, xyz[g] + pad / 2) for g in groups]
    out = []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            if (sides[i] == sides[j]) if side is not None else False:
                continue
            if whose[i] == whose[j] >= 0:
                continue  # one large owner's own points
            for a, b in tree_join(trees[i], trees[j]):
                a, b = groups[i][a], groups[j][b]
                keep = (owner_no[a] != owner_no[b]) & (ids[a] != ids[b])
                if i == j:
                    keep &= ids[a] < ids[b]
                a, b = a[keep], b[keep]
                swap = ids[a] > ids[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                keep = home[a] == leaf
                a, b = a[keep], b[keep]
                keep = haversine_m(lat[a], lon[a], lat[b], lon[b]) <= within_m
                out.append(np.stack([ids[a[keep]], ids[b[keep]]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


#: Blocks of one leaf are numbered below this.
_MOST_BLOCKS = 1 << 20


def block_tasks(ids: np.ndarray, is_heavy: np.ndarray, heavy_blocks: int, other_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, task, side) of each task that a crowded leaf's rows take part in: all pairs of blocks but those of the heavy owner alone."""
    spot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    block = np.where(is_heavy, other_blocks + spot % max(1, heavy_blocks), spot % other_blocks)
    who, task, side = [], [], []
    for other in range(other_blocks + heavy_blocks):
        rows = np.flatnonzero(~is_heavy | (other < other_blocks))
        low, high = np.minimum(block[rows], other), np.maximum(block[rows], other)
        who.append(rows)
        task.append(low * _MOST_BLOCKS + high)
        side.append((block[rows] == high).astype(np.int64))
    return np.concatenate(who), np.concatenate(task), np.concatenate(side)


def near_pairs(
    points: DataFrame, within_m: float, rows: int | None = None, per_leaf: int | None = None, sample_rows: int = 20_000
) -> DataFrame:
    """(a_id, b_id), a_id < b_id: points of different owners at most ``within_m`` apart on the sphere.

    ``points`` has id, lat, lon, owner, one row per id. Rows with a null id or
    owner, with missing, non-finite or out-of-range coordinates or exactly (0, 0)
    are no location and pair with nothing. Distances equal to the limit count.
    Points at the poles and across the date line meet like any others. An empty
    table gives no rows; other columns are ignored. A task holds two blocks of a
    leaf at most; a row is copied once for each block it has to meet.
    """
    reach = math.degrees(within_m / EARTH_M) * (1 + 1e-9)
    good = points.select(
        F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.col("owner").cast("string").alias("owner"),
    ).where(F.col("id").isNotNull() & F.col("owner").isNotNull() & valid_coordinates(F.col("lat"), F.col("lon")))
    tree = sampled_quadtree(good, rows if rows is not None else points.count(), reach, per_leaf, sample_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            if not len(lat):
                continue
            home = tree.leaf_of(lat, lon)
            who, leaf = tree.touched(lat, lon, reach)
            task, side = np.full(len(who), -1, np.int64), np.zeros(len(who), np.int64)
            hot = np.isin(leaf, list(tree.spread))
            if hot.any():
                ids, owners = np.asarray(batch.column(0)), np.asarray(batch.column(3).to_pylist(), dtype=object)
                pieces = [(who[~hot], leaf[~hot], task[~hot], side[~hot])]
                for number in np.unique(leaf[hot]).tolist():
                    heavy_blocks, other_blocks, heavy = tree.spread[number]
                    mine = who[leaf == number]
                    is_heavy = owners[mine] == heavy if heavy is not None else np.zeros(len(mine), bool)
                    rows_in, tasks, sides = block_tasks(ids[mine], is_heavy, heavy_blocks, other_blocks)
                    pieces.append((mine[rows_in], np.full(len(rows_in), number), tasks, sides))
                who, leaf, task, side = (np.concatenate(x) for x in zip(*pieces, strict=True))
            for at in range(0, len(who), 50_000):  # copies leave in pieces of bounded size
                part = slice(at, at + 50_000)
                took = batch.take(pa.array(who[part]))
                yield pa.RecordBatch.from_arrays(
                    [*took.columns, pa.array(home[who[part]]), pa.array(leaf[part]), pa.array(task[part]), pa.array(side[part])],
                    names=["id", "lat", "lon", "owner", "home", "leaf", "task", "side"],
                )

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        task = int(key[1])
        # a block with itself is joined like a leaf
        side = rows["side"].to_numpy() if task >= 0 and task // _MOST_BLOCKS != task % _MOST_BLOCKS else None
        found = near_in_leaf(
            rows["id"].to_numpy(), rows["lat"].to_numpy(), rows["lon"].to_numpy(), rows["owner"].to_numpy(), rows["home"].to_numpy(), side, int(key[0]), within_m
        )
        return pd.DataFrame({"a_id": found[0], "b_id": found[1]})

    routed = good.mapInArrow(route, "id long, lat double, lon double, owner string, home long, leaf long, task long, side long")
    return routed.groupBy("leaf", "task").applyInPandas(join, "a_id long, b_id long")


def near_links(points: DataFrame, within_m: float, per_leaf: int | None = None) -> DataFrame:
    """(id, class_id, n_links): each located point with its class and its number of partners in near_pairs.

    A class is what one owner has at exactly one place; its id is the smallest of
    its points'. Only classes are paired, so a million pictures of two cameras
    from one spot cost one pair. Input and nulls as for near_pairs.
    """
    good = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("owner").cast("string").alias("owner"))
    good = materialise(good.where(F.col("id").isNotNull() & F.col("owner").isNotNull() & valid_coordinates(F.col("lat"), F.col("lon"))), "located")
    place = ["lat", "lon", "owner"]
    classes = materialise(good.groupBy(*place).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_points")), "classes")
    pairs = near_pairs(classes.select(F.col("class_id").alias("id"), *place), within_m, per_leaf=per_leaf)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a_id").alias("class_id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("class_id"), F.col("a_id").alias("other")))).alias("p")).select("p.*")
    sizes = classes.select(F.col("class_id").alias("other"), F.col("n_points").alias("n"))
    links = both.join(sizes, "other").groupBy("class_id").agg(F.sum("n").alias("n_links"))
    known = classes.join(links, "class_id", "left").select(*place, "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_points")
    return skewed_lookup(good, known, place, "n_points").select("id", "class_id", "n_links")


# ---------------------------------------------------------------- inside


def parse_wkt(text: str) -> list[list[np.ndarray]]:
    """Polygons of a POLYGON or MULTIPOLYGON, each a list of rings (outer first); [] for anything else."""
    body = (text or "").strip()
    kind = body[: body.find("(")].strip().upper() if "(" in body else ""
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        return []
    polygons: list[list[np.ndarray]] = []
    rings: list[np.ndarray] = []
    level, start, base = 0, 0, 1 if kind == "POLYGON" else 2
    try:
        for i, ch in enumerate(body):
            if ch == "(":
                level += 1
                start = i + 1
                if level == base:
                    rings = []
            elif ch == ")":
                if level == base + 1:
                    rings.append(np.array([[float(v) for v in p.split()[:2]] for p in body[start:i].split(",")]))
                elif level == base and rings:
                    polygons.append(rings)
                level -= 1
    except (ValueError, IndexError):
        return []
    return polygons


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule over straight edges."""
    inside = np.zeros(len(x), bool)
    ax, ay = ring[:, 0], ring[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    for x1, y1, x2, y2 in zip(ax, ay, bx, by, strict=True):
        if y1 == y2:
            continue
        crosses = (y1 > y) != (y2 > y)
        inside ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def in_area(x: np.ndarray, y: np.ndarray, polygons: list[list[np.ndarray]]) -> np.ndarray:
    hit = np.zeros(len(x), bool)
    for rings in polygons:
        one = in_ring(x, y, rings[0])
        for hole in rings[1:]:
            one &= ~in_ring(x, y, hole)
        hit |= one
    return hit


def inside_areas(points: DataFrame, areas: DataFrame, rows: int | None = None, per_leaf: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """(point_id, area_id) of every area that contains the point; a hole is outside, nested areas count each.

    ``points`` has id, lat, lon; ``areas`` has area_id, wkt (x = longitude). Areas
    go to every leaf their bounding box touches, points to their home leaf alone,
    so no pair comes twice. Points without coordinates in range and areas with a null
    id or a shape that cannot be read match nothing; a repeated point or area row
    gives repeated pairs. A point exactly on an edge follows the even-odd rule.
    Empty tables give no rows.
    """
    good = points.select(
        F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.lit("-").alias("owner")
    ).where(F.col("id").isNotNull() & within_range(F.col("lat"), F.col("lon")))
    tree = sampled_quadtree(good, rows if rows is not None else points.count(), 1e-6, per_leaf, sample_rows)

    def parts_of(leaf: int) -> int:
        heavy, other, _ = tree.spread.get(leaf, (0, 1, None))
        return heavy + other

    def route_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            leaf = tree.leaf_of(lat, lon) if len(lat) else np.zeros(0, np.int64)
            parts = np.array([parts_of(int(x)) for x in leaf], np.int64)
            task = np.arange(len(leaf)) % parts if len(leaf) else leaf
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf), pa.array(task)], names=["id", "lat", "lon", "leaf", "task"])

    def route_areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for area, wkt in zip(batch["area_id"], batch["wkt"], strict=True):
                polygons = parse_wkt(wkt)
                if polygons:
                    xy = np.concatenate([p[0] for p in polygons])
                    (west, south), (east, north) = xy.min(axis=0), xy.max(axis=0)
                    got += [(area, wkt, leaf, t) for leaf in tree.covering(south, west, north, east) for t in range(parts_of(leaf))]
            yield pd.DataFrame(got, columns=["area_id", "wkt", "leaf", "task"])

    def join(here: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(shapes):
            return pd.DataFrame({"point_id": np.zeros(0, np.int64), "area_id": np.zeros(0, np.int64)})
        polygons = [parse_wkt(w) for w in shapes["wkt"]]
        xy = [np.concatenate([p[0] for p in ps]) for ps in polygons]
        boxes = PackedTree(np.array([v.min(axis=0) for v in xy]), np.array([v.max(axis=0) for v in xy]))
        at = here[["lon", "lat"]].to_numpy()
        hits: dict[int, list[np.ndarray]] = {}
        for p, s in tree_join(PackedTree(at, at), boxes):
            order = np.argsort(s, kind="stable")
            p, s = p[order], s[order]
            cut = np.flatnonzero(np.diff(s)) + 1
            for part_p, part_s in zip(np.split(p, cut), np.split(s, cut), strict=True):
                hits.setdefault(int(part_s[0]), []).append(part_p)
        ids, area_ids, out_p, out_a = here["id"].to_numpy(), shapes["area_id"].to_numpy(), [], []
        for s, parts in hits.items():
            p = np.concatenate(parts)
            p = p[in_area(at[p, 0], at[p, 1], polygons[s])]
            out_p.append(ids[p])
            out_a.append(np.full(len(p), area_ids[s]))
        return pd.DataFrame({"point_id": np.concatenate(out_p) if out_p else [], "area_id": np.concatenate(out_a) if out_a else []}, dtype="int64")

    left = good.mapInArrow(route_points, "id long, lat double, lon double, leaf long, task long")
    right = areas.select(F.col("area_id").cast("long").alias("area_id"), F.col("wkt").cast("string").alias("wkt")).where("area_id is not null and wkt is not null")
    right = right.mapInPandas(route_areas, "area_id long, wkt string, leaf long, task long")
    return left.groupBy("leaf", "task").cogroup(right.groupBy("leaf", "task")).applyInPandas(join, "point_id long, area_id long")
