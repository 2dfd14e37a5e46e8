"""Centroid clustering: Lloyd's rounds over kd-trees, exact in integers.

Vectors become integers once. Each task builds kd-trees of its own rows (up to
``TREE_ROWS`` each) whose nodes hold count, integer sum and bounding box; the trees are a
table in the shared folder. A round sends the centroids down every tree: centroids that
another one beats on a node's whole box are pruned there, a node with one centroid left is
taken whole by its sum, leaves are resolved vector by vector. A tie is never pruned, so the
smaller number gets it. What a round shuffles are sums by centroid and component.

Only centroids reach the driver. Components under 2^20 are worked out in doubles, which
hold their squared distances exactly, larger ones in Python's integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

#: Components, centroids, rounds, scale of components.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors a tree and a leaf at most (a leaf of equal vectors may be larger).
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Components from here on are summed and compared as Python's integers.
NARROW = float(1 << 20)
_MOST = (1 << 63) - 1
_TREE = "wide boolean, ids binary, none binary, points binary, nodes binary, boxes binary, sums binary"
_PART = "cluster int, dim int, limb int, value long"


# --------------------------------------------------------------------------------------
# one tree


def kd_tree(points: np.ndarray):
    """(order, nodes, lows, highs, sums): node rows are (from, to, left, right), left 0 for leaves.

    The box's widest side is cut at its median, down to ``LEAF_ROWS`` or equal vectors.
    """
    order = np.arange(len(points))
    nodes, lows, highs, sums = [[0, len(points), 0, 0]], [], [], []
    at = 0
    while at < len(nodes):
        low, high = nodes[at][:2]
        mine = points[order[low:high]]
        lows.append(mine.min(axis=0))
        highs.append(mine.max(axis=0))
        sums.append(mine.sum(axis=0))
        width = highs[-1] - lows[-1]
        side = int(np.argmax(width))
        if high - low > LEAF_ROWS and width[side] > 0:
            middle = (high - low) // 2
            order[low:high] = order[low:high][np.argsort(mine[:, side], kind="stable")]
            nodes[at][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[low, low + middle, 0, 0], [low + middle, high, 0, 0]]
        at += 1
    return order, np.array(nodes, np.int32), np.array(lows), np.array(highs), np.array(sums)


def undominated(centroids: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the centroids ``left`` those that no other one is strictly nearer than on the whole box."""
    there = centroids[left]
    best = there[np.argmin(((2 * there - (low + high)) ** 2).sum(axis=1))]
    corner = np.where(there > best, high, low)  # the box's corner farthest towards each centroid
    return left[((there - corner) ** 2).sum(axis=1) <= ((best - corner) ** 2).sum(axis=1)]


def assigned(tree, centroids: np.ndarray):
    """Yields (from, to, node, centroid) of nodes taken whole, (from, to, node, None) of leaves."""
    _, nodes, lows, highs, _ = tree
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, left = todo.pop()
        low, high, a, b = nodes[node]
        if len(left) > 1:
            left = undominated(centroids, left, lows[node], highs[node])
        if len(left) == 1:
            yield low, high, node, int(left[0])
        elif a:
            todo += [(a, left), (b, left)]
        else:
            yield low, high, node, None


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row a point."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


# --------------------------------------------------------------------------------------
# trees as a table


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 * x): doubles, or Python's integers where one of them is large."""
    found = np.floor(SCALE * values.astype(np.float64))
    if len(found) and np.abs(found).max() >= NARROW:
        return np.array([[int(v) for v in row] for row in found], object)
    return found


def _pack(points: np.ndarray, wide: bool) -> bytes:
    return points.astype(np.float64).tobytes() if wide else points.astype(np.int32).tobytes()


def _unpack(data: bytes, wide: bool, exact: bool, shape) -> np.ndarray:
    found = np.frombuffer(data, np.float64 if wide else np.int32).reshape(shape)
    if not exact:
        return found.astype(np.float64)
    whole = np.empty(found.size, object)
    whole[:] = [int(v) for v in found.ravel()]
    return whole.reshape(found.shape)


def _plant(batches):
    """Rows to trees; vectors with large components get trees of their own."""

    def tree(ids, none, found):
        wide = found.dtype == object
        order, nodes, lows, highs, sums = kd_tree(found)
        # sums of wide trees are exact only as integers, so they are left to the points
        row = [wide, ids[order].tobytes(), none[order].tobytes(), _pack(found[order], wide), nodes.tobytes(), _pack(np.stack([lows, highs]), wide), b"" if wide else sums.astype(np.int64).tobytes()]
        return pd.DataFrame([row], columns=["wide", "ids", "none", "points", "nodes", "boxes", "sums"])

    for batch in batches:
        for low in range(0, len(batch), TREE_ROWS):
            rows = batch.iloc[low : low + TREE_ROWS]
            values = np.stack(rows["embedding"].to_list()).astype(np.float64)
            none = rows["vec_id"].isna().to_numpy()
            ids = rows["vec_id"].fillna(0).astype(np.int64).to_numpy()
            big = np.abs(np.floor(SCALE * values)).max(axis=1) >= NARROW
            for mask in (~big, big):
                if mask.any():
                    yield tree(ids[mask], none[mask], integers(values[mask]))


def _read(row, exact: bool):
    """(points, tree) of a stored tree, in doubles or (``exact``) in Python's integers."""
    nodes = np.frombuffer(row.nodes, np.int32).reshape(-1, 4)
    boxes = _unpack(row.boxes, row.wide, exact, (2, len(nodes), DIMENSIONS))
    points = _unpack(row.points, row.wide, exact, (-1, DIMENSIONS))
    sums = None if row.wide else np.frombuffer(row.sums, np.int64).reshape(-1, DIMENSIONS)
    return points, (None, nodes, boxes[0], boxes[1], sums)


def _sums(centroids):
    """Partial sums of each task: by centroid the count (dim -1) and the components, in limbs of 32 bits."""
    large = any(abs(v) >= NARROW for c in centroids for v in c)

    def run(batches):
        counts, sums = [0] * len(centroids), [np.zeros(DIMENSIONS, object) for _ in centroids]
        for batch in batches:
            for row in batch.itertuples():
                points, tree = _read(row, row.wide or large)
                held = np.array(centroids, object if row.wide or large else np.float64)
                for low, high, node, one in assigned(tree, held):
                    if one is not None:
                        counts[one] += int(high - low)
                        sums[one] = sums[one] + (points[low:high].sum(axis=0) if tree[4] is None else tree[4][node].astype(object))
                        continue
                    mine = points[low:high]
                    took = distances(mine, held).argmin(axis=1)
                    for c in np.unique(took):
                        part = mine[took == c].sum(axis=0)
                        counts[c] += int((took == c).sum())
                        sums[c] = sums[c] + (part if part.dtype == object else part.astype(np.int64).astype(object))
        out = []
        for c, (n, total) in enumerate(zip(counts, sums)):
            if n:
                for dim, value in [(-1, n), *enumerate(map(int, total))]:
                    limb = 0
                    while limb == 0 or value not in (0, -1):
                        out.append((c, dim, limb, value & 0xFFFFFFFF))
                        value >>= 32
                        limb += 1
                    if value:
                        out.append((c, dim, limb, value))
        yield pd.DataFrame(out, columns=["cluster", "dim", "limb", "value"])

    return run


def _members(centroids):
    """(vec_id, cluster, distance) of every vector."""
    large = any(abs(v) >= NARROW for c in centroids for v in c)

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                exact = row.wide or large
                points, tree = _read(row, exact)
                held = np.array(centroids, object if exact else np.float64)
                cluster = np.zeros(len(points), np.int32)
                distance = np.zeros(len(points), object if exact else np.float64)
                for low, high, _, one in assigned(tree, held):
                    if one is not None:
                        cluster[low:high] = one
                        distance[low:high] = ((points[low:high] - held[one]) ** 2).sum(axis=1)
                    else:
                        far = distances(points[low:high], held)
                        cluster[low:high] = far.argmin(axis=1)
                        distance[low:high] = far.min(axis=1)
                ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
                ids[np.frombuffer(row.none, bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": np.array([min(int(d), _MOST) for d in distance], np.int64)})

    return run


# --------------------------------------------------------------------------------------
# rounds


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) of vectors with that many components, all finite."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).where((F.size("embedding") == dimensions) & finite)


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``1:<vec_id>`` (a null id: ``1:``), ties by components."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "embedding").orderBy("digest", "embedding").limit(k).collect()
    return [[int(v) for v in np.floor(SCALE * np.array(r["embedding"], np.float64))] for r in rows]


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; one without vectors stays."""
    rows = trees.mapInPandas(_sums(centroids), _PART).groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in rows:  # k * 65 sums in two limbs or a few more
        sums[r["cluster"], r["dim"]] = sums.get((r["cluster"], r["dim"]), 0) + (r["value"] << (32 * r["limb"]))
    return [[sums[c, d] // sums[c, -1] for d in range(len(was))] if (c, -1) in sums else was for c, was in enumerate(centroids)]


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    Vectors that are null, of another length or not finite have no row. Rows that repeat an id
    are vectors of their own, a null id is one like any other; with fewer than k vectors each
    is a centroid. Distances and sums past 64 bits stop at the largest long. Other columns are
    ignored; an empty table gives no rows.
    """
    kept = kept_vectors(vectors)
    centroids = first_centroids(kept, k)
    trees = stored(kept.mapInPandas(_plant, _TREE), "kd-trees")
    for _ in range(rounds if centroids else 0):
        centroids = moved(trees, centroids)
    found = stored(trees.mapInPandas(_members(centroids), "vec_id long, cluster int, distance long"), "kd-members")
    drop_stored(trees)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("mine")).collect()  # a row a centroid
    capped = lambda v: min(int(v), _MOST)
    whole = capped(sum(r["mine"] for r in sums))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = found.sparkSession.createDataFrame([(r["cluster"], capped(r["mine"]), whole, digest[r["cluster"]]) for r in sums], "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), F.col("cluster") == F.col("_c")).drop("_c")


def query(spark, sf_dir):
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.v, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - k.v[i]) * (v.v[i] - k.v[i])))::BIGINT AS d FROM vectors AS v, {0} AS k) GROUP BY vec_id, v"
    steps = [
        "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "k0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM vectors QUALIFY c < 16)",
    ]
    for n in range(ROUNDS):
        steps.append(f"a{n} AS ({near.format(f'k{n}')})")
        steps.append(f"m{n} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{n}, range(1, 65) AS r(i) GROUP BY c, i) GROUP BY c)")
        steps.append(f"k{n + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM k{n} AS k LEFT JOIN m{n} AS m USING (c))")
    last = near.format(f"k{ROUNDS}")
    return "WITH " + ", ".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps) + f", last AS MATERIALIZED ({last}) " + (
        "SELECT l.vec_id, l.c::INTEGER AS cluster, l.d AS distance, (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(l.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM last AS l JOIN k{ROUNDS} AS k ON k.c = l.c"
    )


SQL = _sql()
