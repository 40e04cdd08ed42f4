"""Centroid clustering by n-simplex projection: apex coordinates bound distances before exact ones are compared.

Some pivots span a simplex. The distances of any vector to the pivots make it the apex over
that simplex: coordinates in the space of the pivots and an altitude. Of two apexes, the
Euclidean distance is a lower bound of the distance of their vectors, and the distance with
one altitude turned round an upper bound. A vector's apex is computed once and stored; only
centroids whose lower bound lies within the best upper bound are compared in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.integers import GroupSums, matrix, moved, squares, whole_vectors
from paperloom.session import materialize

PIVOTS, FLATTEST, BLOCK, PAIRS = 16, 0.05, 4096, 1 << 15


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    apart = x - y
    return squares(apart)


class Simplex:
    """Pivots and the lower triangular coordinates of all but the first, which lies at the origin."""

    def __init__(self, pivots: np.ndarray, base: np.ndarray):
        self.pivots, self.base = pivots, base
        stretch = np.linalg.cond(base) if len(base) else 1.0
        # Altitudes are roots of differences, so rounding errors of their squares count with their root.
        self.slack = 8 * float(np.sqrt(np.finfo(float).eps * stretch))

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates over the base and, last, the altitude of each row of whole numbers."""
        far = np.column_stack([squared_distances(x, p) for p in self.pivots]).astype(float)
        if not len(self.base):
            return np.sqrt(far)
        right = (far[:, :1] - far[:, 1:] + squares(self.base)) / 2
        along = np.linalg.solve(self.base, right.T).T
        return np.column_stack((along, np.sqrt(np.maximum(far[:, 0] - squares(along), 0))))


def spanned(points: np.ndarray, pivots: int = PIVOTS) -> Simplex:
    """Up to ``pivots`` of the points, each the one of the greatest altitude over those before it.

    No pivot is taken whose altitude is under ``FLATTEST`` of the greatest distance, so the
    base never degenerates; points that are all equal leave a single pivot.
    """
    chosen, simplex = [0], Simplex(points[:1], np.zeros((0, 0)))
    while len(chosen) < min(pivots, len(points)):
        apexes = simplex.apexes(points)
        top = int(apexes[:, -1].argmax())
        reach = np.sqrt(np.column_stack([squared_distances(points, p) for p in simplex.pivots]).max())
        if apexes[top, -1] <= FLATTEST * reach:
            break
        base = np.zeros((len(chosen), len(chosen)))
        base[:-1, :-1] = simplex.base
        base[-1] = apexes[top]
        chosen.append(top)
        simplex = Simplex(points[chosen], base)
    return simplex


def assigned(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, over: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: smaller number), its squared distance, and how many were compared exactly."""
    level = np.zeros((len(x), len(centroids)))
    for j in range(over.shape[1] - 1):
        level += np.square(apexes[:, j, None] - over[None, :, j])
    least = np.sqrt(level + np.square(apexes[:, -1, None] - over[None, :, -1]))
    most = level + np.square(apexes[:, -1, None] + over[None, :, -1])
    rows, out = np.arange(len(x)), np.full(level.shape, np.iinfo(np.int64).max)
    likely = most.argmin(axis=1)
    out[rows, likely] = squared_distances(x, centroids[likely])
    size = np.sqrt(squares(apexes))[:, None] + np.sqrt(squares(over))
    open_ = least - slack * size <= np.sqrt(out[rows, likely].astype(float))[:, None]
    open_[rows, likely] = False
    r, c = np.nonzero(open_)
    for at in range(0, len(r), PAIRS):
        some = slice(at, at + PAIRS)
        out[r[some], c[some]] = squared_distances(x[r[some]], centroids[c[some]])
    nearest = out.argmin(axis=1)
    return nearest, out[rows, nearest], 1 + open_.sum(axis=1)


def _blocks(batch, at: int, width: int, pivots: int):
    whole, apexes = matrix(batch.column(at), width), matrix(batch.column(at + 1), pivots, "<f8")
    for k in range(0, len(whole), BLOCK):
        yield whole[k : k + BLOCK].astype(np.int64), apexes[k : k + BLOCK]


def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, pivots: int = PIVOTS,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, compared, cluster_inertia, inertia, centroid_sha256)`` of every vector kept.

    Components become floor(scale * x). Centroids start as the vectors of the smallest
    sha256 of ``seed:vec_id``; rounds assign every vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and replace a non-empty centroid by the
    floor of its vectors' mean; then vectors are assigned once more. ``compared`` says how
    many centroids a vector was compared with exactly in that last assignment.

    Null vectors, vectors of another length than ``width`` and those with a null, non-finite
    or out-of-range component (``whole_vectors``) are left out. A vector without an id is
    clustered but never starts a centroid; equal ids are ordered by their components' bytes.
    Repeated rows count as often as they occur. Fewer vectors than ``clusters`` make fewer
    centroids. Other columns are left out, so no name can clash. An empty table gives no rows.

    The whole numbers and apexes are stored once and scanned once a round. Each task hands on
    one sum a centroid, so a centroid with a third of all vectors is no group of its own;
    only centroids, as many as asked for, meet the driver.
    """
    spark = vectors.sparkSession
    kept = materialize(whole_vectors(vectors, embedding, width, scale, vec_id=F.col(f"`{vec_id}`").cast("long")), "whole-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id IS NOT NULL").orderBy(order, "vec_id", "ints").limit(clusters).select("ints").collect()
    shown = "vec_id long, cluster int, distance long, compared int"
    if not first:
        return spark.createDataFrame([], f"{shown}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.frombuffer(b"".join(bytes(r.ints) for r in first), "<i4").astype(np.int64).reshape(1, -1, width)
    simplex = spanned(centroids[0], pivots)
    corners = len(simplex.pivots)

    def lifted(batches):
        for batch in batches:
            whole, rows = matrix(batch.column(1), width), []
            for at in range(0, len(whole), BLOCK):
                rows += [row.tobytes() for row in simplex.apexes(whole[at : at + BLOCK].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=["vec_id", "ints", "apex"])

    table = materialize(kept.select("vec_id", "ints").mapInArrow(lifted, "vec_id long, ints binary, apex binary"), "apexes")
    for _ in range(rounds):

        def gathered(batches, centroids=centroids, over=simplex.apexes(centroids[0])):
            groups = GroupSums(*centroids.shape)
            for batch in batches:
                for x, apexes in _blocks(batch, 0, width, corners):
                    groups.add(0, assigned(x, apexes, centroids[0], over, simplex.slack)[0], x)
            yield groups.batch()

        centroids = moved(centroids, table.select("ints", "apex").mapInArrow(gathered, GroupSums.SCHEMA))
    final, over = centroids[0], simplex.apexes(centroids[0])

    def told(batches):
        for batch in batches:
            found = [assigned(x, apexes, final, over, simplex.slack) for x, apexes in _blocks(batch, 1, width, corners)]
            columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
            types = (pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["vec_id", "cluster", "distance", "compared"]
            )

    ends = materialize(table.select("vec_id", "ints", "apex").mapInArrow(told, shown), "clusters")
    sums = {r.cluster: r.inertia for r in ends.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [
        (number, sums.get(number, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for number, centroid in enumerate(final.tolist())
    ]
    # One row a centroid: the broadcast is as large as the centroids asked for.
    told_of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(told_of), "cluster").select(
        "vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256"
    )
