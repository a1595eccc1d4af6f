"""Near-duplicate vectors by dual traversal of cover trees.

Vectors with the same label are compared by cosine in double precision; on unit vectors the
threshold is a distance. Equal vectors form one class, which stands as one point with a count. The
points of a label are dealt into blocks: each goes to the nearest of up to `CENTERS` pivots (a
bounded sample per label), and pivots with many points are split by hash, so a block holds about
`BLOCK` points whatever the label holds. In a block a cover tree nests levels of halving radii: a
node's centre covers its children's centres, and its true covering radius bounds all its points.

Pairs of blocks whose balls come closer than the threshold are traversed together: a pair of nodes
further apart than their radii and the threshold allow is dropped; a pair that lies within the
threshold as a whole is taken without opening it; others are opened, the larger node first, down
to points. A task returns a row per point of its blocks at most: how many vectors it found linked,
and the local group they form. Groups are joined by connected components.

Null labels and vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths are never compared. Null ids are left out of links. Repeated
rows count as vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import save
from scanloom.llm.graph import components

COSINE = 0.98
CENTERS, BLOCK = 16, 1024
#: Rounding that bounds allow for; final decisions compare the cosine itself.
SLACK = 1e-7
#: Points of a node that is not split further, and trees that a task keeps for the next pairs of its blocks.
LEAF, KEPT_TREES = 32, 16


def reach(cosine: float) -> float:
    """Distance of unit vectors at a cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


@dataclass
class Tree:
    """Nodes by number: the root is 0. Points are reordered so that every node's are a run of them."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray  # row of points
    radius: np.ndarray
    first: np.ndarray  # run of points
    last: np.ndarray
    kids: list[np.ndarray]


def build(points: np.ndarray) -> Tree:
    """Cover tree of unit vectors: each level's radius is half of the one above."""
    center, radius, spans, kids, order = [], [], [], [], []

    def add(own: np.ndarray, head: int, scale: float) -> int:
        """A node over the rows `own`, all within `scale` of row `head`."""
        node = len(center)
        away = np.sqrt(np.maximum(0, 2 - 2 * points[own] @ points[head])) if len(own) > 1 else np.zeros(1)
        center.append(head)
        radius.append(float(away.max()))
        spans.append([len(order), 0])
        kids.append([])
        if len(own) <= LEAF or radius[node] < 1e-9:
            order.extend(own.tolist())
        else:
            step = scale / 2
            while step >= radius[node]:
                step /= 2
            # Greedy cover by balls of half the radius: the centre's own first, then of the farthest point left.
            best, owner, heads = away.copy(), np.zeros(len(own), np.int64), [head]
            while best.max() > step:
                far = int(best.argmax())
                new = np.sqrt(np.maximum(0, 2 - 2 * points[own] @ points[own[far]]))
                new[far] = 0.0
                closer = new < best
                owner[closer], best[closer] = len(heads), new[closer]
                heads.append(int(own[far]))
            for k, h in enumerate(heads):
                part = own[owner == k]
                if len(part):
                    kids[node].append(add(part, h, step))
        spans[node][1] = len(order)
        return node

    if len(points):
        add(np.arange(len(points)), 0, 2.0)
    order_ = np.array(order, np.int64)
    place = np.empty(len(points), np.int64)
    place[order_] = np.arange(len(points))
    runs = np.array(spans, np.int64).reshape(-1, 2)
    return Tree(points[order_], order_, place[np.array(center, np.int64)], np.array(radius), runs[:, 0], runs[:, 1],
                [np.array(k, np.int64) for k in kids])


class Groups:
    """Union of local points."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def dual(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float, same: bool
         ) -> tuple[np.ndarray, np.ndarray, Groups]:
    """(linked weight per point of a, of b, groups of a's points followed by b's), in the trees' order.

    With `same` both are one tree: a pair of nodes is visited once, and a point is no link of its own.
    """
    eps, n = reach(cosine), len(a.points)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.points), np.int64)
    groups = Groups(n + (0 if same else len(b.points)))
    shift = 0 if same else n
    stack = [(0, np.zeros(1, np.int64))] if n and len(b.points) else []

    def whole(x: int, y: int) -> None:
        sa, sb = slice(a.first[x], a.last[x]), slice(b.first[y], b.last[y])
        links_a[sa] += weight_b[sb].sum()
        if same and x == y:
            links_a[sa] -= weight_a[sa]  # a class's own members are counted by the caller
        else:
            links_b[sb] += weight_a[sa].sum()
        for i in range(a.first[x], a.last[x]):
            groups.join(int(a.first[x]), i)
        for j in range(b.first[y], b.last[y]):
            groups.join(int(a.first[x]), shift + j)

    def points(x: int, y: int) -> None:
        ia, jb = np.arange(a.first[x], a.last[x]), np.arange(b.first[y], b.last[y])
        hit = a.points[ia] @ b.points[jb].T >= cosine
        if same:
            hit &= ia[:, None] < jb[None, :] if x == y else True
        links_a[ia] += hit @ weight_b[jb]
        links_b[jb] += weight_a[ia] @ hit
        if hit.all():  # all of one group: a chain says as much as every pair
            for k in (*ia.tolist(), *(shift + jb).tolist()):
                groups.join(int(ia[0]), k)
            return
        for i, j in zip(*np.nonzero(hit), strict=True):
            groups.join(int(ia[i]), shift + int(jb[j]))

    while stack:
        x, others = stack.pop()
        away = np.sqrt(np.maximum(0, 2 - 2 * b.points[b.center[others]] @ a.points[a.center[x]]))
        near = others[away <= a.radius[x] + b.radius[others] + eps + SLACK]
        inside = away + a.radius[x] + b.radius[others] <= eps - SLACK
        open_b = []
        for y, take in zip(near.tolist(), inside[away <= a.radius[x] + b.radius[others] + eps + SLACK].tolist(), strict=True):
            if take or same and x == y and 2 * a.radius[x] <= eps - SLACK:
                whole(x, y)
            elif not len(a.kids[x]) and not len(b.kids[y]):
                points(x, y)
            elif same and x == y:
                own = a.kids[x]
                stack.extend((int(c), own[k:]) for k, c in enumerate(own))
            elif len(a.kids[x]) and (a.radius[x] >= b.radius[y] or not len(b.kids[y])):
                open_b.append(y)
            else:
                stack.append((x, b.kids[y]))
        if open_b:
            both = np.array(open_b, np.int64)
            stack.extend((int(c), both) for c in a.kids[x])
    if same:
        links_a += links_b
    return links_a, links_b, groups


# --- on tables -------------------------------------------------------------------------------

def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, unit) of the vectors that can link: unit vectors in double precision, equal ones bit for bit equal."""
    double = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), double.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    top = F.array_max(F.transform("v", F.abs))  # scaled first, so that squares neither overflow nor vanish
    rows = rows.withColumn("top", top).filter("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64)


def assigned(points: DataFrame, pivots: DataFrame) -> DataFrame:
    """Points with the number of the nearest pivot of their label and length."""
    joined = points.join(pivots, ["label", "width"]).select("class_id", "label", "width", "n", "unit", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int32)
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                labels = part.column(1).to_pylist()
                widths = part.column(2).to_pylist()
                units = part.column(4).to_pylist()
                for group in set(zip(labels, widths, strict=True)):
                    own = [i for i, g in enumerate(zip(labels, widths, strict=True)) if g == group]
                    heads = _matrix(part.column(5)[own[0]].as_py())
                    near[[k + i for i in own]] = (_matrix([units[i] for i in own]) @ heads.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near)], ["class_id", "label", "width", "n", "unit", "pivot"])

    return joined.mapInArrow(run, "class_id long, label string, width int, n long, unit array<double>, pivot int")


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = save(usable(vectors, key, vector, label).withColumn("width", F.size("unit"))
                .withColumn("hash", F.xxhash64("unit")), "units", "none")
    # Equal vectors: the class is named by its least id; the vector itself is part of the key.
    points = save(rows.groupBy("label", "width", "hash", "unit").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")), "points", "none")
    # Up to CENTERS pivots per label: the least hash in each of so many hash classes.
    some = points.groupBy("label", "width", F.pmod("hash", F.lit(CENTERS)).alias("c")).agg(F.min_by("unit", F.xxhash64("hash")).alias("unit"))
    pivots = some.groupBy("label", "width").agg(F.collect_list("unit").alias("pivots"))
    placed = save(assigned(points, pivots), "placed", "none")
    sizes = placed.groupBy("label", "width", "pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("unit", F.lit(7)), F.col("parts")).cast("int")
    blocked = placed.join(sizes, ["label", "width", "pivot"]).withColumn("part", part)
    blocks = save(blocked.groupBy("label", "width", "pivot", "part").agg(F.collect_list(F.struct("class_id", "n", "unit")).alias("own"))
                  .withColumn("block", F.xxhash64("label", "width", "pivot", "part")), "blocks", "none")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                units = _matrix([s["unit"] for s in batch.column(3)[k].as_py()])
                mid = units.mean(0)
                size = float(np.linalg.norm(mid))
                mid = mid / size if size > 1e-9 else units[0]
                far = float(np.sqrt(np.maximum(0, 2 - 2 * units @ mid)).max())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1),
                                                  pa.array([mid.tolist()], pa.list_(pa.float64())), pa.array([far])],
                                                 ["block", "label", "width", "mid", "radius"])

    balls = save(blocks.select("block", "label", "width", "own").mapInArrow(
        ball, "block long, label string, width int, mid array<double>, radius double"), "balls")
    other = balls.select(F.col("block").alias("other"), "label", "width", F.col("mid").alias("mid2"), F.col("radius").alias("radius2"))
    dot = F.aggregate(F.zip_with("mid", "mid2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    pairs = (balls.join(other, ["label", "width"]).filter("block <= other")
             .filter(apart <= F.col("radius") + F.col("radius2") + reach(cosine) + SLACK).select("block", "other"))
    both = (pairs.join(blocks.select("block", F.col("own").alias("x")), "block")
            .join(blocks.select(F.col("block").alias("other"), F.col("own").alias("y")), "other").select("block", "other", "x", "y"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: OrderedDict[int, tuple[Tree, np.ndarray, list[int]]] = OrderedDict()

        def tree_of(block: int, own: pa.Scalar) -> tuple[Tree, np.ndarray, list[int]]:
            """Tree, counts and ids of a block in the tree's order; those used last are kept."""
            if block not in trees:
                points = own.values
                units = points.field("unit")
                tree = build(units.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1))
                counts, ids = (points.field(f).to_numpy(zero_copy_only=False)[tree.order] for f in ("n", "class_id"))
                trees[block] = tree, counts, ids.tolist()
                if len(trees) > KEPT_TREES:
                    trees.popitem(last=False)
            trees.move_to_end(block)
            return trees[block]

        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                same = left == right
                a, wa, ids_a = tree_of(left, batch.column(2)[k])
                b, wb, ids_b = (a, wa, ids_a) if same else tree_of(right, batch.column(3)[k])
                la, lb, groups = dual(a, b, wa, wb, cosine, same)
                ids = ids_a + ([] if same else ids_b)
                links = la.tolist() + ([] if same else lb.tolist())
                hit = [i for i, n in enumerate(links) if n]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in hit], pa.int64()), pa.array([links[i] for i in hit], pa.int64()),
                    pa.array([ids[groups.root(i)] for i in hit], pa.int64())], ["class_id", "links", "head"])

    found = save(both.mapInArrow(traverse, "class_id long, links long, head long"), "found")
    part = components(found.select(F.col("class_id").alias("a"), F.col("head").alias("b")))
    sums = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    classes = (points.select("class_id", "n", "label", "width", "hash", "unit").join(sums, "class_id", "left")
               .join(part, F.col("class_id") == F.col("node"), "left")
               .select("label", "width", "hash", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("component", "class_id").alias("component_id")))
    linked = rows.join(classes, ["label", "width", "hash", "unit"]).select("vec_id", "n_links", "component_id")
    # Rows that repeat an id are told apart by nothing but their vectors, so they meet by id alone.
    per_id = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = vectors.select(F.col(key).cast("long").alias("vec_id"))
    return (every.join(per_id, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
