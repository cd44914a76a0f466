"""Near duplicates among embeddings by dual traversal of cover trees.

Vectors are scaled to length one; cosine >= c is a distance of at most sqrt(2 - 2c). Equal
vectors of a label become one *class* first. Classes are dealt to blocks of bounded size
around sampled centres of their label, and every pair of blocks whose covering radii allow
a near pair becomes one task. A task builds a cover tree of nested levels with halving radii
for either block and descends both at once, keeping only pairs of nodes whose distance is
within the sum of their covering radii and the limit. The pairs of classes that are left at
the bottom are exact; a task returns how many links each class has and a spanning forest,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, components, discard, run_starts, stage

COSINE = 0.98
BLOCK_ROWS = 2048
CENTRES = 4096  # sampled vectors over all labels, at most
LEAST_RADIUS = 1 / 16
SLACK = 1e-7  # bounds are widened by more than the rounding of distances


class CoverTree:
    """Nested levels of centres; level k covers all points within 2^(1-k)."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        self.levels: list[np.ndarray] = []  # centre of each node
        self.radius: list[np.ndarray] = []  # measured covering radius of each node
        self.children: list[list[np.ndarray]] = []  # nodes of the next level
        self.members: list[np.ndarray] = []  # points of each lowest node
        centres = np.zeros(min(n, 1), np.int64)
        reach = 1.0
        parts = [np.arange(n)] if n else []
        while True:
            self.levels.append(centres)
            self.radius.append(np.array([self._far(c, p) for c, p in zip(centres, parts, strict=True)]))
            if reach < LEAST_RADIUS or len(centres) == n:
                break
            below_centres: list[int] = []
            below_parts: list[np.ndarray] = []
            children = []
            for centre, part in zip(centres, parts, strict=True):
                first = len(below_centres)
                rest = part
                pick = int(centre)  # nested: a centre stays one on the next level
                while len(rest):
                    near = self._distance(pick, rest) <= reach
                    near[rest == pick] = True
                    below_centres.append(pick)
                    below_parts.append(rest[near])
                    rest = rest[~near]
                    if len(rest):
                        pick = int(rest[0])
                children.append(np.arange(first, len(below_centres)))
            self.children.append(children)
            centres, parts = np.array(below_centres, np.int64), below_parts
            reach /= 2
        self.members = parts

    def _distance(self, centre: int, part: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.points[part] @ self.points[centre]), 0))

    def _far(self, centre: int, part: np.ndarray) -> float:
        return float(self._distance(int(centre), part).max()) + SLACK


def near_pairs(a: CoverTree, b: CoverTree, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: candidate groups (points of a, points of b) that may be within limit."""
    if not len(a.points) or not len(b.points):
        return
    todo = [(0, 0, 0, 0)]
    while todo:
        la, na, lb, nb = todo.pop()
        end_a, end_b = la == len(a.levels) - 1, lb == len(b.levels) - 1
        if end_a and end_b:
            yield a.members[na], b.members[nb]
            continue
        ka = np.array([na]) if end_a else a.children[la][na]
        kb = np.array([nb]) if end_b else b.children[lb][nb]
        ma, mb = la + (not end_a), lb + (not end_b)
        inner = a.points[a.levels[ma][ka]] @ b.points[b.levels[mb][kb]].T
        reach = a.radius[ma][ka][:, None] + b.radius[mb][kb][None, :] + limit + SLACK
        # distance <= reach, compared as cosines; beyond 2 everything is in reach
        keep = (inner >= 1 - np.minimum(reach, 2) ** 2 / 2 - SLACK)
        last = ma == len(a.levels) - 1 and mb == len(b.levels) - 1
        rows, columns = np.nonzero(keep)
        if last:
            # Join what each node of a meets, so that leaves are compared in few products.
            cut = np.searchsorted(rows, np.arange(len(ka) + 1))
            for i in np.flatnonzero(np.diff(cut)):
                met = columns[cut[i] : cut[i + 1]]
                yield a.members[ka[i]], np.concatenate([b.members[kb[j]] for j in met])
            continue
        todo += [(ma, int(ka[i]), mb, int(kb[j])) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


LINKS = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def block_pair_task(cosine: float) -> Callable:
    limit = float(np.sqrt(2 - 2 * cosine))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        side = table.column("side").to_numpy()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        raw = np.frombuffer(binary_column(table.column("vector"))[0].tobytes(), np.float64)
        vectors = raw.reshape(len(cls), -1)
        order = np.argsort(cls, kind="stable")
        left = order[side[order] == 0]
        right = left if same else order[side[order] == 1]
        tree = CoverTree(vectors[left])
        other = tree if same else CoverTree(vectors[right])
        links = np.zeros(len(cls), np.int64)
        forest = Forest(len(cls))
        edges: list[tuple[int, int]] = []
        for x, y in near_pairs(tree, other, limit):
            inner = vectors[left[x]] @ vectors[right[y]].T
            i, j = np.nonzero(inner >= cosine)
            gi, gj = left[x[i]], right[y[j]]
            if same:
                keep = gi < gj  # each pair turns up in both orders; count it once
                gi, gj = gi[keep], gj[keep]
            np.add.at(links, gi, copies[gj])
            np.add.at(links, gj, copies[gi])
            edges += [(int(cls[p]), int(cls[q])) for p, q in zip(gi.tolist(), gj.tolist(), strict=True) if forest.link(p, q)]
        counted = np.flatnonzero(links)
        a = [cls[counted], np.array([e[0] for e in edges], np.int64)]
        b = [np.full(len(counted), -1, np.int64), np.array([e[1] for e in edges], np.int64)]
        n = [links[counted], np.zeros(len(edges), np.int64)]
        valid = [np.zeros(len(counted), bool), np.ones(len(edges), bool)]
        return pa.Table.from_arrays([
            pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=~np.concatenate(valid)), pa.array(np.concatenate(n)),
        ], schema=LINKS)

    return run


def unit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes; null where a vector cannot be compared."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            values = v.as_py()
            unit = None
            if values and None not in values:
                x = np.array(values, np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top  # keeps the squares in range
                    unit = (x / np.sqrt((x * x).sum())).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])


def place_task(centres_of: Callable[[], dict]) -> Callable:
    """Nearest sampled centre of the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {k: np.frombuffer(v, np.float64).reshape(n, -1) for k, (n, v) in centres_of().items()}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            cell = np.zeros(batch.num_rows, np.int32)
            data, offsets = binary_column(batch.column("vector"))
            for label in set(labels):
                known = centres.get((label, 0))
                rows = [i for i, x in enumerate(labels) if x == label]
                by_size: dict[int, list[int]] = {}
                for i in rows:
                    by_size.setdefault(int(offsets[i + 1] - offsets[i]), []).append(i)
                for size, members in by_size.items():
                    if known is None or known.shape[1] * 8 != size:
                        continue
                    x = np.stack([np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), np.float64) for i in members])
                    cell[members] = np.argmax(x @ known.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def radius_task(key: tuple, table: pa.Table) -> pa.Table:
    """Centre and covering radius of one block."""
    raw = np.frombuffer(binary_column(table.column("vector"))[0].tobytes(), np.float64)
    x = raw.reshape(table.num_rows, -1)
    middle = x.mean(axis=0)
    radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1).max())) + SLACK
    return pa.table({"block": pa.array([key[0].as_py()], pa.string()), "label": table.column("label").slice(0, 1),
                     "width": pa.array([x.shape[1]], pa.int32()), "middle": pa.array([middle.tolist()], pa.list_(pa.float64())),
                     "radius": pa.array([radius])})


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links between vectors of one label with at least the given cosine.

    Returns one row per vector: vec_id, n_links (other vectors linked directly), component_id
    (the smallest vec_id reachable), kept (vec_id = component_id). Vectors with a null label,
    and vectors that are null, empty, zero or hold a null or a non-finite component, link with
    nothing; so do vectors of different length. Repeated rows are copies and link with each
    other. Other columns are ignored; an empty table gives an empty result. Memory of a task
    is two blocks; the sampled centres (at most ``CENTRES``) steer only the dealing.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    units, units_path = stage(rows.mapInArrow(unit_task, "vec_id long, label string, vector binary"), "units")
    usable = units.where("label IS NOT NULL AND vector IS NOT NULL")
    # Equal vectors of a label are one class, named by its smallest vec_id.
    classes, classes_path = stage(usable.groupBy("label", "vector").agg(
        F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies")), "classes")
    of_label = classes.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_rows)
    large = of_label.agg(F.sum(F.least(F.lit(64), F.ceil(F.col("rows") / block_rows)))).first()[0] or 0
    share = min(1.0, CENTRES / max(large, 1))
    chance = F.least(F.lit(64), F.ceil(F.col("rows") / block_rows)) * share / F.col("rows")
    draw = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) / float(1 << 30)
    picked = classes.join(of_label, "label").where(draw < chance).select("label", "vector").limit(CENTRES).collect()
    centres: dict = {}
    for r in picked:
        n, v = centres.get((r["label"], 0), (0, b""))
        if not v or len(v) == n * len(r["vector"]):
            centres[(r["label"], 0)] = (n + 1, v + bytes(r["vector"]))
    shared = spark.sparkContext.broadcast(centres)
    placed = classes.mapInArrow(place_task(lambda: shared.value), "label string, vector binary, cls long, copies long, cell int")
    placed, placed_path = stage(placed.withColumn("width", F.length("vector")), "placed")
    cells = placed.groupBy("label", "width", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("splits"))
    key = ["label", "width", "cell"]
    block = F.concat_ws("|", F.xxhash64(*key), F.pmod(F.xxhash64("cls"), "splits"), "width", "label")
    placed = placed.join(F.broadcast(cells) if cells.count() <= 50_000 else cells, key).withColumn("block", block)
    blocks, blocks_path = stage(placed.groupBy("block").applyInArrow(
        radius_task, "block string, label string, width int, middle array<double>, radius double"), "blocks")
    one = blocks.select(F.col("block").alias("block_a"), "label", "width", F.col("middle").alias("ma"), F.col("radius").alias("ra"))
    two = blocks.select(F.col("block").alias("block_b"), "label", "width", F.col("middle").alias("mb"), F.col("radius").alias("rb"))
    apart = F.sqrt(F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    limit = float(np.sqrt(2 - 2 * cosine)) + SLACK
    pairs = one.join(two, ["label", "width"]).where("block_a <= block_b").where(apart <= F.col("ra") + F.col("rb") + limit)
    pairs = pairs.select("block_a", "block_b")
    sides = pairs.select("block_a", "block_b", F.col("block_a").alias("block"), F.lit(0).alias("side")).union(
        pairs.where("block_a < block_b").select("block_a", "block_b", F.col("block_b").alias("block"), F.lit(1).alias("side")))
    tasks = placed.select("block", "cls", "copies", "vector").join(sides, "block")
    found = tasks.groupBy("block_a", "block_b").applyInArrow(block_pair_task(cosine), "cls long, other long, links long")
    found, found_path = stage(found, "vector-links")
    counts = found.where("other IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("label", "vector", "cls", "copies").join(counts, "cls", "left").join(
        groups.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "cls").alias("component_id"))
    alone = F.col("component_id").isNull()
    out = units.join(of_class, ["label", "vector"], "left").select(
        "vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    out, _ = stage(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "near-vectors")
    discard(spark, units_path, classes_path, placed_path, blocks_path, found_path)
    return out
