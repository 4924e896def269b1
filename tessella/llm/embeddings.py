"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors link where their cosine is at least the threshold, that is where they are at most r = sqrt(2 - 2 threshold)
apart. Equal vectors are one class with a multiplicity, so a group of copies of any size costs one.

Upper levels: a cell of more than `size` classes is dealt to the nearest of up to FANOUT of its members, level by level,
until cells fit a chunk; a cell's covering radius is the largest distance found. Pairs of cells are traversed down the same
levels as a table of ids, centres and radii: a pair farther apart than both radii and r is dropped with all below it.
Lower levels: each chunk has a cover tree of nested levels with halving radii, down to leaves so small that their members
all link. Near chunks meet in tasks of two blocks of at most BLOCK chunks, so a tree is written once and travels once for
each block that is near its own. Two trees are traversed level by level: a pair of nodes farther apart than their covering
radii and r is dropped, a pair nearer than r less their radii links whole, the rest descends, and at the leaves the cosine
decides. A meeting yields numbers of links and one edge for each pair of leaves that link, never all pairs of members.

On vectors without structure (random directions in 64 dimensions, where all distances are alike and no bound can exclude
anything) every pair of chunks is near: the work is quadratic, in tasks of bounded memory.

Defined cases: a null or zero vector and one with null or non-finite components links with nothing; vectors of different
lengths don't link; a null id takes part in links but is no component's least id; a component of null ids has a null
component_id and its rows are kept; repeated rows link with one another; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, bounded_batches, components, drop_tables, materialise, table

THRESHOLD = 0.95
#: Classes of a chunk, and numbers that it holds at most: a chunk of long vectors has fewer of them.
CHUNK, CHUNK_NUMBERS = 4096, 1 << 19
#: Parts of a cell at most, levels of cells, and numbers of all centres that one pass over the vectors compares with.
FANOUT, LEVELS, PASS_NUMBERS = 64, 12, 1 << 21
#: Chunks of a block at most; there are about BLOCKS blocks where so few hold all chunks.
BLOCK, BLOCKS = 16, 4
#: Tasks that meet groups of chunks, at most: a task takes its groups one after the other.
MEETING_TASKS = 1000
#: Bytes of a table of vectors that the driver may hold to broadcast it; a larger one is joined by shuffle.
SENT_BYTES = 16 << 20
#: Node pairs whose children are more than LARGE_BLOCK pairs are multiplied as matrices, smaller ones gathered, BLOCK_PAIRS at once.
LARGE_BLOCK, BLOCK_PAIRS = 256, 20_000
#: Candidate centres compared with a node's members at once.
CANDIDATES = 64
#: Slack of bounds that are computed from rounded distances.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Tree:
    """Levels of nodes; a node has a centre (a point), a covering radius and a range of children, a leaf a range of points.

    Points are stored in leaf order. Node 0 of level 0 is the root; each level's radius halves, and a node's centre is
    also the centre of its first child.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, reach: float):
        points = unit(vectors.astype(np.float64))
        everything = np.arange(len(points))
        nodes, self.levels = [(everything, float((points @ points[0]).min()))], []
        radius = 2.0
        while True:
            leaf = radius <= reach / 2
            below, first = [], [0]
            for members, _ in nodes:
                if not leaf:
                    below += self.split(points, members, 1 - (radius / 2) ** 2 / 2)
                first.append(len(below))
            centre = np.array([m[0] for m, _ in nodes])
            cover = distance(np.array([far for _, far in nodes])) + SLACK
            cover[[len(m) == 1 for m, _ in nodes]] = 0
            self.levels.append((centre, cover, np.array(first)))
            if leaf:
                break
            nodes, radius = below, radius / 2
        order = np.concatenate([m for m, _ in nodes])
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        self.levels = [(where[c], r, f) for c, r, f in self.levels]
        size = np.array([len(m) for m, _ in nodes])
        c, r, _ = self.levels[-1]
        self.levels[-1] = (c, r, np.concatenate([[0], np.cumsum(size)]))
        self.ids, self.counts = ids[order], counts[order]
        self.hold(vectors[order])

    def hold(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.points = unit(vectors.astype(np.float64))
        self.single = self.points.astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("single", "points")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.hold(self.vectors)

    @staticmethod
    def split(points: np.ndarray, members: np.ndarray, least: float) -> list[tuple[np.ndarray, float]]:
        """A net of the members: each centre takes those within the radius that no earlier one took; and their least cosine."""
        if len(members) == 1:
            return [(members, 1.0)]
        found = []
        while len(members):
            cosine = points[members] @ points[members[:CANDIDATES]].T
            free = np.ones(len(members), bool)
            for k in range(cosine.shape[1]):
                if free[k]:
                    near = free & (cosine[:, k] >= least)
                    near[k] = True
                    found.append((members[near], float(cosine[near, k].min())))
                    free &= ~near
            members = members[free]
        return found


def near_nodes(a: Tree, b: Tree, level: int, na: np.ndarray, nb: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block of nodes that may be within their radii and r of each other; single precision, with slack.

    A block is tested against its widest pair of radii, so nodes with wide radii form blocks of their own.
    """
    (ca, ra, _), (cb, rb, _) = a.levels[level], b.levels[level]
    wide_a, wide_b = ra[na] > reach / 2, rb[nb] > reach / 2
    for p, q in ((na[~wide_a], nb[~wide_b]), (na[wide_a], nb), (na[~wide_a], nb[wide_b])):
        if len(p) and len(q):
            widest = min(2.0, ra[p].max() + rb[q].max() + reach)
            i, j = np.nonzero(a.single[ca[p]] @ b.single[cb[q]].T >= np.float32(1 - widest * widest / 2 - 1e-5))
            yield p[i], q[j]


def children(tree: Tree, level: int, to: int) -> np.ndarray:
    """Offsets of the nodes' descendants at a deeper level."""
    first = tree.levels[level][2]
    for k in range(level + 1, to):
        first = tree.levels[k][2][first]
    return first


def deeper(a: Tree, b: Tree, level: int) -> int:
    """The level to descend to: past those that hardly add nodes, as an explicit cover tree skips nodes of one child."""
    last, to = len(a.levels) - 1, level + 1
    size = lambda k: len(a.levels[k][0]) + len(b.levels[k][0])
    while to < last and size(to + 1) <= 1.5 * size(level + 1):
        to += 1
    return to


def expanded(fa: np.ndarray, fb: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the children of node pairs."""
    wa, wb = fa[i + 1] - fa[i], fb[j + 1] - fb[j]
    n = wa * wb
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(wb, n)
    return np.repeat(fa[i], n) + at // width, np.repeat(fb[j], n) + at % width


def meet(a: Tree, b: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of the points of a, of those of b (multiplicities of the others counted), and edges between ids."""
    reach = float(np.sqrt(2 - 2 * threshold))
    links_a, links_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    last, level = len(a.levels) - 1, 0
    i = j = np.zeros(1, np.int64)
    while True:
        (ca, ra, _), (cb, rb, _) = a.levels[level], b.levels[level]
        kept = []
        for k in range(0, len(i), BLOCK_PAIRS):
            x, y = i[k : k + BLOCK_PAIRS], j[k : k + BLOCK_PAIRS]
            cosine = np.einsum("nd,nd->n", a.points[ca[x]], b.points[cb[y]])
            d = distance(cosine)
            ok = d <= ra[x] + rb[y] + reach + SLACK
            if same:
                ok &= x <= y
            kept.append((x[ok], y[ok], d[ok], cosine[ok]))
        i, j, d, cosine = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (i, j, np.zeros(0), np.zeros(0))
        if not len(i):
            return links_a, links_b, []
        if level == last:
            break
        to = deeper(a, b, level)
        fa, fb = children(a, level, to), children(b, level, to)
        large = (fa[i + 1] - fa[i]) * (fb[j + 1] - fb[j]) > LARGE_BLOCK
        found = [expanded(fa, fb, i[~large], j[~large])]
        for x, y in zip(i[large], j[large], strict=True):
            found += near_nodes(a, b, to, np.arange(fa[x], fa[x + 1]), np.arange(fb[y], fb[y + 1]), reach)
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        level = to
    fa, fb = a.levels[-1][2], b.levels[-1][2]
    single = (fa[i + 1] - fa[i] == 1) & (fb[j + 1] - fb[j] == 1) & ~(same & (i == j))
    hit = single & (cosine >= threshold)
    x, y = fa[i[hit]], fb[j[hit]]
    np.add.at(links_a, x, b.counts[y])
    np.add.at(links_b, y, a.counts[x])
    edges = list(zip(a.ids[x].tolist(), b.ids[y].tolist(), strict=True))
    for x, y, far in zip(i[~single], j[~single], d[~single], strict=True):
        u, v = slice(fa[x], fa[x + 1]), slice(fb[y], fb[y + 1])
        if same and x == y:  # a leaf's members all link
            total = a.counts[u].sum()
            links_a[u] += total - a.counts[u]
            edges += [(int(a.ids[fa[x]]), int(k)) for k in a.ids[u][1:]]
            continue
        if far + a.levels[-1][1][x] + b.levels[-1][1][y] <= reach - SLACK:
            links_a[u] += b.counts[v].sum()
            links_b[v] += a.counts[u].sum()
        else:
            linked = a.points[u] @ b.points[v].T >= threshold
            if not linked.any():
                continue
            links_a[u] += linked @ b.counts[v]
            links_b[v] += linked.T @ a.counts[u]
        edges.append((int(a.ids[fa[x]]), int(b.ids[fb[y]])))
    return links_a, links_b, edges


def _stack(series: pd.Series) -> np.ndarray:
    """The vectors as rows, in single precision where that holds them exactly."""
    x = np.stack([np.asarray(v, np.float64) for v in series])
    return x.astype(np.float32) if (x.astype(np.float32) == x).all() else x


def apart(a: str, b: str) -> Column:
    """Distance of the directions of two columns of vectors."""

    @F.pandas_udf("double")
    def measured(v: pd.Series, w: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        x, y = unit(_stack(v).astype(np.float64)), unit(_stack(w).astype(np.float64))
        return pd.Series(distance(np.einsum("nd,nd->n", x, y)))

    return measured(a, b)


def _lookup(df: DataFrame, row_bytes: int) -> DataFrame:
    """df as a side to join with: broadcast if it is small in rows and bytes, else by shuffle, whatever its files' compressed size."""
    most = min(BROADCAST_ROWS, SENT_BYTES // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def _dealt(shared):
    """A function over batches of classes: rows of a split cell go to the nearest of its centres."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, far = batch["cell"].to_numpy(object).copy(), batch["far"].to_numpy().copy()
            for parent in set(cell) & set(shared.value):
                rows = np.flatnonzero(cell == parent)
                names, centres = shared.value[parent]
                cosine = unit(_stack(batch["vector"].iloc[rows]).astype(np.float64)) @ centres.T
                best = cosine.argmax(axis=1)
                cell[rows], far[rows] = names[best], distance(cosine[np.arange(len(rows)), best])
            yield batch.assign(cell=cell, far=far)

    return deal


def cells(classes: DataFrame, size: int, length: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """classes with `cell`, and the pairs (a, b) of cells, a <= b, that may hold links; a cell's name is its place in each level.

    Cells that are narrower than half of r, or that LEVELS levels haven't cut to `size`, stay as they are.
    """
    spark = classes.sparkSession
    kind = dict(classes.dtypes)["vector"]
    placed = classes.select("cid", "n", "vector", F.lit("").alias("cell"), F.lit(2.0).alias("far"))
    row_bytes = 8 * length + 100
    pairs = spark.createDataFrame([("", "")], "a string, b string")
    known = spark.createDataFrame([], f"cell string, vector {kind}")  # each cell's centre
    for _ in range(LEVELS):
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        big = sizes.where((F.col("n") > size) & (F.col("radius") > reach / 2)).select("cell", F.least(F.lit(FANOUT), 2 * F.ceil(F.col("n") / size)).alias("parts"))
        big = materialise(big, "cover-split")
        if big.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cid"), "cid"))  # the limit of FANOUT applies before the shuffle
        picked = placed.join(bounded(big), "cell").withColumn("k", place).where(F.col("k") <= FANOUT).where("k <= parts")
        picked = picked.select("cell", F.concat("cell", F.lpad((F.col("k") - 1).cast("string"), 2, "0")).alias("child"), "vector")
        per_pass = max(1, PASS_NUMBERS // (FANOUT * length))
        turn = big.select("cell", F.floor((F.row_number().over(Window.orderBy("cell")) - 1) / per_pass).alias("turn"))  # a row for each cell to split
        picked = materialise(picked.join(bounded(turn), "cell"), "cover-centres")
        dealt = placed
        for k in range(-(-big.count() // per_pass)):
            own = picked.where(F.col("turn") == k).orderBy("child").toPandas()  # at most PASS_NUMBERS numbers
            table_of = {c: (g["child"].to_numpy(object), unit(_stack(g["vector"]).astype(np.float64))) for c, g in own.groupby("cell")}
            dealt = dealt.mapInPandas(_dealt(spark.sparkContext.broadcast(table_of)), f"cid long, n long, vector {kind}, cell string, far double")
        before, placed = placed, materialise(dealt, "cover-cells")
        drop_tables(before)
        known = materialise(known.unionByName(picked.select(F.col("child").alias("cell"), "vector")), "cover-known")
        nodes = placed.groupBy("cell").agg(F.max("far").alias("radius")).join(_lookup(known, row_bytes), "cell")
        split = F.substring("cell", 1, F.length("cell") - 2)
        above = nodes.join(bounded(big.select(F.col("cell").alias("parent"))), split == F.col("parent"), "left").select("cell", F.coalesce("parent", "cell").alias("parent"), "vector", "radius")
        nodes = materialise(above, "cover-nodes")
        side = lambda s: nodes.select(F.col("parent").alias(s), F.col("cell").alias(f"{s}_cell"), F.col("vector").alias(f"{s}_vector"), F.col("radius").alias(f"{s}_radius"))
        both = pairs.join(_lookup(side("a"), row_bytes), "a").join(_lookup(side("b"), row_bytes), "b").where("a_cell <= b_cell")
        near = both.where(apart("a_vector", "b_vector") <= F.col("a_radius") + F.col("b_radius") + reach + SLACK)
        pairs = materialise(near.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")), "cover-pairs")
    return placed, pairs


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """classes(cid, n, vector), all of one length -> rows (cid, links, other): a number of links, or an edge to other."""
    length = classes.agg(F.max(F.size("vector"))).first()[0]
    size = max(1, min(CHUNK, CHUNK_NUMBERS // length))
    reach = float(np.sqrt(2 - 2 * threshold))
    placed, near = cells(classes, size, length, reach)
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    chunks = parts.select("cell", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    chunks = materialise(chunks.withColumn("chunk", F.row_number().over(Window.orderBy("cell", "part")) - 1), "cover-chunks")  # a row a chunk
    count = chunks.count()
    width = max(1, min(BLOCK, -(-count // BLOCKS)))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(frame["cid"].to_numpy(), frame["n"].to_numpy(), _stack(frame["vector"]), reach)
        return pd.DataFrame({"chunk": [int(frame["chunk"].iloc[0])], "tree": [pickle.dumps(tree, protocol=5)]})

    marked = placed.join(bounded(parts), "cell").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    dealt = marked.join(bounded(chunks.drop("parts")), ["cell", "part"]).select("chunk", "cid", "n", "vector")
    trees = materialise(dealt.groupBy("chunk").applyInPandas(build, "chunk int, tree binary"), "cover-trees")
    one = chunks.select("cell", "chunk")
    x, y = (one.select(F.col("cell").alias(c), F.col("chunk").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    met = near.join(bounded(x), "a").join(bounded(y), "b").where("a < b or x <= y").select("x", "y", F.floor(F.col("x") / width).cast("int").alias("bx"), F.floor(F.col("y") / width).cast("int").alias("by"))
    met = materialise(met, "cover-meetings")
    groups = met.select("bx", "by").distinct().withColumn("number", F.row_number().over(Window.orderBy("bx", "by")) - 1)  # a row for each two blocks
    groups = materialise(groups, "cover-groups")
    todo = met.join(_lookup(groups, 50), ["bx", "by"]).select("number", "x", "y")  # at most BLOCK squared rows a group
    sent = materialise(todo.select("number", F.explode(F.array("x", "y")).alias("chunk")).distinct(), "cover-sent")

    def finished(todo: list[tuple[int, int]], trees: dict[int, Tree]) -> Iterator[pd.DataFrame]:
        """The meetings of two blocks' near chunks."""
        totals = {k: np.zeros(len(t.ids), np.int64) for k, t in trees.items()}
        for a, b in sorted(todo):
            links_a, links_b, edges = meet(trees[a], trees[b], threshold, a == b)
            totals[a] += links_a
            totals[b] += links_b  # a node pair (i, j) with i < j of one tree stands for both directions
            if edges:
                yield pd.DataFrame({"cid": [e[0] for e in edges], "links": 0, "other": pd.array([e[1] for e in edges], "Int64")})
        for k, n in totals.items():
            if n.any():
                yield pd.DataFrame({"cid": trees[k].ids[n > 0], "links": n[n > 0], "other": pd.array([None] * int((n > 0).sum()), "Int64")})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Group after group, first its pairs of chunks and then its trees; no more than one group's trees are held."""
        now, todo, trees = None, [], {}
        for batch in batches:
            for number, x, y, blob in zip(batch["number"], batch["x"], batch["y"], batch["tree"], strict=True):
                if number != now:
                    yield from finished(todo, trees)
                    now, todo, trees = number, [], {}
                if y >= 0:
                    todo.append((int(x), int(y)))
                else:
                    trees[int(x)] = pickle.loads(blob)
        yield from finished(todo, trees)

    told = todo.select("number", "x", "y", F.lit(None).cast("binary").alias("tree"))
    carried = _lookup(sent, 50).join(trees, "chunk").select("number", F.col("chunk").alias("x"), F.lit(-1).alias("y"), "tree")
    tasks = max(1, min(MEETING_TASKS, groups.count()))
    together = told.unionByName(carried).repartitionById(tasks, F.pmod("number", F.lit(tasks)).cast("int")).sortWithinPartitions("number", F.desc("y"))
    out = materialise(together.mapInPandas(gather, "cid long, links long, other long"), "cover-links")
    drop_tables(placed, trees)
    return out


def dedup(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): one for each row of vectors."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    spark = vectors.sparkSession
    bounded_batches(spark, 1024)
    finite = lambda v: F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    vec = F.when(F.coalesce(finite(F.col(vector)), F.lit(False)), F.col(vector))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), vec.alias("vector"))
    marks = [F.xxhash64("vector").alias("h"), F.xxhash64("vector", F.lit(1)).alias("k")]
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "least", "n", *marks, "vector"), "cover-classes")
    named = classes.select("cid", "least", "n", "h", "k")
    # rows find their class by 128 bits of hash, which must be the class's own
    if not named.groupBy("h", "k").count().where("count > 1").isEmpty():
        raise RuntimeError("two vectors have the same 128 bits of hash")
    found = None
    for r in classes.select(F.size("vector").alias("k")).distinct().orderBy("k").collect():
        part = class_links(classes.where(F.size("vector") == r.k).select("cid", "n", "vector"), threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = components(found.where("other is not null").select("cid", "other"), "cover-components")
    roots = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    linked = roots.join(named, roots.node == F.col("cid")).select("cid", "root", "least")
    lead = linked.groupBy("root").agg(F.min("least").alias("component"))
    groups = linked.join(lead, "root").select("cid", "component")
    full = named.join(totals, "cid", "left").join(groups, "cid", "left").select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    # written, so that both sides of the join come straight from exchanges and a group of copies can be split
    full = materialise(full, "cover-result")
    keys = rows.select("vec_id", *[F.when(F.col("vector").isNotNull(), m).alias(c) for m, c in zip([F.xxhash64("vector"), F.xxhash64("vector", F.lit(1))], ("h", "k"), strict=True)])
    out = keys.join(full, ["h", "k"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as node, vec_id as least from embeddings union select links.b, reach.least from reach join links on links.a = reach.node where reach.least < links.b),
comp as (select node, min(least) as component_id from reach group by node),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join comp on comp.node = e.vec_id left join n on n.a = e.vec_id
"""
