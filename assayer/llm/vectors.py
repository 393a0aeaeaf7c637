"""Embedding near-dedup by NN-descent.

Vectors of one label are compared by cosine in double precision. Equal vectors are one class. A
first neighbour graph comes from leaves of random hyperplane trees; rounds of local joins then try
each vector's neighbours, and those that have it as neighbour, against each other, and keep the
best ``K`` of every vector, until few lists change. A list of ``K`` links is saturated: it is enlarged, to ``WIDE`` links at
first and then to its whole component, whose links are counted by cells of vectors at like angles from its centre:
the triangle inequality settles most pairs of cells, and only the others are multiplied. An audit tries vectors
against all, more of them until enough have links; while its recall is below ``RECALL``, more trees and rounds follow, and
in the end an error. Edges at the threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.flat import give_back
from assayer.llm.graph import components
from assayer.llm.lineage import cut, release, tasks

THRESHOLD = 0.93
K = 10
#: Links that the list of a vector with more than K keeps.
WIDE = 4 * K
#: Trees of an attempt, and one more for each level of depth.
TREES = 4
#: Rounds go on until a smaller share of the lists' entries is new.
CHANGED = 0.02
LEAF = 256
BLOCK = 512
#: Vectors to audit: at first, at most, and with links.
AUDIT = 128
AUDIT_MOST = 8192
AUDIT_LINKED = 200
RECALL = 0.98
ATTEMPTS = 8


def _unit(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    largest = np.abs(values).max(1, keepdims=True)
    values = values / largest  # squares of very large or small components would leave the range
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, dim, v of the vectors that can link."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.size(v).alias("dim"), v.cast(f"array<{element}>").alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)


def _codes(attempt: int):
    """Sign bits of TREES sets of hyperplanes through each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([attempt, dim]).standard_normal((dim, (TREES + 24) * 24))
                bits = (_unit(part.column("v"), part.num_rows) @ planes[dim] > 0).reshape(-1, TREES + 24, 24).astype(np.int64)
                code = (bits << np.arange(24)).sum(2)
                depth = part.column("bits").to_numpy()
                for tree in range(TREES + int(depth.max())):
                    use = np.flatnonzero(tree < TREES + depth)
                    own = part.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "place", "bits", "v")), pa.array(np.full(len(use), tree)), pa.array(code[use, tree])], names=["id", "place", "bits", "v", "tree", "code"])

    return run


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest entries."""
    k = min(k, sims.shape[1] - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), top.ravel()


_EDGE = "a long, b long, sim double"


def _edges(a: list, b: list, sim: list) -> pa.Table:
    join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)])
    return pa.table([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)), pa.array(join(sim, np.float64))], names=["a", "b", "sim"])


def _leaf(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    unit = _unit(table.column("v").combine_chunks(), len(ids))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    i, j = _best(sims, K)
    return _edges([ids[i]], [ids[j]], [sims[i, j]])


def _local(table: pa.Table) -> pa.Table:
    """Members of many lists, in one table; each list's members are tried against each other."""
    table = table.sort_by([("m", "ascending"), ("salt", "ascending"), ("id", "ascending")])
    m, salt, ids = (table.column(c).to_numpy() for c in ("m", "salt", "id"))
    unit = _unit(table.column("v").combine_chunks(), len(ids)) if len(ids) else np.empty((0, 1))
    edge = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (salt[1:] != salt[:-1]), [True]]))
    a, b, sim = [], [], []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own, who = unit[lo:hi], ids[lo:hi]
        sims = own @ own.T
        sims[who[:, None] == who[None, :]] = -2
        keep = np.zeros(sims.shape, bool)
        for k, least in ((2, -1.5), (K, THRESHOLD)):
            i, j = _best(sims, k)
            keep[i, j] |= sims[i, j] >= least
        i, j = np.nonzero(keep)
        a.append(who[i])
        b.append(who[j])
        sim.append(sims[i, j])
    del unit
    give_back()
    return _edges(a, b, sim)


def _top(edges: DataFrame) -> DataFrame:
    """The best K of each list, and of links the best WIDE. edges: a, b, sim, old (1 for those that the lists had)."""
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    order = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return edges.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= K) | (F.col("sim") >= THRESHOLD) & (F.col("rank") <= WIDE))


def _with(edges: DataFrame | None, grown: DataFrame) -> DataFrame:
    grown = grown.withColumn("old", F.lit(0))
    return cut(_top(grown if edges is None else edges.select("a", "b", "sim", F.lit(1).alias("old")).union(grown)))


def _trees(items: DataFrame, attempt: int) -> DataFrame:
    coded = items.mapInArrow(_codes(attempt), items.select("id", "place", "bits", "v").withColumns({"tree": F.lit(0).cast("long"), "code": F.lit(0).cast("long")}).schema)
    leaf = coded.withColumn("leaf", F.xxhash64("tree", "place", F.col("code").bitwiseAND(F.expr("shiftleft(1L, bits) - 1"))))
    leaf = cut(leaf.select("id", "leaf", "v"))
    size = cut(leaf.groupBy("leaf").agg(F.count("*").alias("n")))
    split = leaf.join(size, "leaf").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (2 * LEAF)).cast("long")))
    return split.select("leaf", "salt", "id", "v").groupBy("leaf", "salt").applyInArrow(_leaf, _EDGE)


def _refined(graph: DataFrame, items: DataFrame, buckets: int) -> DataFrame:
    """One round of local joins."""
    short = graph.where(F.col("rank") <= K)
    forward = short.select(F.col("a").alias("m"), F.col("b").alias("id"))
    reverse = short.select(F.col("b").alias("m"), F.col("a").alias("id"))
    parts = cut(reverse.groupBy("m").agg(F.ceil(F.count("*") / (4 * K)).cast("int").alias("parts")))
    forward = forward.join(parts, "m", "left").select("m", "id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    reverse = reverse.join(parts, "m").select("m", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    members = forward.union(reverse).distinct().join(items.select("id", "dim", "v"), "id")
    members = members.withColumn("bucket", F.pmod(F.xxhash64("m", "salt"), F.lit(buckets)))
    return members.groupBy("bucket", "dim").applyInArrow(_local, _EDGE)


def _audit(items: DataFrame, asked: pa.Table) -> DataFrame:
    """The links of some vectors, by brute force in one pass: all of those with up to K, K at least of the others."""
    groups: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    place, dim = asked.column("place").to_numpy(), asked.column("dim").to_numpy()
    for key in set(zip(place.tolist(), dim.tolist())):
        own = asked.filter(pa.array((place == key[0]) & (dim == key[1])))
        groups[key] = own.column("id").to_numpy(), _unit(own.column("v").combine_chunks(), own.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, dim = batch.column("place").to_numpy(), batch.column("dim").to_numpy()
            a, b, sim = [], [], []
            for key in set(zip(place.tolist(), dim.tolist())) & groups.keys():
                own = batch.filter(pa.array((place == key[0]) & (dim == key[1])))
                who, other = own.column("id").to_numpy(), _unit(own.column("v"), own.num_rows).T
                for lo in range(0, len(groups[key][0]), BLOCK):
                    ids, unit = (x[lo : lo + BLOCK] for x in groups[key])
                    sims = unit @ other
                    near = (sims >= THRESHOLD) & (ids[:, None] != who[None, :])
                    i, j = np.nonzero(near & (np.cumsum(near, 1) <= K))
                    a.append(ids[i])
                    b.append(who[j])
                    sim.append(sims[i, j])
            yield from _edges(a, b, sim).to_batches()

    return items.select("id", "place", "dim", "v").mapInArrow(run, _EDGE)


def _truth(items: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Links of audited vectors, how many each has (K at most), and whether they are enough to tell the recall."""
    n, total = AUDIT, items.count()
    while True:
        asked = items.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "place", "dim", "v").toArrow()
        truth = cut(_audit(items, asked))
        due = cut(truth.groupBy("a").agg(F.least(F.count("*"), F.lit(K)).alias("due")))
        enough = due.count() >= AUDIT_LINKED or n >= total
        if enough or n >= AUDIT_MOST:
            return truth, due, enough
        n *= 8


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each component's unit vectors in a batch."""
    for batch in batches:
        part, dim = batch.column("part").to_numpy(), batch.column("dim").to_numpy()
        for d in np.unique(dim).tolist():
            own = batch.filter(pa.array(dim == d))
            parts, at = np.unique(part[dim == d], return_inverse=True)
            total = np.zeros((len(parts), d))
            np.add.at(total, at, _unit(own.column("v"), own.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["part", "c"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.array(table.column("c").to_pylist()).sum(0)
    return pa.table([table.column("part").slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "c"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's angle to its component's centre."""
    for batch in batches:
        dim, angle = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
        for d in np.unique(dim).tolist():
            own = batch.filter(pa.array(dim == d))
            centre = own.column("c").flatten().to_numpy().reshape(own.num_rows, d)
            size = np.sqrt((centre * centre).sum(1))
            cosine = (_unit(own.column("v"), own.num_rows) * centre).sum(1) / np.where(size > 0, size, 1)
            angle[dim == d] = np.arccos(np.clip(cosine, -1, 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "id", "many", "v")), pa.array(angle)], names=["part", "id", "many", "v", "angle"])


def _blocks(table: pa.Table) -> pa.Table:
    """Links between the members of two blocks of one component (or of one block), as counts."""
    side = table.column("side").to_numpy()
    x, y = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    own = table.column("own")[0].as_py()
    if own:
        y = x
    if not x.num_rows or not y.num_rows:
        return pa.table([pa.array([], pa.int64())] * 2, names=["id", "n"])
    ux, uy = (_unit(t.column("v").combine_chunks(), t.num_rows) for t in (x, y))
    near = (ux @ uy.T >= THRESHOLD) & (x.column("id").to_numpy()[:, None] != y.column("id").to_numpy()[None, :])
    ids, n = [x.column("id").to_numpy()], [near @ y.column("many").to_numpy()]
    if not own:
        ids.append(y.column("id").to_numpy())
        n.append(near.T @ x.column("many").to_numpy())
    return pa.table([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n).astype(np.int64))], names=["id", "n"])


def links_within(members: DataFrame) -> DataFrame:
    """(id, whole): how many vectors of its component, with ``many`` each, a vector links with, itself not counted.

    members: part, id, many, dim, v. Two vectors at angles r and s from the centre are at an angle from |r - s| to r + s
    from each other; what that leaves open is multiplied, in pairs of blocks.
    """
    reach, margin = float(np.arccos(THRESHOLD)), 1e-7
    centre = members.mapInArrow(_sums, "part long, c array<double>").groupBy("part").applyInArrow(_sum, "part long, c array<double>")
    kind = members.schema["v"].dataType.simpleString()
    placed = members.join(centre, "part").mapInArrow(_angles, f"part long, id long, many long, v {kind}, angle double")
    # The core lies within half the reach of the centre, so that all of it links; around it are shells.
    core = reach / 2 - margin
    shell = F.when(F.col("angle") <= core, 0).otherwise(1 + F.floor((F.col("angle") - core) / (reach / 8))).cast("int")
    placed = cut(placed.withColumn("shell", shell))
    shells = placed.groupBy("part", "shell").agg(
        F.sum("many").alias("vectors"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    shells = cut(shells)
    other = shells.select("part", *(F.col(c).alias(f"{c}_b") for c in ("shell", "vectors", "blocks", "low", "high")))
    pairs = shells.join(other, "part").withColumn("all", F.col("high") + F.col("high_b") <= reach - margin)
    pairs = pairs.where(F.greatest(F.col("low") - F.col("high_b"), F.col("low_b") - F.col("high")) <= reach + margin)
    sure = pairs.where("all").groupBy("part", "shell").agg(F.sum("vectors_b").alias("sure"), F.max(F.col("shell") == F.col("shell_b")).alias("with_own"))
    sure = placed.join(sure, ["part", "shell"]).select("id", (F.col("sure") - F.when(F.col("with_own"), F.col("many")).otherwise(0)).alias("n"))

    open_ = cut(pairs.where("not all and shell <= shell_b").select("part", "shell", "shell_b", "blocks", "blocks_b"))
    dealt = placed.join(shells.select("part", "shell", F.col("blocks").alias("own_blocks")), ["part", "shell"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("own_blocks")).cast("int")).select("part", "shell", "block", "id", "many", "v")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(open_, ["part", "shell"]).withColumn("far", each("blocks_b"))
    same = F.col("shell") == F.col("shell_b")
    turned = same & (F.col("block") > F.col("far"))
    left = left.select(
        "part", "shell", "shell_b", F.when(turned, F.col("far")).otherwise(F.col("block")).alias("x"),
        F.when(turned, F.col("block")).otherwise(F.col("far")).alias("y"), turned.cast("int").alias("side"), "id", "many", "v",
    )
    over = open_.where("shell < shell_b").select("part", F.col("shell").alias("s"), F.col("shell_b").alias("shell"), "blocks")
    right = dealt.join(over, ["part", "shell"]).withColumn("far", each("blocks"))
    right = right.select("part", F.col("s").alias("shell"), F.col("shell").alias("shell_b"), F.col("far").alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "id", "many", "v")
    border = left.union(right).withColumn("own", (F.col("shell") == F.col("shell_b")) & (F.col("x") == F.col("y")))
    border = border.groupBy("part", "shell", "shell_b", "x", "y").applyInArrow(_blocks, "id long, n long")
    return sure.union(border).groupBy("id").agg(F.sum("n").alias("whole"))


def neighbour_links(items: DataFrame) -> DataFrame:
    """The neighbour graph's edges a, b, sim, rank; those at the threshold are links. items: id, place, dim, bits, v.

    The recall is the mean over audited vectors with links, so that a crowded component counts no more than a pair.
    Where too few have links, attempts go on until one adds less than 1 - RECALL to the links.
    """
    spark = items.sparkSession
    buckets = tasks(spark, 12)
    truth, due, enough = _truth(items)
    edges, before = None, 0
    for attempt in range(ATTEMPTS):
        edges = _with(edges, _trees(items, attempt))
        while True:
            edges = _with(edges, _refined(edges, items, buckets))
            release(spark)
            listed, new = edges.where(F.col("rank") <= K).agg(F.count("*"), F.count(F.when(F.col("old") == 0, 1))).first()
            if new <= CHANGED * listed:
                break
        has = edges.where(F.col("sim") >= THRESHOLD).groupBy("a").agg(F.count("*").alias("has"))
        recall = due.join(has, "a", "left").agg(F.avg(F.least(F.coalesce("has", F.lit(0)), "due") / F.col("due"))).first()[0]
        links = edges.where(F.col("sim") >= THRESHOLD).count()
        settled = enough or attempt and links - before <= (1 - RECALL) * links
        if settled and (recall is None or recall >= RECALL):
            return _with(edges, truth)
        before = links
    raise RuntimeError(f"recall of the audited vectors is {recall} after {ATTEMPTS} attempts, below {RECALL} or not settled")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is 0.93 or more.
    Null, empty and zero vectors and those with null or non-finite components link with nothing: 0 links, a component of
    their own. Rows that repeat a vec_id are vectors of their own, each with its own links; a component's id is the smallest
    vec_id in it. A null vec_id has no links, a null component, and is kept. Other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    key = ["label", "dim", "mark", "mark2"]
    marked = cut(usable(vectors).withColumn("mark", F.xxhash64("label", "dim", "v")).withColumn("mark2", F.hash("v", "label")))
    classes = marked.groupBy(*key).agg(F.min("id").alias("low"), F.count("*").alias("many"), F.first("v").alias("v"))
    # A class has a number of its own: vec_ids may repeat.
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    size = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    items = classes.join(size, ["label", "dim"])
    items = cut(items.select("id", F.xxhash64("label", "dim").alias("place"), "dim", F.least(bits, F.lit(24)).alias("bits"), "many", "low", "v"))
    edges = neighbour_links(items)
    links = cut(edges.where(F.col("sim") >= THRESHOLD).select("a", "b"))
    parts = items.select("id", "low", "many", "dim", "v").join(components(links), "id", "left")
    parts = cut(parts.withColumn("part", F.coalesce("component", "id")).drop("component"))

    other = parts.select(F.col("id").alias("b"), "many")
    direct = links.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.sum("many").alias("n"), F.count("*").alias("listed"))
    direct = cut(direct)
    full = parts.select("id", "part").join(direct.where(F.col("listed") >= K).select("id"), "id").select("part").distinct()
    counted = links_within(cut(parts.join(full, "part", "left_semi").select("part", "id", "many", "dim", "v")))

    first = parts.groupBy("part").agg(F.min("low").alias("component_id"))
    tally = parts.select("id", "many", "part").join(direct, "id", "left").join(counted, "id", "left").join(first, "part")
    n_links = F.coalesce("whole", "n", F.lit(0)) + F.col("many") - 1
    named = classes.select("id", *key).join(tally.select("id", n_links.alias("n_links"), "component_id"), "id").drop("id")
    linked = marked.select("id", *key).join(cut(named), key).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    vec_id = F.col("vec_id").cast("long").alias("vec_id")
    alone = vectors.select(vec_id).exceptAll(linked.select("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.union(alone).select("vec_id", "n_links", "component_id", kept)
