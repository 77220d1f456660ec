"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

Centroids are fitted on a bounded sample. Every vector goes to its OVERLAP nearest centroids' shards, so close vectors
share a shard. Each shard prunes a graph of its vectors (a neighbour is kept only if no kept neighbour is closer to it by
the factor ALPHA), the adjacency lists of a vector are united over its shards, and each shard is searched along the united
lists: greedily from the medoid towards the query, and then on through every vector in range. Pairs in range are verified
as cosines in double precision; a pair is counted by the first shard that holds both. Recall is audited on
queries against all vectors, as the mean share of its own partners that a query finds, for queries with up to FEW
partners and for those in a crowd apart, so that no crowd hides what sparse vectors lose; below MIN_RECALL in either part
the overlap is raised and the search runs again. Where too few sparse queries have a partner to tell, it is raised until
the search itself finds hardly any more.

Equal vectors are one class with a multiplicity, so a vector that repeats without end costs one place. A shard
above CROWD rows is dealt in blocks, and every two of its blocks are compared whole in a task of their own; no row is
left out.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import components, when_small
from tempora.session import stage

_LOG = logging.getLogger(__name__)

COSINE = 0.9
SHARD = 600
SAMPLE = 40_000
OVERLAP = 2
DEGREE = 24
ALPHA = 1.2
BEAM = 24
BATCH = 128
#: Rows above which a shard is compared by pairs of blocks, and rows of a block on average.
CROWD = 1800
BLOCK = 600
#: Cosines this far below the threshold are still walked through.
SLACK = 0.08
AUDIT = 256
#: Partners up to which a query counts as sparse; sparse queries with partners that an audit needs, and further queries
#: when the first have fewer.
FEW = 64
EVIDENCE = 30
MORE_AUDIT = 4096
MIN_RECALL = 0.95


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced sample rows; deterministic for one sample."""
    k = max(1, min(k, len(sample)))
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        best = np.concatenate([(sample[i : i + 4096] @ found.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, best, sample)
        size = np.linalg.norm(sums, axis=1)
        found[size > 0] = sums[size > 0] / size[size > 0, None]
    return found.astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _graph(table: pa.Table) -> pa.Table:
    """(src, dst) edges of one shard's graph, both ways."""
    ids = table.column("vec").to_numpy()
    order = np.argsort(ids)
    ids, vectors = ids[order], _matrix(table.column("unit"))[order]
    n, src, dst = len(ids), [], []
    width = min(3 * DEGREE, n)
    for lo in range(0, n, BATCH):
        sims = vectors[lo : lo + BATCH] @ vectors.T
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        rank = np.take_along_axis(-sims, near, 1).argsort(1, kind="stable")
        near = np.take_along_axis(near, rank, 1)
        kept = prune(near, vectors, np.arange(lo, lo + len(sims)))
        at, _ = np.nonzero(kept >= 0)
        src.append(ids[lo + at])
        dst.append(ids[kept[kept >= 0]])
    src, dst = np.concatenate(src), np.concatenate(dst)
    return pa.table({"src": np.concatenate([src, dst]), "dst": np.concatenate([dst, src])})


def prune(near: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates (by falling similarity); -1 fills the rest.

    A candidate is dropped when one that is kept is closer to it, times ALPHA, than the row is.
    """
    kept = np.full((len(rows), DEGREE), -1)
    filled = np.zeros(len(rows), int)
    own = vectors[near]
    away = np.maximum(1 - np.einsum("nwd,nd->nw", own, vectors[rows]), 0)
    alive = near != rows[:, None]
    for j in range(near.shape[1]):
        take = np.flatnonzero(alive[:, j] & (filled < DEGREE))
        if not len(take):
            continue
        kept[take, filled[take]] = near[take, j]
        filled[take] += 1
        between = np.maximum(1 - np.einsum("nwd,nd->nw", own[take], own[take, j]), 0)
        alive[take] &= ALPHA * between > away[take]
    return kept


def search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, start: int, reach: float) -> np.ndarray:
    """Visited similarities (queries by vectors, -2 where not visited) of greedy searches that widen over the range.

    Each step expands, for every query, its best unexpanded vector: while that is among the BEAM best seen, or within
    reach. neighbours has -1 where a list ends.
    """
    q, n = len(queries), len(vectors)
    sims = np.full((q, n), -2.0)
    expanded = np.zeros((q, n), bool)
    sims[:, start] = queries @ vectors[start]
    live = np.arange(q)
    while len(live):
        front = np.where(expanded[live], -3.0, sims[live])
        best = front.argmax(1)
        value = front[np.arange(len(live)), best]
        seen = sims[live]
        bar = np.partition(seen, n - BEAM, axis=1)[:, n - BEAM] if n > BEAM else np.full(len(live), -2.0)
        going = (value > -1.5) & ((value >= bar) | (value >= reach))
        live, best = live[going], best[going]
        if not len(live):
            break
        expanded[live, best] = True
        around = neighbours[best]
        rows, cols = np.nonzero(around >= 0)
        at, to = live[rows], around[rows, cols]
        new = sims[at, to] < -1.5
        at, to = at[new], to[new]
        sims[at, to] = np.einsum("kd,kd->k", queries[at], vectors[to])
    return sims


def _shard_links(table: pa.Table, cosine: float) -> pa.Table:
    """Per vector of a shard: links counted here (with multiplicities) and the smallest vector of its local component."""
    ids = table.column("vec").to_numpy()
    order = np.argsort(ids)
    ids, vectors = ids[order], _matrix(table.column("unit"))[order]
    n = len(ids)
    shards = _matrix(table.column("shards"))[order].astype(np.int64)
    here = table.column("shard")[0].as_py()
    weight = table.column("times").to_numpy()[order]
    lists = table.column("adj").to_pylist()
    lists = [lists[i] for i in order]
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    place = np.minimum(np.searchsorted(ids, flat), n - 1)
    inside = ids[place] == flat
    owner, place = owner[inside], place[inside]
    width = max(1, int(np.bincount(owner, minlength=n).max()) if n else 1)
    first = np.searchsorted(owner, np.arange(n))
    neighbours = np.full((n, width), -1)
    neighbours[owner, np.arange(len(owner)) - first[owner]] = place
    start = int((vectors @ vectors.mean(0)).argmax())
    links, pairs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for lo in range(0, n, BATCH):
        queries = vectors[lo : lo + BATCH]
        sims = search(vectors, neighbours, queries, start, cosine - SLACK)
        at, to = np.nonzero(sims >= cosine - 1e-9)
        at = at + lo
        other = at != to
        at, to = at[other], to[other]
        # verified as the cosine of the vectors themselves
        exact = np.einsum("kd,kd->k", vectors[at], vectors[to]) >= cosine
        at, to = at[exact], to[exact]
        common = (shards[at][:, :, None] == shards[to][:, None, :]) & (shards[at] >= 0)[:, :, None]
        lowest = np.where(common.any(2), shards[at], np.iinfo(np.int64).max).min(1)
        mine = lowest == here
        np.add.at(links, at[mine], weight[to[mine]])
        np.add.at(pairs, at[mine], 1)
        # pairs whose ends are joined already are passed over at once
        while (root[root] != root).any():
            root = root[root]
        ends = np.stack([root[at[mine]], root[to[mine]]])
        for a, b in np.unique(ends[:, ends[0] != ends[1]], axis=1).T.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(n)], np.int64) if n else root
    return pa.table({"vec": ids, "links": links, "pairs": pairs, "root": ids[roots] if n else ids})


def _block_links(table: pa.Table, cosine: float) -> pa.Table:
    """As _shard_links, of all pairs between two blocks of a crowded shard (or inside one)."""
    ids, vectors = table.column("vec").to_numpy(), _matrix(table.column("unit"))
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    shards = _matrix(table.column("shards"))[order].astype(np.int64)
    here, low, high = (table.column(c)[0].as_py() for c in ("shard", "low", "high"))
    weight, block = table.column("times").to_numpy()[order], table.column("block").to_numpy()[order]
    n = len(ids)
    near = np.zeros((n, n), bool)
    for lo in range(0, n, BATCH):
        at, to = np.nonzero(vectors[lo : lo + BATCH] @ vectors.T >= cosine - 1e-9)
        at = at + lo
        other = (at != to) & ((low == high) | (block[at] != block[to]))
        at, to = at[other], to[other]
        # a pair belongs to the first shard that holds both
        common = (shards[at][:, :, None] == shards[to][:, None, :]).any(2)
        mine = np.where(common, shards[at], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == here
        at, to = at[mine], to[mine]
        exact = np.einsum("kd,kd->k", vectors[at], vectors[to]) >= cosine
        near[at[exact], to[exact]] = True
    root = np.full(n, -1)
    for i in range(n):
        front = np.array([i]) if root[i] < 0 else np.zeros(0, int)
        while len(front):
            root[front] = i
            front = np.flatnonzero(near[front].any(0) & (root < 0))
    return pa.table({"vec": ids, "links": near @ weight, "pairs": near.sum(1), "root": ids[root]})


def block_pairs(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of ``members(vec, shard, ..)`` in the shards of ``crowded(shard, blocks)``, once for each pair (low, high) of
    blocks that their own block is in.
    """
    rows = members.join(crowded, "shard").withColumn("block", F.pmod(F.xxhash64("vec", F.lit("block")), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def _assign(batches: Iterator[pa.RecordBatch], shared, overlap: int) -> Iterator[pa.RecordBatch]:
    """Adds the shards of each vector, nearest first."""
    means = shared.value
    k = min(overlap, len(means))
    for batch in batches:
        vectors = _matrix(batch.column(batch.schema.get_field_index("unit"))).astype(np.float32)
        if not len(vectors):
            continue
        sims = vectors @ means.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int64)
        near.sort(axis=1)
        lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, k, dtype=np.int32), near.ravel())
        yield batch.append_column("shards", lists)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = unit(_matrix(batch.column(1)))
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], ["vec", "times", "unit"])


def _audit(batches: Iterator[pa.RecordBatch], shared, cosine: float) -> Iterator[pa.RecordBatch]:
    """Brute force: how many other vectors of a task the audited queries link with, each once whatever its copies."""
    ids, queries = shared.value
    sums = np.zeros(len(ids), np.int64)
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(2))
            hit = queries @ vectors.T >= cosine
            hit &= ids[:, None] != batch.column(0).to_numpy()[None, :]
            sums += hit.sum(1)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], ["vec", "found"])


def audit(own: DataFrame, cosine: float) -> dict[int, int]:
    """Queries of ``own(vec, times, unit)`` with the number of distinct vectors that each links with."""
    truth: dict[int, int] = {}
    for most in (AUDIT, MORE_AUDIT):
        asked = own.orderBy(F.xxhash64("vec", F.lit("audit"))).limit(most).collect()
        asked = [r for r in asked if r["vec"] not in truth]
        if not asked or sum(0 < n <= FEW for n in truth.values()) >= EVIDENCE:
            break
        ids, queries = np.array([r["vec"] for r in asked]), np.array([r["unit"] for r in asked])
        shared = own.sparkSession.sparkContext.broadcast((ids, queries))
        found = own.mapInArrow(lambda b, s=shared: _audit(b, s, cosine), "vec long, found long").groupBy("vec").agg(F.sum("found").alias("found"))
        truth |= {r["vec"]: r["found"] for r in found.collect()}
    return truth


def recalls(truth: dict[int, int], seen: dict[int, int]) -> dict[str, float]:
    """Mean share of its partners that a query finds, apart for sparse queries and those in a crowd; none without partners."""
    parts = {"sparse": [v for v, n in truth.items() if 0 < n <= FEW], "crowded": [v for v, n in truth.items() if n > FEW]}
    return {name: float(np.mean([min(1.0, seen.get(v, 0) / truth[v]) for v in own])) for name, own in parts.items() if own}


def _gained_little(before: DataFrame, now: DataFrame) -> bool:
    """Whether, in both parts, an earlier search had found the share MIN_RECALL of each vector's (vec, pairs) of now."""
    both = now.join(before.withColumnRenamed("pairs", "had"), "vec", "left").filter("pairs > 0")
    share = F.least(F.coalesce(F.col("had"), F.lit(0)) / F.col("pairs"), F.lit(1.0))
    parts = both.groupBy((F.col("pairs") <= FEW).alias("sparse")).agg(F.avg(share).alias("share"))
    return all(r["share"] >= MIN_RECALL for r in parts.collect())


def audited(own: DataFrame, means: np.ndarray, overlap: int, cosine: float) -> tuple[DataFrame, float | None]:
    """Links at the first overlap that the audit, or for want of partners the search at half the overlap, bears out, and
    the lower of the audit's two recalls (None where no query has a partner).
    """
    truth = audit(own, cosine)
    enough = sum(0 < n <= FEW for n in truth.values()) >= EVIDENCE
    asked = own.sparkSession.createDataFrame([(x,) for x in truth], "vec long")
    before = None
    while True:
        links = search_links(own, means, overlap, cosine)
        each = links.groupBy("vec").agg(F.sum("pairs").alias("pairs"))
        seen = {r["vec"]: r["pairs"] for r in each.join(asked, "vec", "left_semi").collect()}
        shares = recalls(truth, seen)
        _LOG.info("overlap %d: recall %s of %d queries", overlap, shares, len(truth))
        low = min(shares.values(), default=None)
        if overlap >= len(means) or (low is None or low >= MIN_RECALL) and (enough or before is not None and _gained_little(before, each)):
            return links, low
        before, overlap = each, overlap * 2


def audited_links(own: DataFrame, means: np.ndarray, overlap: int, cosine: float) -> DataFrame:
    return audited(own, means, overlap, cosine)[0]


def search_links(classes: DataFrame, means: np.ndarray, overlap: int, cosine: float) -> DataFrame:
    """(vec, links, pairs, root) rows of every shard's search over ``classes(vec, times, unit)``."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(means)
    kind = "vec long, times long, unit array<double>, shards array<long>"
    dealt = stage(classes.mapInArrow(lambda b: _assign(b, shared, overlap), kind), "assigned")
    members = dealt.select("*", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    crowded = when_small(stage(sizes.select("shard", F.ceil(F.col("n") / BLOCK).alias("blocks")), "crowded"), 16)
    edges = members.join(crowded, "shard", "left_anti")
    edges = edges.select("shard", "vec", "unit").groupBy("shard").applyInArrow(_graph, "src long, dst long")
    united = stage(edges.groupBy("src").agg(F.collect_set("dst").alias("adj")), "adjacency")
    # a list has DEGREE entries of its own from each shard and those that point back at it
    full = dealt.join(united, F.col("vec") == F.col("src"), "left")
    full = full.select("vec", "times", "unit", "shards", F.coalesce("adj", F.array().cast("array<long>")).alias("adj"))
    full = full.withColumn("shard", F.explode("shards")).join(crowded, "shard", "left_anti")
    out = "vec long, links long, pairs long, root long"
    found = full.groupBy("shard").applyInArrow(lambda t: _shard_links(t, cosine), out)
    blocks = block_pairs(members, crowded).groupBy("shard", "low", "high").applyInArrow(lambda t: _block_links(t, cosine), out)
    return stage(found.union(blocks), "vector_links")


def link(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept, n_copies, audit_recall.

    ``audit_recall`` is what the audit measured for vectors of this length, NULL where no audited query has a partner.
    Vectors that are null, zero, or hold null or non-finite components link with nothing and name their own component.
    Vectors of another length than most are compared with those of their length only. Equal vectors are linked with each
    other. A null id is linked, and names a component only when all its ids are null. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    fine = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists("e", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(fine, F.col("e")).alias("e"))
    classes = rows.filter("e is not null").groupBy("e").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"))
    # the class id is a hash of the vector's bits
    classes = stage(classes.select(F.xxhash64("e").alias("vec"), "e", "times", "first_id", F.size("e").alias("dim")), "vector_classes")
    clash = classes.groupBy("vec").count().filter("count > 1")
    if not clash.isEmpty():
        raise ValueError("two vectors share a class id")
    found, measured = None, {}
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):
        own = classes.filter(F.col("dim") == dim).select("vec", "e", "times")
        own = stage(own.mapInArrow(_units, "vec long, times long, unit array<double>"), "units")
        share = min(1.0, SAMPLE / n)
        drawn = own.filter(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("vec"))
        sample = np.array([r["unit"] for r in drawn.select("unit").limit(SAMPLE).collect()]).reshape(-1, dim)
        means = centroids(sample, -(-n // SHARD) if n > SHARD else 1)
        links, low = audited(own, means, overlap, cosine)
        measured[dim] = low
        found = links if found is None else found.union(links)
    if found is None:
        none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.select("*", F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("double").alias("audit_recall"))
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("root").alias("a"), F.col("vec").alias("b")))
    named = classes.join(counts, "vec", "left").join(groups, F.col("vec") == F.col("node"), "left")
    named = stage(named.select("vec", "dim", "times", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "vec").alias("comp")), "named")
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "comp").select("vec", "dim", "times", "links", "component_id")
    out = rows.select("vec_id", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("vec")).join(named, "vec", "left")
    recall = F.lit(None).cast("double")
    for dim, low in measured.items():
        recall = F.when(F.col("dim") == dim, F.lit(low).cast("double")).otherwise(recall)
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("times") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("times", F.lit(1)).cast("long").alias("n_copies"),
        recall.alias("audit_recall"),
    )
