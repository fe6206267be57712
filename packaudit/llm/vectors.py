"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping shards: their nearest cluster centres, from a bounded sample,
and within clusters much larger than a shard to the nearest of a second level of centres.  Each shard builds a graph whose edges are
pruned so that a neighbour already reached through a nearer one is left out; the adjacency
lists that a vector gets in its shards are united.  Every vector searches all shards of its
clusters: a greedy beam from the shards' medoids, then a range-expanding walk through all
that lies within the threshold.  Every link is verified in double precision, and counted in
the first cluster that its two ends share.

How many clusters a vector is dealt to is measured in the job: hash-chosen vectors meet all
others in blocks, and the number is the least at which nearly all their true links share a
cluster.  What the search then counts is audited against the same links; while too few are
found, the number doubles and the search runs again.

A shard is of bounded size, so a cluster that holds a third of all vectors is many shards;
what leaves a task is a count per vector and a spanning forest, never all pairs.

Package files have no embeddings of their own, so the operator is kept general: it takes a
table (vec_id, embedding).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions.tables import cut, first_rows
from packaudit.llm.common import components, key_type, stored

COSINE = 0.9
SAMPLE = 20_000  # vectors, in the order of a hash, that the cluster centres are fitted to
CLUSTER = 1500  # vectors that a cluster should hold
CENTRES = 2048  # most clusters; beyond that, clusters have a second level of centres
INNER = 20_000  # members of a cluster that its second level is fitted to
CENTRE_BYTES = 64 << 20  # of all second-level centres of one length together
OVERLAP = 3  # fewest clusters each vector is dealt to
AUDIT = 256  # vectors, last in the order of the hash, whose links are looked for among all
SHARED, RECALL = 0.97, 0.9  # shares of true links: that must share a cluster, that must be counted
BLOCK = 4000  # most members of a shard, and most queries of a task
SPLIT = 8 * BLOCK  # members from which a cluster gets a second level: up to there, few blocks cost less than more homes
DEGREE, POOL, ALPHA = 24, 64, 1.2  # most neighbours kept, candidates looked at, slack of the pruning
BEAM, ENTRIES = 32, 8
PAIRS = 2_000_000  # cosines in memory at a time


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit) per row: the vector in double precision and of length one, null if it cannot be compared."""
    e = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("e", F.abs))  # scaling first: squares neither overflow nor vanish
    rows = vectors.select("vec_id", F.when(ok, e).alias("e")).withColumn("top", top)
    rows = rows.select("vec_id", F.when(F.col("top") > 0, F.transform("e", lambda x: x / F.col("top"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("vec_id", F.transform("e", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _kmeans(x: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(8):
        home = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def centres(points: DataFrame, dim: int, count: int) -> np.ndarray:
    """Spherical k-means on at most SAMPLE vectors."""
    rows = points.where(F.size("unit") == dim).orderBy("key", "unit").limit(SAMPLE).select("unit").toArrow()
    x = _matrix(rows.column("unit"))
    return _kmeans(x, count)


def robust_prune(x: np.ndarray, i: int, pool: np.ndarray) -> np.ndarray:
    """At most DEGREE of the pool, nearest first; one that lies ALPHA times nearer to a kept one than to i goes."""
    pool = np.unique(pool[pool != i])
    own = x[pool] @ x[i]
    order = np.argsort(-own, kind="stable")
    pool, far = pool[order], np.maximum(1 - own[order], 0)
    mutual = np.maximum(1 - x[pool] @ x[pool].T, 0)
    kept, alive = [], np.ones(len(pool), bool)
    for j in range(len(pool)):
        if alive[j]:
            kept.append(j)
            if len(kept) == DEGREE:
                break
            alive &= ~(ALPHA * mutual[j] <= far)
    return pool[kept]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of one shard: pruned nearest and far-off candidates, edges both ways, pruned again."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    rng = np.random.default_rng(n)
    k = min(POOL, n - 1)
    near = []
    for s in range(0, n, 1024):
        sims = x[s:s + 1024] @ x.T
        near.append(np.argpartition(-sims, k, axis=1)[:, :k + 1] if k + 1 < n else np.tile(np.arange(n), (len(sims), 1)))
    near = np.vstack(near)
    far = rng.integers(0, n, (n, 16))
    out = [robust_prune(x, i, np.concatenate([near[i], far[i]])) for i in range(n)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row:
            back[j].append(i)
    return [row if not back[i] else (both if len(both := np.union1d(row, back[i])) <= DEGREE else robust_prune(x, i, both)) for i, row in enumerate(out)]


def medoids(x: np.ndarray) -> np.ndarray:
    """The medoid of the shard and of a few parts of it, dealt by nearness to random members."""
    first = int((x @ x.mean(0)).argmax())
    rng = np.random.default_rng(len(x))
    seeds = x[rng.choice(len(x), min(ENTRIES - 1, len(x)), replace=False)]
    part = (x @ seeds.T).argmax(1)
    found = [first]
    for p in range(len(seeds)):
        own = np.flatnonzero(part == p)
        if len(own):
            found.append(int(own[(x[own] @ x[own].mean(0)).argmax()]))
    return np.unique(found)


def search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) with cosine >= threshold, all queries stepping together.

    ``own`` is each query's member number or -1; ``table`` holds adjacency rows filled up with
    the number of members.  A query that is a member itself lies within its own range, so the
    walk starts from it as well.
    """
    n, q = len(x), len(queries)
    padded = np.vstack([x, np.zeros((1, x.shape[1]))])
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    entry = medoids(x)
    width = max(BEAM, len(entry))
    beam = np.full((q, width), n)
    sims = np.full((q, width), -2.0)
    done = np.ones((q, width), bool)
    beam[:, :len(entry)], sims[:, :len(entry)], done[:, :len(entry)] = entry, queries @ x[entry].T, False
    seen[:, entry] = True
    hits = [np.argwhere(sims >= threshold)]
    hits = [np.column_stack([hits[0][:, 0], beam[hits[0][:, 0], hits[0][:, 1]]])]
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], -3.0, sims[active])
        best = open_.argmax(1)
        going = open_[np.arange(len(active)), best] > -2.5
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        step = max(1, PAIRS // (table.shape[1] * x.shape[1]))
        for s in range(0, len(active), step):
            a = active[s:s + step]
            near = table[beam[a, best[s:s + step]]]
            fresh = ~seen[a[:, None], near]
            near = np.where(fresh, near, n)
            seen[a[:, None], near] = True
            found = np.where(near < n, np.einsum("qrd,qd->qr", padded[near], queries[a]), -2.0)
            r, c = np.nonzero(found >= threshold)
            hits.append(np.column_stack([a[r], near[r, c]]))
            all_sims, all_ids = np.hstack([sims[a], found]), np.hstack([beam[a], near])
            all_done = np.hstack([done[a], near == n])
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[a], beam[a], done[a] = (np.take_along_axis(m, top, 1) for m in (all_sims, all_ids, all_done))
    # The walk follows edges both ways: a member that no list kept is still reached from its own.
    tail, column = np.nonzero(table[:n] < n)
    head = table[tail, column]
    edges = np.unique(np.concatenate([tail * n + head, head * n + tail]))
    at, heads = np.searchsorted(edges, np.arange(n + 1) * n), edges % n
    start = np.column_stack([np.flatnonzero(own >= 0), own[own >= 0]])
    new = start[~seen[start[:, 0], start[:, 1]]]
    seen[new[:, 0], new[:, 1]] = True
    frontier = np.vstack([*hits, new])
    hits.append(new)
    while len(frontier):
        grown, sizes = [], at[frontier[:, 1] + 1] - at[frontier[:, 1]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, PAIRS // x.shape[1] * 4))
        for s, e in zip(cuts, [*cuts[1:], len(frontier)]):
            part, size = frontier[s:e], sizes[s:e]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[part[:, 1]], size)
            who, near = np.repeat(part[:, 0], size), heads[place]
            fresh = ~seen[who, near]
            cells = np.unique(who[fresh] * n + near[fresh])
            who, near = cells // n, cells % n
            seen[who, near] = True
            for i in range(0, len(who), PAIRS // x.shape[1]):
                w, m = who[i:i + PAIRS // x.shape[1]], near[i:i + PAIRS // x.shape[1]]
                close = np.einsum("pd,pd->p", queries[w], x[m]) >= threshold
                grown.append(np.column_stack([w[close], m[close]]))
        frontier = np.vstack(grown) if grown else np.zeros((0, 2), np.int64)
        hits.append(frontier)
    pairs = np.vstack(hits)
    return pairs[:, 0], pairs[:, 1]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the given links join, at most one per end."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := up.setdefault(v, v)) != v:
            up[v] = v = up[p]
        return v

    kept = []
    for p, q in zip(a.tolist(), b.tolist()):
        r, s = root(p), root(q)
        if r != s:
            up[max(r, s)] = min(r, s)
            kept.append((p, q))
    return kept


def _homes(column) -> np.ndarray:
    """Homes of each row, filled up with -1 to the longest row."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(flat.value_lengths())
    out = np.full((len(flat), sizes.max(initial=1)), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.asarray(flat.flatten())
    return out


def _first_shared(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest cluster that row a of left and row b of right both hold."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for s in range(0, len(a), PAIRS):
        p = slice(s, s + PAIRS)
        for i in range(left.shape[1]):
            own = left[a[p], i].astype(np.int64)
            hit = (own >= 0) & (right[b[p]] == own[:, None]).any(1)
            out[p][hit] = np.minimum(out[p][hit], own[hit])
    return out


def ranks(sims: np.ndarray) -> np.ndarray:
    """Place of each cluster in the order that vectors are dealt by, from 1."""
    order = np.argsort(-sims, axis=1, kind="stable")
    out = np.empty(order.shape, np.int32)
    np.put_along_axis(out, order, np.arange(1, sims.shape[1] + 1, dtype=np.int32)[None, :], 1)
    return out


def fit(points: DataFrame) -> dict[int, np.ndarray]:
    """Cluster centres for each length of vectors."""
    sizes = {r["d"]: r["n"] for r in points.groupBy(F.size("unit").alias("d")).agg(F.count("*").alias("n")).collect()}
    return {d: centres(points, d, max(1, min(CENTRES, math.ceil(n / CLUSTER)))) for d, n in sizes.items()}


def truth(points: DataFrame, fitted: dict[int, np.ndarray], threshold: float) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """(overlap per length, {rep: (length, true links)}) from AUDIT vectors of each length against all others.

    The asked vectors are last in the hash's order, so that centres of large tables are not
    fitted to them.  Only counts leave the tasks.
    """
    asked = {}
    for d, c in fitted.items():
        rows = points.where(F.size("unit") == d).orderBy(F.desc("key"), F.desc("unit")).limit(AUDIT).select("rep", "unit").toArrow()
        x = _matrix(rows.column("unit"))
        asked[d] = np.asarray(rows.column("rep")), x, ranks(x @ c.T)

    def meet(batches):
        for batch in batches:
            lists, reps, copies = batch.column("unit"), np.asarray(batch.column("rep")), np.asarray(batch.column("copies"))
            dims = np.asarray(lists.value_lengths())
            out: list[tuple[int, int | None, int | None, int]] = []
            for d in map(int, np.unique(dims)):
                ids, q, order = asked[d]
                every = np.flatnonzero(dims == d)
                for s in range(0, len(every), 1024):
                    rows = every[s:s + 1024]
                    x = _matrix(lists.take(pa.array(rows)))
                    a, b = np.nonzero((q @ x.T >= threshold) & (ids[:, None] != reps[rows][None, :]))
                    if not len(a):
                        continue
                    own = ranks(x @ fitted[d].T)
                    n = np.bincount(a, copies[rows][b], len(ids)).astype(np.int64)
                    out += [(d, int(ids[i]), None, int(n[i])) for i in np.flatnonzero(n)]
                    step = max(1, PAIRS // own.shape[1])
                    least = np.concatenate([np.maximum(order[a[i:i + step]], own[b[i:i + step]]).min(1) for i in range(0, len(a), step)])
                    out += [(d, None, int(r), int(k)) for r, k in zip(*np.unique(least, return_counts=True))]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))] if out else
                                             [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64())], ["d", "rep", "rank", "n"])

    told = points.select("rep", "unit", "copies").mapInArrow(meet, "d int, rep bigint, rank int, n bigint").groupBy("d", "rep", "rank").agg(F.sum("n").alias("n")).collect()
    overlap = {}
    for d, c in fitted.items():
        counts = np.zeros(len(c) + 1, np.int64)
        for r in told:
            if r["d"] == d and r["rank"] is not None:
                counts[r["rank"]] = r["n"]
        least = int(np.searchsorted(np.cumsum(counts), SHARED * counts.sum())) if counts.sum() else 1
        overlap[d] = min(len(c), max(OVERLAP, least))
    return overlap, {r["rep"]: (r["d"], r["n"]) for r in told if r["rep"] is not None}


def audited(found: DataFrame, true: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Share of the true links of the asked vectors that were counted, per length of vectors."""
    if not true:
        return {}
    rows = found.sparkSession.createDataFrame([(r, d, n) for r, (d, n) in true.items()], "rep bigint, d int, n bigint")
    told = rows.join(found, "rep", "left").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0)))).alias("got")).collect()
    return {r["d"]: r["got"] / r["n"] for r in told}


def split(placed: DataFrame, sizes: dict[int, int], dim: int, taken: int) -> tuple[dict[int, tuple[int, np.ndarray]], int]:
    """Centres of the second level: cluster -> (number of its first leaf, centres), and the next free number.

    Only clusters over SPLIT are split.  Each is fitted by one task to at most INNER of its
    members, the first in the order of their hash.  All second-level centres together stay
    within CENTRE_BYTES, since they go to every task: beyond that a cluster gets fewer of them
    and its leaves are cut into blocks.
    """
    large = {c: n for c, n in sizes.items() if n > SPLIT}
    if not large:
        return {}, taken
    room = max(1, CENTRE_BYTES // (8 * dim))
    wanted = {c: math.ceil(n / CLUSTER) for c, n in large.items()}
    share = min(1.0, room / sum(wanted.values()))
    counts = {c: max(2, int(n * share)) for c, n in wanted.items()}
    inner = placed.select(F.explode("homes").alias("cluster"), "key", "unit").join(
        F.broadcast(placed.sparkSession.createDataFrame(list(counts.items()), "cluster int, leaves int")), "cluster")  # a row per first-level centre
    sample = first_rows(inner, ["cluster"], [F.col("key"), F.col("unit")], INNER)

    def fitted(key, table):
        c = _kmeans(_matrix(table.column("unit")), table.column("leaves")[0].as_py())
        return pa.table({"cluster": pa.array([key[0].as_py()] * len(c), pa.int32()), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    rows = sample.groupBy("cluster").applyInArrow(fitted, "cluster int, centre array<double>").toArrow()
    owner, matrix, out = np.asarray(rows.column("cluster")), _matrix(rows.column("centre")), {}
    for c in sorted(large):
        own = matrix[owner == c]
        out[c] = taken, own
        taken += len(own)
    return out, taken


def deal(points: DataFrame, fitted: dict[int, np.ndarray], overlap: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(members, queries) of all shards: shard, rep, unit, homes, with copies or the part of the queries.

    A vector is dealt to the nearest clusters and, in clusters over SPLIT, to the nearest
    leaves of a second level of centres; the leaves and the clusters without are its homes.
    Members of a home fall into blocks by a hash, and so do its queries; each block of queries
    meets each block of members.  As homes stay under SPLIT, a query visits a bounded number
    of shards however large the table is, but for crowds that no centre can part.
    """
    kind = key_type(points, "rep")
    base = dict(zip(fitted, np.cumsum([0, *(len(c) for c in fitted.values())]).tolist()))
    schema = f"rep {kind}, key bigint, unit array<double>, copies bigint, homes array<int>"
    names = ["rep", "key", "unit", "copies", "homes"]

    def nearest(x: np.ndarray, c: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :many]

    def assign(batches):
        for batch in batches:
            homes = [None] * batch.num_rows
            lists = batch.column("unit")
            dims = np.asarray(lists.value_lengths())
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                best = nearest(_matrix(lists.take(pa.array(rows))), fitted[int(d)], overlap[int(d)]) + base[int(d)]
                for r, h in zip(rows, best.tolist()):
                    homes[r] = h
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(homes, pa.list_(pa.int32()))], names)

    placed = cut(points.select(*names[:4]).mapInArrow(assign, schema))
    sizes = {r["cluster"]: r["count"] for r in placed.select(F.explode("homes").alias("cluster")).groupBy("cluster").count().collect()}  # one per centre
    leaves, taken = {}, sum(len(c) for c in fitted.values())
    for d, c in fitted.items():
        own = {i: n for i, n in sizes.items() if base[d] <= i < base[d] + len(c)}
        more, taken = split(placed.where(F.size("unit") == d), own, d, taken)
        leaves |= more
    if leaves:
        shared = placed.sparkSession.sparkContext.broadcast(leaves)  # at most CENTRE_BYTES per length of vectors

        def refine(batches):
            table = shared.value
            for batch in batches:
                lists, old = batch.column("unit"), batch.column("homes").to_pylist()
                asked: dict[int, list[int]] = {}
                for r, own in enumerate(old):
                    for c in own:
                        if c in table:
                            asked.setdefault(c, []).append(r)
                homes = [[c for c in own if c not in table] for own in old]
                for c, rows in asked.items():
                    first, centre = table[c]
                    x = _matrix(lists.take(pa.array(rows)))
                    for r, h in zip(rows, (nearest(x, centre, overlap[x.shape[1]]) + first).tolist()):
                        homes[r] += h
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(homes, pa.list_(pa.int32()))], names)

        placed = cut(placed.mapInArrow(refine, schema))
    members = placed.select(F.explode("homes").alias("cluster"), "rep", "unit", "copies", "homes")
    counts = stored(members.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "blocks")  # small, so Spark may broadcast it
    salt = F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int")
    shard = F.col("cluster").cast("long") * F.lit(1 << 24)
    members = members.join(counts, "cluster")
    asked = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = asked.select((shard + F.col("block")).alias("shard"), salt.alias("part"), "rep", "unit", "homes")
    return members.select((shard + salt).alias("shard"), "rep", "unit", "copies", "homes"), queries


def walks(points: DataFrame, fitted: dict[int, np.ndarray], overlap: dict[int, int], threshold: float) -> DataFrame:
    """(rep, found, other): links counted in each shard, and a forest of them."""
    members, queries = deal(points, fitted, overlap)

    def graph(key, table):
        x = _matrix(table.column("unit"))
        reps = np.asarray(table.column("rep"))
        lists = pa.array([reps[row] for row in build(x)], pa.list_(pa.int64()))
        return pa.table({"rep": pa.array(reps), "near": lists})

    adjacency = members.groupBy("shard").applyInArrow(graph, "rep bigint, near array<bigint>")
    # The lists of a vector from its shards, DEGREE each at most, become one.
    united = cut(adjacency.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    ready = members.join(united, "rep").select("shard", "rep", "unit", "copies", "homes", "near")
    parts = queries.select("shard", "part").distinct()
    ready = ready.join(parts, "shard").select("shard", "part", "rep", "unit", "copies", "homes", "near", F.lit(False).alias("asks"))
    asking = queries.select("shard", "part", "rep", "unit", F.lit(0).cast("bigint").alias("copies"), "homes", F.array().cast("array<bigint>").alias("near"), F.lit(True).alias("asks"))

    def walk(key, table):
        asks = np.asarray(table.column("asks"))
        member, query = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out = {"rep": [], "found": [], "other": []}
        if member.num_rows and query.num_rows:
            x, q = _matrix(member.column("unit")), _matrix(query.column("unit"))
            reps, asked, copies = (np.asarray(t.column(c)) for t, c in ((member, "rep"), (query, "rep"), (member, "copies")))
            place = {r: i for i, r in enumerate(reps.tolist())}
            n = len(x)
            rows = [[place[r] for r in near if r in place] for near in member.column("near").to_pylist()]
            width = max(1, max(map(len, rows)))
            adjacent = np.full((n + 1, width), n)
            for i, row in enumerate(rows):
                adjacent[i, :len(row)] = row
            own = np.array([place.get(r, -1) for r in asked.tolist()])
            a, b = search(q, own, x, adjacent, threshold)
            asker = np.full(n, -1)
            asker[own[own >= 0]] = np.flatnonzero(own >= 0)
            both = (own[a] >= 0) & (asker[b] >= 0)  # found from one end, so a link of the other
            cells = np.unique(np.concatenate([a * n + b, asker[b[both]] * n + own[a[both]]]))
            a, b = cells // n, cells % n
            other = asked[a] != reps[b]
            a, b = a[other], b[other]
            shared = _first_shared(_homes(query.column("homes")), _homes(member.column("homes")), a, b)
            counted = shared == key[0].as_py() >> 24  # a pair that shares clusters is met in each
            out["rep"] = asked.tolist()
            out["found"] = np.bincount(a[counted], copies[b[counted]], len(asked)).astype(np.int64).tolist()
            out["other"] = [None] * len(asked)
            for r, s in forest(asked[a], reps[b]):
                out["rep"].append(r)
                out["found"].append(0)
                out["other"].append(s)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return cut(ready.unionByName(asking).groupBy("shard", "part").applyInArrow(walk, "rep bigint, found bigint, other bigint"))


def links(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component, kept, audited_recall) per row of (vec_id, embedding).

    n_links counts the other rows linked directly, at cosine >= threshold; component is the
    smallest vec_id reached by links, the row's own included; kept tells whether that is its
    own.  Null, empty and zero vectors and those with null or non-finite components link with
    nothing, and neither do vectors of different lengths.  Equal vectors are collapsed first
    and counted again at the end.  Rows that repeat a vec_id count as rows.  A null vec_id
    names no component unless all of it is null.  Other columns are not read.
    ``audited_recall`` is the share of the true links of the audited vectors that were counted,
    the same for all rows (the least over lengths of vectors): under RECALL only if searching
    every cluster has not found more.
    """
    kind = key_type(vectors, "vec_id")
    unit = cut(units(vectors).withColumn("key", F.xxhash64("unit")))
    # One point per distinct vector, however many rows hold it; the checkpoint fixes its number.
    distinct = unit.where("unit is not null").groupBy("key", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    points = cut(distinct.withColumn("rep", F.monotonically_increasing_id()))
    fitted = fit(points)
    overlap, true = truth(points, fitted, threshold)
    while True:
        walked = walks(points, fitted, overlap, threshold)
        found = walked.groupBy("rep").agg(F.sum("found").alias("found"))
        shares = audited(found, true)
        poor = {d: share for d, share in shares.items() if share < RECALL}
        wider = {d: min(2 * o, len(fitted[d])) if d in poor else o for d, o in overlap.items()}
        if wider == overlap:
            break
        overlap = wider
    joined = components(walked.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    told = points.join(found, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    told = cut(told.select("key", "unit", "least", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    least = stored(told.groupBy("root").agg(F.min("least").alias("component")), "least")
    told = cut(told.join(least, "root").select("key", F.col("unit").alias("_unit"), "n_links", "component"))
    linked = unit.join(told, (unit["key"] == told["key"]) & (F.col("unit") == F.col("_unit")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component"))
    audit = min(shares.values(), default=1.0)
    return linked.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component")), "audited_recall": F.lit(float(audit))})


def recall(vectors: DataFrame, found: DataFrame, share: int = 100, threshold: float = COSINE) -> float:
    """Audit: share of true links that were found, over the rows whose vec_id hash falls in one
    of ``share`` parts, against all rows in blocks.  1.0 where there are none."""
    asked = units(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)).where("unit is not null").toArrow()
    ids, x = np.asarray(asked.column("vec_id")), asked.column("unit")
    if not len(ids):
        return 1.0
    q = _matrix(x)

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            keep = np.flatnonzero(np.asarray(batch.column("unit").value_lengths()) == q.shape[1])
            if len(keep):
                m = _matrix(batch.column("unit").take(pa.array(keep)))
                for s in range(0, len(m), 2048):
                    total += (q @ m[s:s + 2048].T >= threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = units(vectors).where("unit is not null").mapInArrow(count, "vec_id bigint, n bigint").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    row = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("got")).first()
    return float(row["got"]) / row["n"] if row["n"] else 1.0
