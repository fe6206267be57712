"""Prefix trie of step sequences, built as a burst trie.

Packages that were copied from a template begin with the same declared steps.  Each package
is a sequence of step ids; all sequences start in one container under the root of the trie.
A container whose suffixes hold more than LIMIT steps bursts: what its suffixes share becomes
a chain of nodes, and the next step id deals them to new heads with a container each.  What
remains is small: containers lie in shards, hashed by their head, and a task sorts the
suffixes of each and sweeps over them once to make their nodes.  Counts of burst nodes are
then added up from the last round to the first.  Only ids are shuffled, no texts.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packaudit.functions.tables import cut
from packaudit.llm.common import key_type, placed, stored, stretches

LIMIT = 50_000  # steps of a container that one task sorts
CHAIN = 1024  # nodes of a chain that are added up together
NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ("skill_id", "depth", "parent_skill_id", "n_skills", "n_children", "n_leaves", "saved_chars", "ends_sha256")
_HEAD = ["head", "head_depth"]


def items(steps: DataFrame) -> DataFrame:
    """(skill_id, step_index, item, n_chars) per step: ``item`` stands for its action and
    description, null being empty; steps are the same if both are."""
    action, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("action", "description"))
    framed = F.concat(F.octet_length(action).cast("string"), F.lit(":"), action, text)
    return steps.select("skill_id", "step_index", F.unhex(F.md5(framed.cast("binary"))).alias("item"), F.char_length(text).cast("long").alias("n_chars"))


def in_order(steps: DataFrame) -> DataFrame:
    """Items (see ``items``) with ``depth``, their place in the package from 1, and ``n_steps``.

    Order is by step_index, null first; steps with the same index follow each other by item.
    """
    found = placed(steps, ["skill_id"], ["step_index", "item"], "depth", "n_steps")
    return found.withColumn("depth", F.col("depth") + 1)


def sweep(members: list[tuple[list[bytes], object, list[int]]], depth: int, head: object) -> list[list]:
    """Nodes below a head at ``depth``, of members (item ids, key, characters) in any order.

    Rows hold key, depth, parent key, members, children, leaves, saved characters and the
    digest of the keys that end there.
    """
    out: list[list] = []
    open_: list[dict] = []

    def close() -> None:
        node = open_.pop()
        leaves, saved = node["leaves"] or 1, node["saved"] + (node["n"] - 1) * node["chars"]
        for child in node["below"]:
            out[child][2] = node["least"]
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest() if node["ends"] else NO_ENDS
        out.append([node["least"], depth + len(open_) + 1, head, node["n"], len(node["below"]), leaves, saved, ends])
        if open_:
            up = open_[-1]
            up["below"].append(len(out) - 1)
            up["n"] += node["n"]
            up["leaves"] += leaves
            up["saved"] += saved
            up["least"] = node["least"] if up["least"] is None else min(up["least"], node["least"])

    before: list[bytes] = []
    for ids, key, chars in sorted(members, key=lambda m: m[0]):
        same = next((i for i, (a, b) in enumerate(zip(before, ids)) if a != b), min(len(before), len(ids)))
        while len(open_) > same:
            close()
        for i in range(same, len(ids)):
            open_.append({"n": 0, "least": None, "leaves": 0, "saved": 0, "chars": chars[i], "ends": [], "below": []})
        last = open_[-1]
        last["ends"].append(key)
        last["n"] += 1
        last["least"] = key if last["least"] is None else min(last["least"], key)
        before = ids
    while open_:
        close()
    return out


def _swept(suffixes: DataFrame, kind: str) -> DataFrame:
    """Nodes of the containers that remain, from (head, head_depth, skill_id, depth, item, n_chars)."""
    names = [*_HEAD, *RESULT]
    schema = f"head {kind}, head_depth bigint, skill_id {kind}, depth bigint, parent_skill_id {kind}, n_skills bigint, n_children bigint, n_leaves bigint, saved_chars bigint, ends_sha256 string"

    def run(batches):
        rows: list[list] = []
        key = None

        def flush():
            columns = list(zip(*rows))
            types = [key, pa.int64(), key, pa.int64(), key, *[pa.int64()] * 4, pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            rows.clear()
            return batch

        for container in stretches(batches, *_HEAD):
            key = container.schema.field("skill_id").type
            head, depth = (container.column(c)[0].as_py() for c in _HEAD)
            members: dict = {}
            for m, item, chars in zip(*(container.column(c).to_pylist() for c in ("skill_id", "item", "n_chars"))):
                ids, sizes = members.setdefault(m, ([], []))
                ids.append(item)
                sizes.append(chars)
            rows.extend([head, depth, *node] for node in sweep([(ids, m, sizes) for m, (ids, sizes) in members.items()], depth, head))
            if len(rows) >= 4096:
                yield flush()
        if rows:
            yield flush()

    dealt = suffixes.select(*_HEAD, "skill_id", "depth", "item", "n_chars").repartition(*_HEAD).sortWithinPartitions(*_HEAD, "skill_id", "depth")
    return dealt.mapInArrow(run, schema)


def _burst(open_: DataFrame, steps: DataFrame, big: DataFrame):
    """One round: chains, children and ends of the containers in ``big``, and the members' new heads."""
    moving = open_.join(big.drop("n_steps"), _HEAD)
    rows = steps.join(moving, "skill_id").where(F.col("depth") > F.col("head_depth"))
    level = cut(rows.groupBy(*_HEAD, "lead", "members", "depth").agg(F.count("*").alias("here"), F.min("item").alias("low"), F.max("item").alias("high"), F.max("n_chars").alias("n_chars")))
    parts = (F.col("here") < F.col("members")) | (F.col("low") != F.col("high"))
    stop = cut(level.groupBy(*_HEAD, "lead", "members").agg(F.coalesce(F.min(F.when(parts, F.col("depth"))), F.max("depth") + 1).alias("stop")))
    chain = cut(level.join(stop.drop("lead", "members"), _HEAD).where("depth < stop").select(
        *_HEAD, "lead", "stop", "depth", F.col("members").alias("n_skills"), ((F.col("members") - 1) * F.col("n_chars")).alias("own")))
    # Who goes on beyond the chain, and with which step.
    at = cut(rows.join(stop.drop("lead", "members"), _HEAD).where("depth = stop").select(*_HEAD, "lead", "stop", "skill_id", "length", "item", "n_chars"))
    children = cut(at.groupBy(*_HEAD, "lead", "stop", "item").agg(F.min("skill_id").alias("skill_id"), F.count("*").alias("n_skills"), F.max("n_chars").alias("n_chars")).withColumn(
        "own", (F.col("n_skills") - 1) * F.col("n_chars")))
    dealt = cut(at.join(children.select(*_HEAD, "item", F.col("skill_id").alias("_new")), [*_HEAD, "item"]).select(
        "skill_id", "length", F.col("_new").alias("head"), F.col("stop").alias("head_depth")))
    ended = moving.join(stop.select(*_HEAD, "stop"), _HEAD).where("length < stop").select(F.col("lead").alias("node"), F.col("length").alias("depth"), "skill_id")
    ended = ended.unionByName(dealt.where("length = head_depth").select(F.col("head").alias("node"), F.col("head_depth").alias("depth"), "skill_id"))
    return chain, children.drop("item", "n_chars"), ended, dealt.where("length > head_depth")


def _digests(ends: DataFrame, kind: str) -> DataFrame:
    """(node, depth, ends_sha256) over (node, depth, skill_id): keys of a node pass through one
    digest in ascending order, never as a list; SHA-256 is sequential, so they do so in one task."""

    def run(batches):
        key, digest, done, last = None, None, [], None

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in done], last), pa.array([d for _, d, _ in done], pa.int64()), pa.array([h for _, _, h in done], pa.string())], ["node", "depth", "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            last = batch.schema.field("node").type
            for node, depth, m in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "skill_id"))):
                if (node, depth) == key:
                    digest.update(f",{m}".encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256(str(m).encode())
            if len(done) >= 4096:
                yield flush()
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield flush()

    dealt = ends.repartition("node", "depth").sortWithinPartitions("node", "depth", "skill_id")
    return dealt.mapInArrow(run, f"node {kind}, depth bigint, ends_sha256 string")


def trie(steps: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """One row per node of the prefix trie of the packages' step sequences.

    ``steps`` holds (skill_id, depth, item, n_chars), depths of a package being 1, 2, 3, ...
    (see ``in_order``); ``packages`` names all packages, for those without steps.  A node is a
    distinct sequence of first steps, from the empty one at depth 0; packages that start with
    it are its members.  Returned are its smallest member ``skill_id`` and ``depth``, which
    identify it; ``parent_skill_id`` (null for the root); ``n_skills`` members;
    ``n_children``; ``n_leaves``, nodes without children in its subtree, itself included;
    ``saved_chars``, summed over its subtree: each node's (n_skills - 1) times the characters
    of its last step, what storing each shared step once would save; ``ends_sha256`` of the
    ascending keys of the members that end there, joined by commas.

    Rows with a null skill_id belong to no package and are left out.  Packages with the same
    steps share all nodes.  Repeated packages count once.  Other columns are not read.
    Without any package there is no node.

    A round bursts every container over LIMIT, and goes past all that its members share at
    once, so rounds grow with the number of branchings on the way to small containers, not
    with the length of sequences.
    """
    kind = key_type(steps, "skill_id")
    steps = stored(steps.where("skill_id is not null").select("skill_id", F.col("depth").cast("long").alias("depth"), "item", F.col("n_chars").cast("long").alias("n_chars")), "steps")
    members = steps.groupBy("skill_id").agg(F.max("depth").alias("length"))
    if packages is not None:
        names = packages.where("skill_id is not null").select("skill_id").distinct()
        members = names.join(members, "skill_id", "full").select("skill_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    members = cut(members)
    root = members.agg(F.min("skill_id").alias("skill_id"), F.count("*").alias("n_skills")).where("n_skills > 0").select("skill_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kind).alias("parent_skill_id"), "n_skills", F.lit(0).cast("long").alias("own"))
    root = cut(root)
    at_root = root.select(F.col("skill_id").alias("head"), F.lit(0).cast("long").alias("head_depth"))
    open_ = members.where("length > 0").crossJoin(F.broadcast(at_root))  # one row
    ends = [members.where("length = 0").crossJoin(F.broadcast(at_root)).select(F.col("head").alias("node"), F.col("head_depth").alias("depth"), "skill_id")]

    rounds = []
    while True:
        sizes = open_.groupBy(*_HEAD).agg(F.sum(F.col("length") - F.col("head_depth")).alias("n_steps"), F.count("*").alias("members"), F.min("skill_id").alias("lead"))
        big = cut(sizes.where(F.col("n_steps") > LIMIT))
        if big.isEmpty():
            break
        chain, children, ended, moved = _burst(open_, steps, big)
        rounds.append((chain, children))
        ends.append(ended)
        open_ = cut(open_.join(big.select(*_HEAD), _HEAD, "left_anti").unionByName(moved))

    swept = stored(_swept(steps.join(open_, "skill_id").where(F.col("depth") > F.col("head_depth")), kind), "nodes")
    below = swept.where(F.col("depth") == F.col("head_depth") + 1).groupBy(*_HEAD).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_chars").alias("saved_chars"))

    made = []  # burst nodes, all columns but the digest
    columns = [c for c in RESULT if c != "ends_sha256"]

    def with_below(nodes: DataFrame) -> DataFrame:
        under = below.select(F.col("head").alias("skill_id"), F.col("head_depth").alias("depth"), "n_children", "n_leaves", F.col("saved_chars").alias("_under"))
        return nodes.join(under, ["skill_id", "depth"], "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_chars": F.col("own") + F.coalesce("_under", F.lit(0))}).drop("_under")

    for chain, children in reversed(rounds):
        before = F.when(F.col("stop") - 1 == F.col("head_depth"), F.col("head")).otherwise(F.col("lead"))
        found = cut(with_below(children.withColumns({"depth": F.col("stop"), "parent_skill_id": before})))
        made.append(found.select(*columns))
        sums = found.groupBy(*_HEAD).agg(F.count("*").alias("forks"), F.sum("n_leaves").alias("leaves"), F.sum("saved_chars").alias("saved"))
        # Sums from the end of a chain, by stretches of it.
        part = F.floor(F.col("depth") / CHAIN)
        inside = Window.partitionBy(*_HEAD, "part").orderBy(F.desc("depth"))
        after = Window.partitionBy(*_HEAD).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        parts = chain.withColumn("part", part)
        totals = parts.groupBy(*_HEAD, "part").agg(F.sum("own").alias("part_own")).withColumn("later", F.coalesce(F.sum("part_own").over(after), F.lit(0)))
        links = parts.withColumn("own_after", F.sum("own").over(inside)).join(totals, [*_HEAD, "part"]).join(sums, _HEAD, "left").select(
            F.col("lead").alias("skill_id"), "depth", F.when(F.col("depth") - 1 == F.col("head_depth"), F.col("head")).otherwise(F.col("lead")).alias("parent_skill_id"), "n_skills",
            F.when(F.col("depth") < F.col("stop") - 1, 1).otherwise(F.coalesce("forks", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own_after") + F.col("later") + F.coalesce("saved", F.lit(0))).alias("saved_chars"))
        made.append(links)
        chains = chain.groupBy(*_HEAD).agg(F.sum("own").alias("chain_own"))
        new = chains.join(sums, _HEAD, "full").select(
            *_HEAD, F.when(F.col("chain_own").isNotNull(), 1).otherwise(F.col("forks")).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("chain_own", F.lit(0)) + F.coalesce("saved", F.lit(0))).alias("saved_chars"))
        below = cut(below.unionByName(new))
    made.append(with_below(root).select(*columns))
    burst = reduce(DataFrame.unionByName, made)
    digests = _digests(reduce(DataFrame.unionByName, ends), kind).withColumnRenamed("node", "skill_id")
    burst = burst.join(digests, ["skill_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return burst.select(*RESULT).unionByName(swept.select(*RESULT))
