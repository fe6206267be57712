"""Merkle manifest of a corpus with incremental witnesses.

Every file is a leaf; the leaves of a package are one tree, and the roots of the packages are
the leaves of the corpus tree.  Leaves are appended in order to a frontier of open subtrees
that carry the partial witnesses of all leaves below them; when a sibling subtree completes,
the witnesses of both are extended.  Appends are aligned: ranges of BLOCK leaves are folded
apart from each other, and their roots are appends to a further frontier, until one is left.
So a package that holds a third of all files is folded by as many tasks as it has blocks, and
of the upper levels there is one row per block.  Texts are read once, for the leaf digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit.llm.common import placed, stored, stretches

HEIGHT = 10
BLOCK = 1 << HEIGHT  # leaves of a block: what one frontier holds at a time
LEFT, ALONE, RIGHT = -1, 0, 1  # side on which a sibling stands
SIBLINGS = T.ArrayType(T.StructType([T.StructField("side", T.IntegerType()), T.StructField("digest", T.StringType())]))
RESULT = ("position", "siblings", "subroot", "root")


def leaf(*fields: str | Column) -> Column:
    """Digest of a record: each value as its UTF-8 byte count, a colon and its text; null as a dash."""

    def framed(value: str | Column) -> Column:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def fold(start: Column, siblings: Column) -> Column:
    """Root that a leaf digest and its siblings, from the leaf upwards, lead to."""
    return F.aggregate(siblings, start, lambda node, s: F.sha2(
        F.when(s["side"] == LEFT, F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256))


def proof(siblings: Column) -> Column:
    """Digest of a witness: its siblings one after the other, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: s["digest"]), ""), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """Open subtrees of an append-only tree, high ones first; no two are equally high.

    Each holds its height, its root and the witnesses of the leaves below it: lists of
    (side, digest) that grow while the subtree is joined with others.
    """

    def __init__(self):
        self.open: list[tuple[int, str, list[list[tuple[int, str]]]]] = []
        self.witnesses: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        node = 0, digest, self.witnesses[-1:]
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def close(self, height: int = 0) -> str:
        """Root after the last append: a subtree without a sibling rises alone, until one
        subtree is left and is at least ``height`` high."""
        while len(self.open) > 1 or self.open[0][0] < height:
            level, root, below = self.open.pop()
            if self.open and self.open[-1][0] == level:
                self.open.append(self._joined(self.open.pop(), (level, root, below)))
            else:
                for witness in below:
                    witness.append((ALONE, ""))
                self.open.append((level + 1, _hash(root), below))
        return self.open[0][1]

    @staticmethod
    def _joined(left, right):
        for witness in left[2]:
            witness.append((RIGHT, right[1]))
        for witness in right[2]:
            witness.append((LEFT, left[1]))
        return left[0] + 1, _hash(left[1] + right[1]), left[2] + right[2]


def _folded(nodes: DataFrame) -> DataFrame:
    """The nodes with their witness inside their block and the root of the block."""
    out = T.StructType([*nodes.schema.fields, T.StructField("_siblings", SIBLINGS), T.StructField("_top", T.StringType())])

    def block(rows: pa.Table) -> pa.Table:
        frontier = Frontier()
        for digest in rows.column("_digest").to_pylist():
            frontier.append(digest)
        # A tree of several blocks has all of them equally high; a tree of one ends with its root.
        top = frontier.close(HEIGHT if rows.column("_n")[0].as_py() > BLOCK else 0)
        steps = [s for w in frontier.witnesses for s in w]
        offsets = pa.array([0, *accumulate(map(len, frontier.witnesses))], pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in steps], pa.int32()), pa.array([d for _, d in steps], pa.string())], ["side", "digest"])
        return rows.append_column("_siblings", pa.ListArray.from_arrays(offsets, pairs)).append_column("_top", pa.array([top] * len(rows), pa.string()))

    def run(batches):
        done: list[pa.Table] = []
        many = 0
        for rows in stretches(batches, "_scope", "_block"):
            done.append(block(rows))
            many += len(rows)
            if many >= 4 * BLOCK:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, many = [], 0
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    dealt = nodes.repartition("_scope", "_block").sortWithinPartitions("_scope", "_block", "_position")
    return dealt.mapInArrow(run, out)


def _climb(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (_scope, _position, _n, _digest, ...) with what ``finish`` adds to the one node that
    is left of each scope; ``_siblings`` comes before what that one has.

    One round folds blocks of BLOCK nodes; the roots of the blocks are the nodes of the next.
    """
    if (nodes.agg(F.max("_n")).first()[0] or 0) <= 1:
        return finish(nodes)
    folded = stored(_folded(nodes.withColumn("_block", F.shiftright("_position", HEIGHT))), "blocks")
    tops = folded.where(F.col("_position") % BLOCK == 0).select(
        "_scope", F.col("_block").alias("_position"), F.shiftright(F.col("_n") + BLOCK - 1, HEIGHT).alias("_n"), F.col("_top").alias("_digest"))
    above = _climb(tops, finish).drop("_n", "_digest").withColumnsRenamed({"_scope": "_above_scope", "_position": "_above", "_siblings": "_above_siblings"})
    both = folded.join(above, folded["_scope"].eqNullSafe(above["_above_scope"]) & (folded["_block"] == above["_above"]))
    return both.withColumn("_siblings", F.concat("_siblings", "_above_siblings")).drop("_block", "_top", "_above_scope", "_above", "_above_siblings")


def witnesses(leaves: DataFrame, group: str = "skill_id", key: str = "path", digest: str = "leaf") -> DataFrame:
    """The rows with their place in the manifest: position, siblings, subroot, root.

    ``leaves`` has a digest per file (see ``leaf``).  Files of a package ascend by key, nulls
    first, and by digest where keys repeat; each repeated row is a leaf of its own.  While
    several nodes are left, each two neighbours become their digest, a last one without a
    neighbour becomes its own digest.  What is left is the package's ``subroot``; these,
    ordered by package (the null package first), lead to ``root`` alike.  ``siblings`` are
    the witness from the leaf to the root, one per level, on their side; ALONE where a node
    had no neighbour.  ``fold(digest, siblings)`` gives the root.  A null digest counts as the
    digest of an empty text.  All other columns stay; columns with the names of the result
    are replaced.  An empty table gives an empty one.
    """
    clean = leaves.drop(*(c for c in RESULT if c not in (group, key, digest)))
    names = clean.columns
    nodes = clean.withColumns({"_scope": F.col(group), "_digest": F.coalesce(F.col(digest), F.sha2(F.lit(""), 256))})
    nodes = placed(nodes, ["_scope"], [key, "_digest"], "_position", "_n")

    def corpus(roots: DataFrame) -> DataFrame:
        """Roots of packages are the leaves of the corpus tree."""
        mine = roots.drop("_position", "_n").withColumnsRenamed({"_scope": "_package", "_digest": "_subroot"}).withColumns({"_scope": F.lit(0), "_digest": F.col("_subroot")})
        done = _climb(placed(mine, ["_scope"], ["_package"], "_position", "_n"), lambda d: d.withColumns({"_siblings": F.array().cast(SIBLINGS), "_root": F.col("_digest")}))
        return done.drop("_scope", "_digest").withColumnRenamed("_package", "_scope").withColumn("_position", F.lit(0).cast("long"))

    found = _climb(nodes, corpus)
    return found.select(*names, *(F.col(f"_{c}").alias(c) for c in RESULT))


def manifest(files: DataFrame, fields: tuple[str, ...] = ("skill_id", "path", "content")) -> DataFrame:
    """``witnesses`` of package files by the digest of the given fields."""
    return witnesses(files.withColumn("leaf", leaf(*fields)))
