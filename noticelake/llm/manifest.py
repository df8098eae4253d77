"""Merkle manifest of a dataset: a tree of SHA-256 digests a source, and one over the sources' roots.

Leaves ascend by ``doc_id`` within their source; while a tree has several nodes
on a level, every ``FAN`` consecutive ones become the digest of their hex texts.

A parent keeps a copy of its hash state from before each of its child slots
(midstates).  Folding a replaced child up the tree resumes the state of its slot
with the replacement and the siblings to its right; those to its left are never
hashed again.

Work is cut at blocks of ``FAN ** LEVELS`` leaves, three levels: one pass over sorted
blocks gives the blocks' own digests, whose trees are built in the same way until
one node is left; a second pass holds one block's states at a time and folds all
its documents up to the root, the levels above the block by one state each.  So
no task holds more than a block, whatever a source's share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import lower_ascii, stored

FAN = 16
LEVELS = 3
#: Columns that name a tree: 0 for the null source, and the source.
TREE = ("named", "name")


def digest(*values: Column) -> Column:
    """SHA-256 as lower-case hex of the values, each ``-`` if null, else the number of its UTF-8 bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a document, optionally with another text than its own."""
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text") if text is None else text)


def _placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Appends ``at``, a node's place in its tree by ``order``, and ``size``, the tree's nodes.

    A range sort deals any tree to as many tasks as its share needs; places are
    those within a task's run plus what the runs before hold.  Nodes that are
    equal in all of ``order`` are spread by the place where they lie, as their
    order makes no difference.
    """
    keys = [F.asc_nulls_first(c) for c in (*TREE, *order)]
    spread = nodes.withColumn("_lies", F.monotonically_increasing_id()).repartitionByRange(*keys, F.asc("_lies")).sortWithinPartitions(*keys, F.asc("_lies"))
    run = stored(spread.drop("_lies").withColumn("_id", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_id", 33)))
    counts = run.groupBy("_run", *TREE).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy(*TREE)
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("_run", *TREE, "_first", before.alias("_before"), F.sum("_n").over(tree).alias("size")))
    return run.join(counts, ["_run", *TREE]).withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_run", "_id", "_first", "_before")


def levels_of(size: int, most: int) -> int:
    """Levels above the leaves of a block in a tree of so many leaves."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // FAN), levels + 1
    return levels


class Midstates:
    """The tree of a block: on each level the nodes, and for each node its parent's hash state before it."""

    def __init__(self, digests: Sequence[str], levels: int) -> None:
        self.nodes, self.states = [[d.encode() for d in digests]], []
        for _ in range(levels):
            below, states, above = self.nodes[-1], [], []
            for k in range(0, len(below), FAN):
                h = hashlib.sha256()
                for d in below[k : k + FAN]:
                    states.append(h.copy())
                    h.update(d)
                above.append(h.hexdigest().encode())
            self.states.append(states)
            self.nodes.append(above)

    def top(self) -> bytes:
        return self.nodes[-1][0]

    def fold(self, at: int, replaced: bytes) -> bytes:
        """The block's digest with another node at a leaf's place."""
        for below, states in zip(self.nodes, self.states):
            h = states[at].copy()
            h.update(replaced)
            h.update(b"".join(below[at + 1 : at - at % FAN + FAN]))
            replaced, at = h.hexdigest().encode(), at // FAN
        return replaced

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """For each level what stands left and right of the node that leads to a leaf."""
        out = []
        for below in self.nodes[:-1]:
            begin = at - at % FAN
            out.append((b"".join(below[begin:at]), b"".join(below[at + 1 : begin + FAN])))
            at //= FAN
        return out


def _steps(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode() for x in step.split(":")) for step in path.split("/")] if path else []


def _path(steps: list[tuple[bytes, bytes]]) -> str:
    return "/".join(f"{a.decode()}:{b.decode()}" for a, b in steps)


def _runs(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key of a sorted stream, across its batches."""
    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        for c in keys:
            new |= (frame[c] != frame[c].shift()).to_numpy()
        edges = [*np.flatnonzero(new), len(frame)]
        for a, b in zip(edges[:-2], edges[1:]):
            yield frame.iloc[a:b]
        held = frame.iloc[edges[-2] :]
    if held is not None and len(held):
        yield held


_KEYS = (*TREE, "block")


def _tops(levels: int):
    def run_tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for run in _runs(frames, _KEYS):
            first = run.iloc[0]
            out.append((first["named"], first["name"], first["block"], first["size"], Midstates(list(run["digest"]), levels_of(int(first["size"]), levels)).top().decode()))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=[*_KEYS, "size", "digest"])
                out = []
        yield pd.DataFrame(out, columns=[*_KEYS, "size", "digest"])

    return run_tops


def _climbed(levels: int):
    def run_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames, _KEYS):
            head, nodes = run.iloc[0], run.iloc[1:]
            tree = Midstates(list(nodes["digest"]), levels_of(int(head["size"]), levels))
            paths = ["/".join(x for x in (_path(tree.siblings(k)), head["path"]) if x) for k in range(len(nodes))]
            yield pd.DataFrame({"named": nodes["named"], "name": nodes["name"], "at": nodes["at"], "path": paths})

    return run_paths


def _in_blocks(rows: DataFrame, levels: int, heads: DataFrame | None = None) -> DataFrame:
    """Rows dealt by block and sorted there, each block's head first where there is one."""
    rows = rows.withColumn("block", F.expr(f"at div {FAN**levels}"))
    if heads is not None:
        rows = heads.withColumn("at", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "at")


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(named, name, at, size, digest) -> the trees' roots (named, name, digest), and for each block of nodes (named, name, block, size, path) the siblings on the way from its digest to the root."""
    blocks = _in_blocks(nodes.select(*TREE, "at", "size", "digest"), levels)
    tops = stored(blocks.select(*_KEYS, "at", "size", "digest").mapInPandas(_tops(levels), "named int, name string, block long, size long, digest string"))
    if tops.where(F.col("size") > FAN**levels).isEmpty():
        return tops.select(*TREE, "digest"), tops.select(*_KEYS, "size", F.lit("").alias("path"))
    upper = tops.select(*TREE, F.col("block").alias("at"), F.ceil(F.col("size") / FAN**levels).alias("size"), "digest")
    roots, heads = climb(upper, levels)
    paths = node_paths(upper, heads, levels).select(*TREE, F.col("at").alias("block"), "path")
    return roots, tops.select(*_KEYS, "size").join(paths, list(_KEYS))


def node_paths(nodes: DataFrame, heads: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(named, name, at, path): the siblings on the way from each node to its tree's root."""
    rows = _in_blocks(nodes.select(*TREE, "at", "size", "digest"), levels, heads)
    return stored(rows.select(*_KEYS, "at", "size", "digest", "path").mapInPandas(_climbed(levels), "named int, name string, at long, path string"))


_FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folding(root: str, levels: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        final = root.encode()
        for run in _runs(frames, _KEYS):
            head, docs = run.iloc[0], run.iloc[1:]
            tree = Midstates(list(docs["leaf"]), levels_of(int(head["size"]), levels))
            above = _steps(head["path"])
            beyond = b"".join(a + b for a, b in above)
            resumed = [(hashlib.sha256(left), right) for left, right in above]
            proofs, folded = [], []
            for k, changed in enumerate(docs["changed"]):
                proof = hashlib.sha256(b"".join(a + b for a, b in tree.siblings(k)))
                proof.update(beyond)
                proofs.append(proof.hexdigest())
                d = tree.fold(k, changed.encode())
                for state, right in resumed:
                    h = state.copy()
                    h.update(d)
                    h.update(right)
                    d = h.hexdigest().encode()
                folded.append(d == final and root or d.decode())
            yield pd.DataFrame({
                "doc_id": docs["doc_id"].astype("Int64"), "leaf": docs["leaf"], "subroot": head["subroot"], "root": root,
                "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded],
            })

    return fold


def tampered(docs: DataFrame) -> Column:
    """Which documents the check tampers with: those where 5 divides the CRC-32 of the decimal id; never those without one."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row.

    ``changed`` is the text that is held against the manifest (the document's
    own by default); ``folded_root`` is what its leaf and the siblings give, and
    ``verified`` whether that is the root.  Null fields count as ``-``.  Rows
    without a ``doc_id`` come first in their source, rows with the same id are
    ordered by their leaves, and rows that repeat are leaves of their own.  The
    null source is a tree of its own, before the others; a lone leaf is its
    tree's root.  An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in ("source", "lang", "n_chars", "text")])
    own = leaves(docs)
    other = own if changed is None else F.when(changed.eqNullSafe(F.col("text")), own).otherwise(leaves(docs, changed))
    named = F.col("source").isNotNull().cast("int").alias("named")
    # written before the range sort, whose sample would read and hash every text a second time
    hashed = stored(docs.select(named, F.coalesce("source", F.lit("")).alias("name"), "doc_id", own.alias("leaf"), other.alias("changed")))
    placed = stored(_placed(hashed, ["doc_id", "leaf"]))
    roots, heads = climb(placed.withColumnRenamed("leaf", "digest"), levels)
    roots = stored(roots)
    # the tree of the sources' roots: all of them under one name
    under = [F.lit(0).alias("named"), F.lit("").alias("name")]
    ordered = stored(_placed(roots.select(*under, F.col("named").alias("of"), F.col("name").alias("of_name"), "digest"), ["of", "of_name"]))
    top, top_heads = climb(ordered, levels)
    paths = node_paths(ordered, top_heads, levels).select("at", F.col("path").alias("rest"))
    rest = ordered.select("at", F.col("of").alias("named"), F.col("of_name").alias("name"), F.col("digest").alias("subroot")).join(paths, "at").drop("at")
    join = F.concat_ws("/", F.nullif("path", F.lit("")), F.nullif("rest", F.lit("")))
    heads = heads.join(rest, list(TREE)).select(*_KEYS, "size", "subroot", join.alias("path"))
    root = top.first()  # one row: the tree over all sources
    rows = _in_blocks(placed.select(*TREE, "at", "doc_id", "leaf", "changed"), levels, heads)
    return rows.select(*_KEYS, "at", "size", "doc_id", "leaf", "changed", "path", "subroot").mapInPandas(_folding(root["digest"] if root else "", levels), _FOLDED)


def check_against_tampered(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``manifest`` with the texts of the tampered documents lower-cased (A-Z only; null texts stay)."""
    return manifest(docs, F.when(tampered(docs), lower_ascii(F.col("text"))).otherwise(F.col("text")), levels)
