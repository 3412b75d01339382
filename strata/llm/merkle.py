"""Merkle dataset manifest: a leaf for every row, a witness for every leaf, built incrementally.

Leaves are appended in order, ``BLOCK`` aligned ones a task.  A block's open subtrees form a
stack: a new node that meets an open sibling closes it, and the closing extends the partial
witness of every leaf on both sides by the other side's root.  The roots of the blocks are
appended likewise as nodes of the next level, block by block, until one root remains; their
witnesses extend those of their leaves.  No task holds more than ``BLOCK`` nodes, whatever the
size of a group, and a group that holds most rows spreads over as many tasks as it has blocks.

Rules: ``H`` is the lower-case hex sha256 of its inputs put together, digests as hex text.  A
leaf is H of the named columns, each ``-`` for a null, else its UTF-8 byte count, ``:`` and the
value.  Within a group, leaves ascend by ``doc_id``; while there are several nodes, each pair
becomes its H, and a last single one the H of itself.  Groups' roots, the null group first and
then by UTF-8 bytes, form the tree above in the same way.

Defined results: rows with equal ids are ordered by their leaves (equal leaves are
interchangeable); a null id comes first; a null group is a group; a group of one row has its
leaf as its root; an empty table gives an empty manifest; texts are hashed whole; columns that
are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bounded, placed, ship, written

ship(__name__)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10  # of a block's subtree
BLOCK = 1 << HEIGHT
BROADCAST_ROWS = 10_000  # block roots, each with a witness of at most some 60 digests


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def node(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Witnesses:
    """A streaming append: a stack of open subtrees, and a partial witness for each leaf."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int]] = []  # height, root, first leaf
        self.paths: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        self.paths.append([])
        self._push(0, digest, len(self.paths) - 1)

    def _push(self, height: int, root: bytes, first: int) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, start = self.open.pop()
            for path in self.paths[start:first]:
                path.append(root)
            for path in self.paths[first:]:
                path.append(left)
            height, root, first = height + 1, node(left, root), start
        self.open.append((height, root, first))

    def close(self, height: int | None) -> bytes:
        """The root once nothing more is appended, at ``height`` if one is given: single last
        nodes are lifted, which adds nothing to a witness."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            h, root, first = self.open.pop()
            self._push(h + 1, node(root), first)
        return self.open[0][1]


def _appended(rows: pa.Table) -> pa.Table:
    """The witnesses of one block's nodes within the block, and the block's root."""
    rows = rows.sort_by("at")
    block = Witnesses()
    for digest in rows["digest"].to_pylist():
        block.append(digest)
    root = block.close(HEIGHT if rows["total"][0].as_py() > BLOCK else None)
    return pa.table({"g": rows["g"], "at": rows["at"], "path": pa.array([b"".join(p) for p in block.paths], pa.binary()),
                     "root": pa.array([root] * rows.num_rows, pa.binary())})


def witnesses(nodes: DataFrame) -> DataFrame:
    """``g, at, digest, total`` (place in and size of group ``g``) -> ``g, at, path, root``: every
    node's siblings up to its group's root, 32 bytes each, and that root."""
    level, levels = nodes, []
    while True:
        grouped = level.groupBy("g", F.shiftright("at", HEIGHT).alias("block"))
        done = written(grouped.applyInArrow(_appended, "g string, at long, path binary, root binary"), "witnesses")
        levels.append(done)
        sizes = level.where(f"total > {BLOCK}").select("g", "at", "total")
        if sizes.isEmpty():
            break
        roots = done.where(F.col("at") % BLOCK == 0).join(sizes.withColumnsRenamed({"g": "g2", "at": "at2"}),
                                                         (F.col("g") == F.col("g2")) & (F.col("at") == F.col("at2")))
        level = written(roots.select("g", F.shiftright("at", HEIGHT).alias("at"), F.col("root").alias("digest"),
                                     F.shiftright(F.col("total") + (BLOCK - 1), HEIGHT).alias("total")), "block-roots")
    out = levels.pop()
    while levels:  # the blocks' witnesses extend those of their nodes
        above = out.select(F.col("g").alias("g2"), F.col("at").alias("block"), F.col("path").alias("more"), F.col("root").alias("top"))
        above = F.broadcast(above) if bounded(above, BROADCAST_ROWS) else above
        below = levels.pop()
        out = below.join(above, (F.col("g") == F.col("g2")) & (F.shiftright("at", HEIGHT) == F.col("block")), "left").select(
            "g", "at", F.concat("path", F.coalesce("more", F.lit(b""))).alias("path"), F.coalesce("top", "root").alias("root"))
    return out


def fold(digest: bytes, path: bytes, at: int, total: int) -> bytes:
    """The root that a witness gives for ``digest`` at place ``at`` of ``total``."""
    used = 0
    while total > 1:
        if at ^ 1 < total:
            sibling = path[used:used + 32]
            used += 32
            digest = node(sibling, digest) if at & 1 else node(digest, sibling)
        else:
            digest = node(digest)
        at, total = at >> 1, (total + 1) >> 1
    return digest


def group_key(value: Column) -> Column:
    """A group's name as text that is never null and orders as the groups do."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS,
             claimed: Column | None = None) -> DataFrame:
    """A row for each row: the ``order`` column, ``leaf``, ``claimed`` (the leaf put forward to be
    verified: ``claimed``, or the leaf itself), place ``at`` of ``total`` and ``path`` up to
    ``subroot``, the group's place ``top_at`` of ``top_total`` and ``top_path`` up to ``root``."""
    digest = leaf([F.col(c) for c in fields])
    leaves = written(docs.select(F.col(order), group_key(F.col(group)).alias("g"), F.unhex(digest).alias("digest"),
                                 F.unhex(digest if claimed is None else claimed).alias("claimed"),
                                 F.rand(11).alias("salt")), "leaves")
    leaves = written(placed(leaves, ["g"], [order, "digest", "salt"]).drop("salt"), "places")
    paths = witnesses(leaves.select("g", "at", "digest", "total"))
    subroots = written(paths.where("at = 0").select("g", F.col("root").alias("digest")), "subroots")
    tops = placed(subroots.select(F.lit("").alias("all"), F.col("g").alias("member"), "digest"), ["all"], ["member"])
    tops = written(tops.select(F.col("all").alias("g"), "at", "digest", "total", "member"), "tops")
    top = witnesses(tops.drop("member")).select("at", F.col("path").alias("top_path"), F.col("root").alias("all_root"))
    top = tops.join(top, "at").select(F.col("member").alias("m"), F.col("at").alias("top_at"), F.col("total").alias("top_total"),
                                      "top_path", "all_root")
    top = written(top, "top-witnesses")
    top = F.broadcast(top) if bounded(top, BROADCAST_ROWS) else top
    paths = paths.select(F.col("g").alias("g2"), F.col("at").alias("at2"), "path", F.col("root").alias("subroot"))
    out = leaves.join(paths, (F.col("g") == F.col("g2")) & (F.col("at") == F.col("at2")))
    return out.join(top, F.col("g") == F.col("m")).select(
        F.col(order), "digest", "claimed", "at", "total", "path", "subroot", "top_at", "top_total", "top_path",
        F.col("all_root").alias("root"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, folded = [], []
        for r in batch.drop_columns([batch.schema.names[0]]).to_pylist():
            proofs.append(sha256((r["path"].hex() + r["top_path"].hex()).encode()).hexdigest())
            subroot = fold(r["claimed"], r["path"], r["at"], r["total"])
            folded.append(fold(subroot, r["top_path"], r["top_at"], r["top_total"]).hex())
        digest, subroot, root = ([x.hex() for x in batch.column(c).to_pylist()] for c in ("digest", "subroot", "root"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.string()) for x in (digest, subroot, root, proofs, folded)],
             pa.array([a == b for a, b in zip(folded, root, strict=True)], pa.bool_())],
            [batch.schema.names[0], "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(found: DataFrame) -> DataFrame:
    """Fold every claimed leaf of a ``manifest`` with its witness: the ``order`` column, ``leaf,
    subroot, root, proof_sha256`` (H of the witness, from the leaf's sibling up), ``folded_root``
    and ``verified``."""
    kind = found.schema[0]
    return found.mapInArrow(_checked, f"`{kind.name}` {kind.dataType.simpleString()}, leaf string, subroot string, root string, "
                                      "proof_sha256 string, folded_root string, verified boolean")
