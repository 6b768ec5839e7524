"""A Merkle manifest of a dataset: a hash tree of 16 branches for each source, and one over the sources, with a proof for each row.

A leaf is the hash of a row's fields. Leaves of a source stand in order of id; every ``ARITY`` consecutive nodes (the last run: fewer, even
one) are hashed to a node above, until one is left. The sources' roots, in order of source, are put together likewise.

Proofs within an aligned block of ``ARITY ** LEVELS`` leaves come from a fractal traversal: for each height of the block two subtrees are
held, the existing one, whose nodes the proof of the present leaf takes, and the desired one, which comes next and grows by a
leaf with each proof, so that it is ready when the traversal enters it. Each proof costs a bounded number of steps, and memory
doesn't depend on the number of leaves beyond the block's own digests. Above the blocks, nodes are grouped level by level over all
tasks; from the root down each run hands its proof on to its members. A block gets its upper proof once, beside its leaves.

Scale: texts are read once, for the leaves. Leaves are ranked by ranges of source and id, so a source with a third of all rows is no hot
key. A task holds one block of 256 digests and its proofs at a time; runs are of 16 nodes. Nothing is gathered on the driver but the
largest number of nodes of a tree.

Cases: a null field is ``-`` in the leaf, so that null and empty differ. Null sources are one source, the first. Rows without
an id stand first in their source. Rows of one id and source are ordered by their leaf; equal rows have proofs of their own. An empty table has no tree. A source of
one row has its leaf as root. Other columns are left out, whatever their names; they change no hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.tables import ranked, removed, salted_join, written

#: Branches of a node, and levels of a block that one task traverses.
ARITY, LEVELS = 16, 2
#: The fields of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PROOF = "array<struct<left: string, right: string>>"


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class _Growing:
    """A subtree that gets its leaves one by one: the finished nodes of height ``height`` and, below, what isn't a whole run yet."""

    def __init__(self, height: int):
        self.rows: list[list[str]] = [[] for _ in range(height + 1)]

    def add(self, leaf: str) -> None:
        self.rows[0].append(leaf)
        for k in range(len(self.rows) - 1):
            if len(self.rows[k]) < ARITY:
                break
            self._close(k)

    def _close(self, k: int) -> None:
        self.rows[k + 1].append(_hash(self.rows[k]))
        self.rows[k] = []

    def nodes(self) -> list[str]:
        """The nodes of the top height, with the last run as it is."""
        for k in range(len(self.rows) - 1):
            if self.rows[k]:
                self._close(k)
        return self.rows[-1]


def block_root(leaves: Sequence[str], levels: int) -> str:
    tree = _Growing(levels)
    for leaf in leaves:
        tree.add(leaf)
    return tree.nodes()[0]


def traversed(leaves: Sequence[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """Of each leaf of a block its siblings on the left and on the right at each height, as texts of digests."""
    spans = [ARITY ** (h + 1) for h in range(levels)]
    existing, desired = [], [_Growing(h) for h in range(levels)]
    for h, span in enumerate(spans):
        first = _Growing(h)
        for leaf in leaves[:span]:
            first.add(leaf)
        existing.append(first.nodes())
    for i in range(len(leaves)):
        left, right = [], []
        for h, span in enumerate(spans):
            at = i % span * ARITY // span
            left.append("".join(existing[h][:at]))
            right.append("".join(existing[h][at + 1 :]))
        yield left, right
        for h, span in enumerate(spans):
            if i + span < len(leaves):
                desired[h].add(leaves[i + span])
            if (i + 1) % span == 0:
                existing[h], desired[h] = desired[h].nodes(), _Growing(h)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row of values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _above(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From nodes (tree, at, digest, n: nodes of the tree) the trees' roots (tree, digest), and the runs of each level (tree, at, members, n)."""
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        member = F.sort_array(F.collect_list(F.struct("at", "digest")))["digest"]
        runs = written(nodes.filter("n > 1").groupBy("tree", F.expr(f"at div {ARITY}").alias("up"), "n").agg(member.alias("members")), "merkle-runs")
        levels.append(runs)
        nodes = runs.select("tree", F.col("up").alias("at"), F.sha2(F.array_join("members", ""), 256).alias("digest"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        most = -(-most // ARITY)
    tops.append(nodes.select("tree", "digest"))
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return written(out, "merkle-roots"), levels


def _below(proofs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """From proofs of trees (tree, proof) those of the nodes that _above got: tree, at, proof (from the node upwards)."""
    found = proofs.select("tree", F.lit(0).cast("long").alias("at"), "proof")
    siblings = F.struct(F.array_join(F.slice("members", F.lit(1), F.col("i") - 1), "").alias("left"), F.array_join(F.slice("members", F.col("i") + 1, F.size("members")), "").alias("right"))
    for runs in reversed(levels):
        # Trees of fewer levels have no run here; they pass until their own root is reached.
        joined = found.join(runs.select(F.col("tree").alias("__tree"), "up", "members"), (F.col("tree") == F.col("__tree")) & (F.col("at") == F.col("up")), "left")
        member = joined.select("tree", "at", "members", "proof", F.explode(F.sequence(F.lit(1), F.coalesce(F.size("members"), F.lit(1)))).alias("i"))
        inside = F.col("members").isNotNull()
        found = member.select("tree", F.when(inside, F.col("at") * ARITY + F.col("i") - 1).otherwise(F.col("at")).alias("at"), F.when(inside, F.concat(F.array(siblings), F.col("proof"))).otherwise(F.col("proof")).alias("proof"))
    return found


def _block_of(table: pa.Table) -> tuple[list[str], int]:
    return table.column("leaf").to_pylist(), table.column("levels")[0].as_py()


def _root_of_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    leaves, levels = _block_of(table.sort_by("at"))
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "digest": [block_root(leaves, levels)]})


def _proofs_of_block(key: tuple[pa.Scalar, ...], table: pa.Table, upper: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    leaves, levels = _block_of(table)
    above = upper.column("proof")[0].as_py()
    tail = ([x["left"] for x in above], [x["right"] for x in above])
    left, right, ends = [], [], [0]
    for lows, rights in traversed(leaves, levels):
        left += lows + tail[0]
        right += rights + tail[1]
        ends.append(len(left))
    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
    n = len(leaves)
    same = lambda column: pa.array([upper.column(column)[0].as_py()] * n, pa.string())
    return pa.table({"row": table.column("row"), "leaf": table.column("leaf"), "subroot": same("subroot"), "root": same("root"), "proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)})


def proofs(docs: DataFrame, keep: list[str] | None = None, order: str = "doc_id", group: str = "source", fields: list[str] | None = None) -> DataFrame:
    """Of each row: the columns ``keep`` of docs, leaf, subroot, root and proof (per level, from the leaf up: the siblings on either side)."""
    fields, keep = FIELDS if fields is None else fields, [order] if keep is None else keep
    named = docs.select(F.col(f"`{group}`").alias("tree_name"), F.col(f"`{order}`").alias("place"), leaf(*[F.col(f"`{c}`") for c in fields]).alias("leaf"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    row_type = named.schema["row"].dataType.simpleString()
    leaves = written(named, "merkle-leaves")
    sums = leaves.groupBy("tree_name").agg(F.count("*").alias("n"))
    trees = written(ranked(sums, [F.col("tree_name").asc_nulls_first()]).select("tree_name", F.col("rank").alias("tree"), "n"), "merkle-trees")
    in_order = [F.col("tree_name").asc_nulls_first(), F.col("place").asc_nulls_first(), F.col("leaf").asc()]
    placed = ranked(leaves, in_order, by="tree_name")
    size = ARITY**LEVELS
    need = F.lit(0)
    for k in range(LEVELS):
        need = need + (F.col("n") > ARITY**k).cast("int")
    at = salted_join(placed, trees, "tree_name", "leaf")
    blocks = written(at.select("tree", F.expr(f"rank div {size}").alias("block"), (F.col("rank") % size).cast("int").alias("at"), "n", need.alias("levels"), "leaf", "row"), "merkle-blocks")
    removed(leaves)

    roots = blocks.select("tree", "block", "at", "levels", "leaf").groupBy("tree", "block").applyInArrow(_root_of_block, "tree long, block long, digest string")
    counts = trees.select("tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"))
    nodes = written(roots.join(counts, "tree").select("tree", F.col("block").alias("at"), "digest", "n"), "merkle-nodes")
    subroots, in_sources = _above(nodes)
    n_trees = subroots.count()
    root, over_sources = _above(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(n_trees).cast("long").alias("n")))
    top = root.first()
    start = root.select("tree", F.array().cast(_PROOF).alias("proof"))
    of_sources = _below(start, over_sources).select(F.col("at").alias("tree"), "proof")
    upper = _below(of_sources, in_sources).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    upper = upper.select("tree", F.col("at").alias("block"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), "proof")
    upper = written(upper, "merkle-upper")
    removed(nodes, subroots, root, trees, *in_sources, *over_sources)
    out = blocks.select("tree", "block", "at", "levels", "leaf", "row").groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    return out.applyInArrow(_proofs_of_block, f"row {row_type}, leaf string, subroot string, root string, proof {_PROOF}").select("row.*", "leaf", "subroot", "root", "proof")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, digest, lambda below, level: F.sha2(F.concat(level["left"], below, level["right"]), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The leaf of the row as a tampered copy has it, where the copy was tampered with.
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*[lower if c == "text" else F.col(c) for c in FIELDS]))
    found = proofs(docs.withColumn("other", tampered), keep=["doc_id", "other"])
    out = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
