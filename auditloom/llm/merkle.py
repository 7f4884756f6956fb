"""A Merkle manifest of a dataset by parent preimages.

Every group (language) of rows is a tree: leaves in order of their ids, and while a level has several nodes,
every `arity` consecutive ones are hashed together into one of the next level. The groups' roots, in order of
the groups, are the leaves of one more tree, whose root stands for the table. A node is the SHA-256 of the
concatenated hex digests below it; this concatenation, the node's preimage, is what the manifest stores.

A leaf proves its place by its ancestors' preimages: it cuts its own slot of 64 characters out of each to have
the siblings, and splices the digest computed so far into that slot to go one level up. So neither siblings nor
neighbours are looked up; one row for each ancestor is enough.

Trees are built in blocks. arity ** depth consecutive leaves make a block, a bounded row whose inner nodes need
nothing else; the blocks' roots are the leaves of the next stage. A table of n rows takes log(n) / log(block)
stages instead of log2(n) joins, and the text is read once and never shuffled: leaves are hashes from the start.
Numbers of leaves come from sorted ranges (`shared.numbered`), so a language with most of the rows is spread
over all of them.

Defined cases: an absent value is hashed as `-`. Null ids come before all others in their group; rows that repeat an
id are ordered by their leaf, equal rows as they come (their leaves are equal, so no result depends on it). The null
group is a tree of its own, before the others. n_chars + 1 is counted beyond the range of long. A group of one row has
its leaf as root, a table of one group that group's root; a row without siblings proves with the hash of nothing. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, join_hot, numbered

HEX = 64
#: Rows of (block, path of preimages) that may be broadcast: about 5 kB each, 25 MB together.
PATH_ROWS = 5_000

_MEMBER = "pos long, hash string, changed string, doc_id long"
_BLOCK = f"tree string, n long, block long, members array<struct<{_MEMBER.replace(' ', ':')}>>".replace(":,", ",")
_PATH = "array<struct<slot:int, preimage:string>>"


def sha_hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_text(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf's preimage: each value as its number of UTF-8 bytes, a colon and the value, or `-`."""
    parts = []
    for value in (doc_id, source, lang, n_chars, text):
        shown = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.concat(*parts)


def leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """(tree, doc_id, hash, changed): each row's leaf, and that of the tampered row where `every` divides crc32 of its id."""
    doc_id, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    source, lang, text = (F.col(c).cast("string") for c in ("source", "lang", "text"))
    more = n.cast("decimal(20,0)") + F.lit(1)
    hit = F.crc32(doc_id.cast("string")) % every == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), lang), F.lit("0")).alias("tree"),
        doc_id.alias("doc_id"),
        F.sha2(leaf_text(doc_id, source, lang, n, text), 256).alias("hash"),
        F.when(hit & n.isNotNull(), F.sha2(leaf_text(doc_id, source, lang, more.cast("decimal(20,0)"), text), 256)).alias("changed"),
    )


def levels(n: int, arity: int) -> int:
    """Number of levels over n nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // arity), up + 1
    return up


def inner_levels(hashes: list[str], n: int, arity: int, depth: int) -> tuple[list[list[str]], str]:
    """Preimages of a block's parents, level by level, and the hash of its top; `n` is the size of the whole tree."""
    out = []
    for _ in range(min(depth, levels(n, arity))):
        out.append(["".join(hashes[i : i + arity]) for i in range(0, len(hashes), arity)])
        hashes = [sha_hex(p) for p in out[-1]]
    return out, hashes[0]


def own_path(inner: list[list[str]], at: int, arity: int) -> list[tuple[int, str]]:
    """(slot, preimage) of each ancestor of the block's leaf at this place."""
    path = []
    for level in inner:
        path.append((at % arity, level[at // arity]))
        at //= arity
    return path


def excised(path: list[tuple[int, str]]) -> str:
    """The siblings of all levels: each preimage without the own slot."""
    return "".join(p[: HEX * slot] + p[HEX * (slot + 1) :] for slot, p in path)


def folded(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that follows from a digest spliced into its slot, level by level."""
    for slot, p in path:
        digest = sha_hex(p[: HEX * slot] + digest + p[HEX * (slot + 1) :])
    return digest


class Stage:
    """One level of blocks over (tree, pos, n, hash, changed, doc_id): rows of a block, and the nodes that they make."""

    def __init__(self, nodes: DataFrame, arity: int, depth: int):
        self.arity, self.depth = arity, depth
        size = arity**depth
        member = F.struct(*[F.col(c.split()[0]) for c in _MEMBER.split(", ")])
        rows = nodes.groupBy("tree", "n", F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        self.blocks = cut_lineage(rows)

    def tops(self) -> DataFrame:
        """The blocks' roots as nodes of the next stage."""
        arity, depth, size = self.arity, self.depth, self.arity**self.depth

        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                tops = [inner_levels([m["hash"] for m in r["members"]], r["n"], arity, depth)[1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([-(-r["n"] // size) for r in rows], pa.int64()), pa.array(tops, pa.string())],
                    ["tree", "pos", "n", "hash"],
                )

        up = self.blocks.mapInArrow(run, "tree string, pos long, n long, hash string")
        return up.select("*", F.lit(None).cast("string").alias("changed"), F.lit(None).cast("long").alias("doc_id"))

    def stored(self) -> DataFrame:
        """(tree, pos, level, preimage): the block's parents; level and place are those within the stage."""
        arity, depth = self.arity, self.depth

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    inner, _ = inner_levels([m["hash"] for m in r["members"]], r["n"], arity, depth)
                    flat = [(r["block"] * arity ** (depth - k) + i, k, p) for k, level in enumerate(inner, 1) for i, p in enumerate(level)]
                    at, level, text = (list(c) for c in zip(*flat, strict=True)) if flat else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(level, pa.int32()), pa.array(text, pa.string())], ["tree", "pos", "level", "preimage"])

        return self.blocks.mapInArrow(run, "tree string, pos long, level int, preimage string")

    def _with_above(self, above: DataFrame) -> DataFrame:
        """Blocks with the path of their top; a block is bounded, so a join by block has no hot key."""
        top = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "path", "subroot", "root")
        if top.limit(PATH_ROWS + 1).count() <= PATH_ROWS:
            top = F.broadcast(top)
        return self.blocks.join(top, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_pos"))).drop("_tree", "_pos")

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, pos, path, subroot, root) of every member, from the paths of the blocks' tops."""
        arity, depth = self.arity, self.depth

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    inner, _ = inner_levels([m["hash"] for m in r["members"]], r["n"], arity, depth)
                    rest = [(p["slot"], p["preimage"]) for p in r["path"]]
                    pos = [m["pos"] for m in r["members"]]
                    path = [[{"slot": s, "preimage": p} for s, p in own_path(inner, i, arity) + rest] for i in range(len(pos))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["tree"]] * len(pos), pa.string()), pa.array(pos, pa.int64()), pa.array(path, pa.list_(pa.struct([("slot", pa.int32()), ("preimage", pa.string())]))),
                         pa.array([r["subroot"]] * len(pos), pa.string()), pa.array([r["root"]] * len(pos), pa.string())],
                        ["tree", "pos", "path", "subroot", "root"],
                    )

        return self._with_above(above).mapInArrow(run, f"tree string, pos long, path {_PATH}, subroot string, root string")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The members with the hash of their siblings and the root folded from the changed leaf, else from their own."""
        arity, depth = self.arity, self.depth
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    inner, _ = inner_levels([m["hash"] for m in r["members"]], r["n"], arity, depth)
                    rest = [(p["slot"], p["preimage"]) for p in r["path"]]
                    out = []
                    for i, m in enumerate(r["members"]):
                        path = own_path(inner, i, arity) + rest
                        out.append((m["doc_id"], m["hash"], r["subroot"], r["root"], sha_hex(excised(path)), folded(m["changed"] or m["hash"], path)))
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(columns)], names)

        schema = ", ".join(f"{c} {'string' if i else 'long'}" for i, c in enumerate(names))
        return self._with_above(above).mapInArrow(run, schema)


def _stages(nodes: DataFrame, arity: int, depth: int) -> tuple[list[Stage], DataFrame]:
    """The stages of all trees, and their roots (tree, pos = 0, n = 1, hash)."""
    stages = []
    while True:
        most = nodes.agg(F.max("n")).first()[0] or 1
        if stages and most <= 1:
            return stages, nodes
        stages.append(Stage(nodes, arity, depth))
        nodes = cut_lineage(stages[-1].tops())


class Manifest:
    """The trees over a table's leaves: `preimages`, `roots`, and `proofs` of every row."""

    def __init__(self, rows: DataFrame, arity: int = 2, depth: int = 9):
        """`rows` has tree, doc_id, hash, changed; a block has arity ** depth leaves."""
        if arity < 2 or depth < 1:
            raise ValueError("a tree needs two children at least and a level at least")
        laid = numbered(cut_lineage(rows), F.col("tree").asc(), F.col("doc_id").asc_nulls_first(), F.col("hash").asc())
        trees = cut_lineage(laid.groupBy("tree").agg(F.count("*").alias("n"), F.min("number").alias("_first")))
        nodes = join_hot(laid, trees, "tree").withColumn("pos", F.col("number") - F.col("_first")).drop("number", "_first")
        self.stages, self.roots = _stages(nodes, arity, depth)
        tops = numbered(self.roots.select("tree", "hash"), F.col("tree").asc(), name="pos")
        count = tops.count()
        top_nodes = tops.select(
            F.lit("").alias("tree"), "pos", F.lit(count).cast("long").alias("n"), "hash", F.lit(None).cast("string").alias("changed"), F.lit(None).cast("long").alias("doc_id")
        )
        self.top_stages, self.root = _stages(top_nodes, arity, depth)
        self._tops = tops

    def preimages(self) -> DataFrame:
        """(kind, tree, stage, level, pos, preimage): all that proofs are made of. A level is that of its stage."""
        parts = [s.stored().select(F.lit(kind).alias("kind"), "tree", F.lit(i).alias("stage"), "level", "pos", "preimage") for kind, stages in (("rows", self.stages), ("groups", self.top_stages)) for i, s in enumerate(stages)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
        path = self.root.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
        for stage in reversed(self.top_stages):
            path = stage.paths(path)
        path = path.drop("tree", "subroot").join(self._tops.withColumnRenamed("hash", "subroot"), "pos")
        path = path.select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
        for stage in reversed(self.stages[1:]):
            path = cut_lineage(stage.paths(path))
        out = self.stages[0].proofs(path)
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Per document its leaf, its language's and the table's root, its proof, and the root folded after tampering."""
    return Manifest(leaves(docs)).proofs()
