"""Merkle manifest of a dataset by fractal traversal of aligned blocks.

Nodes of a tree stand in order and are folded two by two, level by level; the last node of an odd level is folded alone.
A tree is cut into aligned blocks of BLOCK leaves. In a block, stacked subtrees of HEIGHT levels hold the nodes that the
current authentication path needs ("existing"), while the next subtree of each level ("desired") is built by two steps a
leaf, just in time. So a task holds the hashes of one block and a few dozen nodes, and emits one path after another.
The roots of the blocks are the leaves of the next layer, and so on until one block is left; a block gets its upper path
(a row a block) before it emits the paths of its leaves. No step sees a whole tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import numbered
from .common import read, written

BLOCK, HEIGHT = 1 << 10, 5
#: Sides of a sibling in a path: it stands left or right of the node; ALONE: the node has none.
LEFT, RIGHT, ALONE = "<", ">", "-"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def parent(left: str | None, right: str | None) -> str | None:
    """Of two neighbours; both are missing beyond the last leaf, and the right one where the left one is the last."""
    return None if left is None else digest(left) if right is None else digest(left, right)


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    return (n - 1).bit_length() if n else 0


class Stack:
    """Hashing of 2^levels leaves from `first` on, one step (a leaf or a fold) at a time; nodes from level `least` on are kept
    by (level, index)."""

    def __init__(self, leaf, first: int, levels: int, least: int) -> None:
        self.leaf, self.next, self.levels, self.least = leaf, first, levels, least
        self.stack: list[tuple[int, int, str | None]] = []
        self.nodes: dict[tuple[int, int], str | None] = {}

    @property
    def root(self) -> str | None:
        return self.stack[0][2]

    @property
    def done(self) -> bool:
        return bool(self.stack) and self.stack[0][0] == self.levels

    def step(self) -> None:
        if self.done:
            return
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (level, i, right), (_, _, left) = s.pop(), s.pop()
            node = (level + 1, i // 2, parent(left, right))
        else:
            node = (0, self.next, self.leaf(self.next))
            self.next += 1
        if self.least <= node[0] < self.levels:
            self.nodes[node[:2]] = node[2]
        s.append(node)

    def finish(self) -> Stack:
        while not self.done:
            self.step()
        return self


def block_root(leaves: list[str], levels: int) -> str:
    """Root of one aligned block: `levels` folds, missing leaves at its end."""
    return Stack(lambda i: leaves[i] if i < len(leaves) else None, 0, levels, levels).finish().root


def traverse(leaves: list[str], levels: int, step: int = HEIGHT) -> Iterator[list[str]]:
    """The authentication path of each leaf of a block in turn: a side and a sibling for each of `levels` levels.

    Existing subtrees cover the levels from 0, step, 2 * step .. on; one that the next leaf leaves behind is replaced by
    the desired one beside it, which two steps a leaf have finished by then.
    """
    leaf = lambda i: leaves[i] if i < len(leaves) else None
    floors = list(range(0, levels, step))
    tops = [min(f + step, levels) for f in floors]
    existing = [Stack(leaf, 0, t, f).finish() for f, t in zip(floors, tops, strict=True)]
    desired = [Stack(leaf, 1 << t, t, f) for f, t in zip(floors[:-1], tops[:-1], strict=True)]
    for i in range(len(leaves)):
        path = []
        for tree in existing:
            for level in range(tree.least, tree.levels):
                at = i >> level
                other = tree.nodes[level, at ^ 1]
                path.append(ALONE if other is None else (LEFT if at & 1 else RIGHT) + other)
        yield path
        for k, tree in enumerate(desired):
            tree.step()
            tree.step()
            after = i + 1
            if after % (1 << tree.levels) == 0 and after < len(leaves):
                existing[k] = tree.finish()  # it is done: 2^levels leaves and as many folds less one, in 2^levels rounds
                desired[k] = Stack(leaf, after + (1 << tree.levels), tree.levels, tree.least)


def folded(node: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for x in path:
        node = digest(node) if x == ALONE else digest(x[1:], node) if x[0] == LEFT else digest(node, x[1:])
    return node


def _levels(n: int, block: int) -> int:
    return min(height(block), height(n))


def upper_paths(nodes: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(tree, block, path, root): for each block of `nodes` (tree, i, n, node: the i-th of n) the path from the block's root to
    the tree's. `most`: the largest n; `block`: a power of two. A layer has 1/block of the rows of the one below."""

    def root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "i": [key[1]], "n": [-(-n // block)], "node": [block_root(pdf.sort_values("i")["node"].tolist(), _levels(n, block))]})

    tops = nodes.groupBy("tree", F.expr(f"i div {block}").alias("block")).applyInPandas(root, "tree string, i long, n long, node string")
    if most <= block:
        return written(tops.select("tree", F.col("i").alias("block"), F.array().cast("array<string>").alias("path"), F.col("node").alias("root")), "paths")
    tops = written(tops, "blocks")

    def climb(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rest, n = list(above["path"].iloc[0]), int(pdf["n"].iloc[0])
        paths = [p + rest for p in traverse(pdf["node"].tolist(), _levels(n, block))]
        return pd.DataFrame({"tree": key[0], "block": pdf["i"], "path": paths, "root": above["root"].iloc[0]})

    above = upper_paths(tops, -(-most // block), block)
    both = tops.groupBy("tree", F.expr(f"i div {block}").alias("block")).cogroup(above.groupBy("tree", "block"))
    return written(both.applyInPandas(climb, "tree string, block long, path array<string>, root string"), "paths")


def _field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` (tree, place in all trees) plus i, the place in its tree, and n, the tree's rows; the largest n."""
    trees = written(rows.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n")), "trees")
    most = trees.agg(F.max("n")).first()[0] or 0
    return rows.join(trees, "tree").withColumn("i", F.col("place") - F.col("first")).drop("first", "place"), most


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, tampered: Column, block: int = BLOCK) -> DataFrame:
    """One row for each of `rows`: its key (column `order`), leaf, subroot, root, proof_sha256, folded_root and verified.

    Leaves of each `group` (null: one of its own, which comes first) ascend by `order` (nulls first, ties by leaf; rows that
    agree in both are interchangeable) and fold to the group's subroot; subroots, ordered by group, fold to the root.
    proof_sha256 is the hash of a leaf's siblings in order; folded_root is what `tampered` (a hash; null: the leaf itself)
    and those siblings give. An empty table gives an empty one; other columns of `rows` are not read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    hashed = rows.select(tree.alias("tree"), F.col(f"`{order}`").alias("key"), leaf.alias("node"), tampered.alias("tampered"))
    kind = dict(hashed.dtypes)["key"]
    placed, most = _counted(numbered(hashed, ["tree", "key", "node"], "place"))
    placed = written(placed.withColumn("key", F.col("key").cast("string")), "leaves")  # pandas has no long with nulls
    blocks = upper_paths(placed.select("tree", "i", "n", "node"), most, block)
    subroots = written(blocks.filter("block = 0").select("tree", F.col("root").alias("node")), "subroots")
    top = numbered(subroots, ["tree"], "i").withColumn("tree", F.struct("tree", "node")).select(F.lit("").alias("tree"), "i", F.col("tree").alias("of"))
    top = written(top.crossJoin(top.agg(F.count("*").alias("n"))), "tops")  # one row
    trees = top.agg(F.max("n")).first()[0] or 0
    above = upper_paths(top.select("tree", "i", "n", F.col("of.node").alias("node")), trees, block)

    def climb(key: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rest = list(up["path"].iloc[0])
        return pd.DataFrame({"tree": pdf["of"].map(lambda x: x["tree"]), "above": [p + rest for p in traverse([x["node"] for x in pdf["of"]], _levels(int(pdf["n"].iloc[0]), block))], "root": up["root"].iloc[0]})

    crowns = top.groupBy("tree", F.expr(f"i div {block}").alias("block")).cogroup(above.groupBy("tree", "block")).applyInPandas(climb, "tree string, above array<string>, root string")
    whole = blocks.withColumnRenamed("root", "subroot").join(written(crowns, "crowns"), "tree").select("tree", "block", "path", "above", "subroot", "root")

    def prove(key: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rest, root = [*up["path"].iloc[0], *up["above"].iloc[0]], up["root"].iloc[0]
        out = []
        for leaf_, changed, path in zip(pdf["node"], pdf["tampered"], traverse(pdf["node"].tolist(), _levels(int(pdf["n"].iloc[0]), block)), strict=True):
            path = path + rest
            found = folded(leaf_ if changed is None else changed, path)
            out.append((digest(*(x[1:] for x in path)), found, found == root))
        proofs = pd.DataFrame(out, columns=["proof_sha256", "folded_root", "verified"], index=pdf.index)
        return pd.DataFrame({"key": pdf["key"], "leaf": pdf["node"], "subroot": up["subroot"].iloc[0], "root": root}).join(proofs)

    both = placed.groupBy("tree", F.expr(f"i div {block}").alias("block")).cogroup(whole.groupBy("tree", "block"))
    out = both.applyInPandas(prove, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select(F.col("key").cast(kind).alias(order), *out.columns[1:])


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::bigint)"


def _fold_sql(name: str, leaves: str) -> str:
    """Nodes of all levels, and the path of each leaf of the trees in `leaves` (tree, i, n, node)."""
    return f"""{name}_nodes as (
  select tree, 0 as level, i, n, node from {leaves}
  union all
  select tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' order by i)) from {name}_nodes where n > 1 group by tree, level, i // 2, n),
{name}_paths as (
  select l.tree, l.i, list(case when s.node is null then '-' when s.i < l.i >> v.level then '<' || s.node else '>' || s.node end order by v.level) as path
  from {leaves} l join (select distinct tree, level from {name}_nodes where n > 1) v using (tree)
  left join {name}_nodes s on s.tree = l.tree and s.level = v.level and s.i = xor(l.i >> v.level, 1) group by l.tree, l.i)"""


ORACLE = f"""with recursive leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 as i, count(*) over (partition by tree) as n from (
    select doc_id, coalesce('=' || lang, '') as tree, {_LEAF.format(n="n_chars")} as node, case when {_CRC} % 7 = 0 then {_LEAF.format(n="(n_chars + 1)")} end as tampered from documents)),
{_fold_sql("own", "leaves")},
subroots as (select '' as tree, tree as of, node, row_number() over (order by tree) - 1 as i, count(*) over () as n from own_nodes where n = 1),
{_fold_sql("top", "subroots")},
proofs as (
  select l.*, s.node as subroot, r.node as root, coalesce(p.path, []) || coalesce(q.path, []) as path
  from leaves l join subroots s on s.of = l.tree join top_nodes r on r.n = 1 left join own_paths p on p.tree = l.tree and p.i = l.i left join top_paths q on q.i = s.i),
folds as (
  select *, list_reduce(list_prepend(coalesce(tampered, node), path), lambda a, x: sha256(case x[1] when '<' then x[2:] || a when '>' then a || x[2:] else a end)) as folded_root from proofs)
select doc_id, node as leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folds"""


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's leaf, proof and verification; every seventh one, by crc32 of its id, is tampered with.

    Null ids are never tampered with and come first in their language; an n_chars that is null stays null.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")), F.when(hit, leaf(F.try_add("n_chars", F.lit(1)))))
