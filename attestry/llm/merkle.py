"""A manifest of a whole data set: one digest for all, and for every row the proof that leads to it.

Rows are leaves in the order of their ids, one tree a source, and the trees' roots are the leaves of one more tree. A tree is cut into aligned
blocks of FAN ** LEVELS leaves. Each block is walked by one recursion that returns a subtree's digest and, on its way back, appends the siblings
of each child to the paths of the leaves in it. The blocks' roots are the leaves of the next, far smaller traversal, until each tree is one node.

A tree of any size is met by blocks alone: no task holds more than a block, and positions come from an exchange by range.
Nulls are digested as such, texts whole at any length; a null source is a tree of its own, the first. Rows of one id follow each other by their
digests, and rows that are alike in everything are leaves each. An empty table gives an empty manifest. Further columns aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import forget, save

FAN, LEVELS, TASK_ROWS, LEAST_TASKS = 3, 7, 200_000, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def digest_of(*values: Column) -> Column:
    """SHA-256 of the fields, each with its length before it, `-` for null."""
    framed = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*(framed(v.cast("string")) for v in values)), 256)


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row, with another text in its place if one is given."""
    return digest_of(*(docs[c] for c in FIELDS[:-1]), docs["text"] if text is None else text)


def tree_of(source: Column) -> Column:
    """A name for the tree that is never null and sorts as sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with idx, the place in the tree from 0 by `order`, and total, the tree's size. The rows are exchanged by range and
    numbered within tasks; only one count for each task and tree is added up."""
    tasks = LEAST_TASKS + rows.count() // TASK_ROWS
    by_range = rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = save(by_range.withColumn("task", F.shiftright("at", 33)), "merkle-placed")
    counts = placed.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    begins = counts.select("tree", "task", "first", (F.sum("n").over(tree.orderBy("task")) - F.col("n")).alias("begin"), F.sum("n").over(tree).alias("total"))
    # Sizes decide at run time whether the counts are sent around or exchanged.
    out = placed.join(begins, ["tree", "task"]).withColumn("idx", F.col("begin") + F.col("at") - F.col("first")).drop("task", "at", "first", "begin")
    out.saved_at = placed.saved_at
    return out


def _levels(n: int) -> int:
    """Levels above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def walk(digests: list[bytes], height: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """(root, path of each leaf from below) of consecutive leaves at the begin of an aligned block. A step of a path is what stands left and
    what stands right of the node in its run; a node alone in its run is digested too."""
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]

    def visit(level: int, lo: int, hi: int) -> bytes:
        if level == 0:
            return digests[lo]
        width = FAN ** (level - 1)
        spans = [(a, min(a + width, hi)) for a in range(lo, hi, width)]
        below = [visit(level - 1, a, b) for a, b in spans]
        for i, (a, b) in enumerate(spans):
            step = (b"".join(below[:i]), b"".join(below[i + 1 :]))
            for path in paths[a:b]:
                path.append(step)
        return hashlib.sha256(b"".join(below).hex().encode()).digest()

    return visit(height, 0, len(digests)), paths


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes(tree, idx, total, digest binary, ...) with path, from the node up to its tree's root, and top, that root."""
    size = FAN**levels

    def walked(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        total = block.column("total")[0].as_py()
        root, paths = walk(block.column("digest").to_pylist(), levels if total > size else _levels(total))
        steps = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))
        return block.append_column("path", steps).append_column("top", pa.array([root] * len(paths), pa.binary()))

    split = nodes.withColumn("block", F.expr(f"idx div {size}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema) + f", path {PATH}, top binary"
    walked = save(split.groupBy("tree", "block").applyInArrow(walked, schema), "merkle-walked")
    largest = walked.agg(F.max("total")).first()[0] or 0
    if largest <= size:
        return walked.drop("block")
    roots = walked.groupBy("tree", "block").agg(F.first("top").alias("digest"), F.first("total").alias("total"))
    above = climb(roots.select("tree", F.col("block").alias("idx"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), "digest"), levels)
    above = above.select("tree", F.col("idx").alias("block"), F.col("path").alias("rest"), F.col("top").alias("whole"))
    joined = walked.join(above, ["tree", "block"])
    return joined.withColumns({"path": F.concat("path", "rest"), "top": F.col("whole")}).drop("block", "rest", "whole")


def manifest(docs: DataFrame, *shown: Column, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, *shown): path leads from the leaf over its source's root to the root of all. Digests are binary.
    `shown` are further columns made of a row of docs."""
    given = docs.select("doc_id", tree_of(F.col("source")).alias("tree"), F.unhex(leaf(docs)).alias("digest"), *shown)
    leaves = save(given, "merkle-leaves")
    placed = numbered(leaves, "doc_id", "digest")
    own = climb(placed, levels)
    forget(leaves, placed)
    subroots = own.groupBy("tree").agg(F.first("top").alias("digest")).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    whole = climb(numbered(save(subroots, "merkle-subroots"), "name"), levels).select(F.col("name").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root"))
    rest = [c for c in leaves.columns if c not in ("doc_id", "tree", "digest")]
    return own.join(whole, "tree").select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"), *rest)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and a path give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(_hex(s["left"]), acc, _hex(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def verified(docs: DataFrame, tampered: Column, text: Column, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): rows where `tampered` holds are shown with `text` in place of theirs,
    and each shown row is led to the root along the path of the original."""
    other = F.when(tampered, F.unhex(leaf(docs, text))).alias("other")
    m = manifest(docs, other, levels=levels)
    root = _hex(F.col("root"))
    back = folded(_hex(F.coalesce("other", "leaf")), F.col("path"))
    out = m.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _climbed(name: str, levels: int) -> str:
    """SQL: {name}0(tree, i, n, node, proof, fold, ...), one row a leaf, climbed a level at a time."""
    out = []
    left, right = "left(r.every, 64 * cast(p.i % 3 as int))", "substr(r.every, 64 * cast(p.i % 3 as int) + 65)"
    for k in range(1, levels + 1):
        below = f"{name}{k - 1}"
        out.append(f"{name}n{k} as (select tree, i, any_value(node) as node from {below} where n > 1 group by tree, i)")
        out.append(f"{name}r{k} as (select tree, i // 3 as run, string_agg(node, '' order by i) as every from {name}n{k} group by tree, i // 3)")
        out.append(f"""{name}{k} as (select p.* replace (case when p.n > 1 then p.i // 3 else p.i end as i, case when p.n > 1 then (p.n + 2) // 3 else p.n end as n, case when p.n > 1 then sha256(r.every) else node end as node,
  case when p.n > 1 then proof || {left} || {right} else proof end as proof, case when p.n > 1 then sha256({left} || fold || {right}) else fold end as fold) from {below} p left join {name}r{k} r on r.tree = p.tree and r.run = p.i // 3)""")
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    framed = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return f"sha256({' || '.join(framed(f'cast({c} as varchar)') for c in FIELDS[:-1])} || {framed(text)})"


def oracle(tampered: str, text: str, levels: int = 11, source_levels: int = 6) -> str:
    """SQL for verified(), of trees of at most 3 ** levels leaves; `tampered` and `text` are its arguments in SQL."""
    return f"""with l as (select doc_id, coalesce('=' || source, '') as tree, {_sql_leaf('text')} as leaf, {_sql_leaf(f'case when {tampered} then {text} else text end')} as fold from documents),
a0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n, leaf as node, '' as proof from l),
{_climbed('a', levels)},
b0 as (select doc_id, leaf, node as subroot, '' as tree, dense_rank() over (order by tree) - 1 as i, (select count(distinct tree) from l) as n, node, proof, fold from a{levels}),
{_climbed('b', source_levels)}
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified from b{source_levels}"""


#: SQL for an unsigned CRC-32 of a string of ASCII characters: eight shifts a character.
CRC32 = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(range(1, length({0}) + 1), lambda i: list_prepend(cast(ord({0}[i]) as bigint), cast([-1, -1, -1, -1, -1, -1, -1, -1] as bigint[]))))),
  lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""
#: Of the query: rows whose id has an even CRC lose their line ends.
ORACLE = oracle(f"coalesce({CRC32.format('cast(doc_id as varchar)')} % 2 = 0, false)", "replace(text, chr(10), '')")
