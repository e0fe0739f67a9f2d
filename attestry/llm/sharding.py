"""Sharding by histogram sort, under the law `bytes`: shards of nearly equal size.

Documents are ordered by (hash of the text, doc_id, a number of the row), so equal texts stand side by side and no two rows tie.
Splitters of that order are searched for iteratively: in each round a fixed number of candidate keys is probed for every splitter
that isn't yet within tolerance, each partition counts the exact bytes below every probe, the counts are added up, and the search
goes on in the gap that holds the target, until every splitter is within tolerance or between two neighbouring keys. The driver
sees one number for each probe, a few hundred in all for each shard, whatever the rows. Only ids, hashes and sizes take part in the
rounds, never texts. When all splitters are found, rows are exchanged once, into ranges of that same order which keep a task's rows
bounded; a hot group of equal texts, even of equal rows, is cut like anything else. A group of equal texts stays in one shard if a
splitter at its edge is within tolerance.

Defined results: null text has no bytes and size 16; a very long text is one row, which may make its shard larger than others;
repeated rows are rows of their own; an empty table gives no rows; a null doc_id sorts first; other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import forget, save

SHARDS = 40
#: How far a splitter may lie from its target, as a share of a shard's bytes.
TOLERANCE = 0.01
#: Probes for each open splitter and round.
PROBES = 24
#: Rows that one task of the exchange holds, on average.
RANGE_ROWS = 2_000_000
LOW = -(2**63)
#: Keys as single numbers: the hash of the text, the id and the row's number, 64 bits each.
HASH, ID = 1 << 128, 1 << 64


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k, d, u): the order is by k, then d, then u."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("k"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )


def _columns(cuts: list[int]) -> np.ndarray:
    """Keys as rows of (k, d, u)."""
    return np.array([[(c // HASH) + LOW, (c // ID) % ID + LOW, c % ID + LOW] for c in cuts], np.int64).reshape(-1, 3)


def position(columns: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """How many cuts lie at or before each row; cuts are sorted rows of (k, d, u). Only rows that tie with a cut look further."""
    first, last = (np.searchsorted(cuts[:, 0], columns[0], side) for side in ("left", "right"))
    if len(columns) == 1:
        return last
    out, tied = last.copy(), first < last
    for lo in np.unique(first[tied]):
        rows = np.flatnonzero(tied & (first == lo))
        out[rows] = lo + position([c[rows] for c in columns[1:]], cuts[lo : last[rows[0]], 1:])
    return out


def bytes_before(rows: DataFrame, cuts: list[int]) -> list[int]:
    """Exact bytes of the rows before each of the sorted cuts: each partition counts, then counts are added."""
    sent = _columns(cuts)

    def count(batches):
        total = np.zeros(len(sent) + 1, np.int64)
        for b in batches:
            np.add.at(total, position([b.column(i).to_numpy() for i in range(3)], sent), b.column(3).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "bytes"])

    out = np.zeros(len(cuts) + 1, np.int64)
    for r in rows.select("k", "d", "u", "size").mapInArrow(count, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect():  # one row for each probe
        out[r["at"]] = r["bytes"]
    return np.cumsum(out)[:-1].tolist()


def _between(lo: int, hi: int, most: int, ids: tuple[int, int], last_row: int) -> list[int]:
    """Up to `most` keys evenly between two: whole hashes as long as there are any, then ids that occur, then rows."""
    first, last = lo // HASH, -(-hi // HASH)
    unit = HASH
    if last - first <= 1:  # all in one hash
        base = lo // HASH * ID
        first, last, unit = max(lo // ID, base + ids[0] - LOW), min(-(-hi // ID), base + ids[1] - LOW + 1), ID
        if last - first <= 1:  # all of one id
            base = first * ID - LOW
            first, last, unit = max(lo, base - 1), min(hi, base + last_row + 1), 1
    n = last - first - 1
    return sorted({(first + 1 + i * n // most) * unit for i in range(most)}) if n > 0 else []


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The keys at which shards 1, 2 and so on begin, in order."""
    stats = rows.agg(F.sum("size").alias("bytes"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("u").alias("last")).first()
    total = stats["bytes"] or 0
    if not total:
        return []
    slack, ids = tolerance * total / shards, (stats["lo"], stats["hi"])
    # For each target the tightest keys known below and above it, with the bytes before them.
    targets = [total * i / shards for i in range(1, shards)]
    low, high = [(0, 0)] * (shards - 1), [(HASH * ID - 1, total)] * (shards - 1)
    cut: list[int | None] = [None] * (shards - 1)
    nearest = lambda i: min((low[i], high[i]), key=lambda x: abs(x[1] - targets[i]))
    while todo := [i for i, c in enumerate(cut) if c is None]:
        gaps: dict[tuple[int, int], int] = {}
        for i in todo:
            gap = (low[i][0], high[i][0])
            gaps[gap] = gaps.get(gap, 0) + 1
        found = {gap: _between(*gap, PROBES * n, ids, stats["last"]) for gap, n in gaps.items()}
        at = sorted({p for ps in found.values() for p in ps})
        before = bytes_before(rows, at) if at else []
        for i in todo:
            nothing_between = not found[low[i][0], high[i][0]]
            a, b = bisect_right(at, low[i][0]), bisect_left(at, high[i][0])
            j = bisect_right(before, targets[i], a, b) if a < b else a
            if a < j:
                low[i] = (at[j - 1], before[j - 1])
            if j < b:
                high[i] = (at[j], before[j])
            if nothing_between or abs(nearest(i)[1] - targets[i]) <= slack:
                cut[i] = nearest(i)[0]
    return sorted(cut)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): slots follow the sorted order within the shard."""
    rows = save(keys(docs), "shard-keys")
    cuts = _columns(splitters(rows, shards, tolerance))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "size", "text_crc32", "k", "d", "u"]

    def place(batches):
        for b in batches:
            at = position([b.column(n).to_numpy() for n in ("k", "d", "u")], cuts)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(at, pa.int32())], [*names, "shard"])

    def number(batches):
        """One task of the exchange: numbers its rows in order, from 0 in each shard."""
        from pyspark import TaskContext

        part, last, nth = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = b.column("shard").to_numpy()
            slot = np.empty(len(at), np.int64)
            for lo, hi in _runs(at):
                if at[lo] != last:
                    last, nth = at[lo], 0
                slot[lo:hi] = nth + np.arange(hi - lo)
                nth += hi - lo
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:3]), b.column("shard"), pa.array(np.full(len(at), part, np.int32)), pa.array(slot)], [*names[:3], "shard", "part", "nth"])

    placed = rows.select(*names).mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, k long, d long, u long, shard int")
    parts = max(shards, -(-rows.count() // range_rows))
    exchanged = placed.repartitionByRange(parts, "shard", "k", "d", "u").sortWithinPartitions("shard", "k", "d", "u")
    numbered = save(exchanged.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, shard int, part int, nth long"), "shard-numbered")
    forget(rows)
    # Where a task's rows begin in a shard: one row for each task, and for each shard that begins within one.
    counts = numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("begin"))
    joined = numbered.join(F.broadcast(begins), ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _runs(a: np.ndarray):
    edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    return [(i, j) for i, j in zip(edges, edges[1:]) if i < j]
