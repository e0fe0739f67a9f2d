"""Best-fit packing of token sequences, with bounds that certify the number of bins.

Every partition packs its own pieces by best-fit decreasing and compares its number of bins with a lower bound from dual
feasible functions. Where the two agree, the partition is certified: no packing of its pieces needs fewer bins. The whole
result is measured the same way. While it has more bins than the bound over all pieces, partitions exchange documents:
pieces of bins with a gap move, by hash, into fewer partitions, which rerun best-fit decreasing; a rerun that needs no
fewer bins is discarded. Rounds end when the bound is met, when one partition has held all that is open, or when what is open can't be
held by fewer partitions and a round has taken less than WORTH of the bins above the bound. `report` gets bins, bound and rounds.

Defined results: null text is an empty document, which is the end id alone; a very long text is encoded whole and cut into full
pieces and one rest; repeated rows are packed each by itself, dealt out like any others; pieces of equal length are packed in order
of their ids; an empty table gives no rows; a null doc_id is kept; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import forget, remembered, save, small_batches

CAPACITY = 2048
#: Pieces that one task packs, a few dozen bytes each.
TASK_PIECES = 120_000
MEMORY = 350_000
#: What a round must gain, as a share of the bins above the bound, for another of the same width.
WORTH = 0.05
#: Control characters that Python, but not the vocabulary's pre-tokenizer, takes for white space aren't among bytes.split()'s.
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"

class WordIds(dict):
    """Word → its ids as little-endian 32-bit numbers. A text may be cut at ASCII white space, which the vocabulary drops
    before it splits; neither its normaliser nor its pattern looks across."""

    def __init__(self, spec: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.cuttable = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"])
        self.special = {t["content"].encode() for t in parsed["added_tokens"]} | {t["content"].lower().encode() for t in parsed["added_tokens"]} | {b"<|"}
        self.lowers = "Lowercase" in json.dumps(parsed["normalizer"])
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: What was remembered before the last time that the memory was full; words still in use come back from it.
        self.older: dict[bytes, bytes] = {}

    def _remember(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= self.memory:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.older.get(word)) is not None:
            return self._remember(word, ids)
        core = word.rstrip(b".,")
        if core != word and core and core[-1:].isalpha() and b"<|" not in word:
            # Between an ASCII letter and a stop or comma the pattern always splits.
            return self._remember(word, self[core] + self[word[len(core) :]])
        return self._remember(word, np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes())

    def ids(self, text: bytes) -> bytes:
        if not self.cuttable:
            return self[text]
        # The vocabulary lower-cases; doing so first lets more words be known. Special tokens are met with their case.
        words = text.split() if any(t in text for t in self.special) or not self.lowers else text.lower().split()
        return b"".join(map(self.__getitem__, words))


def word_ids(spec: str, memory: int = MEMORY) -> WordIds:
    return remembered(("packing", hash(spec), memory), lambda: WordIds(spec, memory))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, memory: int = MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut only if longer than a bin."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB, fixed in size
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(spec.value, memory)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = words.ids(text or b"") + last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return given.mapInArrow(run, PIECES.format(id=given.schema["doc_id"].dataType.simpleString()))


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best bound over two families of dual feasible functions: u(x) that drops pieces under a threshold and counts those
    above its complement as whole, and the rounding functions u_k(x) for k to 20."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    for e in np.unique(np.concatenate([lengths[lengths <= capacity // 2], capacity - lengths[lengths > capacity // 2] + 0])):
        if not 0 < e <= capacity // 2:
            continue
        big, mid = lengths > capacity - e, (lengths >= e) & (lengths <= capacity - e)
        best = max(best, int(counts[big].sum()) + -(-int((lengths[mid] * counts[mid]).sum()) // capacity))
    for k in range(1, 21):
        x = (k + 1) * lengths
        whole = x % capacity == 0
        value = np.where(whole, lengths * k, (x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, gap of the bin) of pieces given longest first. Open bins are kept by the room they have; one number's
    bits say which rooms exist, so the tightest bin that fits is its lowest bit at or above the length."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room = 0, []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)[bins] if len(bins) else bins


def _pack_once(items: DataFrame, parts: int, round_no: int, capacity: int) -> DataFrame:
    """Deals the pieces into `parts` partitions by hash and packs each. Adds the bin, the place in it, the bin's gap, and the
    partition with its number of bins and its bound."""
    kind = items.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        n = t.column("length").to_numpy()
        bins, offsets, gaps = best_fit_decreasing(n, capacity)
        part = TaskContext.get().partitionId()
        values, counts = np.unique(n, return_counts=True)
        bound, used = lower_bound(values, counts, capacity), int(bins.max()) + 1
        size = len(n)
        t = (
            t.append_column("sequence_id", pa.array(bins + (part << 28) + (round_no << 50)))
            .append_column("offset", pa.array(offsets))
            .append_column("gap", pa.array(gaps))
            .append_column("part", pa.array(np.full(size, part)))
            .append_column("part_bins", pa.array(np.full(size, used)))
            .append_column("part_bound", pa.array(np.full(size, bound)))
        )
        yield from t.to_batches(50_000)

    dealt = items.select(*names, F.xxhash64("row", F.lit(round_no)).alias("deal")).repartition(parts, "deal")
    return dealt.mapInArrow(run, PIECES.format(id=kind) + ", row long, sequence_id long, offset long, gap long, part long, part_bins long, part_bound long")


def pack(items: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, report: dict | None = None) -> DataFrame:
    """Packs (doc_id, piece, start, length, ids_crc32) into sequences of at most `capacity`; `certified` says that the
    partition which packed the piece met its bound. `report`, if given, gets bins, bound and rounds."""
    # Numbered once and written, so that rows alike in all else are told apart, and the same way if a task is repeated.
    items = save(items.withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = items.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in by_length)
    bound = lower_bound(np.array([r["length"] for r in by_length]), np.array([r["count"] for r in by_length]), capacity)
    parts = max(1, -(-total // task_pieces))
    done, open_now = [], save(_pack_once(items, parts, 0, capacity), "packed-0")
    open_bins = open_now.where("offset = 0").count()
    closed_bins, width, k = 0, parts, 0
    while closed_bins + open_bins > bound and width > 1:
        k += 1
        full, gaps = open_now.where("gap = 0"), open_now.where("gap > 0")
        seen = gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        least = max(1, -(-seen["n"] // task_pieces))
        before, width = width, max(least, min(width - 1, width // 8))
        again = save(_pack_once(gaps, width, k, capacity), f"packed-{k}")
        bins = again.where("offset = 0").count()
        gain, above = seen["bins"] - bins, closed_bins + open_bins - bound
        if gain > 0:
            done.append(full)
            closed_bins, open_bins, open_now = closed_bins + open_bins - seen["bins"], bins, again
        else:
            forget(again)
        if gain < WORTH * above and (width == least or width >= before):
            break
    out = open_now
    for d in done:
        out = out.unionByName(d)
    forget(items)
    if report is not None:
        report.update(bins=closed_bins + open_bins, bound=bound, rounds=k)
    return out.withColumn("certified", F.col("part_bins") == F.col("part_bound")).drop("part_bins", "part_bound", "part", "row")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, report: dict | None = None, memory: int = MEMORY) -> DataFrame:
    """`memory`: words that a Python worker remembers, twice over at most; fewer cost time, not rows."""
    return pack(pieces(docs, vocabulary, capacity, memory=memory), capacity, task_pieces, report)
