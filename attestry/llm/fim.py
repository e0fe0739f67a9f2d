"""Fill-in-middle: texts cut at two units and reordered, the cuts found through a sparse index of checkpoints.

While units (lines) are counted, the byte and code-point offset of every EVERYth unit's begin is recorded. A cut is found by binary search over
the checkpoints and a rescan of fewer than EVERY units from there; no offsets of all units are kept, and no text is decoded.

Null texts count as empty, and empty ones stay plain; so do texts that hold a marker, of whatever length. A null id has the digest of the seed
alone. Rows are independent: repeated ones give repeated rows, an empty table an empty one; of other columns none is read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import small_batches

MARKERS = ("<P>", "<S>", "<M>")
#: Units between checkpoints, and bytes counted at a time.
EVERY, BLOCK = 64, 1 << 20
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output binary"


class Checkpoints:
    """The number of units of a text, and for every EVERYth the offsets of its begin."""

    def __init__(self, text: bytes, every: int = EVERY):
        self.text, self.units, self.at, self.points = text, [0], [0], [0]
        seen = points = 0
        for lo in range(0, len(text), BLOCK):
            block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - lo), lo)
            ends = np.flatnonzero(block == 10)
            begins = (block & 0xC0) != 0x80  # code points by their first bytes
            picked = ends[every - 1 - seen % every :: every] + 1
            if len(picked):
                self.units += range(seen - seen % every + every, seen + len(ends) + 1, every)
                self.at += (picked + lo).tolist()
                self.points += (points + np.cumsum(np.add.reduceat(begins, np.concatenate(([0], picked[:-1])), dtype=np.int64) - _overrun(begins, picked))).tolist()
            seen += len(ends)
            points += int(np.count_nonzero(begins))
        self.n = seen + (text[-1:] not in (b"", b"\n"))

    def find(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which that unit begins; the n-th begins at the end."""
        k = bisect_right(self.units, unit) - 1
        at = self.at[k]
        for _ in range(unit - self.units[k]):
            at = self.text.find(b"\n", at) + 1 or len(self.text)
        rescanned = np.frombuffer(self.text, np.uint8, at - self.at[k], self.at[k])
        return at, self.points[k] + int(np.count_nonzero((rescanned & 0xC0) != 0x80))


def _overrun(begins: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """reduceat's last sum runs on to the block's end: what lies beyond the last checkpoint."""
    out = np.zeros(len(picked), np.int64)
    out[-1] = np.count_nonzero(begins[picked[-1] :])
    return out


def draws(seed: int, doc_id: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS, every: int = EVERY) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): of `rate` in a hundred documents a form with its parts moved, `spm` in a hundred of
    them suffix first. form is plain, psm or spm; of plain ones output is the text and the two lengths are null."""
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    p, s, m = (x.encode() for x in markers)

    def one(name: str, text: bytes):
        index = Checkpoints(text, every)
        h = draws(seed, name)
        if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
            return index.n, "plain", None, None, text
        first, last = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
        (a, a_points), (b, b_points) = index.find(first), index.find(last)
        head, middle, tail = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm:
            return index.n, "spm", a_points, b_points - a_points, b"".join((s, tail, p, head, m, middle))
        return index.n, "psm", a_points, b_points - a_points, b"".join((p, head, s, tail, m, middle))

    def run(batches):
        for b in batches:
            if b.num_rows:
                done = zip(*map(one, b.column(1).to_pylist(), b.column(2).to_pylist()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(done, kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {FIELDS}")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from output and form alone. No part holds a marker, so each is cut at the first one that follows it."""
    p, s, m = (F.lit(x) for x in markers)
    # psm and spm differ in which marker leads; what is between the first two markers, and what follows the second.
    lead, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    body = F.substring(output, F.length(lead) + 1, F.length(output))
    one = F.call_function("substring_index", body, second, F.lit(1))
    rest = F.substring(body, F.length(one) + F.length(second) + 1, F.length(body))
    two = F.substring_index(rest, markers[2], 1)
    middle = F.substring(rest, F.length(two) + F.length(m) + 1, F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


ORACLE = r"""with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
u as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(units[1:a], ''), '') as head, coalesce(array_to_string(units[a + 1:b], ''), '') as middle, coalesce(array_to_string(units[b + 1:], ''), '') as tail from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(head) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || middle else '<S>' || tail || '<P>' || head || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p"""
