"""Only what changed is audited again: components whose content hash no determination has yet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.functions import digests, paths


def undetermined(hashes: DataFrame, determinations: DataFrame) -> DataFrame:
    """hashes(component_id, terms_content_hash) that no row of determinations(terms_content_hash) answers."""
    return hashes.join(determinations.select("terms_content_hash").distinct(), "terms_content_hash", "left_anti")


def watch(arrivals: DataFrame, determinations: Callable[[], DataFrame], audit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `audit` on each micro-batch's undetermined components. `determinations` is read anew for every batch; the checkpoint
    holds which arrivals were seen, so `audit` must be idempotent by batch id."""

    def batch(df: DataFrame, batch_id: int) -> None:
        audit(undetermined(df.dropDuplicates(["terms_content_hash"]), determinations()), batch_id)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGE = "component_id string, path string, digest string, seq bigint"
KEYS = "component_id string, terms_content_hash string, files bigint"
_STATE = "paths array<string>, digests array<string>, seqs array<bigint>"


def content_key(records: list[tuple[str, str]]) -> str:
    """The key of a set of (path, digest), as digests.content_hash has it."""
    whole = hashlib.sha256()
    for parts in sorted((p.encode(), d.encode()) for p, d in records):
        for part in parts:
            whole.update(b"%d:%b" % (len(part), part))
    return f"{digests.SCHEME}-{whole.hexdigest()}"


def changes_of(files: DataFrame, removed: str = "removed", seq: str = "seq") -> DataFrame:
    """changes(component_id, path, digest, seq) of a feed of files(component_id, path, content, removed, seq): licence files only; a removal has no digest."""
    covered = files.where(paths.is_terms_file(F.col("path")))
    return covered.select("component_id", "path", F.when(~F.col(removed), digests.file_digest(F.col("content"))).alias("digest"), F.col(seq).cast("long").alias("seq"))


def _applied(key: tuple, feed: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {p: (s, d) for p, d, s in zip(*state.get)} if state.exists else {}
    before = {p: d for p, (_, d) in held.items() if d is not None}
    for changes in feed:
        for p, d, s in zip(changes["path"], changes["digest"], changes["seq"]):
            d = d if isinstance(d, str) else None
            # What is older than what is known is late; a removal stays known, so that an older change doesn't bring the file back.
            if p not in held or (s, d is not None, d or "") > (held[p][0], held[p][1] is not None, held[p][1] or ""):
                held[p] = (int(s), d)
    order = sorted(held)
    state.update(([*order], [held[p][1] for p in order], [held[p][0] for p in order]))
    now = {p: d for p, (_, d) in held.items() if d is not None}
    if now != before or not before:
        yield pd.DataFrame({"component_id": [key[0]], "terms_content_hash": [content_key(list(now.items()))], "files": [len(now)]})


def content_keys(changes: DataFrame) -> DataFrame:
    """(component_id, terms_content_hash, files): of a stream of changes the new key of each component that they touch. The state is one component's paths and
    digests, so a batch rehashes what it touches and nothing else; changes may come late, twice and in any order within and between batches."""
    return changes.groupBy("component_id").applyInPandasWithState(_applied, KEYS, _STATE, "update", GroupStateTimeout.NoTimeout)
