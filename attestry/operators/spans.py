"""Where in a file a known text stands, and how far the file's wording departs from it.

Shingle containment names the candidates, in the JVM. For each, runs of words that the known text holds once are its anchors; of the window of the
file that holds most of them the longest increasing run of anchors is kept, and what lies between, before and after them is aligned word by word.
The distance is the least number of words to put in, take out or change; confidence is what is left of the known text's words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators import classify

#: Share of a known text's shingles from which a file is aligned with it, words of an anchor, and how much longer than the text its window may be.
CANDIDATE, ANCHOR, STRETCH = 0.25, 3, 1.25
PLACE = T.StructType().add("first", "integer").add("last", "integer").add("distance", "integer")


def distance(a: np.ndarray, b: np.ndarray, free: bool = False) -> tuple[int, int]:
    """(edits, end): the fewest edits that make a into b; with `free` into a beginning of b, whose length is `end`. A row of the table at a time."""
    places = np.arange(len(b) + 1)
    row = places.copy()
    for i, word in enumerate(a, 1):
        below = np.empty_like(row)
        below[0] = i
        below[1:] = np.minimum(row[:-1] + (b != word), row[1:] + 1)
        row = np.minimum.accumulate(below - places) + places
    end = int(np.argmin(row)) if free else len(b)
    return int(row[end]), end


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words: wrapping sums of multiples, so that one pass does all."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k].view(np.uint64)
    return out


def increasing(values: np.ndarray) -> list[int]:
    """The indexes of a longest strictly increasing run of values, in order."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values.tolist()):
        k = int(np.searchsorted(tops, v)) if tops else 0
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def anchors(file: np.ndarray, known: np.ndarray, n: int = ANCHOR) -> list[tuple[int, int]]:
    """(place in the file, place in the known text) of the runs of n words kept, both rising."""
    n = min(n, len(known))
    grams = _grams(known, n)
    values, first, counts = np.unique(grams, return_index=True, return_counts=True)
    values, first = values[counts == 1], first[counts == 1]
    if not len(values):
        return []
    ours = _grams(file, n)
    at = np.minimum(np.searchsorted(values, ours), len(values) - 1)
    f = np.flatnonzero(values[at] == ours)
    if not len(f):
        return []
    # The window: of all that begin at an anchor the first that holds the most different ones.
    k = first[at[f]]
    ends = np.searchsorted(f, f + int(len(known) * STRETCH) + n)
    held = ends - np.arange(len(f))
    best = 0, 0
    for i in np.argsort(-held, kind="stable"):
        if held[i] <= best[0]:
            break
        different = len(np.unique(k[i : ends[i]]))
        if different > best[0]:
            best = different, int(i)
    i = best[1]
    f, k = f[i : ends[i]], k[i : ends[i]]
    return [(int(f[j]), int(k[j])) for j in increasing(k)]


def place(file: np.ndarray, known: np.ndarray) -> tuple[int, int, int] | None:
    """(first, last, distance) of the known text in the file, last exclusive; None without an anchor."""
    chain = anchors(file, known)
    if not chain:
        return None
    n = min(ANCHOR, len(known))
    f, k = chain[0]
    # Before the first anchor, backwards; the file's side may begin anywhere.
    edits, back = distance(known[:k][::-1], file[max(0, f - 2 * k) : f][::-1], free=True)
    first = f - back
    f, k = f + n, k + n
    for nf, nk in chain[1:]:
        if nf < f or nk < k:  # overlaps the one before: only the new words count, and only where both sides move alike
            step = min(nf + n - f, nk + n - k)
            if nf - f != nk - k:
                continue
            f, k = f + step, k + step
            continue
        edits += distance(known[k:nk], file[f:nf])[0]
        f, k = nf + n, nk + n
    rest = len(known) - k
    more, ahead = distance(known[k:], file[f : f + 2 * rest], free=True)
    return first, f + ahead, edits + more


@F.pandas_udf(PLACE)
def _place(file: pd.Series, known: pd.Series) -> pd.DataFrame:
    out = [place(np.asarray(a, np.int64), np.asarray(b, np.int64)) or (None, None, None) for a, b in zip(file, known)]
    return pd.DataFrame(out, columns=["first", "last", "distance"]).astype("Int32")


def _hashed(text: Column) -> Column:
    return F.transform(classify.tokens(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def located(files: DataFrame, key: list[str], corpus: DataFrame, text: str = "text", candidate: float = CANDIDATE) -> DataFrame:
    """(key..., id, first, last, distance, total, confidence): each corpus(id, text) entry of which a file holds a fair share, where it stands
    best, in words. Only candidates' words travel, as hashes: a file's once for each candidate."""
    pairs = classify.containment(files, key, corpus, text).where(F.col("confidence") >= candidate).select(*key, "id")
    known = corpus.select("id", _hashed(F.col("text")).alias("known"))
    words = files.select(*key, _hashed(F.col(text)).alias("words"))
    both = pairs.join(known, "id").join(words, key).withColumn("p", _place("words", "known"))
    total = F.size("known")
    out = both.where("p.first is not null").select(*key, "id", "p.first", "p.last", "p.distance", total.alias("total"))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("total")))


def nearest(places: DataFrame, key: list[str]) -> DataFrame:
    """Of located() texts that claim one place, the one that explains most of it: of two that share more than half of the shorter one's words, that of the
    larger total - 2 * distance stays, ties by confidence and id. A file has few candidates."""
    order = F.struct((2 * F.col("distance") - F.col("total")).alias("a"), (-F.col("confidence")).alias("b"), "id", "first", "last", "distance", "total", "confidence")
    per = places.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("all"))
    shared = lambda k, m: F.least(k["last"], m["last"]) - F.greatest(k["first"], m["first"])
    clash = lambda k, m: 2 * shared(k, m) > F.least(k["last"] - k["first"], m["last"] - m["first"])
    kept = F.aggregate("all", F.expr("filter(all, x -> false)"), lambda acc, m: F.when(F.exists(acc, lambda k: clash(k, m)), acc).otherwise(F.concat(acc, F.array(m))))
    return per.select(*key, F.explode(kept).alias("m")).select(*key, "m.id", "m.first", "m.last", "m.distance", "m.total", "m.confidence")


def identify(files: DataFrame, key: list[str], corpus: DataFrame, text: str = "text") -> DataFrame:
    """(key..., id, first, last, distance, total, confidence): the known texts of each file with their places. Two texts of one file are two rows, an
    altered text has its nearest name and a lower confidence, and a text that lies within another's is no row."""
    return nearest(located(files, key, corpus, text), key)
