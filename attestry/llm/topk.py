"""Exact top-k search by inner product over a pivot-distance index.

Vectors become whole numbers (floor(scale * x)), so scores and squared distances are exact. Pivots are chosen from a bounded
sample, far from one another. Each vector is keyed by its nearest pivot and its distance to it; the keys of one pivot are cut
into annuli by a histogram of the distances, at most CELLS a pivot however many vectors there are. A query sorts the annuli by the
best score that they may hold: by the triangle inequality |d(q, p) - d(x, p)| is at most d(q, x), and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2,
so an annulus' radii and its longest vector bound every score in it. In that order it expands outwards, in rounds of one, then eight,
then sixty-four annuli and so on, and its k-th score so far rises; it stops at the first annulus whose bound is under that score, as all
later ones are too. An annulus is searched in blocks of a bounded number of vectors and queries.

Blocks stay where the exchange puts them and queries stream past: a task holds one block and one batch of queries, and a block is copied
only for each QUERIES queries that ask for it.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Products are exact whatever their size:
where 64 bits might not hold a sum, whole numbers of any length are used. Only a score among the k highest that 64 bits don't hold, or a
component that no double holds when scaled, ends the job, with an error that says so. Vectors of unlike length are
never compared; ties go to the smaller id; rows that repeat an id are candidates of their own, but never of a query with that id; a
query id with several different vectors is as many queries, each with ranks of its own; an empty table gives no rows; a null id takes
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import forget, save, shuffle_partitions

SAMPLE = 2048
PIVOTS = 32
#: Histogram cells for each pivot's distances, so annuli at most; vectors that an annulus has at least, but for a pivot's last.
CELLS, ANNULUS = 256, 2048
#: Vectors of a block, and queries that pass it in one task.
BLOCK, QUERIES = 8192, 262_144
#: Stands for a score that is too low for 64 bits.
LOWEST = -(2**63) + 1
#: How many times as many annuli each round takes as the one before.
GROW = 8


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, v array<double>) of the vectors that take part, in whole numbers."""
    x = F.col(vector_col)
    # NaN is beyond infinity here; null makes forall null.
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(F.forall(x, lambda c: F.abs(c.cast("double")) < float("inf")), F.lit(False))

    def scaled(c):
        # A double holds every such whole number exactly; from 2**52 on it is one already.
        y = c.cast("double") * scale
        small, fits = F.abs(y) < 2.0**52, F.abs(y) < float("inf")
        return F.when(small, F.floor(y).cast("double")).when(fits, y).otherwise(F.raise_error(F.lit("a component of a vector is beyond all doubles when scaled")).cast("double"))

    quantised = F.transform(x, scaled)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), quantised.alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers: in floating point where every sum stays below 2**53, in 64 bits below 2**62, else in whole numbers of any length."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    long = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return long(a) @ long(b).T


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample's vector farthest from those so far."""
    sample = np.unique(sample, axis=0)
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _keyed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the nearest pivot (numbered over all lengths of vector), its squared distance and the squared norm."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows for each length
    first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist()))

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, p = _matrix(part.column(2)), sent.value[int(dim)]
                # As floats: the bounds allow for their rounding.
                norm = (x**2).sum(1)
                d2 = np.stack([((x - row) ** 2).sum(1) for row in p], axis=1)
                near = d2.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(near + first[int(dim)], pa.int32()), pa.array(d2[np.arange(len(x)), near]), pa.array(norm)], ["id", "dim", "v", "pivot", "d2", "norm"]
                )

    return vectors.mapInArrow(run, "id long, dim int, v array<double>, pivot int, d2 double, norm double")


def index(keyed: DataFrame, annulus: int = ANNULUS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(the vectors with annulus and block, one row of radii for each annulus). Annuli are numbered (pivot, annulus), blocks are parts of them by hash."""
    spread = keyed.groupBy("pivot").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi"))
    cells = keyed.join(F.broadcast(spread), "pivot")  # one row for each pivot
    width = F.greatest(F.lit(1.0), (F.sqrt("hi") - F.sqrt("lo")) / CELLS)
    celled = cells.withColumn("cell", F.floor((F.sqrt("d2") - F.sqrt("lo")) / width).cast("int")).drop("lo", "hi")
    counts = celled.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most CELLS + 1 rows a pivot
    upto = F.sum("n").over(Window.partitionBy("pivot").orderBy("cell"))
    annuli = counts.withColumn("annulus", F.floor((upto - F.col("n")) / annulus).cast("long")).withColumn("n", F.sum("n").over(Window.partitionBy("pivot", "annulus"))).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    placed = celled.join(F.broadcast(annuli), ["pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).drop("cell")
    radii = placed.groupBy("pivot", "annulus", "dim").agg(F.min("d2").alias("r_min2"), F.max("d2").alias("r_max2"), F.max("norm").alias("norm_max"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
    return placed, radii


def _search(queries: DataFrame, assigned: DataFrame, placed: DataFrame, k: int, tasks: int) -> DataFrame:
    """Each query's k best of each block of the annuli that it is assigned to, but for rows of its own id."""
    key = ["pivot", "annulus", "part", "chunk"]
    # At most one row for each annulus.
    asked = assigned.groupBy("pivot", "annulus").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    passing = queries.join(assigned, "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(F.broadcast(asked), ["pivot", "annulus"])
    passing = passing.select(F.lit(1).alias("side"), "q", "id", "v", "pivot", "annulus", "part", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int").alias("chunk"))
    held = placed.join(F.broadcast(asked), ["pivot", "annulus"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select(F.lit(0).alias("side"), F.lit(-1).cast("long").alias("q"), "id", "v", "pivot", "annulus", "part", "chunk")
    # Of each block its vectors come first, then the queries.
    met = held.unionByName(passing).repartition(tasks, *key).sortWithinPartitions(*key, "side")

    def best_of(nth, qi, qv, xi, xv):
        for at in range(0, len(qi), 256):
            s = products(qv[at : at + 256], xv)
            own = qi[at : at + 256, None] == xi[None]
            wide = s.dtype == object
            s[own] = -(2**200) if wide else LOWEST
            best = np.argsort(-s, axis=1, kind="stable")[:, :k] if wide or s.shape[1] <= 4 * k else _best(s, k)
            rows = np.repeat(np.arange(len(s)), best.shape[1])
            cols = best.ravel()
            keep = ~own[rows, cols]
            picked = s[rows[keep], cols[keep]]
            if wide:
                if max(picked, default=0) >= 2**63:
                    raise OverflowError("a score among the highest doesn't fit 64 bits")
                picked = np.array([max(int(x), LOWEST) for x in picked], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nth[at + rows[keep]]), pa.array(xi[cols[keep]]), pa.array(picked)], ["q", "vec_id", "score"])

    def run(batches):
        now, ids, vectors = None, [], []
        for b in batches:
            cols = [b.column(c).to_numpy() for c in key]
            side, qs, them = b.column("side").to_numpy(), b.column("q").to_numpy(), b.column("id").to_numpy()
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*cols, side)], axis=0)) + 1 if b.num_rows else []
            edges = [0, *changes, b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                here = tuple(int(c[lo]) for c in cols)
                if here != now:
                    now, ids, vectors = here, [], []
                v = _matrix(b.column("v").slice(lo, hi - lo))
                if side[lo] == 0:
                    ids.append(them[lo:hi])
                    vectors.append(v)
                elif ids:
                    xi, xv = np.concatenate(ids), np.concatenate(vectors)
                    order = np.argsort(xi, kind="stable")
                    ids, vectors = [xi[order]], [xv[order]]
                    yield from best_of(qs[lo:hi], them[lo:hi], v, ids[0], vectors[0])

    return met.mapInArrow(run, "q long, vec_id long, score long")


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, ties to the smaller column."""
    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(s), k), np.int64)
    for i, row in enumerate(s):
        at = np.flatnonzero(row >= cut[i])
        out[i] = at[np.argsort(-row[at], kind="stable")][:k]
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _queries(asked: DataFrame) -> DataFrame:
    """Adds q, a number for each distinct (id, vector)."""
    # Numbered once and written: a task that is repeated finds the same numbers.
    return save(asked.dropDuplicates(["id", "v"]).withColumn("q", F.monotonically_increasing_id()), "topk-queries")


def search(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS, annulus: int = ANNULUS, block: int = BLOCK, report: dict | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of `queries` with rows of other ids. `report`, if given,
    gets the rounds, and how many scores were computed of how many that a search of everything computes."""
    spark = vectors.sparkSession
    base = whole(vectors, id_col, vector_col, scale)
    dims = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen: dict[int, np.ndarray] = {}
    for dim, n in dims.items():
        share = -(2**63) + int(2**64 * min(1.0, 1.2 * SAMPLE / n)) - 1
        rows = base.where((F.col("dim") == dim) & (F.xxhash64("id") <= share)).select("v").limit(2 * SAMPLE).collect()  # bounded sample, for the pivots alone
        if not rows:
            rows = base.where(F.col("dim") == dim).select("v").limit(SAMPLE).collect()
        chosen[dim] = pivots_of(np.array([r["v"] for r in rows], float), pivots)
    keyed = save(_keyed(base, chosen), "topk-keyed")
    placed, radii = (save(df, f"topk-{name}") for df, name in zip(index(keyed, annulus, block), ("placed", "radii")))
    asked = _queries(_keyed(whole(queries, id_col, vector_col, scale).where(F.col("dim").isin(*dims)), chosen))
    # At most PIVOTS * (CELLS + 1) annuli for each length of vector.
    annuli = radii.orderBy("pivot", "annulus", "dim").toPandas()
    sent = spark.sparkContext.broadcast((chosen, {c: annuli[c].to_numpy() for c in annuli}))
    first = dict(zip(chosen, np.cumsum([0, *(len(p) for p in chosen.values())]).tolist()))

    def expand(batches, start: int, end: int):
        """The annuli from place `start` to `end` of each query's order, as far as its k-th score allows."""
        pv, a = sent.value
        lo, hi, longest = np.sqrt(a["r_min2"].astype(float)), np.sqrt(a["r_max2"].astype(float)), a["norm_max"].astype(float)
        for b in batches:
            qs, picks = [], []
            for q, dim, v, norm, kth in zip(*(b.column(n).to_pylist() for n in ("q", "dim", "v", "norm", "kth"))):
                d2 = ((pv[dim] - np.array(v, float)) ** 2).sum(1)
                mine = np.flatnonzero(a["dim"] == dim)
                d = np.sqrt(d2)[a["pivot"][mine] - first[dim]]
                gap = np.maximum(0, np.maximum(d - hi[mine], lo[mine] - d))
                # A little more than the bound, so that rounding never rules out an annulus.
                bound = (norm + longest[mine] - gap**2) / 2 + (norm + longest[mine] + d**2 + hi[mine] ** 2) * 1e-12 + 1
                bound[np.isnan(bound)] = np.inf  # squares beyond all doubles bound nothing
                order = np.argsort(-bound, kind="stable")[start:end]
                if kth is not None:
                    order = order[bound[order] >= kth - abs(kth) * 1e-15]
                qs.append(np.full(len(order), q, np.int64))
                picks.append(mine[order])
            pick = np.concatenate([*picks, np.empty(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*qs, np.empty(0, np.int64)]).astype(np.int64)), pa.array(a["pivot"][pick], pa.int32()), pa.array(a["annulus"][pick], pa.int64()), pa.array(a["parts"][pick], pa.int32()), pa.array(a["n"][pick], pa.int64())], ["q", "pivot", "annulus", "parts", "n"])

    found, start, take, rounds, scores = None, 0, 1, 0, 0
    # Annuli of one length of vector: no query has more.
    longest = int(annuli.groupby("dim").size().max())
    while start < longest:
        kth = found.where(F.col("rank") == k).select("q", F.col("score").alias("kth")) if found is not None else None
        state = asked.select("q", "dim", "v", "norm")
        state = state.join(kth, "q", "left") if kth is not None else state.withColumn("kth", F.lit(None).cast("long"))
        end = start + take
        assigned = save(state.mapInArrow(lambda it, i=start, j=end: expand(it, i, j), "q long, pivot int, annulus long, parts int, n long"), "topk-assigned")
        computed = assigned.agg(F.sum("n").alias("n")).first()["n"]
        if not computed:
            forget(assigned)
            break
        new = _search(asked.select("q", "id", "v"), assigned, placed, k, shuffle_partitions(spark))
        after = save(_top(new if found is None else found.drop("rank").unionByName(new), k), "topk-found")
        forget(assigned, *([found] if found is not None else []))
        found, start, take, rounds, scores = after, end, take * GROW, rounds + 1, scores + computed
    if report is not None:
        per_dim = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        report.update(rounds=rounds, annuli=len(annuli), scores=scores, of=sum(n * dims[d] for d, n in per_dim.items()))
    forget(keyed, placed, radii)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    told = F.when(F.col("score") == LOWEST, F.raise_error(F.lit("a score among the highest doesn't fit 64 bits")).cast("long")).otherwise(F.col("score"))
    return found.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", told.alias("score"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(embedding) > 0),
s as (select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) as bigint) as score from v q join v x on q.vec_id <> x.vec_id and len(q.v) = len(x.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
