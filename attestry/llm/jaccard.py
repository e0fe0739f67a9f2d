"""N-gram Jaccard join by grouped prefixes, exact, with one row for each document: its class in the similarity graph.

A document's set holds the 64-bit hashes of its word shingles. Equal sets collapse into one representative. All sets are ordered
alike, rare shingles first (counts over all documents; an order is all they give, so their being estimates loses nothing).
Two sets can only reach the threshold if their prefixes share a shingle, and only if sizes and positions allow the overlap.
Representatives with identical prefix and size collapse into a group, which is posted once for each shingle of its prefix; pairs
of groups are filtered, then their members expanded and verified with the whole sets.

What is asked for is connectivity, so pairs already known to be connected need no check. A shingle with many groups is first
checked against one hub, the group with most such shingles (in a family of near copies the original); whatever isn't connected
to the hub after that is compared with everything under that shingle that it isn't connected to. No bucket is capped or dropped,
no pair of unconnected documents with a chance is left unverified, and none of the lists is collected.

Defined results: null or wordless text has an empty set, links with nothing and is its own class; a null doc_id stays alone with a
null class; rows that repeat a doc_id with different texts have each its own size, and one class, in which whatever any of the texts
resembles is; very long texts are whole sets like others; an empty table gives no rows; other columns aren't read. `keep_one` keeps,
with all columns, the rows whose doc_id is its class' smallest, once where id and text repeat (a null doc_id stays).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import forget, hold, remembered, save, settle, small_batches

#: Shingles met in fewer documents aren't told apart from rare ones; of others the most frequent are ranked, one for so many documents within
#: these bounds (what is sent is then at most 64 MB). All this only shapes the order.
FREQUENT, RANKED_DOCS, RANKED = 16, 64, (1 << 18, 1 << 22)
#: Shingles that a task gathers before it counts them; those that it meets once in so many don't count.
COUNTED = 2_000_000
#: Groups under one shingle from which a hub is used.
BUCKET = 40
MEMORY = 150_000
FILTER_BITS = 1 << 28
#: Candidates of one shingle that meet in one place at most, and about how many documents a place takes.
CROWD, PLACE = 400, 100
#: Rows of (document, place), two numbers each, that may be sent to every executor; more are joined by exchange.
BROADCAST_ROWS = 500_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int, distinct: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence counts as one if it is shorter."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered("shingles", Words).__getitem__, words), np.uint64, n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : n - k + 1 + i]) * _M1
            out ^= out >> np.uint64(31)
        out *= _M2
        out ^= out >> np.uint64(33)
    return np.unique(out) if distinct else out


def _frequent(docs: DataFrame, width: int, ranked: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, their ranks) of frequent shingles: each task counts its own, sums are added up over all documents."""

    def counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    def count(batches):
        waiting, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                waiting.append(shingles(t, width, False))
                size += len(waiting[-1])
            if size > COUNTED:
                yield counted(waiting)
                waiting, size = [], 0
        if size:
            yield counted(waiting)

    summed = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = summed.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(ranked).toArrow()  # at most RANKED[1] pairs of numbers
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    by_count = np.lexsort((h, n))
    rank = np.empty(len(h), np.int64)
    rank[by_count] = np.arange(1, len(h) + 1)
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], rank[order]


def _prefixes(docs: DataFrame, width: int, num: int, den: int, rows: int) -> DataFrame:
    """(doc_id, n, digest, prefix): the size, a 128-bit digest of the set, and its first shingles in the common order."""
    ranked = min(max(RANKED[0], rows // RANKED_DOCS), RANKED[1])
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width, ranked))  # at most RANKED[1] pairs of numbers
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        import xxhash

        known, ranks = sent.value
        for b in batches:
            ns, digests, prefixes = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                n = len(s)
                ns.append(n)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                p = n - -(-num * n // den) + 1 if n else 0
                if n and len(known):
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    rank = np.where(known[at] == s, ranks[at], 0)
                    s = s[np.argsort(rank, kind="stable")] if rank.any() else s
                prefixes.append(s[:p].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "prefix"])

    return given.mapInArrow(run, "doc_id long, n int, digest binary, prefix array<long>")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of the documents in `nodes`, and of the few others that share a bit with one of them in a filter of fixed size;
    what is too much here finds no partner in the join that follows. Other texts never leave their task."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (32 * nodes.count()).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = nodes.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # FILTER_BITS / 64 pairs of numbers at most
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    given = given.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(bits)))

    def run(batches):
        t = sent.value
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.select(["id", "text"]).filter(pa.array((t[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return given.mapInArrow(run, "id long, text binary")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int, rows: int) -> DataFrame:
    """Of the candidates (a, b, h) those whose whole sets reach the threshold.

    Candidates of one shingle h meet in one place, so that a text that resembles many travels and is cut into shingles once or a
    few times. Where a shingle has more than CROWD candidates they are dealt out by the end of the pair that has fewer candidates;
    only the other end, such as the original of a large family, is sent to several places. No place holds more than a bounded
    number of texts on average."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    degrees = settle(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "jaccard-degrees", rows)
    places = max(1, degrees.count() // PLACE)
    crowded = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > CROWD)
    named = lambda end: degrees.select(F.col("id").alias(end), F.col("degree").alias(f"d{end}"))
    joined = pairs.join(named("a"), "a").join(named("b"), "b").join(crowded, "h", "left")
    low = F.when((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    part = F.when(F.col("crowd").isNotNull(), F.pmod(F.xxhash64(low), F.ceil(F.col("crowd") / CROWD))).otherwise(0)
    dealt = settle(joined.select("a", "b", F.pmod(F.xxhash64("h", part), F.lit(places)).cast("int").alias("place")), "jaccard-dealt", rows)
    wanted = dealt.select(F.col("a").alias("id"), F.col("place").alias("goes")).unionByName(dealt.select(F.col("b").alias("id"), F.col("place").alias("goes"))).distinct()
    wanted = settle(wanted, "jaccard-wanted", rows)
    small = wanted.count() <= BROADCAST_ROWS
    texts = _texts(docs, degrees.select("id")).join(F.broadcast(wanted) if small else wanted, "id").select("goes", "id", "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for i, t in zip(right.column("id").to_pylist(), right.column("text").to_pylist()):
            # Rows that repeat an id stand for one node; the texts of each are tried.
            sets.setdefault(i, []).append(shingles(t, width))
        out = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            for x in sets.get(a, ()):
                if any(len(x) and len(y) and den * (n := len(np.intersect1d(x, y, assume_unique=True))) >= num * (len(x) + len(y) - n) for y in sets.get(b, ())):
                    out.append((a, b))
                    break
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    links = settle(dealt.groupBy("place").cogroup(texts.groupBy("goes")).applyInArrow(run, "a long, b long").distinct(), "jaccard-links", rows)
    forget(degrees, dealt, wanted)
    return links


def connected_components(links: DataFrame, rows: int) -> DataFrame:
    """(id, label): the smallest id reachable over (a, b), for the ids that have links. Smallest labels pass along links and are
    then looked up at the label itself, so chains halve from round to round."""
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges", rows)
    labels = settle(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "cc-labels", rows)
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("via"))
        near = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "via").alias("label"))
        far = near.join(labels.select(F.col("id").alias("label"), F.col("label").alias("beyond")), "label", "left").select("id", "old", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        after = settle(far, "cc-labels", rows)
        changed = after.agg(F.count_if(F.col("label") < F.col("old")).alias("n")).first()["n"]
        forget(labels)
        labels = after
        if not changed:
            forget(edges)
            return labels


def _fits(num: int, den: int):
    """Sizes (na >= nb) and places of the shared shingle leave room for the needed overlap."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (den * small >= num * large) & ((den + num) * room >= num * (F.col("na") + F.col("nb")))


def _rest(n: str, num: int, den: int) -> F.Column:
    """The size of a set of n without its prefix."""
    return F.ceil(num * F.col(n) / F.lit(den)).cast("long") - 1


def link(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; two link when den * |A and B| >= num * |A or B|."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    made = hold(_prefixes(docs, width, num, den, rows).withColumn("key", F.xxhash64("n", "prefix")))
    real = made.where("n > 0 and doc_id is not null")
    # Size and key follow from the set, so any of its documents' will do.
    reps = settle(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key")), "jaccard-reps", rows)
    groups = settle(reps.groupBy("key").agg(F.min(F.struct("rep", "digest")).alias("first"), F.count(F.lit(1)).alias("size")).select("key", F.col("first.rep").alias("g"), F.col("first.digest").alias("digest"), "size"), "jaccard-groups", rows)
    # Each group's prefix is looked up by its first member's id and set: no key is hot.
    own = real.select(F.col("doc_id").alias("g"), "digest", "n", "prefix")
    posted = groups.select("g", "digest").join(own, ["g", "digest"]).dropDuplicates(["g", "digest"]).select("g", "n", F.posexplode("prefix").alias("pos", "h"))
    posted = hold(posted.select("h", "g", (F.col("n").cast("long") * (1 << 31) + F.col("pos")).alias("np")))
    counts = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posts = posted.join(counts, "h").select("h", "g", F.shiftright("np", 31).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"), "c")
    posts = save(posts, "jaccard-posts")
    posted.unpersist()
    # Sets of n shingles that differ share at most n - 1, which small ones can't afford.
    big = groups.where("size > 1").join(own.select("g", "digest", "n"), ["g", "digest"]).select("key", "g", (den * (F.col("n") - 1) >= num * (F.col("n") + 1)).alias("may")).distinct()
    inside = settle(big.join(reps.select("key", F.col("rep").alias("member")), "key").select("g", "member", "may"), "jaccard-inside", rows)

    hot = settle(posts.where(F.col("c") > BUCKET).drop("c"), "jaccard-hot", rows)
    heat = settle(hot.groupBy("g").agg(F.count(F.lit(1)).alias("heat")), "jaccard-heat", rows)
    # How many shingles two prefixes share bounds what the sets can share: beyond the prefix that ends first, at most all its rest.
    cold = posts.where(F.col("c") <= BUCKET)
    left, right = cold.select("h", F.col("g").alias("a"), F.col("n").alias("na")), cold.select("h", F.col("g").alias("b"), F.col("n").alias("nb"))
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    shared = left.join(right, "h").where(larger & (den * F.col("nb") >= num * F.col("na"))).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("h"))
    of_heat = lambda end: heat.select(F.col("g").alias(end), F.col("heat").alias(f"h{end}"))
    # Frequent shingles aren't joined here, so every one of them counts as shared.
    most = F.col("k") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) + F.greatest(_rest("na", num, den), _rest("nb", num, den))
    likely = shared.join(of_heat("a"), "a", "left").join(of_heat("b"), "b", "left").where((den + num) * most >= num * (F.col("na") + F.col("nb")))
    cold_pairs = settle(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "h"), "jaccard-cold", rows)

    hubs = hot.join(heat, "g").groupBy("h").agg(F.max_by(F.struct("g", "n"), F.struct("heat", -F.col("g"))).alias("hub")).select("h", F.col("hub.g").alias("hub"), F.col("hub.n").alias("hub_n"))
    hubs = settle(hubs, "jaccard-hubs", rows)
    to_hub = hot.join(hubs, "h").where((F.col("g") != F.col("hub")) & (den * F.least("n", "hub_n") >= num * F.greatest("n", "hub_n"))).select(F.least("g", "hub").alias("a"), F.greatest("g", "hub").alias("b"), "h")
    stars = inside.where("g <> member and may").select(F.col("g").alias("a"), F.col("member").alias("b"), F.xxhash64("g").alias("h"))
    first = settle(cold_pairs.unionByName(to_hub).unionByName(stars).groupBy("a", "b").agg(F.min("h").alias("h")), "jaccard-first", rows)
    links = _verified(docs, first, width, num, den, rows)
    labels = connected_components(links, rows)

    def labelled(df: DataFrame, node: str, out: str) -> DataFrame:
        return df.join(labels.select(F.col("id").alias(node), F.col("label").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))

    # What the first round left open: members of groups that aren't connected, and what isn't connected to its hub.
    of = lambda node: inside.select(F.col("g").alias(node), F.col("member").alias(f"{node}_m"))
    expanded = cold_pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_m is not null or b_m is not null").select(F.coalesce("a_m", "a").alias("a"), F.coalesce("b_m", "b").alias("b"))
    loose = settle(labelled(inside.where("may").select("g", F.col("member").alias("id")), "id", "l").join(labelled(inside.select("g").distinct(), "g", "lg"), "g").where("l <> lg").select("g", "id", "l"), "jaccard-loose", rows)
    within = loose.join(inside, "g").where("id <> member").select(F.least("id", "member").alias("a"), F.greatest("id", "member").alias("b"))
    hot_nodes = hot.join(inside, "g", "left").select("h", F.coalesce("member", "g").alias("id"), "n", "pos")
    hot_nodes = settle(labelled(hot_nodes, "id", "l"), "jaccard-hot-nodes", rows)
    away = hot_nodes.join(labelled(hubs.select("h", "hub"), "hub", "lh"), "h").where("l <> lh").select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("l").alias("la"), "lh")
    others = hot_nodes.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("l").alias("lb"))
    # Of two that are both away from the hub, one order is enough.
    open_pairs = away.join(others, "h").where((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("lh")) | (F.col("a") < F.col("b"))) & _fits(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = expanded.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").unionByName(open_pairs).distinct()
    second = labelled(labelled(rest, "a", "la"), "b", "lb").where("la <> lb").select("a", "b").join(first, ["a", "b"], "left_anti")
    second = settle(second, "jaccard-second", rows)
    open_left = second.count()
    if open_left:
        more = _verified(docs, second.withColumn("h", F.xxhash64("a")), width, num, den, rows)
        if more.count():
            # Links found now join classes, so classes are linked, not documents.
            joined = labelled(labelled(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            upper = connected_components(joined, rows)
            ends = lambda df: df.select(F.col("a").alias("id")).unionByName(df.select(F.col("b").alias("id")))
            every = ends(links).unionByName(ends(more)).distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            labels = settle(every.join(upper.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label")), "jaccard-labels", rows)
    # A copy takes its representative's class. The smallest id of a class is always a representative.
    classes = reps.select("digest", F.col("rep").alias("id")).join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component_id"))
    out = made.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    out = save(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-classes")
    made.unpersist()
    forget(reps, groups, posts, cold_pairs, hot, heat, hubs, first, loose, hot_nodes, inside, second, links, labels)
    return out


def keep_one(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of `docs` but those of documents whose class has a smaller id; of rows that repeat an id and text one stays."""
    ids = link(docs, width, num, den).groupBy(F.col("doc_id").cast("long").alias("__jaccard_id")).agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("rows"))
    ids = save(ids.where("c < __jaccard_id or rows > 1"), "jaccard-surplus")
    of = lambda condition: (ids.where(condition).select("__jaccard_id"), docs["doc_id"].cast("long") == F.col("__jaccard_id"))
    kept = docs.join(*of("c < __jaccard_id"), "left_anti")
    repeated = "rows > 1 and c = __jaccard_id"
    if ids.where(repeated).isEmpty():
        return kept
    once = docs.join(*of(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(*of(repeated), "left_anti").unionByName(once)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r(id, pos) as (with recursive w(id, pos) as (select doc_id, doc_id from documents union select w.id, e.b from w join e on e.a = w.pos) select id, pos from w)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, (select min(pos) from r where r.id = d.doc_id) as component_id from d left join n using (doc_id)
"""
