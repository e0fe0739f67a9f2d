"""Quality rules whose thresholds follow the data: quantile sketches per language and source, merged upwards, then a join.

Every whole text gives integer measures. Each measure's values go into a sketch of logarithmic buckets (sixteen to a power of
two, so a quantile is right to within a sixteenth), which is nothing but counts by bucket: partial counts merge by addition in
any order, so the result is the same however rows are dealt, and a hot source costs no task more than its share. Every sketch
gives each measure a limit, q75 + FENCE * (q75 - q25) + the measure's slack. A (language, source) pair's limit is the mean of its own
and its language's, weighted by its documents against `prior` documents; a language's is weighted alike against that of everything.
Large pairs so follow their own sketch, small ones mostly the merged one, with no size at which one takes the other's place. A
document is dropped if a measure lies beyond its pair's limit. Where a quarter of a large pair's documents are junk by a measure,
that measure's limit lies beyond the junk and rejects none of it there; so it is with any threshold that follows the data.

DataFrame functions only. Defined results: null text has no words and fails the base rule; null lang or source is a value of
its own; very long texts are counted whole; ties with a limit are kept; repeated rows are judged alike; an empty table gives no
rows; clashing names in other columns don't matter to `measure`, and `keep` returns its input's columns untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import WORD, forget, save

#: As how many documents the next larger group's limit counts in a group's own.
PRIOR = 100
FENCE = 3
#: The measures and how far beyond the fence a value is still taken for ordinary spread (per thousand; word_length in hundredths).
SLACK = {"symbols": 60, "dup_lines": 350, "repeats": 350, "word_length": 150, "shouts": 120}
#: Rows of thresholds that may be sent to every executor; beyond, the join shuffles.
BROADCAST_GROUPS = 50_000
_P = "__qr_"


def _counts(docs: DataFrame) -> DataFrame:
    """Adds the counts under the prefix, in steps: each step's arrays are made once a row."""
    c = lambda name: F.col(_P + name)
    whole = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({_P + "words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), _P + "lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))})
    windows = F.when(
        F.size(c("words")) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns(
        {
            _P + "n_words": F.size(c("words")).cast("long"),
            _P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
            _P + "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
            _P + "n_shouts": F.regexp_count(whole, F.lit(r"\p{Lu}{2,}+|!{2,}+")).cast("long"),
            _P + "n_lines": F.size(c("lines")).cast("long"),
            _P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            _P + "windows": windows,
        }
    ).drop(_P + "words", _P + "lines")
    # Windows sorted by hash with their place in the low bits: equal ones become neighbours, in n log n whatever the text.
    df = df.withColumns({_P + "bits": F.length(F.bin(F.size(c("windows")))), _P + "again": F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))})
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), c("bits"))
    df = df.withColumn(_P + "mask", mask)
    keyed = F.transform(c("windows"), lambda x, i: x.bitwiseAND(c("mask")).bitwiseOR(i.cast("long")))
    df = df.withColumn(_P + "sorted", F.when(c("again"), F.sort_array(keyed)))
    place = lambda k: F.get(c("sorted"), k).bitwiseAND(F.bitwise_not(c("mask"))).cast("int")
    same = F.filter(
        F.sequence(F.lit(1), F.size(c("sorted")) - 1),
        lambda k: (F.get(c("sorted"), k).bitwiseAND(c("mask")) == F.get(c("sorted"), k - 1).bitwiseAND(c("mask"))) & (F.get(c("windows"), place(k)) == F.get(c("windows"), place(k - 1))),
    )
    df = df.withColumn(_P + "same", F.when(c("again"), same))
    df = df.withColumn(_P + "at", F.when(c("again"), F.array_union(F.transform(c("same"), place), F.transform(c("same"), lambda k: place(k - 1)))))
    covered = F.array_union(F.array_union(c("at"), F.transform(c("at"), lambda p: p + 1)), F.transform(c("at"), lambda p: p + 2))
    df = df.withColumn(_P + "n_repeat_words", F.when(c("again"), F.size(covered)).otherwise(0).cast("long"))
    # A column that depends on the task keeps the optimizer from moving filters into the steps above, where it would copy their expressions.
    return df.drop(*(_P + x for x in ("windows", "bits", "again", "mask", "sorted", "same", "at"))).withColumn(_P + "task", F.spark_partition_id())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
#: The measures from the counts, whole numbers so that every engine buckets them alike.
MEASURES = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "shouts": "1000 * n_shouts div greatest(n_words, 1)",
}


def _prefixed(sql: str) -> str:
    for name in (*COUNTS, "n_lines", "n_shouts"):
        sql = sql.replace(name, f"`{_P}{name}`")
    return sql


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, m_<measure>) of every whole text; no null in lang or source."""
    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    df = _counts(given)
    return df.select(
        "doc_id", "lang", "source", *(F.col(_P + x).alias(x) for x in COUNTS), F.expr(_prefixed(BASE_FAILED)).alias("base_failed"), *(F.expr(_prefixed(sql)).alias(f"m_{k}") for k, sql in MEASURES.items())
    )


def _bucket(v: str) -> str:
    return f"if({v} < 32, {v}, (length(bin({v})) - 5) * 16 + shiftright({v}, length(bin({v})) - 5))"


def _highest(b: str) -> str:
    """The largest value of a bucket."""
    return f"if({b} < 32, {b}, shiftleft({b} - ({b} div 16 - 1) * 16 + 1, cast({b} div 16 - 1 as int)) - 1)"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable counts. Documents that fail the base rule say nothing of what is usual."""
    stacked = measured.where("not base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, " + ", ".join(f"'{k}', m_{k}" for k in MEASURES) + ") as (measure, v)")
    return stacked.groupBy("lang", "source", "measure", F.expr(_bucket("v")).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of `keys`: its documents and each measure's limit."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # The sketch of a group is a short list of (bucket, n), bounded by the number of buckets.
    lists = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    at = lambda q: f"element_at(filter(transform(h, (x, i) -> struct(x.bucket as bucket, aggregate(slice(h, 1, i + 1), 0L, (a, y) -> a + y.n) as upto)), x -> 100 * x.upto >= {q} * total), 1).bucket"
    quartiles = lists.withColumns({"lo": F.expr(at(25)), "hi": F.expr(at(75))}).withColumns({"q25": F.expr(_highest("lo")), "q75": F.expr(_highest("hi"))})
    limit = F.col("q75") + FENCE * (F.col("q75") - F.col("q25"))
    return quartiles.groupBy(*keys).agg(F.max("total").alias("docs"), *(F.max(F.when(F.col("measure") == k, limit + s)).alias(f"limit_{k}") for k, s in SLACK.items()))


def thresholds(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, group_docs, limit_<measure>): each pair's limits and the documents in its own sketch."""
    # A group whose documents all fail the base rule isn't in the sketch; its pair takes the larger groups' limits.
    sketch = sketches(measured)
    pairs = measured.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    own, by_lang = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"])
    overall = _fences(sketch.withColumn("__all", F.lit(1)), ["__all"])
    name = lambda df, p: df.select(*(F.col(x).alias(x if x in ("lang", "source", "__all") else p + x) for x in df.columns))
    joined = pairs.join(name(own, "o_"), ["lang", "source"], "left").join(name(by_lang, "l_"), ["lang"], "left")
    joined = joined.withColumn("__all", F.lit(1)).join(F.broadcast(name(overall, "a_")), "__all", "left")  # one row

    def weighed(docs: str, own: str, wider: str) -> str:
        return f"(coalesce({docs}, 0) * coalesce({own}, 0) + {prior} * {wider}) div (coalesce({docs}, 0) + {prior})"

    limits = (F.expr(weighed("o_docs", f"o_limit_{k}", weighed("l_docs", f"l_limit_{k}", f"a_limit_{k}"))).alias(f"limit_{k}") for k in MEASURES)
    return joined.select("lang", "source", F.coalesce("o_docs", F.lit(0)).cast("long").alias("group_docs"), *limits)


def _beyond() -> F.Column:
    over = [F.coalesce(F.col(f"m_{k}") > F.col(f"limit_{k}"), F.lit(False)) for k in MEASURES]
    return F.array_join(F.filter(F.array(*(F.when(o, F.lit(k)) for o, k in zip(over, MEASURES))), lambda x: x.isNotNull()), ",")


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """measure() and group_docs, beyond (the measures over their limit, joined by commas) and kept."""
    measured = save(measure(docs), "quality-measures")
    limits = save(thresholds(measured, prior), "quality-limits")
    small = limits.count() <= BROADCAST_GROUPS
    return (
        measured.join(F.broadcast(limits) if small else limits, ["lang", "source"], "left")
        .withColumn("beyond", _beyond())
        .withColumn("kept", ~F.col("base_failed") & (F.col("beyond") == ""))
        .drop(*(f"limit_{k}" for k in MEASURES))
    )


def keep(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of `docs` that are kept, with its columns. Limits are taken from one pass, the filter is a second: texts don't move."""
    measured = save(measure(docs), "quality-measures")
    limits = save(thresholds(measured, prior), "quality-limits")
    forget(measured)
    small = limits.count() <= BROADCAST_GROUPS
    limits = limits.select(F.col("lang").alias(_P + "lang"), F.col("source").alias(_P + "source"), *(F.col(f"limit_{k}").alias(f"{_P}limit_{k}") for k in MEASURES))
    df = _counts(docs).withColumns({_P + "lang": F.coalesce("lang", F.lit("")), _P + "source": F.coalesce("source", F.lit(""))})
    over = [f"coalesce({_prefixed(sql)} > `{_P}limit_{k}`, false)" for k, sql in MEASURES.items()]
    joined = df.join(F.broadcast(limits) if small else limits, [_P + "lang", _P + "source"], "left")
    return joined.where(f"`{_P}task` >= 0 and not " + _prefixed(BASE_FAILED) + " and not (" + " or ".join(over) + ")").select(*docs.columns)


ORACLE = r"""
with given as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as row from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from given),
win as (select row, unnest(range(1, len(words) - 1)) as pos, words from w where len(words) >= 3),
keyed as (select row, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] as k from win),
dup as (select row, pos from (select row, pos, count(*) over (partition by row, k) as c from keyed) where c > 1),
rep as (select row, count(distinct p) as n_repeat_words from (select row, pos + unnest([0, 1, 2]) as p from dup) group by row),
c as (select w.row, doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(regexp_extract_all(text, '\p{Lu}{2,}|!{2,}')) as bigint) as n_shouts, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from w left join rep using (row)),
m as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, 1000 * n_symbols // greatest(n_words, 1) as m_symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as m_dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) as m_repeats, 100 * word_chars // greatest(n_words, 1) as m_word_length, 1000 * n_shouts // greatest(n_words, 1) as m_shouts from c),
v as (select lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'shouts']) as measure, unnest([m_symbols, m_dup_lines, m_repeats, m_word_length, m_shouts]) as v from m where not base_failed),
s as (select lang, source, measure, case when v < 32 then v else (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) end as bucket, count(*) as n from v group by all),
levels as (select 'source' as level, lang, source, measure, bucket, n from s union all select 'lang', lang, '', measure, bucket, sum(n) from s group by all union all select 'all', '', '', measure, bucket, sum(n) from s group by all),
cum as (select *, sum(n) over (partition by level, lang, source, measure order by bucket) as upto, sum(n) over (partition by level, lang, source, measure) as total from levels),
q as (select level, lang, source, measure, max(total) as total, min(bucket) filter (where 100 * upto >= 25 * total) as lo, min(bucket) filter (where 100 * upto >= 75 * total) as hi from cum group by all),
qv as (select *, case when lo < 32 then lo else ((lo - (lo // 16 - 1) * 16 + 1) << cast(lo // 16 - 1 as int)) - 1 end as q25, case when hi < 32 then hi else ((hi - (hi // 16 - 1) * 16 + 1) << cast(hi // 16 - 1 as int)) - 1 end as q75 from q),
lim as (select level, lang, source, max(total) as docs, max(q75 + 3 * (q75 - q25) + 60) filter (where measure = 'symbols') as l_symbols, max(q75 + 3 * (q75 - q25) + 350) filter (where measure = 'dup_lines') as l_dup_lines,
  max(q75 + 3 * (q75 - q25) + 350) filter (where measure = 'repeats') as l_repeats, max(q75 + 3 * (q75 - q25) + 150) filter (where measure = 'word_length') as l_word_length, max(q75 + 3 * (q75 - q25) + 120) filter (where measure = 'shouts') as l_shouts from qv group by all),
f as (select m.*, coalesce(o.docs, 0) as group_docs,
  (coalesce(o.docs, 0) * coalesce(o.l_symbols, 0) + 100 * (coalesce(l.docs, 0) * coalesce(l.l_symbols, 0) + 100 * a.l_symbols) // (coalesce(l.docs, 0) + 100)) // (coalesce(o.docs, 0) + 100) as x1,
  (coalesce(o.docs, 0) * coalesce(o.l_dup_lines, 0) + 100 * (coalesce(l.docs, 0) * coalesce(l.l_dup_lines, 0) + 100 * a.l_dup_lines) // (coalesce(l.docs, 0) + 100)) // (coalesce(o.docs, 0) + 100) as x2,
  (coalesce(o.docs, 0) * coalesce(o.l_repeats, 0) + 100 * (coalesce(l.docs, 0) * coalesce(l.l_repeats, 0) + 100 * a.l_repeats) // (coalesce(l.docs, 0) + 100)) // (coalesce(o.docs, 0) + 100) as x3,
  (coalesce(o.docs, 0) * coalesce(o.l_word_length, 0) + 100 * (coalesce(l.docs, 0) * coalesce(l.l_word_length, 0) + 100 * a.l_word_length) // (coalesce(l.docs, 0) + 100)) // (coalesce(o.docs, 0) + 100) as x4,
  (coalesce(o.docs, 0) * coalesce(o.l_shouts, 0) + 100 * (coalesce(l.docs, 0) * coalesce(l.l_shouts, 0) + 100 * a.l_shouts) // (coalesce(l.docs, 0) + 100)) // (coalesce(o.docs, 0) + 100) as x5
  from m left join lim o on o.level = 'source' and o.lang = m.lang and o.source = m.source left join lim l on l.level = 'lang' and l.lang = m.lang left join lim a on a.level = 'all')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(m_symbols > x1, false) or coalesce(m_dup_lines > x2, false) or coalesce(m_repeats > x3, false) or coalesce(m_word_length > x4, false) or coalesce(m_shouts > x5, false)) as kept,
  cast(group_docs as bigint) as group_docs from f
"""
