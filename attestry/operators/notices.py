"""Which notice a source file begins with: a positional index of phrases, met in order with bounded gaps.

A wording is a line of phrases, `a b | [c d] | e | !f`: plain ones must be there, those in brackets may, those after `!` must not stand within
or just behind the match. The index holds a hash of each phrase under its number of words; a notice is cut into runs of just those lengths, so one
exact join finds every phrase at every place. What is left is to chain them: per notice and wording the chain of most words in which each phrase
begins at or after the end of the one before and at most `gap` words behind it. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions.vocabulary import HEADER_VARIANTS
from attestry.operators.classify import tokens

GAP, EXCEPTION_GAP, BROADCAST_PHRASES, MOST_HEADS = 14, 130, 100_000, 1000
#: Comment signs that are words.
LINE_SIGNS = r"(?im)^[^\w\n]*(?:dnl|rem)\b"
HEADERS = "name string, variant string, gap int, wording string"

# The notices that their licences recommend, in the parts that hold whatever the program is called. The grants they stand for are those of the
# names and variants in the vocabulary; which of several variants of one grant a wording is called by is a choice of this library.
_FREE, _FOUNDATION, _TERMS = "[is free software] | [redistribute it and or modify it]", "[as published by the free software foundation]", "[under the terms of]"
_ONLY = "!any later version | !or later | !or newer | !later versions"
_NAMES = {"GPL": ("gnu general public license",), "AGPL": ("gnu affero general public license",), "LGPL": ("gnu lesser general public license", "gnu library general public license")}
_SHORT = {"GPL": "gnu gpl", "AGPL": "gnu agpl", "LGPL": "gnu lgpl"}
_EXCEPTIONS = {
    "classpath": "classpath exception", "autoconf": "as a special exception | configuration script generated by autoconf", "bison": "as a special exception | bison parser skeleton",
}


def _family(name: str) -> tuple[str, str]:
    family, version = name.split("-with-")[0].split("-")
    return family, version.removesuffix(".0").replace(".", " ")


def _names(name: str) -> tuple[str, ...]:
    return {"LGPL-2.0": _NAMES["LGPL"][1:], "LGPL-2.1": _NAMES["LGPL"], "LGPL-3.0": _NAMES["LGPL"][:1]}.get(name, _NAMES[_family(name)[0]])


def standard_headers() -> list[tuple[str, str, int, str]]:
    """(name, variant, gap, wording) of the notices above: for each name the first two variants of each grant, `header.txt` before others, as the
    long notice and the short one."""
    by_grant: dict[tuple[str, str], list[str]] = {}
    for name, variant, grant in HEADER_VARIANTS:
        by_grant.setdefault((name, grant), []).append(variant)
    out = []
    for (name, grant), variants in by_grant.items():
        family, v = _family(name)
        exception = _EXCEPTIONS.get(name.split("-with-")[1].removesuffix("-exception")) if "-with-" in name else None
        later = "-or-later" in grant
        variants = sorted(variants, key=lambda x: (x != "header.txt", x))
        gap, more = (EXCEPTION_GAP, f" | {exception}") if exception else (GAP, "")
        for full in _names(name.split("-with-")[0]):
            begin = f"{_FREE} | {_TERMS} | {full} | {_FOUNDATION} | version {v} | [of the license]"
            out.append((name, variants[0], gap, f"{begin} | any later version{more}" if later else f"{begin}{more}" + ("" if exception else f" | {_ONLY}")))
        if not exception and len(variants) > 1:
            for said in (f"version {v}", f"v{v}"):
                for short in (*_names(name), _SHORT[family]):
                    tails = ("or later", "or newer") if later else (f"[only] | {_ONLY}",)
                    out += [(name, variants[1], GAP, f"{short} | {said} | {tail}") for tail in tails]
    out.append(("Apache-2.0", "header.txt", GAP, "licensed under the apache license version 2 0 | you may not use this file except in compliance with the license | [you may obtain a copy of the license at] | [www apache org licenses license 2 0]"))
    out.append(("MPL-2.0", "header.txt", GAP, "this source code form is subject to the terms of the mozilla public license v 2 0 | [if a copy of the mpl was not distributed with this file]"))
    return out


def headers(spark: SparkSession, rows: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(standard_headers() if rows is None else rows, HEADERS)


def _phrases(headers_: DataFrame) -> DataFrame:
    """(header, name, variant, gap, phrases array<struct<no, words, optional, forbidden, g>>, total, must, first): total words of those that may match, the numbers of
    those that must and the first of them."""
    said = F.transform(F.split("wording", r" \| "), lambda p: F.btrim(p))
    parsed = F.transform(
        said, lambda p, i: F.struct(i.alias("no"), F.split(F.btrim(F.translate(p, "[]!", "")), " +").alias("words"), p.startswith("[").alias("optional"), p.startswith("!").alias("forbidden"))
    )
    full = F.transform(parsed, lambda p: F.struct(p["no"].alias("no"), F.size(p["words"]).alias("n"), p["optional"].alias("optional"), p["forbidden"].alias("forbidden"), F.get(p["words"], F.lit(0)).alias("head"), F.xxhash64(F.array_join(p["words"], " ")).alias("g")))
    out = headers_.select("name", "variant", "gap", full.alias("phrases")).withColumn("header", F.xxhash64("name", "variant", F.to_json("phrases")))
    wanted = F.filter("phrases", lambda p: ~p["forbidden"])
    total = F.aggregate(wanted, F.lit(0), lambda a, p: a + p["n"])
    must = F.transform(F.filter(wanted, lambda p: ~p["optional"]), lambda p: p["no"])
    return out.dropDuplicates(["header"]).select("header", "name", "variant", "gap", "phrases", total.alias("total"), must.alias("must"), F.array_min(must).alias("first"))


def _chained() -> F.Column:
    """struct<words, start, end>: the best chain of `hits` (no, at, end), null without one. Each step adds the chains that end with its phrase; where
    the phrase may be missing, the ones before it stay."""
    none = F.array().cast("array<struct<words:int,start:int,end:int>>")

    def step(acc, p):
        mine = F.filter("hits", lambda h: h["no"] == p["no"])

        def grown(h):
            before = F.filter(acc, lambda s: (s["end"] <= h["at"]) & (h["at"] - s["end"] <= F.col("gap")))
            longer = F.transform(before, lambda s: F.struct((s["words"] + p["n"]).alias("words"), s["start"].alias("start"), h["end"].alias("end")))
            alone = F.when(p["no"] <= F.col("first"), F.array(F.struct(p["n"].alias("words"), h["at"].alias("start"), h["end"].alias("end")))).otherwise(none)
            return F.array_max(F.concat(longer, alone))

        added = F.filter(F.transform(mine, grown), lambda s: s.isNotNull())
        return F.when(p["forbidden"], acc).otherwise(F.concat(F.when(p["optional"], acc).otherwise(none), added))

    best = F.array_max(F.aggregate("phrases", none, step))
    barred = F.filter("phrases", lambda p: p["forbidden"])
    shut = F.exists(barred, lambda p: F.exists("hits", lambda h: (h["no"] == p["no"]) & (h["at"] >= best["start"]) & (h["at"] <= best["end"] + F.col("gap"))))
    return F.when(~shut, best)


def identify_headers(notices: DataFrame, key: list[str], headers_: DataFrame, text: str = "text") -> DataFrame:
    """(key..., name, variant, confidence, first, last, rank): the notices found in each text, the one of most words first. confidence is the share of the
    wording's words that were met; first and last are word places, last exclusive. Of two matches over one place the longer stays.

    Null and empty texts match nothing; texts are taken whole; a key that repeats is one text's key or its matches are mixed."""
    index = _phrases(headers_)
    phrases = index.select("header", F.explode("phrases").alias("p")).select("header", F.col("p.no").alias("no"), F.col("p.n").alias("n"), F.col("p.head").alias("head"), F.col("p.g").alias("g"))
    small = phrases.count() <= BROADCAST_PHRASES
    # Of each length the words that phrases begin with, unless they are too many to be told apart here: no other run is hashed.
    heads = {r["n"]: r["heads"] for r in phrases.groupBy("n").agg(F.slice(F.collect_set("head"), 1, MOST_HEADS + 1).alias("heads")).collect()}
    words = notices.select(*key, tokens(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINE_SIGNS, " ")).alias("w"))
    # All words are looked at once, for any of the heads; each length then looks at those places alone.
    told = sorted({h for listed in heads.values() if len(listed) <= MOST_HEADS for h in listed})
    places = F.transform("w", lambda x, i: F.when(x.isin(*told), i + 1)) if told else F.array().cast("array<int>")
    words = words.withColumn("likely", F.array_compact(places))
    starts = lambda n: F.sequence(F.lit(1), F.size("w") - n + 1)
    likely = lambda n: F.filter("likely", lambda i: (i <= F.size("w") - n + 1) & F.get("w", i - 1).isin(*heads[n])) if len(heads[n]) <= MOST_HEADS else starts(n)
    run = lambda n: F.transform(likely(n), lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " ")).alias("g")))
    runs = F.flatten(F.array(*(F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<struct<at:int,n:int,g:bigint>>")) for n in sorted(heads))))
    # An outer explode, filtered after: see classify.shingles.
    places = words.select(*key, runs.alias("r")).select(*key, F.explode_outer("r").alias("r")).where("r is not null").select(*key, "r.*")
    listed = phrases.drop("head")
    met = places.join(F.broadcast(listed) if small else listed, ["g", "n"])
    hits = met.groupBy(*key, "header").agg(F.collect_list(F.struct("no", "at", (F.col("at") + F.col("n")).alias("end"))).alias("hits"))
    # A wording of which a phrase that must be there wasn't met has no chain.
    whole = F.size(F.array_except("must", F.transform("hits", lambda h: h["no"]))) == 0
    held = hits.join(F.broadcast(index) if small else index, "header").where(whole).withColumn("chain", _chained()).where("chain is not null")
    found = held.select(*key, "name", "variant", (F.col("chain.words") / F.col("total")).alias("confidence"), F.col("chain.words").alias("words"), F.col("chain.start").alias("first"), F.col("chain.end").alias("last"))
    return _longest(found, key)


def _longest(found: DataFrame, key: list[str]) -> DataFrame:
    """Of matches that overlap the one of most words stays, then the surer one, then the first by name. One notice has few."""
    order = F.struct((-F.col("words")).alias("a"), (-F.col("confidence")).alias("b"), "name", "variant", "first", "last", "words", "confidence")
    per = found.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("all"))
    none = F.expr("filter(all, x -> false)")
    kept = F.aggregate("all", none, lambda acc, m: F.when(F.exists(acc, lambda k: (k["first"] < m["last"]) & (m["first"] < k["last"])), acc).otherwise(F.concat(acc, F.array(m))))
    each = per.select(*key, F.posexplode(kept).alias("before", "m"))
    return each.select(*key, "m.name", "m.variant", "m.confidence", "m.first", "m.last", (F.col("before") + 1).alias("rank"))


def header_grants(notices: DataFrame, key: list[str], headers_: DataFrame, granted, text: str = "text") -> DataFrame:
    """(key..., expression): what the first notice of each text grants that grants anything; granted(name, variant) is a column."""
    found = identify_headers(notices, key, headers_, text).withColumn("expression", granted(F.col("name"), F.col("variant"))).where("expression is not null")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where("k = 1")
    return first.select(*key, "expression")
