"""Queries over notices and known texts planted in the driver's tables. The SQL knows what was planted and where, not how it is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import spdx
from attestry.operators import classify, detection, names, notices, spans
from attestry.plans.formed import _mod, _pick, _sql_pick
from attestry.plans.queries import _TOK, query, table

# Eight beginnings of a source file: seven notices, each in comment signs of its own, and none. What they say is (name, variant, met words, all words, grant).
_GNU = "{0} is free software; you can redistribute it and/or modify\n{1} it under the terms of the {2} as\n{1} published by the Free Software Foundation; {3}\n{1}\n{1} {0} comes without any warranty.\n"
_NOTICES = (
    ("/* frob.c\n * Copyright (C) 2020 Someone\n *\n * " + _GNU.format("Frob", " *", "GNU General Public License", "either version 2\n * of the License, or (at your option) any later version.") + " */\n", ("GPL-2.0", "header.txt", 32, 32, "GPL-2.0-or-later")),
    ("# " + _GNU.format("The quux tool", "#", "GNU General Public License", "either version 3 of the\n# License, or any later version."), ("GPL-3.0", "header.txt", 32, 32, "GPL-3.0-or-later")),
    ("// " + _GNU.format("This library", "//", "GNU Lesser General\n// Public License", "either version 2.1 of the License, or\n// (at your option) any later version."), ("LGPL-2.1", "header.txt", 34, 34, "LGPL-2.1-or-later")),
    ("dnl " + _GNU.format("This macro", "dnl", "GNU General\ndnl Public License", "version 2."), ("GPL-2.0", "e.txt", 26, 29, "GPL-2.0-only")),
    ("-- " + _GNU.format("This service", "--", "GNU Affero General Public License", "version 3 of the License,\n-- or any later version."), ("AGPL-3.0", "header.txt", 33, 33, "AGPL-3.0-or-later")),
    ("/*\n * This code is free software; redistribute it and/or modify it under the terms of the GNU General Public License version 2 of the License\n * only. The owner designates this file as subject to the \"Classpath\" exception.\n */\n", ("GPL-2.0-with-classpath-exception", "header.txt", 24, 31, "GPL-2.0-only WITH Classpath-exception-2.0")),
    (";; Part of the suite, under the GNU LGPL v3 only.\n", ("LGPL-3.0", "b.txt", 4, 4, "LGPL-3.0-only")),
    ("", None),
)


def _said(i: int) -> tuple:
    return tuple(n[1][i] if n[1] else None for n in _NOTICES)


def _sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(_pick(tuple(n[0] for n in _NOTICES), _mod("doc_id", 8)), F.coalesce("text", F.lit(""))).alias("text"))


_STATED = "contains(text, 'GNU General Public License, version 3.')"


@query(f"""with k as (select doc_id, cast(doc_id % 8 as int) as k, {_STATED} as stated from documents)
select doc_id, {_sql_pick(_said(0), 'k')} as name, {_sql_pick(_said(1), 'k')} as variant, round({_sql_pick(_said(2), 'k')} / {_sql_pick(_said(3), 'k')}, 9) as confidence, {_sql_pick(_said(4), 'k')} as expression from k where k < 7
union all select doc_id, 'GPL-3.0', 'b.txt', round(6 / 7, 9), 'GPL-3.0-only' from k where stated""")
def header_notices(spark, sf_dir):
    """Every notice in each text, planted ones and the statements that documents have themselves, with the grant that each stands for."""
    found = notices.identify_headers(_sources(spark, sf_dir), ["doc_id"], notices.headers(spark))
    return found.select("doc_id", "name", "variant", F.round("confidence", 9).alias("confidence"), spdx.header_grant(F.col("name"), F.col("variant")).alias("expression"))


@query(f"""with d as (select 'c' || (doc_id % 50) as component_id, 's/f' || doc_id || '.c' as path, doc_id, cast(doc_id % 8 as int) as k, {_STATED} as stated, doc_id % 3 = 0 as tagged from documents),
g as (select component_id, path, doc_id, case when tagged then 'MIT' when k = 6 and stated then 'GPL-3.0-only' else coalesce({_sql_pick(_said(4), 'k')}, case when stated then 'GPL-3.0-only' end) end as expression, case when tagged then 'spdx-tag' else 'header' end as source from d)
select component_id, expression, arg_min(source, path) as source, min(path) as path, count(*) as files from g where expression is not null group by 1, 2""")
def notice_grants(spark, sf_dir):
    """Grants by tag and by notice of whole components: a tag decides, else the longest notice that grants something."""
    k = F.col("doc_id")
    tag = F.when(F.pmod(k, F.lit(3)) == 0, "# SPDX-License-Identifier: MIT\n").otherwise("")
    files = _sources(spark, sf_dir).select(F.concat(F.lit("c"), F.pmod(k, F.lit(50)).cast("string")).alias("component_id"), F.concat(F.lit("s/f"), k.cast("string"), F.lit(".c")).alias("path"), F.concat(tag, "text").alias("text"), F.lit(1).alias("nth"))
    return detection.grants(files)


# Known texts: two passages in each turn of a conversation, the second with every ninth word changed.
_CHANGED = "len(list_filter(range(len(b)), lambda i: i % 9 = 4 and i < len(b) - 1))"


@query(f"""with n as (select count(*) as n from benchmark), p as (select item_id, {_TOK} as w, row_number() over (order by item_id) - 1 as r from benchmark),
c as (select conv_id, turn, {_TOK} as w, conv_id % n as ra, (conv_id % n + 1 + turn % (n - 1)) % n as rb from conversations, n),
j as (select conv_id, turn, len(c.w) as k, a.item_id as ia, a.w as a, b.item_id as ib, b.w as b from c join p a on a.r = c.ra join p b on b.r = c.rb)
select conv_id, turn, cast(ia as varchar) as id, cast(k as bigint) as first, cast(k + len(a) as bigint) as last, 0 as distance, 1.0 as confidence from j
union all select conv_id, turn, cast(ib as varchar), k + len(a) + 2, k + len(a) + 2 + len(b), {_CHANGED}, round(1 - {_CHANGED} / len(b), 9) from j""")
def known_texts(spark, sf_dir):
    """Whole and altered passages with their places and what was changed."""
    files, corpus = _with_passages(spark, sf_dir)
    found = spans.identify(files, ["conv_id", "turn"], corpus)
    return found.select("conv_id", "turn", "id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "distance", F.round("confidence", 9).alias("confidence"))


def _with_passages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    passages = table(spark, sf_dir, "benchmark")
    n = passages.count()
    from pyspark.sql.window import Window

    ranked = passages.select("item_id", "text", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("r"))  # one row a benchmark item
    words = classify.tokens(F.col("text"))
    changed = F.transform(words, lambda w, i: F.when((i % 9 == 4) & (i < F.size(words) - 1), F.concat(F.lit("zz"), i.cast("string"))).otherwise(w))
    a, b = ranked.select(F.col("r").alias("ra"), F.col("text").alias("a")), ranked.select(F.col("r").alias("rb"), F.array_join(changed, " ").alias("b"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("own")).withColumn("ra", F.pmod("conv_id", F.lit(n))).withColumn("rb", F.pmod(F.col("ra") + 1 + F.pmod("turn", F.lit(n - 1)), F.lit(n)))
    text = F.concat("own", F.lit("\n\n"), "a", F.lit("\n\nnext: part,\n"), "b")
    files = turns.join(a, "ra").join(b, "rb").select("conv_id", "turn", text.alias("text"))
    return files, passages.select(F.col("item_id").cast("string").alias("id"), "text")


# A list as long as the parts, and names that people write for its entries: by identifier, name, address, wording, base, or none of these.
_OTHER = ("Apache License,  Version 2.0", "GPL-2.0", "KUKA")


@query(f"""with e as (select p_partkey as k, 'Own-' || p_partkey || '-1.0' as id, p_partkey % 10 = 0 as gone, p_partkey % 8 = 3 as shared from part), a as (select *, k % 6 as form, (k // 6) % 3 as o from e)
select k as p_partkey, case when form = 3 then case o when 0 then 'Apache-2.0' end when form = 4 then case when not gone then id end when gone or form = 5 or form = 2 and shared then null else id end as id, case when form = 3 and o = 1 then 'GPL-2.0' end as grant_base,
  case when form = 3 and o = 1 then 'GPL-2.0-or-later' end as or_later, case when form = 5 then 'Terms ' || k when form = 3 then case o when 2 then 'KUKA' end when gone or form = 2 and shared then case form when 0 then upper(id) when 1 then 'The OWN terms, no.' || k || '!' when 2 then 'http://www.own.example/t/' || case when shared then 0 else k end || '.html' else id end end as ref from a""")
def names_by_list(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Own-"), k.cast("string"), F.lit("-1.0")).alias("licenseId"))
    url = F.concat(F.lit("https://own.example/t/"), F.when(F.pmod(k, F.lit(8)) == 3, F.lit("0")).otherwise(k.cast("string")))
    entries = parts.select("licenseId", F.concat(F.lit("the own terms no "), k.cast("string")).alias("name"), (F.pmod(k, F.lit(10)) == 0).alias("isDeprecatedLicenseId"), F.array(url, F.lit("not an address")).alias("seeAlso"))
    form = _mod("p_partkey", 6)
    said = (
        F.when(form == 0, F.concat(F.lit(" "), F.upper("licenseId"))).when(form == 1, F.concat(F.lit("The OWN terms, no."), k.cast("string"), F.lit("!"))).when(form == 2, F.concat(F.replace(url, F.lit("https://"), F.lit("http://www.")), F.lit(".html")))
        .when(form == 3, _pick(_OTHER, _mod("p_partkey", 3, 6))).when(form == 4, F.col("licenseId")).otherwise(F.concat(F.lit("Terms "), k.cast("string")))
    )
    out = names.resolve(parts.select("p_partkey", said.alias("said")), "said", names.dimension(entries))
    return out.select("p_partkey", "resolved.id", "resolved.grant_base", "resolved.or_later", "resolved.ref")
