"""Licence scans by sentence rules: sentences → known sentence identifiers → ordered licence rules.

A text that holds none of the stems on which the known sentences are built is passed over at once. Others are cut into sentences,
at sentence ends followed by white space and at blank lines, and normalised (every run of other than ASCII letters, digits and
. + - is one blank). Each sentence takes the identifiers of all known statements that it contains, by place, and the identifiers of a
document form a sequence such as <apache-2-0><as-is>. Rules are tried in their order; each replaces the stretch that it matches
by its licence, so that a longer rule takes its sentences away from shorter ones. Identifiers that no rule takes are reported.

An SPDX tag and the expression after it are a sentence of their own, <spdx-tag:expression>, and its licence is the expression: known
names as they are listed, former GNU names by their present ones, others as stated. Where more words follow on the tag's line, only
known names are believed. Beyond the known sentences, titles of licences count where they stand, and short names where the sentence speaks of
licensing. What a sentence says isn't so, to its end or to what it says instead, is no statement. NONE, NOASSERTION and brackets that don't match give <spdx-tag>, which no rule takes.

DataFrame functions only, row by row: no exchange, no join. Defined results: null and empty texts have no sentences; very long texts are scanned whole; repeated rows give
repeated results; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.spdx import VOCABULARY
from attestry.functions.vocabulary import look_up

#: (identifier, stem, pattern of the normalised sentence). The stem, one lower-case word or a part of one, occurs in whatever the pattern matches.
SENTENCES = (
    ("spdx-tag", "spdx", r"spdx-license-identifier"),
    ("apache-2-0", "licen", r"licensed under the apache license,? version 2(\.0)?\b"),
    ("apache-2-0", "licen", r"apache license,? version 2\.0"),
    ("apache-obtain", "licen", r"you may obtain a copy of the license at"),
    ("apache-comply", "licen", r"you may not use this file except in compliance with the license"),
    ("agpl-3", "licen", r"gnu affero general public license,? (version 3|v3)"),
    ("lgpl-3", "licen", r"gnu lesser general public license,? (version 3|v3)"),
    ("lgpl-2-1", "licen", r"gnu lesser general public license,? (version 2\.1|v2\.1)"),
    ("gpl-3", "licen", r"gnu general public license,? (version 3|v3)"),
    ("gpl-2", "licen", r"gnu general public license,? (version 2|v2)"),
    ("gpl-any", "licen", r"gnu general public license"),
    ("gpl-later", "version", r"(at your option,? )?any later version"),
    ("gpl-received", "received", r"you should have received a copy of the gnu"),
    ("mit", "licen", r"(released|licensed|available|distributed) under the( terms of the)? mit( x11)? licen[sc]e"),
    ("mit-grant", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "permission", r"the above copyright notice and this permission notice shall be included"),
    ("isc-grant", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "licen", r"(released|licensed|available|distributed) under the( terms of the)? (new |modified |simplified |revised )?bsd licen[sc]e"),
    ("bsd-grant", "redistribut", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistribut", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistribut", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("mpl-2", "licen", r"mozilla public license,? (version |v )?2\.0"),
    ("epl-2", "licen", r"eclipse public license,? (version |v )?2\.0"),
    ("cc0", "cc", r"\bcc0 1\.0\b"),
    ("cc-by-nc-nd", "cc", r"\bcc[ -]by-nc-nd[ -]?4\.0"),
    ("cc-by-nc-sa", "cc", r"\bcc[ -]by-nc-sa[ -]?4\.0"),
    ("cc-by-nc", "cc", r"\bcc[ -]by-nc[ -]?4\.0"),
    ("cc-by-sa", "cc", r"\bcc[ -]by-sa[ -]?4\.0"),
    ("cc-by", "cc", r"\bcc[ -]by[ -]?4\.0"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("as-is", "provided", r"\bprovided\b.{0,60}\bas is\b"),
    ("as-is", "warranty", r"\bas is\b.{0,20}\bwithout warranty"),
    ("all-rights", "reserved", r"all rights reserved"),
)
#: (licence, pattern over the identifiers), longest demands first.
RULES = (
    ("Apache-2.0", r"(<apache-comply>)?(<apache-obtain>)?<apache-2-0>(<apache-comply>)?(<apache-obtain>)?(<as-is>)?"),
    ("AGPL-3.0-or-later", r"<agpl-3>(<gpl-later>)(<as-is>)?(<gpl-received>)?"),
    ("AGPL-3.0-only", r"<agpl-3>(<as-is>)?"),
    ("LGPL-3.0-or-later", r"<lgpl-3>(<gpl-later>)(<as-is>)?(<gpl-received>)?"),
    ("LGPL-3.0-only", r"<lgpl-3>(<as-is>)?"),
    ("LGPL-2.1-or-later", r"<lgpl-2-1>(<gpl-later>)(<as-is>)?(<gpl-received>)?"),
    ("LGPL-2.1-only", r"<lgpl-2-1>(<as-is>)?"),
    ("GPL-3.0-or-later", r"(<gpl-any>)?<gpl-3>(<gpl-later>)(<as-is>)?(<gpl-received>)?"),
    ("GPL-3.0-only", r"<gpl-3>(<as-is>)?"),
    ("GPL-2.0-or-later", r"(<gpl-any>)?<gpl-2>(<gpl-later>)(<as-is>)?(<gpl-received>)?"),
    ("GPL-2.0-only", r"<gpl-2>(<as-is>)?"),
    ("MIT", r"<mit-grant>(<mit-notice>)?(<as-is>)?"),
    ("MIT", r"<mit>(<as-is>)?"),
    ("ISC", r"<isc-grant>(<mit-notice>)?(<as-is>)?"),
    ("BSD-3-Clause", r"<bsd-grant>(<bsd-source>)(<bsd-binary>)(<bsd-endorse>)(<as-is>)?"),
    ("BSD-2-Clause", r"<bsd-grant>(<bsd-source>)(<bsd-binary>)(<as-is>)?"),
    ("BSD-1-Clause", r"<bsd-grant>(<bsd-source>)(<as-is>)?"),
    ("BSD", r"<bsd>(<as-is>)?"),
    ("MPL-2.0", r"<mpl-2>"),
    ("EPL-2.0", r"<epl-2>"),
    ("CC0-1.0", r"<cc0>"),
    ("CC-BY-NC-ND-4.0", r"<cc-by-nc-nd>"),
    ("CC-BY-NC-SA-4.0", r"<cc-by-nc-sa>"),
    ("CC-BY-NC-4.0", r"<cc-by-nc>"),
    ("CC-BY-SA-4.0", r"<cc-by-sa>"),
    ("CC-BY-4.0", r"<cc-by>"),
    ("Unlicense", r"<unlicense>(<as-is>)?"),
)
#: What the scan knows beyond SENTENCES and RULES, on which the SQL rests too: (stem, pattern, replacement), before the known
#: sentences. Replacements bring other wordings into the known form or put an identifier in place of the words.
FAMILIES = (
    ("agpl", r"gnu (?:affero general public licen[sc]e(?: agpl)?|agpl)", ("3",)),
    ("lgpl", r"gnu (?:(?:lesser|library) general public licen[sc]e(?: lgpl)?|lgpl)", ("2-1", "2", "3")),
    ("gpl", r"gnu (?:general public licen[sc]e(?: gpl)?|gpl)", ("3", "2", "1")),
)
VERSIONS = ("2-1", "3", "2", "1")


def _version(v: str) -> str:
    return r"2\.1(?![0-9])" if v == "2-1" else rf"{v}(?:\.0)?(?![0-9]|\.[0-9])"


ANY_FAMILY = r"(?:the )?gnu (?:affero |lesser |library )?general public licen[sc]e"
BEFORE = (
    ("licen", rf"\bsee {ANY_FAMILY} for more details", " <gpl-see> "),
    ("received", rf"you should have received a copy of {ANY_FAMILY}", " <gpl-received> "),
    *(("licen", rf"\b(?:version |v){_version(v)} of the {name}", f" <{f}-{v}> ") for f, name, vs in FAMILIES for v in vs),
    *(("licen", rf"{name} ?(?:version |v\.? ?|)?{_version(v)}", f" <{f}-{v}> ") for f, name, vs in FAMILIES for v in vs),
    *(("licen", name, f" <{f}-any> ") for f, name, _ in FAMILIES),
    *(("version", rf"\b(?:(?:either|foundation) version {_version(v)}|version {_version(v)} of the licen[sc]e|(?<=^ ?)version {_version(v)}(?= ?only| ?\.? *$))(?: of the licen[sc]e)?", f" <version-{v}> ") for v in VERSIONS),
    *(("version", rf"<(gpl|lgpl|version)-{a}> *(?:and|or) (?:version |v)?{_version(b)}", f" <$1-{a}>  <$1-{b}> ") for a, b in (("2", "3"), ("2-1", "3"))),
    ("version", r"(<(?:a|l)?(?:gpl|version)-[0-9-]+>) *(?:\+|or (?:later|newer|above|greater)\b)", "$1 <gpl-later> "),
    ("creative commons", r"creativecommons\.org (?:licenses|publicdomain) (by|zero)([a-z-]*) ", " cc $1$2 "),
    ("creative commons", r"\bcc zero 1\.0|\bcc0(?: universal)?(?:[ -]v?1\.0)?(?![.0-9])", " <cc0> "),
    ("creative commons", r"creative commons(?: licen[sc]e)?[ -]attribution", " cc by"),
    ("cc", r"\bcc[ -]by[ -]non-?commercial", " cc by-nc"),
    ("cc", r"\bcc[ -](by|by-nc)[ -]share-?alike", " cc $1-sa"),
    ("cc", r"\bcc[ -](by|by-nc)[ -]no-?deriv(?:ative works|atives|ative|s)", " cc $1-nd"),
    ("cc", r"\bcc[ -](by(?:[ -](?:nc|sa|nd))*) (?:(?:international|unported|generic|public|licen[sc]e|version|v) ?)+(?=[1-4]\.[0-9])", " cc $1 "),
    ("cc", r"\bcc[ -]by[ -]nc\b", " cc by-nc"),
    ("cc", r"\bcc[ -](by|by-nc)[ -](nd|sa)\b", " cc $1-$2"),
    ("cc", r"\bcc[ -](by(?:-nc)?(?:-nd|-sa)?)[ -]?([1-3]\.[0-9])(?![0-9])", " <cc-$1-$2> "),
    ("cc", r"\bcc[ -](by-nd)[ -]?(4\.0)(?![0-9])", " <cc-$1-$2> "),
)
#: A statement that something isn't so, to the end of its sentence or to what is said instead.
NEGATED = (
    r"\b(?:not|never|no longer|nor|isn t|aren t|wasn t|weren t)(?: [a-z]+){0,3}? (?:licen[sc]ed|released|available|distributed|covered|governed|offered)(?: [a-z]+){0,3}? (?:under|by)\b(?:(?! but\b| instead\b).)*"
)
#: Titles of licences wherever they stand, after the known sentences: (licence, pattern). What they replace is <title:licence>.
TITLES = (
    ("MIT", r"\b(?:the )?(?:mit|expat)(?: x11)? licen[sc]e(?: mit\b)?"),
    *((f"BSD-{n}-Clause", rf"\b(?:the )?(?:{word}bsd[ -]{n}[ -]clause|{n}[ -]clause bsd)(?: licen[sc]e)?(?![a-z])") for n, word in (("1", ""), ("2", ""), ("3", "(?:new |modified |revised )?"))),
    ("BSD-3-Clause", r"\b(?:new|modified|revised) bsd licen[sc]e"), ("BSD-2-Clause", r"\b(?:simplified bsd|freebsd) licen[sc]e"), ("0BSD", r"\b(?:zero[ -]clause bsd|0bsd)(?: licen[sc]e)?(?![a-z])"),
    ("Apache-2.0", r"\b(?:the )?apache(?: software)? licen[sc]e(?: apache)?(?: version| v)? ?2(?:\.0)?(?![0-9.]*[0-9])"), ("ISC", r"\b(?:the )?isc licen[sc]e"), ("Zlib", r"\b(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("BSL-1.0", r"\b(?:the )?boost software licen[sc]e(?: -)?(?:(?: version| v)? ?1\.0)?"), ("Artistic-2.0", r"\b(?:the )?artistic licen[sc]e(?: version| v)? ?2(?:\.0)?(?![0-9])"),
    ("PSF-2.0", r"\b(?:the )?(?:python software foundation|psf) licen[sc]e(?: agreement)?(?:(?: version| v)? ?2)?(?![0-9])"), ("EUPL-1.2", r"\b(?:the )?(?:european union public licen[sc]e|eupl)(?: eupl)?(?: version)?[ -]?(?:v\.? ?)?1\.2"),
    ("Unlicense", r"\bthe unlicense\b"), ("WTFPL", r"\bwtfpl\b"), ("MPL-2.0", r"\bmpl[ -]?(?:v|version )?2\.0"), ("EPL-2.0", r"\bepl[ -]?(?:v|version )?2\.0"),
)
#: Names that are words or short, which count where a sentence speaks of licensing and they stand where a licence's name does.
LICENSING = r"\b(?:licen[sc]ed|licen[sc]e|licen[sc]ing|released|distributed|available|published)\b"
LEAD, TRAIL = r"(?<=\b(?:under|or|and|as|either|both|the|is|licen[sc]e|terms of) )", r"(?![a-z0-9+-]|\.[0-9])"
SHORT = (
    ("Apache-2.0", r"(?:apache|asl)[ -]?2(?:\.0)?"), ("BSD-3-Clause", "bsd-3-clause"), ("BSD-2-Clause", "bsd-2-clause"), ("BSL-1.0", r"bsl-1\.0"), ("Artistic-2.0", r"artistic-2\.0"), ("PSF-2.0", r"psf-2\.0"),
    ("MIT-0", "mit-0"), ("MIT", "mit"), ("ISC", "isc"), ("Zlib", "zlib"), ("Unlicense", "unlicense"),
)
#: GNU names without the word GNU.
GNU_SHORT = tuple((rf"(?<!<)\b{f}[ -]?(?:v\.? ?|version )?{_version(v)}", f" <{f}-{v}> ") for f, _, vs in FAMILIES for v in vs)
GNU_LATER = (r"(<(?:a|l)?gpl-[0-9-]+>) *(?:\+|-or-later\b|or (?:later|newer|above|greater)\b)", "$1 <gpl-later> ")
TITLE_RULE = (r"<title:([^<>]+)>(?:<as-is>)*", "=$1=")
TITLE_STEMS = ("gpl", "clause", "eupl", "wtfpl", "mpl", "epl", "0bsd")
#: Words that are names of licences too: alone they would make every German text a likely one.
SHORT_STEM = r"\b(?:under|as)\s+(?:the\s+)?(?:mit|isc|zlib)\b"
#: These two keep what stands between their words.
AS_IS = ((r"\b(provided\b.{0,60}\b)as is\b", "$1 <as-is> "), (r"\bas is\b(.{0,20}\bwithout warranty)", " <as-is> $1"))
TAIL = "(?:<as-is>|<gpl-see>|<gpl-received>)*"
GNU_RULES = tuple(
    (f"{f.upper()}-{v[0]}.{v[2:] or 0}-{grant}", f"(?:<{f}-any>)*(?:<{f}-{v}>|<{f}-any><version-{v}>){later}{TAIL}")
    for grant, later in (("or-later", "<gpl-later>"), ("only", "")) for f, _, vs in FAMILIES for v in vs
)
CC_RULE = r"<cc-(by[a-z-]*-[0-9]\.[0-9])>"
END, BLANK, OTHER = r"([.!?;:])[\x20\x09-\x0D]+", r"\n[\x20\x09-\x0D]*\n", r"[^A-Za-z0-9.+-]+"
STEMS = "|".join(sorted({stem for _, stem, _ in SENTENCES}))
ALL_STEMS = "|".join(sorted({stem for _, stem, _ in SENTENCES} | {stem for stem, _, _ in BEFORE} | {r"gnu\s+[al]?gpl"}) + [rf"\b[al]?{stem}" for stem in TITLE_STEMS] + [SHORT_STEM])
#: A tag's expression. The first form ends its line or comment, so that names of any kind and operators of either case are believed.
TAG, NAME = r"(?i:spdx-license-identifier):", r"[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?"
OPERAND = rf"(?:\([\x20\t]*)*{NAME}(?:[\x20\t]*\))*"


def _expression(space: str, operator: str) -> str:
    """Closing brackets belong to it only after an opening one."""
    join = f"{space}+{operator}{space}+"
    return rf"((?:{NAME}{join})*(?:\([\x20\t]*{OPERAND}(?:{join}{OPERAND})*|{NAME}))"


WHOLE_TAG = rf"{TAG}[\x20\t]*{_expression(r'[\x20\t]', '(?i:and|or|with)')}(?=[\x20\t]*[.;,]?[\x20\t]*(?:\*/|-->|[\"'`>)}}\r\n]|\z))"
PART_TAG = rf"{TAG}[\x20\x09-\x0D]*{_expression(r'[\x20\x09-\x0D]', '(?:AND|OR|WITH)')}"
#: Lower-case name → present name.
NAMES = VOCABULARY.current | {n.lower(): only for n, (_, only, _) in VOCABULARY.grants.items()} | {f"{b}+".lower(): later for b, (_, _, later) in VOCABULARY.grants.items()}


def _normal(pattern: str) -> str:
    """Commas are blanks after normalising."""
    return "(?i)" + pattern.replace(",? ", " ").replace(",?", "")


def tag_id(sentence: Column) -> Column:
    """The identifier of a marked tag, with its expression where that is believed."""
    words = F.regexp_extract_all(sentence, F.lit(r"[()]|[A-Za-z0-9.+:-]+"), F.lit(0))
    operator = lambda w: F.upper(w).isin("AND", "OR", "WITH")
    brackets = lambda b: F.size(F.filter(words, lambda w: w == b))
    # The last bracket of a tag that is itself in brackets isn't the expression's.
    own = F.slice(words, F.lit(1), F.size(words) - F.when(brackets(")") == brackets("(") + 1, 1).otherwise(0))
    named = F.transform(own, lambda w: F.when(operator(w), F.upper(w)).otherwise(F.coalesce(look_up(NAMES, F.lower(w)), w)))
    expression = F.replace(F.replace(F.array_join(named, " "), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    known = F.forall(own, lambda w: operator(w) | w.isin("(", ")") | look_up(NAMES, F.lower(w)).isNotNull() | w.rlike("^(?:LicenseRef|DocumentRef|AdditionRef)-|(?i:exception|-note$)"))
    good = (sentence.startswith("\u0002") | known) & brackets(")").isin(brackets("("), brackets("(") + 1) & ~expression.rlike("(?i)^(?:none|noassertion)$")
    return F.when(good, F.concat(F.lit("<spdx-tag:"), expression, F.lit(">"))).otherwise("<spdx-tag>")


def statements(sentence: Column) -> Column:
    """All identifiers of a normalised, lower-case sentence in order of place. Each takes the place of its words, so that one that is found later,
    and says less, doesn't take them again; identifiers alone are left in angle brackets, which normalised sentences don't hold."""
    sentence = F.regexp_replace(sentence, NEGATED, " ")
    for _, pattern, identifier in BEFORE:
        sentence = F.regexp_replace(sentence, f"(?i){pattern}", identifier)
    for pattern, identifier in AS_IS:
        sentence = F.regexp_replace(sentence, f"(?i){pattern}", identifier)
    for i, _, pattern in SENTENCES:
        if i != "as-is":
            sentence = F.regexp_replace(sentence, _normal(pattern), f" <{i}> ")
    for name, pattern in TITLES:
        sentence = F.regexp_replace(sentence, pattern, f" <title:{name}> ")
    named = sentence
    for name, pattern in SHORT:
        named = F.regexp_replace(named, f"{LEAD}(?:{pattern}){TRAIL}", f" <title:{name}> ")
    sentence = F.when(sentence.rlike(LICENSING), named).otherwise(sentence)
    for pattern, identifier in (*GNU_SHORT, GNU_LATER):
        sentence = F.regexp_replace(sentence, pattern, identifier)
    return F.array_join(F.regexp_extract_all(sentence, F.lit("<[^<> ]+>"), F.lit(0)), "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, unmatched): sentences with known statements, the sequence of these, the distinct licences in order of
    appearance, joined by commas, and how many identifiers no rule took."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = F.regexp_replace(F.regexp_replace(F.translate(text, "\u0002\u0004", "\u0003\u0003"), WHOLE_TAG, "\u0001\u0002$1\u0001"), PART_TAG, "\u0001\u0004$1\u0001")
    # The full stop of `v. 2` ends no sentence.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(tagged, r"\b([vV])\.[ \t]+(?=[0-9])", "$1 "), END, "$1\u0001"), BLANK, "\u0001")
    likely = lambda s: s.rlike(f"(?i){ALL_STEMS}")
    is_tag = lambda s: s.rlike("^[\u0002\u0004]")
    sentences = F.filter(F.split(marked, "\u0001"), lambda s: likely(s) | is_tag(s))
    ids = F.filter(F.transform(sentences, lambda s: F.when(is_tag(s), tag_id(s)).otherwise(statements(F.lower(F.regexp_replace(s, OTHER, " "))))), lambda i: i != "")
    df = docs.select("doc_id", F.when(likely(text), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    df = df.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "").alias("sentence_ids"))
    sequence = F.regexp_replace("sentence_ids", "<spdx-tag:([^<>]+)>", "=$1=")
    for name, pattern in GNU_RULES + RULES:
        sequence = F.regexp_replace(sequence, pattern, f"={name}=")
    sequence = F.regexp_replace(F.regexp_replace(sequence, CC_RULE, "=cc:$1="), *TITLE_RULE)
    df = df.withColumn("ruled", F.when(F.col("n_sentences") > 0, sequence).otherwise(""))
    named = F.transform(F.regexp_extract_all("ruled", F.lit("=([^=<>]+)="), F.lit(1)), lambda x: F.when(x.startswith("cc:"), F.concat(F.lit("CC-"), F.upper(F.substring(x, F.lit(4), F.length(x))))).otherwise(x))
    return df.select(
        "doc_id", "n_sentences", "sentence_ids",
        F.array_join(F.array_distinct(named), ",").alias("licenses"),
        F.regexp_count("ruled", F.lit("<[^<>]+>")).cast("long").alias("unmatched"),
    )


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    case = "case " + " ".join(f"when regexp_matches(s, {quoted(_normal(p))}) then '<{i}>'" for i, _, p in SENTENCES) + " end"
    ruled = "sentence_ids"
    for name, pattern in RULES:
        ruled = f"regexp_replace({ruled}, {quoted(pattern)}, '={name}=', 'g')"
    return rf"""
with d as (select doc_id, row_number() over () as row, regexp_replace(regexp_replace(coalesce(text, ''), {quoted(END)}, '\1' || chr(1), 'g'), {quoted(BLANK)}, chr(1), 'g') as t, coalesce(text, '') as whole from documents),
p as (select row, unnest(string_split(t, chr(1))) as s, unnest(range(1, len(string_split(t, chr(1))) + 1)) as pos from d where regexp_matches(whole, {quoted("(?i)" + STEMS)})),
n as (select row, pos, regexp_replace(s, {quoted(OTHER)}, ' ', 'g') as s from p where regexp_matches(s, {quoted("(?i)" + STEMS)})),
i as (select row, pos, {case} as id from n),
g as (select row, count(*) as n, string_agg(id, '' order by pos) as ids from i where id is not null group by row),
q as (select doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentence_ids from d left join g using (row)),
r as (select *, {ruled} as ruled from q),
x as (select *, regexp_extract_all(ruled, '=([^=<>]+)=', 1) as l from r)
select doc_id, cast(n_sentences as bigint) as n_sentences, sentence_ids, array_to_string(list_filter(l, lambda y, k: list_position(l, y) = k), ',') as licenses, cast(len(regexp_extract_all(ruled, '<[^<>]+>')) as bigint) as unmatched from x
"""
