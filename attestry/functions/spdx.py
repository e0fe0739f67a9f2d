"""Licence names and expressions as columns; parsing, which recursion needs, is an Arrow UDF over distinct expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import empty_to_null, first_match, trim_space
from attestry.functions.vocabulary import CLASSIFIER_NAMES, SYNONYMS, UNLISTED, Vocabulary, look_up

TAG = r"SPDX-License-Identifier:[\t\n\f\r ]*([A-Za-z0-9.+()\-]+(?:[\t\n\f\r ]+(?:WITH|AND|OR)[\t\n\f\r ]+[A-Za-z0-9.+()\-]+)*)"
INFIX, GROUPED, WITH = r"(?i)\s+(AND|OR)\s+", r"(?i)\([^()]*\s+(AND|OR)\s+[^()]*\)", r"(?i)\s+WITH\s+"
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*(:[A-Za-z0-9][A-Za-z0-9.\-]*)?\+?")
# The endings and beginnings that addresses of one text differ by, in the order in which they go.
URL_PREFIXES, URL_SUFFIXES = ("https://", "http://", "www."), ("/", ".txt", ".html", ".htm", ".php")
VOCABULARY = Vocabulary()


def plain_text(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def plain_url(s: str) -> str:
    s = s.strip().lower()
    for p in URL_PREFIXES:
        s = s.removeprefix(p)
    for x in URL_SUFFIXES:
        s = s.removesuffix(x)
    return s if "/" in s or "." in s else ""


def normalize_text(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))


def normalize_url(s: Column) -> Column:
    u = F.lower(trim_space(s))
    for p in URL_PREFIXES:
        u = F.regexp_replace(u, "^" + re.escape(p), "")
    for x in URL_SUFFIXES:
        u = F.regexp_replace(u, re.escape(x) + r"\z", "")
    return F.when(F.contains(u, F.lit("/")) | F.contains(u, F.lit(".")), u).otherwise("")


def is_ref(s: Column) -> Column:
    return trim_space(s).startswith("LicenseRef-")


def ref(s: Column) -> Column:
    """A name with the reference prefix, unless it has it or is blank."""
    t = trim_space(s)
    return F.when((t == "") | is_ref(t), t).otherwise(F.concat(F.lit("LicenseRef-"), t))


def is_deprecated(s: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    return F.lower(trim_space(s)).isin(*(x.lower() for x in vocabulary.deprecated))


def from_text(s: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """The identifier that a name, address or wording stands for; null where it names no particular licence."""
    t = trim_space(s)
    return F.coalesce(
        look_up(vocabulary.current, F.lower(t)),
        look_up(vocabulary.addresses, normalize_url(t)),
        look_up(vocabulary.names, normalize_text(t)),
        look_up(SYNONYMS, normalize_text(t)),
    )


def normalize(s: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """struct(id, grant_base, only, or_later, ref): exactly one of id, grant_base and ref is set, none for blank."""
    t = trim_space(s)
    current = look_up(vocabulary.current, F.lower(t))
    grants = vocabulary.grants
    base = F.when(current.isNull(), look_up({k: v[0] for k, v in grants.items()}, t))
    named = F.coalesce(current, look_up(CLASSIFIER_NAMES, t))
    found = F.when(base.isNull() & ~t.isin(*UNLISTED), F.coalesce(named, from_text(t, vocabulary)))
    return F.struct(
        found.alias("id"),
        base.alias("grant_base"),
        F.when(base.isNotNull(), look_up({k: v[1] for k, v in grants.items()}, t)).alias("only"),
        F.when(base.isNotNull(), look_up({k: v[2] for k, v in grants.items()}, t)).alias("or_later"),
        F.when(base.isNull() & found.isNull(), empty_to_null(t)).alias("ref"),
    )


def header_grant(name: Column, variant: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    return look_up(vocabulary.header_grants, F.concat(name, F.lit("/"), variant))


def tag(text: Column) -> Column:
    """The first tagged expression of a text, null without one."""
    return first_match(text, TAG)


def without_grant(s: Column) -> Column:
    """The identifier without -only or -or-later at the end of its licence part; references stay whole."""
    t = trim_space(s)
    cut = F.split(t, " WITH ", 2)
    bare = F.regexp_replace(trim_space(F.get(cut, F.lit(0))), r"-(only|or-later)\z", "")
    return F.when(is_ref(t), t).otherwise(F.when(F.size(cut) > 1, F.concat(bare, F.lit(" WITH "), F.get(cut, F.lit(1)))).otherwise(bare))


def family(s: Column) -> Column:
    """What precedes the first version segment; '' for references and for names that begin with a version."""
    named_part = F.regexp_replace(trim_space(F.get(F.split(trim_space(s), " WITH ", 2), F.lit(0))), r"\+\z", "")
    segments = F.split(named_part, "-")
    numeric = F.transform(segments, lambda x: x.rlike(r"^\d+(\.\d+)*\z"))
    at = F.array_position(numeric, True)
    return (
        F.when((named_part == "") | is_ref(named_part), "")
        .when(named_part == "0BSD", "BSD")
        .when(at == 0, named_part)
        .otherwise(F.array_join(F.slice(segments, F.lit(1), F.greatest((at - 1).cast("int"), F.lit(0))), "-"))
    )


def canonicalize(s: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """A declared value rewritten as an expression, operand by operand, where that is certain."""
    t = trim_space(s)
    parts = F.split(t, "/")
    slashed = F.contains(t, F.lit("/")) & ~t.rlike(INFIX) & F.forall(parts, lambda p: from_text(p, vocabulary).isNotNull())
    choice = F.array_join(F.transform(parts, lambda p: from_text(p, vocabulary)), " OR ")
    base = F.when(slashed, choice).otherwise(t)
    operands = F.split(base, INFIX)
    operators = F.transform(F.regexp_extract_all(base, F.lit(INFIX), F.lit(1)), lambda o: F.concat(F.lit(" "), F.upper(o), F.lit(" ")))

    def operand(o: Column) -> Column:
        return F.when((trim_space(o) == "") | trim_space(o).rlike(WITH), trim_space(o)).otherwise(F.coalesce(from_text(o, vocabulary), trim_space(o)))

    rewritten = F.array_join(F.zip_with(F.transform(operands, operand), operators, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(t == "", s).when(from_text(t, vocabulary).isNotNull(), from_text(t, vocabulary)).when(t.rlike(GROUPED), t).otherwise(rewritten)


# Expressions. The form between parsing and use is postfix: operands, then AND or OR.


class _Malformed(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """By operator precedence: WITH joins its two names into one operand, then AND, then OR, each from the left."""
    tokens = re.findall(r"[()]|[^\s()]+", re.sub(r"[^\S \t\n\r]", "\x00", expression))
    rank = {"AND": 2, "OR": 1}
    out: list[str] = []
    waiting: list[str] = []
    operand_next, i = True, 0
    while i < len(tokens):
        tok = tokens[i]
        word = tok.upper()
        if operand_next:
            if tok == "(":
                waiting.append(tok)
            elif tok == ")" or word in ("AND", "OR", "WITH") or not IDENTIFIER.fullmatch(tok):
                raise _Malformed(tok)
            else:
                if i + 1 < len(tokens) and tokens[i + 1].upper() == "WITH":
                    exception = tokens[i + 2] if i + 2 < len(tokens) else ""
                    if exception.upper() in ("AND", "OR", "WITH") or not IDENTIFIER.fullmatch(exception):
                        raise _Malformed(exception)
                    tok, i = f"{tok} WITH {exception}", i + 2
                out.append(tok)
                operand_next = False
        elif tok == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise _Malformed(tok)
            waiting.pop()
        elif word in rank:
            while waiting and rank.get(waiting[-1], 0) >= rank[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            raise _Malformed(tok)
        i += 1
    if operand_next or "(" in waiting:
        raise _Malformed("end")
    return out + waiting[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse(s):
    def one(x):
        try:
            return to_postfix(x) if x is not None else None
        except _Malformed:
            return None

    known = {x: one(x) for x in s.unique()}
    return s.map(known)


def parse(expression: Column) -> Column:
    """array<string> in postfix, null if malformed."""
    return _parse(expression)


def parse_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the postfix form, parsing each distinct expression once."""
    distinct = df.select(column).distinct().withColumn(out, parse(F.col(column)))
    return df.join(distinct, column, "left")


def operands(postfix: Column) -> Column:
    """Sorted distinct names, of every branch."""
    return F.array_sort(F.array_distinct(F.filter(postfix, lambda t: ~t.isin("AND", "OR"))))


def lenient_operands(expression: Column, postfix: Column) -> Column:
    """The names of an expression, or what can be read out of a malformed one."""
    words = F.filter(F.split(F.translate(expression, "(),/", "    "), r"\p{IsWhite_Space}+"), lambda w: (w != "") & ~F.upper(w).isin("AND", "OR", "WITH"))
    return F.coalesce(operands(postfix), F.array_sort(F.array_distinct(words)))


def satisfies(postfix: Column, accepted: Column) -> Column:
    """Evaluates the expression over the accepted names: OR needs any branch, AND all. A stack of booleans, in the plan."""
    stack = F.array().cast("array<boolean>")

    def step(acc: Column, t: Column) -> Column:
        top, below, rest = F.element_at(acc, -1), F.element_at(acc, -2), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 2, F.lit(0)))
        return F.when(t == "AND", F.concat(rest, F.array(top & below))).when(t == "OR", F.concat(rest, F.array(top | below))).otherwise(F.concat(acc, F.array(F.array_contains(accepted, t))))

    return F.try_element_at(F.aggregate(postfix, stack, step), F.lit(1))


def render(postfix: Column) -> Column:
    """The expression as text, an OR under an AND in brackets. The stack holds (text, whether it is an OR)."""
    empty = F.array().cast("array<struct<s:string,o:boolean>>")

    def step(acc: Column, t: Column) -> Column:
        right, left, rest = F.element_at(acc, -1), F.element_at(acc, -2), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 2, F.lit(0)))
        side = lambda x: F.when((t == "AND") & x["o"], F.concat(F.lit("("), x["s"], F.lit(")"))).otherwise(x["s"])
        joined = F.struct(F.concat(side(left), F.lit(" "), t, F.lit(" "), side(right)).alias("s"), (t == "OR").alias("o"))
        return F.when(t.isin("AND", "OR"), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(t.alias("s"), F.lit(False).alias("o")))))

    return F.try_element_at(F.aggregate(postfix, empty, step), F.lit(1))["s"]
