"""The scalar functions under names for SQL text: native ones as SQL functions, which Catalyst inlines; Python ones as vectorised functions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestry.functions import spdx
from attestry.functions.vocabulary import CLASSIFIER_NAMES, SYNONYMS, UNLISTED
from attestry.sources import archives

_CRLF = "chr(13) || chr(10)"
_EDGES = r"'^\\p{IsWhite_Space}+|\\p{IsWhite_Space}+\\z', ''"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_EDGES})"


def _versioned(kind: str, path: str) -> str:
    return f"'pkg:{kind}/' || {path} || if(coalesce(version, '') = '', '', '@' || version)"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(values: dict[str, str]) -> str:
    return f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in values.items())})"


def _plain(x: str) -> str:
    return f"btrim(regexp_replace(lower({x}), '[^a-z0-9]+', ' '))"


def _url(x: str) -> str:
    u = f"lower({_trim(x)})"
    for p in spdx.URL_PREFIXES:
        u = f"regexp_replace({u}, {_quoted('^' + re.escape(p))}, '')"
    for e in spdx.URL_SUFFIXES:
        u = f"regexp_replace({u}, {_quoted(re.escape(e) + chr(92) + 'z')}, '')"
    return f"nullif(regexp_extract({u}, '(?s)^(?=.*[/.]).*$', 0), '')"


def _from_text(x: str) -> str:
    """Functions aren't called within lambdas, so this one is written out wherever it is needed."""
    v, t = spdx.VOCABULARY, _trim(x)
    return f"coalesce(try_element_at({_map(v.current)}, lower({t})), try_element_at({_map(v.addresses)}, {_url(x)}), try_element_at({_map(v.names)}, {_plain(t)}), try_element_at({_map(SYNONYMS)}, {_plain(t)}))"


def _grants(i: int) -> str:
    return _map({k: v[i] for k, v in spdx.VOCABULARY.grants.items()})


def _canonicalize() -> str:
    infix, grouped, joined = _quoted(spdx.INFIX), _quoted(spdx.GROUPED), _quoted(spdx.WITH)
    t = _trim("s")
    base = f"if(contains({t}, '/') and not {t} rlike {infix} and forall(split({t}, '/'), p -> {_from_text('p')} is not null), array_join(transform(split({t}, '/'), p -> {_from_text('p')}), ' OR '), {t})"
    operand = f"if({_trim('o')} = '' or {_trim('o')} rlike {joined}, {_trim('o')}, coalesce({_from_text('o')}, {_trim('o')}))"
    rewritten = f"array_join(zip_with(transform(split({base}, {infix}), o -> {operand}), transform(regexp_extract_all({base}, {infix}, 1), o -> ' ' || upper(o) || ' '), (a, b) -> a || coalesce(b, '')), '')"
    return f"case when {t} = '' then s when {_from_text('s')} is not null then {_from_text('s')} when {t} rlike {grouped} then {t} else {rewritten} end"


_STACK = "slice(acc, 1, greatest(size(acc) - 2, 0))"
#: name -> (parameters, result, body)
NATIVE = {
    "att_normalized_hex": ("content STRING", "STRING", f"sha2(replace(content, {_CRLF}, chr(10)), 256)"),
    "att_file_digest": ("content STRING", "STRING", f"'sha256:' || sha2(replace(content, {_CRLF}, chr(10)), 256)"),
    "att_text_ref": ("content STRING", "STRING", f"if(octet_length(content) = 0, '', 'LicenseRef-v1-' || substr(sha2(replace(content, {_CRLF}, chr(10)), 256), 1, 16))"),
    "att_content_hash": (
        "records ARRAY<STRUCT<path: STRING, digest: STRING>>", "STRING",
        "'v1-' || sha2(coalesce(array_join(transform(sort_array(records), x -> octet_length(x.path) || ':' || x.path || octet_length(x.digest) || ':' || x.digest), ''), ''), 256)",
    ),
    "att_plain_text": ("s STRING", "STRING", "btrim(regexp_replace(lower(s), '[^a-z0-9]+', ' '))"),
    "att_pypi_name": ("s STRING", "STRING", _trim("lower(regexp_replace(s, '[-_.]+', '-'))")),
    "att_purl_golang": ("module STRING, version STRING", "STRING", _versioned("golang", "module")),
    "att_purl_cargo": ("name STRING, version STRING", "STRING", _versioned("cargo", "name")),
    "att_purl_pypi": ("name STRING, version STRING", "STRING", _versioned("pypi", "att_pypi_name(name)")),
    "att_purl_maven": ("group_id STRING, artifact_id STRING, version STRING", "STRING", _versioned("maven", "group_id || '/' || artifact_id")),
    "att_tag": ("s STRING", "STRING", f"if(s rlike {_quoted(spdx.TAG)}, regexp_extract(s, {_quoted(spdx.TAG)}, 1), null)"),
    "att_from_text": ("s STRING", "STRING", _from_text("s")),
    "att_current_id": ("s STRING", "STRING", f"try_element_at({_map(spdx.VOCABULARY.current)}, lower({_trim('s')}))"),
    "att_grant_base": ("s STRING", "STRING", f"if(att_current_id(s) is null, try_element_at({_grants(0)}, {_trim('s')}), null)"),
    "att_named_id": (
        "s STRING", "STRING",
        f"if(att_grant_base(s) is null and not {_trim('s')} in ({', '.join(map(_quoted, UNLISTED))}), coalesce(att_current_id(s), try_element_at({_map(CLASSIFIER_NAMES)}, {_trim('s')}), att_from_text(s)), null)",
    ),
    "att_normalize": (
        "s STRING", "STRUCT<id: STRING, grant_base: STRING, only: STRING, or_later: STRING, ref: STRING>",
        f"named_struct('id', att_named_id(s), 'grant_base', att_grant_base(s), 'only', if(att_grant_base(s) is null, null, try_element_at({_grants(1)}, {_trim('s')})), "
        f"'or_later', if(att_grant_base(s) is null, null, try_element_at({_grants(2)}, {_trim('s')})), 'ref', if(att_grant_base(s) is null and att_named_id(s) is null, nullif({_trim('s')}, ''), null))",
    ),
    "att_canonicalize": ("s STRING", "STRING", _canonicalize()),
    "att_satisfies": (
        "postfix ARRAY<STRING>, accepted ARRAY<STRING>", "BOOLEAN",
        f"try_element_at(aggregate(postfix, cast(array() as array<boolean>), (acc, t) -> case t when 'AND' then concat({_STACK}, array(element_at(acc, -1) and element_at(acc, -2))) "
        f"when 'OR' then concat({_STACK}, array(element_at(acc, -1) or element_at(acc, -2))) else concat(acc, array(array_contains(accepted, t))) end), 1)",
    ),
    "att_is_ref": ("s STRING", "BOOLEAN", f"startswith({_trim('s')}, 'LicenseRef-')"),
}


@F.udtf(returnType="path string, size_bytes bigint, content binary, error string")
class ExpandArchive:
    """The retained members of one archive, or one row with the reason why it isn't read."""

    def eval(self, name: str, content: bytes, prefix: str):
        try:
            members = sorted(archives.expand(name or "", bytes(content or b""), prefix or "").items())
        except archives.DAMAGED as e:
            yield name, 0, None, f"{type(e).__name__}: {e}"
            return
        for path, body in members:
            yield path, len(body), body, None


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (parameters, result, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("att_parse_expression", spdx._parse)
    spark.udtf.register("att_expand_archive", ExpandArchive)
    return [*NATIVE, "att_parse_expression", "att_expand_archive"]
