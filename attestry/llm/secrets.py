"""Secret scans: broad candidates, then a random forest removes false positives.

Candidates are values of four or more characters assigned to names that contain a word such as password, Kennwort or contraseña (DB_PASSWORD,
clientSecret), a scheme's name before the value aside, passwords in addresses (user:password@host), private keys in PEM form, from BEGIN to END or to the last line of base64, and unbroken runs of
sixteen or more letters, digits and + / _ - that hold a digit. A private key needs no measures: its frame says what it is. Each has measures of its length, of changes between kinds of character, of how much of it dictionary
words cover, of path-like surroundings, and of the words next to it. The forest is trained on labelled findings with Spark's own
trainer; its trees are then written out as one SQL expression, so that scoring is part of the scan. The labelled findings are
made here from shapes of real and of harmless strings with hashes for chance, a fixed number of rows whatever the input.

A text is cut at its candidates, so every candidate is judged at its own place, by what stands around it there, and replaced there.

DataFrame functions only, row by row: no exchange of texts, no join. Defined results: null text has no findings; each place of a
value that occurs again is a finding of its own; very long texts are scanned whole, and no candidate is cut (a private key without
its END line goes to its last line of base64); of candidates that overlap the first counts; repeated rows
give repeated results; an empty table gives no rows; other columns aren't read. `redact` returns its input's rows and columns with
confirmed secrets replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of keys in the languages of the corpora this was made for: English, German, French, Spanish.
KEYS = (
    r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|kennwort|passwort|zugangsschl(?:ü|ue)ssel|geheimnis|mot[ _-]?de[ _-]?passe|mdp|jeton|cl(?:é|e)[ _-](?:api|secr(?:è|e)te)"
    r"|contrase(?:ñ|n)a|clave[ _-](?:api|secreta|de[ _-]acceso)|auth)"
)
#: The key is any identifier with one of the words in it; it is taken from the word on. An author is no key.
NAMED = KEYS.replace("|auth)", "|auth(?!or(?!i[sz])))")
#: A scheme's name before the value, as in `Authorization: Bearer ...`, belongs to the key.
SCHEME = r"(?:(?:bearer|basic|digest|token|apikey|negotiate)[ \t]++)?+"
ASSIGN = rf"(?i:{NAMED}[\w.-]*+[\"']?[ \t]{{0,3}}(?:=>|:=|[:=])[ \t]{{0,3}}[\"']?{SCHEME})"
#: The fewest characters of a value that is assigned or stands in an address. Shorter ones can't be told from words of the text.
LEAST = 4
#: How published kinds of token begin.
PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sr]k_(?:live|test)_|sk-(?:proj|svcacct|admin)-|AIza|npm_|hf_|dop_v1_|eyJ)"
#: What stands before the password of an address.
USER = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:@/\"'<>]*+:"
ADDRESS = rf"\b{USER}[^\s@/\"'<>]{{{LEAST},}}+(?=@)"
KIND = r"(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
INSIDE = r"[A-Za-z0-9+/=:,.()\"'\\\s]++"
PEM = rf"-----BEGIN {KIND}(?:{INSIDE}(?:-(?!-){INSIDE})*+-----END {KIND}|(?:(?:\s|\\[rn]|[\"',])*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:\s{{1,2}}[A-Za-z0-9+/]{{1,15}}={{1,2}})?)"
VALUE = rf"(?!{ADDRESS}|-----BEGIN )[^\s\"',;]{{{LEAST},}}"
# A long name with a digit is not a run where it is the key of a value.
RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?![A-Za-z0-9+/_-]*?{ASSIGN}{VALUE})[A-Za-z0-9+/_-]{{16,}}+={{0,2}}"
CANDIDATE = rf"{PEM}|{ADDRESS}|{ASSIGN}{VALUE}|{RUN}"
#: How many characters before and after a candidate count as its neighbourhood.
NEAR = 40
BESIDE = -(-NEAR // LEAST)
DICTIONARY = (
    "the and for with from this that have your here not was are name user test example sample demo change changeme dummy placeholder password secret token key value none null true false "
    "default admin root guest hello world server client standard windows linux version release build main java python index page post image file src lib com org net http https www"
).split()
WORDS = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
SECRET_WORDS, HARMLESS_WORDS = rf"(?i){KEYS}|credential|bearer|akia", r"(?i)\b(?:sha\d*|md5|commit|checksum|digest|hash|revision|uuid|guid|isbn|order|ticket|invoice|example|sample|phone|etag|build)\b"
FEATURES = ("length", "changes", "covered", "digits", "distinct", "upper", "hex", "slashes", "after_slash", "dashes", "assigned", "near_secret", "near_harmless", "known_prefix")
MARK = "[secret removed]"
TREES, DEPTH, FINDINGS, SEED = 15, 6, 4800, 11
#: Share of trees that must agree.
VOTES = 0.5
#: Lengths that are added up at a time.
STRIDE = 256


def features(value: Column, key: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[a-z]", "a"), r"[A-Z]", "B"), r"\d", "0"), r"[^aB0]", "-")
    gone = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    flag = lambda c: c.cast("double")
    return {
        "length": n,
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "covered": (n - gone(f"(?i)(?:{WORDS})")) / n,
        "digits": (n - gone(r"\d")) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "upper": (n - gone(r"[A-Z]")) / n,
        "hex": flag(value.rlike(r"^[0-9a-f]+$")),
        "slashes": (n - gone("/")).cast("double"),
        "after_slash": flag(before.rlike(r"[/.\\]$") | after.rlike(r"^[.][a-z]{2,4}\b")),
        "dashes": (n - gone("[-_]")) / n,
        "assigned": flag(key != ""),
        "near_secret": flag(F.concat(before, key).rlike(SECRET_WORDS)),
        "near_harmless": flag(F.concat_ws(" ", before, after).rlike(HARMLESS_WORDS)),
        "known_prefix": flag(value.rlike(f"^{PREFIX}")),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(value, key, before, after, label): shapes by row number, letters and digits by hash."""
    h = lambda salt: f"sha2(concat(id, '{salt}'), 256)"
    b64 = lambda salt: f"base64(unhex(sha2(concat(id, '{salt}'), 256)))"
    plain = lambda salt: f"regexp_replace({b64(salt)}, '[+/=]', 'x')"
    word = lambda salt: f"element_at(array({', '.join(repr(w) for w in ('eran', 'thonder', 'mentre', 'schung', 'losque', 'readme', 'report', 'orders'))}), int(pmod(xxhash64(id, '{salt}'), 8)) + 1)"
    prose = f"concat({word('p')}, ' ', {word('q')}, ' ')"
    key = "element_at(array('password', 'token', 'secret', 'api_key', 'passwd', 'auth'), int(pmod(xxhash64(id, 'k'), 6)) + 1)"
    eq = "element_at(array('=', ' = \"', ': ', '=\"'), int(pmod(xxhash64(id, 'e'), 4)) + 1)"
    shapes = [  # value, key, before, after, label
        (f"concat('AKIA', substr(upper({plain('a')}), 1, 16))", "''", prose, "' '", 1),
        (f"substr({h('b')}, 1, 40)", f"concat({key}, {eq})", prose, "'\" '", 1),
        (f"substr({h('c')}, 1, 18)", f"concat({key}, {eq})", prose, "' '", 1),
        (f"substr({plain('d')}, 1, 32)", f"concat({key}, {eq})", prose, "' '", 1),
        (f"concat(substr({plain('f')}, 1, 6), '!', substr({plain('g')}, 1, 5), '#')", f"concat({key}, {eq})", prose, "' '", 1),
        (f"concat('ghp_', substr({plain('i')}, 1, 36))", "''", prose, "' '", 1),
        (b64("j"), f"concat({key}, {eq})", prose, "' '", 1),
        (f"substr({h('l')}, 1, 40)", "''", f"concat({prose}, 'commit ')", "' '", 0),
        (f"{h('m')}", "''", f"concat({prose}, 'sha256 ')", "' '", 0),
        (f"concat_ws('-', substr({h('n')}, 1, 8), substr({h('n')}, 9, 4), substr({h('n')}, 13, 4), substr({h('n')}, 17, 4), substr({h('n')}, 21, 12))", "''", f"concat({prose}, 'uuid ')", "' '", 0),
        (f"concat('src/main/java/', {word('r')}, '/', {word('s')}, pmod(id, 97))", "''", prose, "'.java '", 0),
        (f"concat('posts/', 2000 + pmod(id, 30), '-', {word('t')}, '-', {word('u')}, '-', {word('v')})", "''", "'https://www.example.org/'", "' '", 0),
        ("concat('example', pmod(id, 1000))", f"concat({key}, {eq})", prose, "' '", 0),
        ("concat('changeme', pmod(id, 100))", f"concat({key}, {eq})", prose, "' '", 0),
        (f"concat('your_', {key}, '_here')", f"concat({key}, {eq})", prose, "' '", 0),
        ("repeat('x', int(8 + pmod(id, 20)))", f"concat({key}, {eq})", prose, "' '", 0),
        ("cast(1000000000000000 + pmod(xxhash64(id, 'w'), 1000000000000000) as string)", "''", f"concat({prose}, 'order ')", "' '", 0),
        (f"concat({word('x')}, '-', {word('y')}, '-server-', 2000 + pmod(id, 25))", "''", prose, "' '", 0),
        (f"concat({word('z')}, {word('0')}, {word('1')}, pmod(id, 10))", "''", prose, "' '", 0),
        (f"concat({word('2')}, {word('3')})", f"concat({key}, ': ')", prose, "' '", 0),
        # Names with more around the word, passwords of words, addresses, bare secrets, and harmless strings that look like these.
        (f"concat({word('4')}, pmod(id, 97), '!')", f"concat(upper({key}), '=')", f"concat({prose}, 'DB_')", "' '", 1),
        (f"substr({plain('A')}, 1, 20)", f"concat({key}, '_prod', {eq})", f"concat({prose}, 'my_')", "' '", 1),
        (f"concat({word('5')}, pmod(id, 997), substr({plain('B')}, 1, 4))", "'postgres://admin:'", prose, "'@db.internal:5432/x '", 1),
        (f"substr({plain('C')}, 1, 40)", "'ftp://web:'", prose, "'@files.internal '", 1),
        (f"substr(concat({b64('D')}, {b64('E')}), 1, 40)", "''", prose, "' '", 1),
        (f"substr({plain('F')}, 1, int(24 + pmod(id, 17)))", "''", prose, "' '", 1),
        (f"substr(concat(regexp_replace({b64('G')}, '=', ''), {b64('H')}), 1, 64)", "''", "'\n'", "'\n'", 1),
        (b64("I"), "''", f"concat({prose}, element_at(array('sha256 ', 'checksum ', 'digest: ', 'etag ', 'hash '), int(pmod(id, 5)) + 1))", "' '", 0),
        (f"substr({plain('J')}, 1, 24)", "''", "'https://www.host.org/'", "' '", 0),
        (f"concat({word('6')}, initcap({word('7')}), initcap({word('8')}), pmod(id, 10))", "''", prose, "' '", 0),
        ("element_at(array('password', 'changeme', 'placeholder', 'example', 'password1'), int(pmod(id, 5)) + 1)", "'http://user:'", prose, "'@host.org/ '", 0),
        (f"concat(substr({word('9')}, 1, 6), element_at(array('.', ':', ')', ''), int(pmod(id, 4)) + 1))", f"concat({key}, ': ')", prose, "' '", 0),
    ]
    # Kinds of token by their beginnings, short passwords beside short words.
    shapes += [
        (f"concat(element_at(array('ghp_', 'gho_', 'github_pat_', 'glpat-', 'sk-proj-', 'sk_live_', 'npm_', 'hf_', 'xoxb-'), int(pmod(id, 9)) + 1), substr(concat({plain('K')}, {plain('L')}), 1, int(24 + pmod(id, 40))))", "''", prose, "' '", 1),
        (f"concat(element_at(array('ghp_', 'sk-proj-', 'glpat-', 'npm_'), int(pmod(id, 4)) + 1), substr({plain('M')}, 1, 36))", f"concat({key}, {eq})", prose, "' '", 1),
        (f"concat('p', pmod(id, 10), substr({plain('N')}, 1, 2), element_at(array('', '!', 'x'), int(pmod(id, 3)) + 1))", "'psql://u:'", prose, "'@db/x '", 1),
        (f"concat(substr({word('O')}, 1, 3), 10 + pmod(id, 90))", "'password='", prose, "' '", 1),
        ("element_at(array('is', 'the', 'your', 'that', 'dans', 'para', 'oder', 'none', 'null', 'true', 'same', 'here', 'este', 'wird'), int(pmod(id, 14)) + 1)", f"concat({key}, ': ')", prose, "' '", 0),
        (f"substr({word('P')}, 1, int(4 + pmod(id, 3)))", f"concat({key}, {eq})", prose, "' '", 0),
    ]
    n = len(shapes)
    df = spark.range(0, rows, 1, 1).withColumn("shape", F.expr(f"pmod(id, {n})"))
    out = None
    # A dozen shapes at a time, so that the expressions of each part stay within what can be compiled.
    for lo in range(0, n, 12):
        part = range(lo, min(lo + 12, n))
        pick = lambda i: "case " + " ".join(f"when shape = {k} then {shapes[k][i]}" for k in part) + " end"  # noqa: B023, E731
        some = df.where(F.col("shape").isin(*part)).selectExpr(f"{pick(0)} as value", f"{pick(1)} as key", f"{pick(2)} as before", f"{pick(3)} as after", f"cast({pick(4)} as double) as label")
        out = some if out is None else out.unionByName(some)
    return out


def _tree_sql(lines: list[str]) -> str:
    """A tree of the trainer's printout as nested CASE."""

    def node(i: int) -> tuple[str, int]:
        line = lines[i].strip()
        if m := re.match(r"Predict: (\S+)", line):
            return m[1], i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes, j = node(i + 1)
        no, k = node(j + 1)  # line j is "Else"
        return f"CASE WHEN {{{FEATURES[int(m[1])]}}} <= {m[2]} THEN {yes} ELSE {no} END", k

    return node(0)[0]


def train(spark: SparkSession) -> list[str]:
    """The trees as SQL over {feature} names."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled_findings(spark)
    made = rows.select("label", *(c.alias(k) for k, c in features(F.col("value"), F.col("key"), F.col("before"), F.col("after")).items()))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(data)
    trees = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", "\n" + model.toDebugString.split("\n", 1)[1])[1:]
    return [_tree_sql([x for x in t.split("\n") if x.strip()]) for t in trees]


def let(value: Column, body) -> Column:
    """body(value) with the value made once, however often the body names it, and in whichever lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column) -> Column:
    """struct(between, matches): what stands before, between and after the candidates, and the candidates, both in order of place."""
    return F.struct(F.split(text, CANDIDATE, -1).alias("between"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("matches"))


def _woven(first: Column, second: Column) -> Column:
    """The strings of two arrays in turn, as one string."""
    return F.array_join(F.flatten(F.zip_with(first, second, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def _judged(pieces: Column, trees: list[str]) -> Column:
    """array<struct(value, key, rule, score)>: each candidate with the share of trees for it, judged by what stands next to it."""
    between, matches = pieces["between"], pieces["matches"]

    def beside(m: Column, i: Column) -> Column:
        # So many candidates, of LEAST characters each, and what stands between fill the neighbourhood.
        first, n = F.greatest(i - (BESIDE - 1), F.lit(1)), F.least(i, F.lit(BESIDE))
        before = F.concat(_woven(F.slice(between, first, n), F.slice(matches, first, n)), F.get(between, i))
        after = F.concat(F.get(between, i + 1), _woven(F.slice(matches, i + 2, BESIDE), F.slice(between, i + 3, BESIDE)))
        return F.struct(m.alias("m"), F.regexp_extract(m, f"^(?:{USER}|{ASSIGN})", 0).alias("key"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    def parted(p: Column) -> Column:
        return F.struct(F.substring(p["m"], F.length(p["key"]) + 1, F.length(p["m"])).alias("value"), p["key"].alias("key"), p["before"].alias("before"), p["after"].alias("after"))

    def measured(p: Column) -> Column:
        f = features(p["value"], p["key"], p["before"], p["after"])
        return F.struct(p["value"].alias("value"), p["key"].alias("key"), F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in f.items())).alias("f"))

    def scored(x: Column) -> Column:
        votes = F.lit(0.0)
        for t in trees:
            votes = votes + _column(t, x["f"])
        framed = x["value"].startswith("-----BEGIN ")
        rule = F.when(framed, "private-key").when(x["f"]["known_prefix"] > 0, "known-prefix").when(x["key"].rlike(f"^{USER}"), "address").when(x["key"] != "", "assignment").otherwise("run")
        return F.struct(x["value"].alias("value"), x["key"].alias("key"), rule.alias("rule"), F.when(framed, 1.0).otherwise(votes / len(trees)).alias("score"))

    return F.transform(F.transform(F.transform(F.transform(matches, beside), parted), measured), scored)


def _starts(pieces: Column) -> Column:
    """Where each candidate begins. Lengths are added up by strides first, so that a text of very many candidates costs no square of them."""
    between, matches = pieces["between"], pieces["matches"]
    total = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)
    lengths = F.zip_with(between, matches, lambda b, m: (F.length(b) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    stride = lambda i: F.floor(i / STRIDE).cast("int")

    def placed(n: Column, upto: Column) -> Column:
        return F.transform(matches, lambda _, i: F.get(upto, stride(i)) + total(F.slice(n, stride(i) * STRIDE + 1, F.pmod(i, F.lit(STRIDE)))) + F.length(F.get(between, i)))

    strides = lambda n: F.transform(F.sequence(F.lit(0), stride(F.size(n))), lambda j: total(F.slice(n, j * STRIDE + 1, STRIDE)))
    upto = lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j)))
    return let(lengths, lambda n: let(let(strides(n), upto), lambda u: placed(n, u)))


def _column(sql: str, f: Column) -> Column:
    """A tree over the fields of a struct."""
    tokens = re.findall(r"CASE WHEN \{(\w+)\} <= (\S+) THEN|(ELSE)|(END)|([\d.Ee-]+)", sql)
    at = 0

    def node() -> Column:
        nonlocal at
        name, cut, _, _, leaf = tokens[at]
        at += 1
        if leaf:
            return F.lit(float(leaf))
        yes = node()
        at += 1
        no = node()
        at += 1
        return F.when(f[name] <= float(cut), yes).otherwise(no)

    return node()


def scan(docs: DataFrame, trees: list[str] | None = None) -> DataFrame:
    """(doc_id, rule, start, length, score, value): one row for each confirmed secret, at each of its places; these count code points from 0."""
    trees = trees or train(docs.sparkSession)
    # Only texts with a candidate come to the second step.
    given = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    placed = lambda f, at: F.struct(f["rule"].alias("rule"), (at + F.length(f["key"])).cast("long").alias("start"), F.length(f["value"]).cast("long").alias("length"), f["score"].alias("score"), f["value"].alias("value"))
    found = let(_pieces(F.col("text")), lambda p: F.filter(F.zip_with(_judged(p, trees), _starts(p), placed), lambda x: x["score"] > VOTES))
    # An outer explode: from a plain one the optimizer infers a filter on the array, which would compute it twice.
    return given.select("doc_id", F.explode_outer(found).alias("x")).where("x is not null").select("doc_id", "x.*")


def redact(docs: DataFrame, trees: list[str] | None = None) -> DataFrame:
    """The rows and columns of `docs`, confirmed secrets replaced by MARK where they stand; n_chars, where there is one, follows the text."""
    trees = trees or train(docs.sparkSession)
    text = F.col("text")
    mark = lambda m, x: F.when(x["score"] > VOTES, F.concat(x["key"], F.lit(MARK))).otherwise(m)
    clean = F.when(text.rlike(CANDIDATE), let(_pieces(text), lambda p: _woven(p["between"], F.zip_with(p["matches"], _judged(p, trees), mark)))).otherwise(text)
    out = docs.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
