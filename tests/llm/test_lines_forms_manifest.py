"""Line dedup, fill-in-middle and the manifest against brute force, on rows that try them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.llm import fim, linededup, merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINES = [f"Line number {i} of the collection" for i in range(12)] + ["short", "\tLINE number 3 of the collection  ", "", "  ", "ünïcödé Zeilen", "ÜNÏCÖDÉ Zeilen", "123456789", "1234567890", "\x0b1234567890\x0c", " 1234567890"]


def rows():
    rng = random.Random(3)
    out = [(1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "one line, no end"), (6, "<P> in it\nnext"), (7, "<\n<S\n<P\n>"), (8, "a\r\nb\n"), (9, "x" * 300_000 + "\n" + "y" * 10), (10, "ü\n" * 5000 + "end")]
    out += [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 15))) + rng.choice(["", "\n"])) for i in range(11, 120)]
    return out + [(119, "Line number 1 of the collection"), (119, "Line number 1 of the collection"), (-5, "Line number 2 of the collection\nown line of it"), (None, "Line number 2 of the collection\nnobody else has this"), (None, "nobody else has this\n")]


@pytest.fixture(scope="module")
def given():
    return [(i, t, ["en", None][n % 2], [None, "s0", "s1", "é", "hot", "hot", "hot"][n % 7], n if n % 5 else None) for n, (i, t) in enumerate(rows())]


@pytest.fixture(scope="module")
def docs(spark, given):
    names = ("n", "key", "gone", "row", "doc", "at", "batch", "tree", "idx", "total", "digest", "path", "top", "leaf", "block", "task", "form", "output", "name", "held", "kept", "other")
    return spark.createDataFrame(given, SCHEMA).withColumns({c: F.lit(7) for c in names}).repartition(5)


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def deduped(given):
    first = {}
    for i, t, *_ in given:
        for line in (t or "").split("\n"):
            first[key_of(line)] = min(first.get(key_of(line), 1 << 70), linededup.LAST if i is None else i)
    out = []
    for i, t, *_ in given:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or first[key_of(x)] == (linededup.LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 3), (7, 2), (5, 3)])
def test_line_dedup(docs, given, batches, fanout):
    got = linededup.dedup(docs, batches=batches, fanout=fanout)
    assert sorted((tuple(r) for r in got.collect()), key=str) == deduped(given)


def test_line_runs_share_no_key(spark):
    runs = linededup.Runs(spark, 3, 2)
    keys = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    seen = [runs.admit(keys(a, b)).where("held").count() for a, b in ((0, 100), (50, 150), (0, 10), (140, 300), (299, 301))]
    assert seen == [0, 50, 10, 10, 1]
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches in twos
    every = [r for level in runs.levels for name in level for r in spark.table(name).select("key").collect()]
    assert len(every) == len(set(every)) == 301
    plan = keys(0, 9).join(spark.table(runs.levels[0][0]).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan
    runs.close()


def test_line_dedup_native(docs):
    assert "Python" not in linededup.dedup(docs, batches=2)._jdf.queryExecution().executedPlan().toString()


def filled(i, t, rate, spm):
    t = t or ""
    digest = hashlib.sha256(b"7:" + (b"" if i is None else str(i).encode())).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    if not t or any(m in t for m in fim.MARKERS) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("every, rate, spm", [(64, 100, 50), (1, 60, 100), (3, 100, 0)])
def test_fill_in_middle(docs, given, every, rate, spm):
    made = fim.transform(docs, rate=rate, spm=spm, every=every).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in made), key=str) == sorted((filled(i, t, rate, spm) for i, t, *_ in given), key=str)
    assert sorted((str(r["doc_id"]), r["back"]) for r in made) == sorted((str(i), t or "") for i, t, *_ in given)


def test_checkpoints_over_blocks(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        monkeypatch.setattr(fim, "BLOCK", rng.randrange(1, 40))
        text = "".join(rng.choice("aé\n\U0001f600") for _ in range(rng.randrange(200)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        index = fim.Checkpoints(text.encode(), rng.randrange(1, 9))
        assert index.n == len(units)
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.find(u) == (len(head.encode()), len(head))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, t, lang, source, n):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def tree(leaves):
    """(root, path of each leaf): whole levels at a time."""
    level, members, paths = list(leaves), [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        runs = [range(a, min(a + 3, len(level))) for a in range(0, len(level), 3)]
        for run in runs:
            for k in run:
                for leaf_ in members[k]:
                    paths[leaf_].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        members = [[x for k in run for x in members[k]] for run in runs]
        level = [h(*(level[k] for k in run)) for run in runs]
    return level[0], paths


def manifest(given):
    by_source = {}
    for row in given:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: b"" if s is None else b"=" + s.encode())
    for s in sources:
        by_source[s].sort(key=lambda r: ((-(1 << 70) if r[0] is None else r[0]), leaf(*r)))
    trees = [tree([leaf(*r) for r in by_source[s]]) for s in sources]
    root, upper = tree([t for t, _ in trees])
    out = []
    for s, (subroot, paths), above in zip(sources, trees, upper):
        for row, path in zip(by_source[s], paths):
            i, t, *_ = row
            bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
            fold = leaf(i, t.replace("\n", "") if bad and t is not None else t, *row[2:])
            for a, b in path + above:
                fold = h(a, fold, b)
            out.append((i, leaf(*row), subroot, root, h(*(a + b for a, b in path + above)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(docs, given, levels):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.verified(docs, tampered, F.replace("text", F.lit("\n"), F.lit("")), levels=levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest(given)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 100])
def test_walk(n):
    leaves = [h(str(k)) for k in range(n)]
    root, paths = merkle.walk([bytes.fromhex(x) for x in leaves], merkle._levels(n))
    want, want_paths = tree(leaves)
    assert root.hex() == want and [[(a.hex(), b.hex()) for a, b in p] for p in paths] == want_paths


def test_nothing_in_nothing_out(docs):
    none = docs.where("false")
    assert linededup.dedup(none).count() == 0 and fim.transform(none).count() == 0
    assert merkle.verified(none, F.lit(True), F.lit("x")).count() == 0


def test_rows_that_lie_alone(spark):
    one = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    got = merkle.verified(one, F.lit(False), F.lit("")).first()
    assert got["leaf"] == got["subroot"] == got["root"] == h("-----") and got["proof_sha256"] == h("") and got["verified"]
    assert [tuple(r) for r in linededup.dedup(one).collect()] == [(None, 1, 0, "")]
