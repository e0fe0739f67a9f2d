"""The pipeline against a slow version of itself: every stage's decision made again, in plain Python where it isn't a trained model."""

from __future__ import annotations

import random

from attestry.llm import packing, quality_model, quality_rules, secrets
from attestry.llm.queries import WORD_BPE, vocabulary
from tests.llm.test_corpus import brute, words


def test_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    base = words(rng, 120)
    data = [(i, words(rng, 120)) for i in range(200)] + [(200 + i, " ".join(x + "%%%" for x in words(rng, 90).split())) for i in range(100)]
    data += [(300 + i, base + f" tail{i}") for i in range(12)] + [(400, words(rng, 100) + " password=b7db7aa4a5fcc78305 " + words(rng, 5)), (401, "short"), (402, None), (403, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1, 0) for i, _ in data[:300]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality_model.classify(docs, labels).collect()}
    left = [(i, t) for i, t in data if scored[i] == 1]
    assert not any(200 <= i < 300 for i, _ in left) and sum(i < 200 for i, _ in left) == 200
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs.join(spark.createDataFrame(left, "doc_id bigint, t string").drop("t"), "doc_id", "left_semi")).collect()}
    left = [(i, t) for i, t in left if judged[i]]
    classes = brute(left, 5, 80, 100)
    left = [(i, t) for i, t in left if classes[i][1] == i]
    assert sum(300 <= i < 312 for i, _ in left) == 1
    left = [(i, t.replace("b7db7aa4a5fcc78305", secrets.MARK)) for i, t in left]
    want = packing.pieces(spark.createDataFrame(left, "doc_id bigint, text string"), vocabulary(WORD_BPE)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r) for r in want)
    assert any(i == 400 for i, *_ in got)
    sequences(got)


def sequences(got, capacity=2048):
    """Every piece lies in one sequence, side by side with others from place 0 on, and none holds more than it may."""
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    # Two sequences that would fit into one aren't left apart.
    used = sorted(sum(n for _, n in p) for p in placed.values())
    assert len(used) < 2 or used[0] + used[1] > capacity


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, long and empty texts, columns whose names operators use themselves."""
    import corpus_pipeline

    rng = random.Random(12)
    good = [(i, words(rng, 130)) for i in range(120)]
    data = [*good, (5, good[5][1]), (5, good[5][1]), (6, words(rng, 140)), (None, words(rng, 150)), (None, None), (130, None), (131, ""), (132, " \n\t"), (133, words(rng, 60_000)), (134, good[7][1]), (135, good[7][1] + " more")]
    full = [(i, t, None if n % 3 else "en", None if n % 2 else "s", None if n % 5 else len(t or "")) for n, (i, t) in enumerate(data)]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = ("label", "score", "predicted", "kept", "component_id", "c", "rows", "piece", "length", "group_docs", "h", "n")
    docs.selectExpr("*", *(f"7 as {c}" for c in clashing)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(100)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0), (50, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sequences(got)
    texts = {i for i, t in data if t and t.strip()}
    assert {r["doc_id"] for r in got} <= texts and got
    # What the last stage was given: each document's pieces follow each other and none comes twice.
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, pieces in of.items():
        if i is None:
            continue
        at = 0
        for piece, start, length in sorted(pieces):
            assert start == at or i == 6
            at += length
    assert not {134, 7} <= set(of)


def test_run_on_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert len(corpus_pipeline.STAGES) == 5
