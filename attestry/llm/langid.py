"""Language identification by compression: whichever language's dictionary compresses a text best is its language.

For each language that occurs in the labelled rows, whole texts of a bounded sample make a zstandard raw-content dictionary. A
text is compressed with each of them, brought to the same form: lower case, letters alone, one blank for whatever stands between them.
The language with the smallest size wins, and a narrow margin is reported as `rejected`. Texts with nothing in common with any dictionary tie; ties go to the language with more labelled rows,
then to the name that sorts first.

The sample is the one bound here: about SAMPLE_DOCS distinct texts and at most DICT_BYTES bytes for each language (less where so many
languages are labelled that all dictionaries would take more than ALL_BYTES), taken by a hash of the text from every partition.
Counts by language cover all labelled rows. The settings were chosen within the rows that may be learned from: one third taught,
another judged.

Defined results: null text or text without a letter gives `und` with score 0; with nothing to learn from, every row is `und`; a very
long text is compressed whole with the same dictionaries as any other; repeated rows are predicted alike; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import held_out, small_batches

SAMPLE_DOCS = 160
HASH_TOP = 2**63 - 1
DICT_BYTES, ALL_BYTES = 192 << 10, 64 << 20
LEVEL, MIN_MATCH, SEARCH_LOG = 5, 3, 3
#: A lead of less than this share of the size, or of fewer bytes than LEAD, is narrow.
MARGIN, LEAD = 0.01, 2

NO_LETTERS = re.compile(r"[\W\d_]+")

Learned = list[tuple[str, int, bytes]]


def learn(docs: DataFrame, dict_bytes: int = DICT_BYTES, sample: int = SAMPLE_DOCS) -> Learned:
    """(language, labelled rows, dictionary), most rows first. Reads text and lang only, of rows outside the held-out third."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    dict_bytes = min(dict_bytes, ALL_BYTES // max(1, len(counts)))
    # Distinct texts that fit several to a dictionary (any, where a language has none), taken by their hash: as many as its share of hashes holds.
    long = F.octet_length("text") > dict_bytes // 8
    hashed = labelled.where(F.length("text") > 0).select("lang", F.xxhash64("text").alias("h"), long.alias("long")).distinct()
    short = {(r["lang"], r["long"]): r["n"] for r in hashed.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a language
    bounds = [(lang, (lang, False) not in short, min(HASH_TOP, int(-(2**63) + 2**64 * sample / n))) for lang in counts if (n := short.get((lang, False)) or short.get((lang, True)))]
    texts: dict[str, list[bytes]] = {}
    if bounds:
        wanted = docs.sparkSession.createDataFrame(bounds, "lang string, long boolean, top long")  # one row a language
        rows = labelled.withColumns({"h": F.xxhash64("text"), "long": long}).join(F.broadcast(wanted), ["lang", "long"]).where("h <= top and length(text) > 0")
        # Of a text no more than a dictionary's bytes can be used.
        found = rows.groupBy("lang", "h").agg(F.min(F.substring(F.col("text").cast("binary"), 1, dict_bytes)).alias("text")).collect()  # about `sample` texts a language
        for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
            texts.setdefault(r["lang"], []).append(bytes(r["text"]))
    return sorted(((lang, n, dictionary(texts.get(lang, []), dict_bytes)) for lang, n in counts.items()), key=lambda x: (-x[1], x[0]))


def letters(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).encode()


def dictionary(texts: list[bytes], size: int) -> bytes:
    """Whole texts one after another, the last one cut."""
    out = bytearray()
    for t in texts:
        if len(out) >= size:
            break
        out += letters(t.decode(errors="replace")) + b"\n"
    return bytes(out[:size])


def has_letter(text: str) -> bool:
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def classifier(learned: Learned):
    """text → (language, score, rejected)."""
    import zstandard

    compressors = []
    for _, _, content in learned:
        d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, search_log=SEARCH_LOG, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=params)
        compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def classify(text: str | None):
        if not text or not has_letter(text) or not compressors:
            return "und", 0.0, True
        data = letters(text)
        sizes = [(len(c.compress(data)), i) for i, c in enumerate(compressors)]
        best = min(sizes)
        if len(sizes) == 1:
            return learned[0][0], 1.0, False
        second = min(s for s in sizes if s is not best)
        lead = second[0] - best[0]
        share = lead / max(second[0], 1)
        # From one half (a tie) towards 1 as the lead grows.
        return learned[best[1]][0], 0.5 + 0.5 * (share / (share + 0.05)), share < MARGIN or lead < LEAD

    return classify


_classifiers: dict[int, object] = {}


def predict(docs: DataFrame, learned: Learned) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # at most ALL_BYTES
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    key = hash(tuple(learned))

    def run(batches):
        if key not in _classifiers:
            _classifiers.clear()
            _classifiers[key] = classifier(sent.value)
        classify = _classifiers[key]
        for b in batches:
            got = [classify(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
