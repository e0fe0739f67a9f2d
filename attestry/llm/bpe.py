"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be joined by merges, so the place between
them is a certain cut: the text on either side encodes by itself, and the ids of the whole are the ids of the parts in
order. The table of such pairs is computed from the vocabulary. Of the forced pairs two kinds are used, those where the
pre-tokenizer provably agrees: a byte that isn't white space before ASCII white space (a cut almost at every word), and, in
long unbroken runs, two ASCII letters. Fragments repeat, so each worker keeps the ids of those it has met in a dictionary
of bounded size.

Defined results: null text counts as empty text and gives no ids; a special token's own string in a text gives its id, as
the tokenizers library does; repeated rows give repeated results; an empty table gives no rows; columns other than
doc_id and text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import small_batches

#: Fragments that a worker remembers, and the longest that it does.
MEMORY = 250_000
LONGEST = 256
WS = b" \t\n\x0b\x0c\r"
#: White space beyond ASCII (the Unicode property) in UTF-8.
WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encoder and decoder of one byte-level vocabulary, given as the tokenizers library's JSON."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed, alphabet = json.loads(spec), byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in parsed["added_tokens"]}
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in parsed["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.forced = self.forced_pairs([t for t in tokens.values() if t not in self.special])
        self._decode_table(tokens)
        white = np.frombuffer(WS, np.uint8)
        certain = [b for b in range(256) if b not in WS and self.forced[b, white].all()]
        self.all_certain = len(certain) == 256 - len(WS)
        ws = b"[" + re.escape(WS) + b"]"
        no = b"[^" + re.escape(WS) + b"]"
        if self.all_certain:
            self.cuts = re.compile(ws + b"*" + no + b"+|" + ws + b"+").findall
        else:
            before = b"".join(re.escape(bytes([b])) for b in certain)
            self.cuts = re.compile(b"(?<=[" + before + b"])(?=" + ws + b")").split if certain else lambda text: [text]
        self.wide = re.compile(WIDE).search
        any_ws = b"(?:" + ws + b"|" + WIDE + b")"
        #: With wide white space about, a cut comes only before a whole run of white space, where the pre-tokenizer cuts anyway.
        self.wide_cuts = re.compile(any_ws + b"*(?:(?!" + WIDE + b")" + no + b")+|" + any_ws + b"+").findall
        #: Fragments met lately, and those met before the last time that the memory was full.
        self.memory: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    @staticmethod
    def forced_pairs(tokens: list[bytes]) -> np.ndarray:
        """[a, b] is True where no token has byte b right after byte a."""
        inside = np.zeros((256, 256), bool)
        for t in tokens:
            a = np.frombuffer(t, np.uint8)
            inside[a[:-1], a[1:]] = True
        return ~inside

    def _decode_table(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in tokens.items():
            self.length[i] = len(t)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def fragments(self, text: bytes) -> list[bytes]:
        return self.wide_cuts(text) if self.wide(text) else self.cuts(text)

    def _inner(self, fragment: bytes) -> list[bytes]:
        """Cuts a long fragment at forced pairs of ASCII letters, unless it may hold a special token or a contraction."""
        if len(fragment) <= LONGEST or b"'" in fragment or any(t in fragment for t in self.special):
            return [fragment]
        a = np.frombuffer(fragment, np.uint8)
        letter = ((a | 32) >= 97) & ((a | 32) <= 122)
        at = np.flatnonzero(self.forced[a[:-1], a[1:]] & letter[:-1] & letter[1:]) + 1
        edges = [0, *at.tolist(), len(fragment)]
        return [fragment[i:j] for i, j in zip(edges, edges[1:])]

    def _fragment(self, fragment: bytes) -> tuple[bytes, bytes]:
        if found := self.older.get(fragment):
            return self._remember(fragment, found)
        core = fragment.rstrip(b".,")
        if core != fragment and core[-1:].isalpha() and self.forced[core[-1], fragment[len(core)]]:
            # A forced pair where the pre-tokenizer splits too: the word and its stop are known apart.
            tail = fragment[len(core) :]
            a, b = self.memory.get(core) or self._fragment(core), self.memory.get(tail) or self._fragment(tail)
            return self._remember(fragment, (a[0] + b[0], a[1] + b[1]))
        ids = [i for part in self._inner(fragment) for i in self.tokenizer.encode(part.decode(), add_special_tokens=False).ids]
        return self._remember(fragment, ("".join(f"{i}," for i in ids).encode(), np.array(ids, np.uint32).tobytes()))

    def _remember(self, fragment: bytes, found: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        if len(fragment) <= LONGEST:
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[fragment] = found
        return found

    def parts(self, text: bytes) -> list[tuple[bytes, bytes]]:
        """For each fragment its ids as decimal text (a comma after each) and as 32-bit numbers."""
        learn = self._fragment
        return [self.memory.get(f) or learn(f) for f in self.fragments(text)]

    def encode(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join([p[1] for p in self.parts(text)]), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids).astype(np.int64)
        n = self.length[ids]
        total, ends = int(n.sum()), np.cumsum(n)
        at = np.repeat(self.at[ids] - (ends - n), n) + np.arange(total)
        return self.blob[at].tobytes().decode("utf-8", errors="replace")


_codecs: dict[int, ForcedBoundaryCodec] = {}


def codec(spec: str) -> ForcedBoundaryCodec:
    """One codec a worker and vocabulary."""
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = ForcedBoundaryCodec(spec)
    return _codecs[key]


def _spec(spark, path: str):
    """The vocabulary file, a few MB and fixed in size, sent to each executor once; no executor needs the driver's path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    spec = _spec(docs.sparkSession, vocabulary)
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        c = codec(spec.value)
        for b in batches:
            ids = [c.encode(t or b"").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to empty text, ids outside the vocabulary to nothing."""
    spec = _spec(encoded.sparkSession, vocabulary)
    small_batches(encoded.sparkSession)
    given = encoded.select("doc_id", "ids")

    def run(batches):
        c = codec(spec.value)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                a = np.array([i for i in ids or () if i is not None], np.int64)
                texts.append(c.decode(a[(a >= 0) & (a < len(c.length))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what it encoded, and gives digests instead of arrays."""
    spec = _spec(docs.sparkSession, vocabulary)
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        c = codec(spec.value)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                parts = c.parts(t or b"")
                ids = np.frombuffer(b"".join([p[1] for p in parts]), np.uint32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join([p[0] for p in parts])[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
