"""Byte-level BPE encoding and decoding over tiktoken with a local rank file."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches

_ENCODINGS: dict = {}
#: A match of the pattern never runs on from a non-space into white space, so a text may be cut there.
SAFE_CUT = r"(?<=\P{White_Space})(?=\p{White_Space})"
#: A run of white space before other characters is one match up to its last character; at a text's end it is one as a whole.
LONG_BLANK = r"\p{White_Space}{%d,}"


def encoding(path: str, pattern: str):
    """One tiktoken encoding per worker and rank file."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def safe_pieces(text: str, size: int):
    """Cut a long text at safe boundaries: (piece, whether it is one match of white space).

    Pieces have `size` characters or, where there is no boundary, more. Runs of
    white space of that length come apart, as the pattern's look-ahead would
    take a stack as deep as they are long.
    """
    import regex

    blank, at = regex.compile(LONG_BLANK % max(2, size)), 0
    for run in blank.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((x, False) for x in cut_pieces(text[at : run.start()], size))
        yield text[run.start() : end], True
        at = end
    yield from ((x, False) for x in cut_pieces(text[at:], size))


def cut_pieces(text: str, size: int):
    import regex

    cut, at = regex.compile(SAFE_CUT), 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


def encode_text(enc, text: str, size: int = 1 << 16) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, blank in safe_pieces(text, size):
        ids += enc._encode_single_piece(piece) if blank else enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, piece_chars: int = 1 << 16) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null or empty text gives an empty array.

    Each row is taken alone: repeated rows and null ids come back as they are,
    other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode_text(enc, t or "", piece_chars) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids): raw bytes, so ids that cut a character decode too. Null ids decode to nothing."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, piece_chars: int = 1 << 16) -> DataFrame:
    """Encode, decode and digest each row in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            n, one, two = [], [], []
            for text in b.column("text").to_pylist():
                ids = encode_text(enc, text or "", piece_chars)
                n.append(len(ids))
                one.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
