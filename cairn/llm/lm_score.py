"""Cross-entropy difference of matched n-gram models.

Two interpolated bigram models, one of the target texts and one of all texts,
have the same order, smoothing and vocabulary. Words and bigrams are 64-bit
hashes and their counts exact, in tables that grow with the corpus and lie in
no one place: texts are taken in chunks, a chunk asks for each of its different
words and bigrams once, in the bucket of the key's range, a bucket adds up what
its chunks have of a key and answers each of them, and the answers meet the
chunk's texts again. A key takes one entry a chunk, however common it is. The
score of a document is the mean over its tokens of background loss less target
loss (in nats): above 0 the target model predicts it better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import give_back, long_bytes, materialize, mix64, pair64, small_batches
from cairn.llm.jaccard_join import word_hashes

START = np.uint64(0x5354415254)
WORD, PAIR = 0, 1
ASKED = "chunk long, kind int, bucket int, keys binary, counts binary"
ANSWERED = "chunk long, kind int, bucket int, counts binary, words long, tokens long, target_tokens long"


def grams(table: pa.Table, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of its bigram with the token before (START at a start), and the documents' first tokens.

    Texts are taken some at a time, of about `most` bytes, as hashing takes many times what it is given.
    """
    buf, offsets = long_bytes(table.column("text"))
    at = np.unique(np.concatenate([[0], np.searchsorted(offsets, np.arange(most, offsets[-1], most)), [len(offsets) - 1]]))
    hashes, counts = [], []
    for i, j in zip(at[:-1], at[1:], strict=True):
        found, starts = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(found)
        counts.append(np.diff(starts))
    hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts[:-1][np.diff(starts) > 0]] = START
    pair = pair64(before, hashes)
    del before
    return hashes, mix64(pair), starts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and where each key is among them: np.unique in half its memory, for less than 2^31 keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    names = ordered[new]
    del ordered
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return names, where


def vocabulary_of(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's different words and START, sorted; where each token is among them, and where the one before it is."""
    words, as_token = distinct(hashes)
    as_history = np.empty_like(as_token)
    if not len(hashes):
        return words, as_token, as_history
    k = int(np.searchsorted(words, START))
    if k == len(words) or words[k] != START:
        words = np.insert(words, k, START)
        as_token[as_token >= k] += 1
    as_history[1:] = as_token[:-1]
    as_history[starts[:-1][np.diff(starts) > 0]] = k
    return words, as_token, as_history


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted keys begins (buckets+1 numbers)."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def planes(x: np.ndarray) -> bytes:
    """Integers byte place by byte place: high places are mostly 0, which written and shuffled files compress."""
    return x.reshape(-1, 1).view(np.uint8).T.tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(width, -1).T.copy().view(f"u{width}").reshape(-1)


def packed(*counts: np.ndarray) -> bytes:
    """Columns of counts in the narrowest integers that hold them."""
    kind = np.min_scalar_type(max((int(c.max()) for c in counts if len(c)), default=0))
    return bytes([kind.itemsize]) + planes(np.concatenate(counts).astype(kind))


def unpacked(blob: bytes, columns: int) -> np.ndarray:
    return unplanes(blob[1:], blob[0]).reshape(columns, -1)


def ask(table: pa.Table, is_target: np.ndarray, chunk: int, pair_buckets: int, word_buckets: int) -> pa.Table:
    """A chunk's keys by kind and bucket, as differences of sorted ones, with its own counts of them.

    Counts of words are as tokens and as histories, those of bigrams one; each in all texts and in target texts.
    """
    hashes, pair, starts = grams(table)
    mine = np.repeat(is_target, np.diff(starts))
    words, as_token, as_history = vocabulary_of(hashes, starts)
    del hashes
    counted = [np.bincount(x, minlength=len(words)) for x in (as_token, as_token[mine], as_history, as_history[mine])]
    out: list[tuple[int, int, bytes, bytes]] = asked(WORD, words, counted, word_buckets)
    del words, as_token, as_history, counted
    pairs, where = distinct(pair)
    del pair
    out += asked(PAIR, pairs, [np.bincount(x, minlength=len(pairs)) for x in (where, where[mine])], pair_buckets)
    kinds, buckets, keys, counts = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"chunk": pa.array(np.full(len(out), chunk, np.int64)), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def asked(kind: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    at = cuts(keys, buckets)
    return [(kind, int(b), planes(np.diff(keys[at[b] : at[b + 1]], prepend=np.uint64(0))), packed(*(c[at[b] : at[b + 1]] for c in counts))) for b in np.flatnonzero(np.diff(at))]


def answer(key, table):
    """A bucket's counts over all chunks, for each chunk in the order of its keys; and, with a null chunk, what the bucket holds in all."""
    kind, bucket = key[0].as_py(), key[1].as_py()
    columns = 4 if kind == WORD else 2
    keys = [np.cumsum(unplanes(b.as_py(), 8), dtype=np.uint64) for b in table.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    names, where = distinct(keys)
    del keys
    own = np.concatenate([unpacked(b.as_py(), columns) for b in table.column("counts")], axis=1)
    sums = [np.bincount(where, c, len(names)).astype(np.int64) for c in own]  # exact below 2^53
    del own
    out = [packed(*(s[w] for s in sums)) for w in np.split(where, ends[:-1])]
    m = len(out) + 1
    whole = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())] if kind == WORD else [0, 0, 0]
    result = pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "kind": pa.array(np.full(m, kind, np.int32)), "bucket": pa.array(np.full(m, bucket, np.int32)), "counts": pa.array([*out, None], pa.binary()),
        **{c: pa.array([*[None] * len(out), x], pa.int64()) for c, x in zip(("words", "tokens", "target_tokens"), whole, strict=True)},
    })
    give_back()
    return result


def losses(single: np.ndarray, history: np.ndarray, pair: np.ndarray, tokens: int, vocabulary: int, weight: float) -> np.ndarray:
    """-log P(w | v) = -log of weight * c(v, w) / c(v) + (1 - weight) * (c(w) + 1) / (N + V); the second part alone where c(v) is 0."""
    one = (single + 1) / (tokens + vocabulary)
    w = np.where(history > 0, weight, 0.0)
    return -np.log(w * (pair / np.maximum(history, 1)) + (1 - w) * one)


def means(tokens: int, starts: np.ndarray, of, most: int = 1 << 17) -> np.ndarray:
    """Each document's mean of of(a, b), the losses of tokens a to b, which are taken `most` at a time."""
    sofar = np.zeros(tokens + 1)
    for a in range(0, tokens, most):
        sofar[a + 1 : min(a + most, tokens) + 1] = of(a, min(a + most, tokens))
    np.cumsum(sofar, out=sofar)
    return (sofar[starts[1:]] - sofar[starts[:-1]]) / np.maximum(np.diff(starts), 1)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, words: int = 1 << 18, weight: float = 0.6, chunk: int = 8 << 20, bucket: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, score.

    Both models' vocabulary is that of all texts; smoothing takes it to have
    `words` words where it has fewer. Losses are means over tokens; texts
    without words (null and empty ones) have 0 tokens and 0 for the rest.
    Repeated rows count and come back each time; null ids are background. Other
    columns are ignored; an empty table gives an empty result, and with no
    target text both models are still defined (the target model is then
    uniform). `chunk` and `bucket` are bytes of text; rows that repeat an id
    share a chunk.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_buckets, word_buckets = 1 + size // bucket, 1 + size // (8 * bucket)
    # A chunk is a hash of the id (of the text without one): the same rows in every use, and target ids find theirs.
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 + size // chunk)).alias("chunk")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    texts = rows.select(F.when(F.col("doc_id").isNull(), of("text")).otherwise(of("doc_id")).alias("chunk"), "doc_id", "text")
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()

    def collect(key, rows, ids):
        if not rows.num_rows:  # of ids without a text
            return ask(pa.table({"text": pa.array([], pa.string())}), np.zeros(0, bool), -1, 1, 1)
        is_target = np.asarray(pc.is_in(rows.column("doc_id"), value_set=ids.column("doc_id").combine_chunks(), skip_nulls=True)) if ids.num_rows else np.zeros(rows.num_rows, bool)
        out = ask(rows, is_target, key[0].as_py(), pair_buckets, word_buckets)
        give_back()
        return out

    keys = texts.groupBy("chunk").cogroup(ids.select(of("doc_id"), "doc_id").groupBy("chunk")).applyInArrow(collect, ASKED)
    answers = materialize(keys.groupBy("kind", "bucket").applyInArrow(answer, ANSWERED), "lm_answers")
    del keys
    whole = answers.filter("chunk is null").agg(F.sum("words"), F.sum("tokens"), F.sum("target_tokens")).first()
    found, tokens, target_tokens = (x or 0 for x in whole)
    vocabulary = max(words, found)

    def run(texts, told):
        hashes, pair, starts = grams(texts)
        n = np.diff(starts)
        sums = [np.zeros(len(n)), np.zeros(len(n))]
        if len(hashes):
            n_tokens = len(hashes)
            _, w, v = vocabulary_of(hashes, starts)
            del hashes
            p = distinct(pair)[1]
            del pair
            # Chunks ask in the order of their sorted keys, so buckets' answers end to end belong to those.
            blobs = sorted(zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), told.column("counts").to_pylist(), strict=True))
            singles, singles_t, histories, histories_t = np.concatenate([unpacked(b, 4) for k, _, b in blobs if k == WORD], axis=1).astype(np.int64)
            pairs, pairs_t = np.concatenate([unpacked(b, 2) for k, _, b in blobs if k == PAIR], axis=1)
            del blobs
            for k, (s, h, b, total) in enumerate(((singles_t, histories_t, pairs_t, target_tokens), (singles, histories, pairs, tokens))):
                sums[k] = means(n_tokens, starts, lambda i, j: losses(s[w[i:j]], h[v[i:j]], b[p[i:j]].astype(np.int64), total, vocabulary, weight))  # noqa: B023
        out = pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(sums[0]), "background_loss": pa.array(sums[1]), "score": pa.array(sums[1] - sums[0])})
        give_back()
        return out

    told = answers.filter("chunk is not null").select("chunk", "kind", "bucket", "counts")
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
