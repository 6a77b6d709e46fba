"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed when a string of `length` bytes over it also starts earlier
(in a document with a smaller id, or earlier in the same one). As in a
bucket-pointer refining suffix sorter, window starts lie in buckets of equal
q-grams first; a bucket is refined by what follows at later offsets, under the
identifier that the last round gave it; and only starts whose bucket is not yet
settled go on to the next round:

1. of the q-grams in each window of `length` bytes the one with the smallest
   identifier is the window's anchor: its first bucket. Identifiers of q and of
   `length` bytes are made by doubling: that of 2h bytes at i from those of h
   bytes at i and i+h. Windows in a row with one anchor are a region; equal
   windows have equal anchors at equal offsets;
2. buckets that are single in the whole corpus are settled;
3. so are regions met before as a whole; buckets that hold different regions go on;
4. a round deals the windows of each region that goes on by their offset from
   the anchor into nodes. All windows of a node share a core, the bytes that
   each of them covers, longer than the round's before. A node's new bucket is
   its old bucket's identifier with the core's bytes. Nodes with equal bytes
   settle at their first place; buckets that still hold different bytes go on
   with one place for each, under the new identifier and in smaller nodes, down
   to nodes of one window, whose core is the window itself.

Rounds compare bytes, not digests. Every step combines within a task first and
takes firsts by partial aggregates, so a string in a third of all documents is a
few rows for each task, and no bucket has to fit into one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import chunks, discard, long_bytes, materialize, mix64, pair64, small_batches, unique_docs

BLOCK = 1 << 20
_BYTE = mix64(np.arange(256, dtype=np.uint64))


def identifiers(buf: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of q and 4q bytes at each position where so many follow, doubled up level by level."""
    level, h = _BYTE[buf], 1
    while h * 2 <= q:
        level, h = pair64(level[:-h], level[h:]), h * 2
    if h < q:
        level = pair64(level[: len(level) - (q - h)], level[q - h :])
    first = level
    for step in (q, 2 * q):
        level = pair64(level[:-step], level[step:])
    return first, level


def sliding_argmin(ids: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest identifier (leftmost of equal ones) in each run of `width`; under 2**24 positions."""
    low = np.uint64((1 << 24) - 1)
    key = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
    h = 1
    while h * 2 <= width:
        key, h = np.minimum(key[:-h], key[h:]), h * 2
    if h < width:
        key = np.minimum(key[: len(key) - (width - h)], key[width - h :])
    return (key & low).astype(np.int64)


def blocks(offsets: np.ndarray, length: int):
    """Pieces (start, end) of a byte buffer with whole documents where they fit into a block; longer ones overlap by length-1."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = int(np.searchsorted(offsets, offsets[d] + BLOCK, side="right")) - 1
        if e > d:
            yield int(offsets[d]), int(offsets[e])
            d = e
        else:
            at, end = int(offsets[d]), int(offsets[d + 1])
            while at + length <= end:
                yield at, min(at + BLOCK + length - 1, end)
                at += BLOCK
            d += 1


def regions(buf: np.ndarray, offsets: np.ndarray, q: int) -> dict[str, np.ndarray]:
    """doc (row), a, b (first and last window start within the document), place of the anchor behind a, anchor and region identifiers."""
    length, out = 4 * q, []
    for lo, hi in blocks(offsets, length):
        if hi - lo < length:
            continue
        first, whole = identifiers(buf[lo:hi], q)
        at = sliding_argmin(first, length - q + 1)
        n = len(whole)
        starts = np.arange(lo, lo + n)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        ok = starts + length <= offsets[doc + 1]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
        a = np.flatnonzero(new & ok)
        if not len(a):
            continue
        last = np.ones(n, bool)
        last[:-1] = new[1:] | ~ok[1:]
        b = np.flatnonzero(last & ok)
        p = at[a]
        span = (p - a).astype(np.uint64) << np.uint64(32) | (b - p + length).astype(np.uint64)
        region = mix64(pair64(pair64(whole[a], whole[b]), span))
        out.append((doc[a], starts[a] - offsets[doc[a]], starts[b] - offsets[doc[a]], p - a, first[p], region))
    parts = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0, np.uint64)]] * 2
    return dict(zip(("doc", "a", "b", "hi", "anchor", "region"), (np.concatenate(x) for x in parts), strict=True))


def local_first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Mask of the first row (by order) of each key."""
    by = np.lexsort((order, *keys))
    same = np.ones(len(by), bool)
    for k in keys:
        s = k[by]
        same[1:] &= s[1:] == s[:-1]
    if len(same):
        same[0] = False
    out = np.empty(len(by), bool)
    out[by] = ~same
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each document as one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    base = doc.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - base)[np.append(at[1:], len(doc)) - 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _by_id(table) -> tuple[np.ndarray, pa.Table]:
    """The chunk's rows in order of doc_id: rows then stand for document order."""
    table = table.sort_by("doc_id")
    return np.asarray(table.column("doc_id").combine_chunks()).astype(np.int64), table


def widths(offsets: int) -> list[int]:
    """Offsets in a node of each round, down to one."""
    out, w = [], offsets
    while w > 1:
        w = -(-w // (4 if out else 2))
        out.append(w)
    return out or [1]


def _earlier(doc_id: str, s: str):
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(s).alias("s"))


def _smaller_nodes(rows: DataFrame, width: int, nodes: int, length: int) -> DataFrame:
    """rows (bucket, x, y, hi, raw, doc_id, s, core) in nodes of `width` offsets, under the identifier of bucket and core."""
    low = F.col("hi") - (F.length("raw") - length)
    parts = []
    for k in range(nodes):
        x = F.col("x") + k * width
        y = F.least(F.col("y"), x + width)
        top, bottom = F.least(y - 1, F.col("hi")), F.greatest(x, low)
        raw = F.substring("raw", F.col("hi") - top + 1, top - bottom + length)
        parts.append(F.struct(x.alias("x"), y.alias("y"), top.alias("hi"), F.when(top >= bottom, raw).alias("raw"), (F.col("s") + F.col("hi") - top).alias("s")))
    bucket = F.xxhash64("bucket", "x", "core").alias("bucket")
    return rows.select(bucket, "doc_id", F.explode(F.filter(F.array(*parts), lambda n: n["raw"].isNotNull())).alias("n")).select("bucket", "n.x", "n.y", "n.hi", "n.raw", "doc_id", "n.s")


def refined(rows: DataFrame, sizes: list[int], length: int) -> list[DataFrame]:
    """Rounds of refinement over (bucket, x, y, hi, raw, doc_id, s); returns the (doc_id, s, e) of windows met before.

    A row stands for the windows with offsets down from hi to hi - len(raw) +
    length, in the node of offsets x to y-1; raw is what they cover and s where
    that starts.
    """
    found, content = [], ["bucket", "x", "y", "hi", "raw"]
    for k in range(len(sizes)):
        firsts = materialize(rows.groupBy(*content).agg(F.min(_earlier("doc_id", "s")).alias("first"), F.count(F.lit(1)).alias("n")), f"contents{k}")
        copies = firsts.filter("n > 1").select(*content, "first")
        late = rows.join(copies, content).filter(_earlier("doc_id", "s") > F.col("first"))
        found.append(materialize(late.select("doc_id", "s", (F.col("s") + F.length("raw")).cast("int").alias("e")), f"late{k}"))
        discard(rows)
        if k + 1 == len(sizes):  # a node of one window: its core is all of it
            discard(firsts)
            break
        core = F.substring("raw", F.col("hi") - F.col("x") + 1, F.lit(length + 1) - F.col("y") + F.col("x"))
        cored = firsts.withColumn("core", core)
        mixed = materialize(cored.groupBy("bucket", "x", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds"), f"mixed{k}")
        left = cored.join(mixed, ["bucket", "x", "core"]).select("bucket", "x", "y", "hi", "raw", "core", "first.doc_id", "first.s")
        rows = materialize(_smaller_nodes(left, sizes[k + 1], -(-sizes[k] // sizes[k + 1]), length), f"nodes{k}")
        discard(firsts, mixed)
        if rows.limit(1).isEmpty():
            discard(rows)
            break
    return found


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, s, e): byte spans to remove, for documents with unique non-null ids; spans may overlap."""
    if length % 4:
        raise ValueError("length must be a multiple of 4: identifiers double from a quarter of it")
    q = length // 4
    sizes = widths(length - q + 1)
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")

    def buckets(batches):
        for table in chunks(batches):
            _, table = _by_id(table)
            r = regions(*long_bytes(table.column("text")), q)
            keep = local_first(r["doc"], r["anchor"], r["region"])
            anchors, n = np.unique(r["anchor"][keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(anchors), pa.array(n, pa.int32())], ["anchor", "n"])

    several = texts.mapInArrow(buckets, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    several = materialize(several.select(F.col("anchor").alias("bucket")), "buckets")

    def places(batches):
        for table in chunks(batches):
            ids, table = _by_id(table)
            r = regions(*long_bytes(table.column("text")), q)
            keep = local_first(r["doc"], r["anchor"], r["region"])
            d, s, e = merged(r["doc"][~keep], r["a"][~keep], r["b"][~keep] + length)
            # Spans found within the chunk travel along, each under a key of its own and without an anchor.
            key = mix64(pair64(ids[d].view(np.uint64), s.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([r["anchor"][keep], key])),
                    _signed(np.concatenate([r["region"][keep], np.zeros(len(d), np.uint64)])),
                    pa.array(np.concatenate([ids[r["doc"][keep]], ids[d]]), pa.int64()),
                    pa.array(np.concatenate([r["a"][keep], s]), pa.int32()),
                    pa.array(np.concatenate([r["b"][keep] + length, e]), pa.int32()),
                    pa.array(np.concatenate([r["hi"][keep], np.full(len(d), -1)]), pa.int32()),
                ],
                ["anchor", "region", "doc_id", "s", "e", "hi"],
            )

    rows = texts.mapInArrow(places, "anchor long, region long, doc_id long, s int, e int, hi int")
    rows = rows.join(several, F.col("anchor") == F.col("bucket"), "left").filter("hi < 0 or bucket is not null").drop("bucket")
    rows = materialize(rows, "regions")
    discard(several)
    held = rows.filter("hi >= 0")
    firsts = materialize(held.groupBy("anchor", "region").agg(F.min("doc_id").alias("first_doc")), "firsts")
    met = held.join(firsts, ["anchor", "region"])
    spans = ["doc_id", "s", "e"]
    found = [materialize(met.filter("doc_id > first_doc").select(*spans).unionByName(rows.filter("hi < 0").select(*spans)), "again")]
    # Buckets with different regions go on, with each region's first place.
    mixed = materialize(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "mixed")
    alone = met.filter("doc_id = first_doc").select("anchor", "doc_id", "s", "e", "hi")
    goes_on = materialize(alone.join(mixed, "anchor"), "open")
    discard(rows, firsts, mixed)
    by_doc = goes_on.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "s", "e", "hi")).alias("open"))  # a document's own regions
    width = sizes[0]

    def take(batches):
        for table in chunks(batches):
            lists = table.column("open").combine_chunks()
            counts = np.diff(np.asarray(lists.offsets))
            doc = np.repeat(np.asarray(table.column("doc_id")), counts)
            anchor, s, e, hi = (np.asarray(lists.flatten().field(k)) for k in range(4))
            buf, offsets = long_bytes(table.column("text"))
            base = np.repeat(offsets[:-1], counts)
            low, raw = hi - (e - s - length), memoryview(buf)
            for x in range(0, length - q + 1, width):
                y = min(x + width, length - q + 1)
                top, bottom = np.minimum(y - 1, hi), np.maximum(x, low)
                k = np.flatnonzero(top >= bottom)
                at, n = s[k] + hi[k] - top[k], top[k] - bottom[k] + length
                from_ = base[k] + at
                parts = [raw[i:j] for i, j in zip(from_.tolist(), (from_ + n).tolist(), strict=True)]
                fixed = [pa.array(np.full(len(k), v), pa.int32()) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k], pa.int64()), *fixed, pa.array(top[k], pa.int32()), pa.array(parts, pa.binary()), pa.array(doc[k], pa.int64()), pa.array(at, pa.int32())], ["bucket", "x", "y", "hi", "raw", "doc_id", "s"])

    nodes = texts.join(by_doc, "doc_id").mapInArrow(take, "bucket long, x int, y int, hi int, raw binary, doc_id long, s int")
    nodes = materialize(nodes, "nodes")
    discard(goes_on)
    found += refined(nodes, sizes, length)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def cut(raw: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the bytes that stay."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return [(s, e) for s, e in runs], b"".join(kept)


def suffix_dedup(docs: DataFrame, length: int = 100, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans array<struct<s,e>> (maximal removed runs), kept (bytes that stay).

    Null text counts as empty. Rows with a null doc_id take no part and give no
    row; rows that repeat a doc_id count once (see unique_docs). Texts of under
    `length` bytes keep everything. Of equal strings the one that starts first
    stays, so ties cannot occur. Other columns are ignored. decoded gives kept as
    text, without parts of characters at cut edges.
    """
    texts = unique_docs(docs)
    kind = "string" if decoded else "binary"
    spans = repeated_spans(texts, length).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # a document's own
    joined = texts.join(spans, "doc_id", "left")

    def run(batches):
        for b in batches:
            n, runs, kept = [], [], []
            for text, spans_ in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                cuts, stays = cut(raw, [(x["s"], x["e"]) for x in spans_ or ()])
                n.append(len(raw))
                runs.append([{"s": s, "e": e} for s, e in cuts])
                kept.append(kept_text(stays) if decoded else stays)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.string() if decoded else pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept " + kind)


def digests(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of suffix_dedup's rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]).cast("long"))
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def kept_text(kept: bytes) -> str:
    """Text of the bytes that stay; parts of characters at cut edges are left out."""
    return kept.decode("utf-8", "ignore")


