"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles; equal sets are one class. Each set is embedded
as a vector of MinHash values, whose equal coordinates are tokens that two sets
share. A run starts at the root and, at each node, samples `width` coordinates;
sets go to the child of each sampled token. Nodes of at most `small` sets are
brute-forced with the full shingle sets; larger ones are split on, except where
a child keeps most of its parent (`dense`): splitting does not part those sets,
and the node is brute-forced. Nodes beyond a cell's bounds in sets or shingles
are brute-forced in cells: each cell is compared within itself and packed into
one row, and packed cells meet in pairs, so a node gives a row for each member
and one for each pair of cells. Members of a leaf of one cell whose vectors agree with no other's are left out before
that. The chance that a run parts two sets
at the threshold bounds the recall; runs are added until the target is reached.

A pair that meets in several leaves is counted in the smallest of them, so
link counts are exact over all that is found; leaves give spanning edges only,
never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import C1, C2, chunks, discard, give_back, long_bytes, materialize, mix64, pair64, small_batches, unique_docs

#: Fixed byte classes: ASCII letters and digits and all bytes beyond ASCII belong to words; A-Z count as a-z.
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(7777))[_LOWER]
_BASE = 0x5851F42D4C957F2D


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie end to end in buf, and each text's first word (n+1 numbers)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    longest = int((e - s).max()) if len(s) else 0
    # A polynomial over each word's bytes, by byte place: as many steps as the longest word has bytes, on ever fewer words.
    h, live = np.zeros(len(s), np.uint64), np.arange(len(s))
    size = e - s
    if longest > 256:  # a few very long words: prefix sums instead
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]))
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * power[:n])])
        h = (total[e] - total[s]) * back[s]
    else:
        factor = 1
        for k in range(longest):
            live = live[size[live] > k]
            h[live] += _BYTE[buf[s[live] + k]] * np.uint64(factor)
            factor = factor * _BASE % (1 << 64)
    return mix64(h + size.astype(np.uint64) * C1), np.searchsorted(s, offsets, side="left")


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and each text's first; a shorter text with words has one shingle of all of them."""
    counts = np.diff(starts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = padded[: len(words)].copy()
    for k in range(1, n):
        out = pair64(out, padded[k : k + len(words)])
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - starts[doc]
    ok = place <= counts[doc] - n
    short = np.flatnonzero((counts > 0) & (counts < n))
    for d in short:
        value = np.uint64(counts[d])
        for w in words[starts[d] : starts[d + 1]]:
            value = pair64(np.array([value]), np.array([w]))[0]
        out[starts[d]] = value
        ok[starts[d]] = True
    hashes, doc = mix64(out[ok]), doc[ok]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1))


def token_sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of each text end to end, and the n+1 bounds."""
    found, starts = shingles(*word_hashes(*long_bytes(table.column("text"))), n)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    by = np.lexsort((found, doc))
    found, doc = found[by], doc[by]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(starts)))


def survival(threshold: float, width: int, depth: int) -> float:
    """Chance that two sets at the threshold share a leaf of one run `depth` levels down: all nodes of a level sample the same coordinates."""
    return (1 - (1 - threshold) ** width) ** depth


def least_for(threshold: float, coordinates: int, miss: float) -> int:
    """Most equal coordinates that can be asked for: two sets at the threshold have fewer with a chance of at most `miss`."""
    below = 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * threshold**m * (1 - threshold) ** (coordinates - m)
        if below > miss:
            return m
    return coordinates


def place_of(run, level, k, width: int, depth: int):
    """Coordinate that a run samples at a level: none is sampled twice, so levels and runs are independent."""
    return (run * depth + level) * width + k


def runs_for(target: float, threshold: float, width: int, depth: int) -> int:
    p = survival(threshold, width, depth)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - p)))


def signatures(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """(doc_id, size, set_a, set_b, sketch): number of shingles, a 128-bit digest of the set and its MinHash vector."""
    small_batches(docs.sparkSession)
    seeds = mix64(np.arange(coordinates, dtype=np.uint64) + np.uint64(99))
    factors = mix64(np.arange(coordinates, dtype=np.uint64) + np.uint64(3333)) | np.uint64(1)

    def run(batches):
        for table in chunks(batches, 4 << 20):
            found, starts = token_sets(table, n)
            size = np.diff(starts)
            full = size > 0
            one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            sketch = np.zeros((len(size), coordinates), np.uint64)
            if full.any():
                at = starts[:-1][full]
                one[full] = np.add.reduceat(mix64(found), at)
                two[full] = np.add.reduceat(mix64(found ^ C2), at)
                for c in range(coordinates):
                    sketch[full, c] = np.minimum.reduceat((found ^ seeds[c]) * factors[c] ^ (found >> np.uint64(29)), at)
            flat = pa.array(sketch.reshape(-1).view(np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * coordinates, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(size, pa.int32()), pa.array(one.view(np.int64), pa.int64()), pa.array(two.view(np.int64), pa.int64()), lists], ["doc_id", "size", "set_a", "set_b", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size int, set_a long, set_b long, sketch array<long>")


def _children(rows: DataFrame, level: int, width: int, depth: int) -> DataFrame:
    """The nodes below: rows of (rep, run, node, sketch) go to the child of each coordinate sampled for (run, level)."""
    kids = []
    for k in range(width):
        place = place_of(F.col("run"), level, k, width, depth)
        kids.append(F.struct(place.cast("int").alias("c"), F.element_at("sketch", (place + 1).cast("int")).alias("v")))
    rows = rows.withColumn("kid", F.explode(F.array(*kids)))
    return rows.select("rep", "run", F.col("node").alias("parent"), F.xxhash64("node", "run", F.lit(level), "kid.c", "kid.v").alias("node"))


def leaves(reps: DataFrame, runs: int, small: int, dense: float, width: int, depth: int) -> DataFrame:
    """(leaf, rep) of all runs, each set of members once."""
    sketches = reps.select("rep", "sketch")
    frontier = sketches.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(runs)]))).withColumn("node", F.lit(0).cast("long"))
    found: list[DataFrame] = []
    above: DataFrame | None = None
    for level in range(depth):
        rows = materialize(_children(frontier, level, width, depth), f"level{level}")
        sizes = materialize(rows.groupBy("node", "parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"sizes{level}")
        if above is not None:
            # Parents of which a child keeps most are dense: the parent is a leaf and its children are dropped.
            thick = sizes.join(above.select(F.col("node").alias("parent"), F.col("n").alias("was")), "parent").filter(F.col("n") >= dense * F.col("was")).select("parent").distinct()
            thick = materialize(thick, f"dense{level}")
            found.append(above_rows.join(thick.withColumnRenamed("parent", "node"), "node", "left_semi").select(F.col("node").alias("leaf"), "rep"))
            sizes = sizes.join(thick, "parent", "left_anti")
        last = level == depth - 1
        done = sizes if last else sizes.filter(F.col("n") <= small)
        found.append(rows.join(done.select("node"), "node", "left_semi").select(F.col("node").alias("leaf"), "rep"))
        if last:
            break
        big = materialize(sizes.filter(F.col("n") > small).select("node", "n"), f"big{level}")
        if big.limit(1).isEmpty():
            break
        above, above_rows = big, rows.join(big.select("node"), "node", "left_semi").select("rep", "run", "node")
        frontier = above_rows.join(sketches, "rep")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return once(materialize(every, "leaves"), "members")


def once(every: DataFrame, name: str) -> DataFrame:
    """(leaf, rep, n): leaves of two members or more, and of those with the same members one."""
    same = every.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 31)).alias("s"))
    first = same.filter("n > 1").groupBy("n", "x", "s").agg(F.min("leaf").alias("leaf")).select("leaf", "n")
    return materialize(every.join(first, "leaf"), name)


def sifted(members: DataFrame, sketches: DataFrame, least: int, cell: int) -> DataFrame:
    """(leaf, rep): members whose MinHash vector agrees with another's of the leaf in at least `least` coordinates.

    Leaves of more than a cell pass whole: as good as all of their members agree with some other.
    """

    def sift(key, table):
        m = _matrix_of(table.column("sketch"))
        equal = np.zeros((len(m), len(m)), np.uint16)
        for c in range(m.shape[1]):
            equal += m[:, c][:, None] == m[:, c][None, :]
        near = equal >= least
        np.fill_diagonal(near, False)
        keep = np.asarray(table.column("rep"))[near.any(axis=1)]
        return pa.table({"leaf": pa.array(np.full(len(keep), key[0].as_py()), pa.int64()), "rep": pa.array(keep, pa.int64())})

    small = members.filter(F.col("n") <= cell).select("leaf", "rep").join(sketches, "rep")
    return small.groupBy("leaf").applyInArrow(sift, "leaf long, rep long").unionByName(members.filter(F.col("n") > cell).select("leaf", "rep"))


def _matrix_of(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def shared_counts(sets: list[np.ndarray], split: int, columns: int = 4096, at_once: int = 1 << 20) -> np.ndarray:
    """How many values each two sorted sets share: of all sets, or of those before `split` with those behind.

    Values are hashes, taken a range of about `at_once` at a time: memory does not follow the sets' sizes.
    """
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = np.zeros((len(sets[left]), len(sets[right])), np.float32)
    kind = np.iinfo(sets[0].dtype)
    ranges = 1 + sum(map(len, sets)) // at_once
    edges = np.array([kind.min + (k << 64) // ranges for k in range(1, ranges)], kind.dtype)
    cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in sets]
    for k in range(ranges):
        parts = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in parts])
        _, col, df = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        use = df[col] > 1
        row, col = row[use], col[use]
        names, col = np.unique(col, return_inverse=True)
        for at in range(0, len(names), columns):
            inside = (col >= at) & (col < at + columns)
            m = np.zeros((len(sets), min(columns, len(names) - at)), np.float32)
            m[row[inside], col[inside] - at] = 1
            both += m[left] @ m[right].T
    return both


def links_in(tokens: list[np.ndarray], sizes: np.ndarray, split: int, threshold: float) -> np.ndarray:
    """Which sets are at the threshold or over: of all of them, or of those before `split` with those behind."""
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = shared_counts(tokens, split)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-6


def components(links: np.ndarray) -> np.ndarray:
    """Smallest row that each row of a symmetric link matrix is connected to."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(axis=1) if len(links) else label
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(leaf: int, tables: list[pa.Table], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of one cell (rep, leaves, weight, tokens) within itself, or of two cells against each other."""
    order = [np.argsort(np.asarray(t.column("rep"))) for t in tables]
    reps = np.concatenate([np.asarray(t.column("rep"))[by] for t, by in zip(tables, order, strict=True)])
    weight = np.concatenate([np.asarray(t.column("weight"))[by] for t, by in zip(tables, order, strict=True)]).astype(np.float64)
    tokens, lists = ([x for t, by in zip(tables, order, strict=True) for x in _lists(t.column(c), by)] for c in ("tokens", "leaves"))
    tokens = [x.view(np.uint64) for x in tokens]
    sizes = np.array([len(t) for t in tokens], np.float32)
    split = len(order[0]) if len(tables) > 1 else 0
    near = links_in(tokens, sizes, split, threshold)
    if sizes.sum() > 1 << 19:
        del tokens
        give_back()
    # A pair counts here unless it also meets in a smaller leaf.
    mine = near & ~(shared_counts([x[: np.searchsorted(x, leaf)] for x in lists], split) > 0)
    if split:
        links = np.concatenate([mine @ weight[split:], mine.T @ weight[:split]])
        square = np.zeros((len(reps), len(reps)), bool)
        square[:split, split:], square[split:, :split] = near, near.T
    else:
        np.fill_diagonal(mine, False)
        links, square = mine @ weight, near
    root = components(square)
    root_rep = reps[root]
    use = (links > 0) | (root_rep != reps)
    return reps[use], np.rint(links[use]).astype(np.int64), root_rep[use]


def verified(docs: DataFrame, members: DataFrame, weights: DataFrame, n: int, threshold: float, cell: int, cell_shingles: int) -> DataFrame:
    """Brute force within leaves: (rep, links, root) rows; root is a rep that rep is connected to within a cell or a pair of cells."""
    listed = members.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # at most runs * width**depth of them

    def sets(batches):
        for table in chunks(batches, 4 << 20):
            found, starts = token_sets(table, n)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("leaves").combine_chunks(), table.column("weight").combine_chunks(), lists], ["rep", "leaves", "weight", "tokens"])

    # Sorted on both sides at any size: a broadcast on small inputs only would hide what texts cost.
    wanted = docs.hint("merge").join(listed.join(weights.select("rep", "weight"), "rep").withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "leaves", "weight")
    full = materialize(wanted.mapInArrow(sets, "rep long, leaves array<long>, weight long, tokens array<long>"), "sets")
    heavy = members.join(weights.select("rep", "size"), "rep").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    heavy = heavy.select("leaf", F.greatest(F.ceil(F.col("n") / cell), F.ceil(F.col("shingles") / cell_shingles)).cast("int").alias("cuts"))
    placed = members.select("leaf", "rep").join(materialize(heavy, "cells"), "leaf").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("cuts")).cast("int"))
    kinds = {"leaf": pa.int64(), "own": pa.int32(), "rep": pa.int64(), "links": pa.int64(), "root": pa.int64(), "packed": pa.binary()}

    def within(key, table):
        leaf, own = (k.as_py() for k in key)
        reps, links, root = compared(leaf, [table], threshold) if len(table) > 1 else [[], [], []]
        packed = []
        if table.column("cuts")[0].as_py() > 1:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (lean := table.select(["rep", "leaves", "weight", "tokens"])).schema) as w:
                w.write_table(lean)
            packed = [sink.getvalue().to_pybytes()]
        rows, more = len(reps), len(packed)
        cols = [[leaf] * (rows + more), [own] * (rows + more), [*reps, *[None] * more], [*links, *[None] * more], [*root, *[None] * more], [*[None] * rows, *packed]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    def across(batches):
        for b in batches:
            for leaf, one, two in zip(*(b.column(c) for c in ("leaf", "one", "two")), strict=True):
                tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in (one, two)]
                cols = compared(leaf.as_py(), tables, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "root"])
        give_back()

    inside = placed.join(full, "rep").groupBy("leaf", "own").applyInArrow(within, "leaf long, own int, rep long, links long, root long, packed binary")
    inside = materialize(inside, "cells_within")
    discard(full)
    packed = inside.filter("packed is not null")
    one, two = (packed.select("leaf", F.col("own").alias(i), F.col("packed").alias(c)) for i, c in (("i", "one"), ("j", "two")))
    pairs = one.select("leaf", "i").join(two.select("leaf", "j"), "leaf").filter("i < j")
    met = pairs.hint("merge").join(one, ["leaf", "i"]).join(two.hint("merge"), ["leaf", "j"]).select("leaf", "one", "two")
    links = ["rep", "links", "root"]
    return materialize(inside.filter("packed is null").select(*links).unionByName(met.mapInArrow(across, "rep long, links long, root long")), "links")


def _lists(column, by) -> list[np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, cuts = np.asarray(lists.values), np.asarray(lists.offsets)
    return [values[cuts[k] : cuts[k + 1]] for k in by]


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(rep, class_id): smallest rep of the component of each end of the edges (a, b). Min-label spreading with pointer jumps."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("rep"), "label"), "labels")
    for _ in range(rounds):
        spread = both.join(labels, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(spread, F.col("rep") == F.col("a")).select("rep", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("rep").alias("label"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "label").select("rep", "was", F.least("label", "further").alias("label")), "labels")
        labels = new.select("rep", "label")
        if new.filter("label <> was").limit(1).isEmpty():
            return labels.withColumnRenamed("label", "class_id")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, target: float = 0.9999, small: int = 64, dense: float = 0.6, width: int = 2, depth: int = 4, cell: int = 2048, cell_shingles: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, rep_id, class_id, n_links, n_shingles.

    Words are runs of ASCII letters and digits or non-ASCII characters, A-Z as
    a-z; a text of 1 to n-1 words has one shingle of all its words. rep_id is
    the smallest doc_id with the same shingle set, class_id the smallest of all
    documents linked to it over any number of links, n_links the number of
    other documents at a Jaccard similarity of at least `threshold`, copies
    included. Texts without words (null and empty ones) have no links. Rows
    with a null doc_id give no row; rows that repeat a doc_id count once (see
    unique_docs). Other columns are ignored; an empty table gives an empty
    result. A link at the threshold itself is found with a chance of at least
    `target`, nearer ones with more; the equal coordinates asked for
    before the sets are compared add a chance of a miss of at most a hundredth
    of the target's.
    """
    docs = unique_docs(docs)
    runs = runs_for(target, threshold, width, depth)
    signed = materialize(signatures(docs, n, runs * depth * width), "signatures")
    classes = materialize(signed.filter("size > 0").groupBy("set_a", "set_b", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    reps = signed.select(F.col("doc_id").alias("rep"), "sketch").join(classes.select("rep", "weight"), "rep")
    members = leaves(reps, runs, small, dense, width, depth)
    near = once(materialize(sifted(members, reps.select("rep", "sketch"), least_for(threshold, runs * depth * width, (1 - target) / 100), cell), "sifted"), "near")
    pairs = verified(docs, near, classes.select("rep", "weight", "size"), n, threshold, cell, cell_shingles)
    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected(pairs.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = classes.join(groups, "rep", "left").join(links, "rep", "left")
    known = known.select("set_a", "set_b", "size", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "size", "set_a", "set_b").join(known, ["set_a", "set_b", "size"], "left")
    return out.select("doc_id", F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("size").cast("long").alias("n_shingles"))
