"""Best-fit packing of token sequences by the linear grouping scheme.

The plan depends only on how many pieces there are of each length (at most
`capacity` numbers), never on the documents, so the driver can make it at any
scale:

1. lengths above `capacity / small_part` are sorted downwards and cut into
   groups of equal cardinality; each is rounded up to the longest of its group;
2. a configuration LP over the few rounded lengths is solved by column
   generation (Gilmore and Gomory); its rounded-down solution says how many
   sequences to open with which configuration;
3. actual pieces take the places of their groups in order of length, the last
   place of a sequence the longest piece that the room gained by rounding allows;
4. what is left, and all small lengths, are put best-fit: each length, longest
   first, goes to the tightest sequences that can still take it.

Sequences filled alike are held as runs, so the plan has a few rows for each
configuration and length however many sequences there are.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import chunks, materialize, small_batches

_WORDS: dict = {}


# ---------------------------------------------------------------- tokenizing


class WordIds:
    """Ids of whitespace-delimited words under a `tokenizers` file; words seen are kept, up to a bound.

    The tokenizer drops white space and no pre-token or normalisation reaches
    across it, so a text's ids are those of its words. New words are encoded
    together, each behind a digit that is always a token of its own. Words stay
    in Arrow arrays throughout.
    """

    MOST = 1_000_000
    AT_ONCE = 20  # texts of a call to the tokenizer: its results are large
    LETTERS, CLOSING = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]"

    def __init__(self, path: str) -> None:
        # A task has one core; the tokenizer's own threads would each hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same model behind cheaper splitting, for words of Latin letters and closing punctuation: it gives the same ids.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.whole.encode("0", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _together(self, tokenizer, words: pa.Array, step: int = 1000) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words that hold no mark, end to end, and their counts."""
        offsets = np.append(np.arange(0, len(words), step), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), pa.scalar(" 0 ", words.type)).to_pylist()
        flat, lengths = [], []
        for at in range(0, len(texts), self.AT_ONCE):
            for e in tokenizer.encode_batch_fast(["0 " + x for x in texts[at : at + self.AT_ONCE]], add_special_tokens=False):
                ids = np.asarray(e.ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark[0])
                lengths.append(np.diff(marks, append=len(ids)) - 1)
                flat.append(np.delete(ids, marks))
        return flat, lengths

    def add(self, words: pa.Array) -> np.ndarray:
        """Learn new words; their numbers."""
        plain = np.asarray(pc.match_substring_regex(words, f"^{self.LETTERS}{self.CLOSING}*$"))
        ascii_ = np.asarray(pc.string_is_ascii(words)) & ~np.asarray(pc.match_substring_regex(words, r"[0']|<\|"))
        if len(self.mark) != 1:
            plain = ascii_ = np.zeros(len(words), bool)
        order = [np.flatnonzero(plain), np.flatnonzero(~plain & ascii_), np.flatnonzero(~plain & ~ascii_)]
        apart = pc.replace_substring_regex(words.take(pa.array(order[0])), f"^({self.LETTERS})({self.CLOSING}+)$", r"\1 \2")
        flat, lengths = self._together(self.plain, apart)
        more = self._together(self.whole, words.take(pa.array(order[1])))
        flat, lengths = flat + more[0], lengths + more[1]
        own = words.take(pa.array(order[2])).to_pylist()
        for i in range(0, len(own), 1000):
            ids = [e.ids for e in self.whole.encode_batch_fast(own[i : i + 1000], add_special_tokens=False)]
            flat += [np.asarray(x, np.uint32) for x in ids]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        order, at = np.concatenate(order), len(self.lengths)
        self.known = pa.concat_arrays([self.known, words.take(pa.array(order))])
        self.flat, self.lengths = np.concatenate([self.flat, *flat]), np.concatenate([self.lengths, *lengths])
        numbers = np.empty(len(words), np.int64)
        numbers[order] = at + np.arange(len(words))
        return numbers

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and each text's count."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offsets = np.asarray(lists.offsets).astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, unique = np.asarray(words.indices), words.dictionary
        if len(self.known) > self.MOST:
            self.forget()
        where = np.asarray(pc.fill_null(pc.index_in(unique, self.known), -1)).astype(np.int64)
        new = where < 0
        where[new] = self.add(unique.filter(pa.array(new)))
        starts = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[where][codes]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(starts[where][codes] - (ends - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], ends])
        bounds = total[offsets - offsets[0]]
        return ids, np.diff(bounds)


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut each document's ids (with end_id behind) into pieces of at most `capacity`.

    part and place number the pieces of one length within a task. Null text
    counts as empty and gives one piece holding end_id alone.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for table in chunks(batches, 4 << 20):
            ids, counts = encode(table.column("text"))
            at, rows = 0, []
            for doc, n in zip(table.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for k, start in enumerate(range(0, n + 1, capacity)):
                    cut = own[start : start + capacity]
                    rows.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes()), part, int(seen[len(cut)])))
                    seen[len(cut)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


# ------------------------------------------------------------------ planning


def grouped(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths over `least`, longest first, in groups of equal cardinality: (rounded length, [(length, count)])."""
    sizes = [s for s in range(len(counts) - 1, least, -1) if counts[s]]
    total = int(sum(counts[s] for s in sizes))
    if not total:
        return []
    each = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for s in sizes:
        left = int(counts[s])
        while left:
            if not room:
                out.append((s, []))
                room = each
            n = min(left, room)
            out[-1][1].append((s, n))
            left, room = left - n, room - n
    return out


def knapsack(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value within the capacity, sizes usable again and again."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    sizes_a = np.asarray(sizes)
    order = np.argsort(sizes_a)
    ordered, worth = sizes_a[order], values[order]
    for c in range(int(ordered[0]) if len(ordered) else capacity + 1, capacity + 1):
        n = int(np.searchsorted(ordered, c, side="right"))
        got = best[c - ordered[:n]] + worth[:n]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], order[k]
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for the configuration LP; (configuration, whole number of uses) rounded down."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.asarray(demand, float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = knapsack(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-9:
            break
        step, x = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    uses = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int)
    return [(basis[:, i].round().astype(int), int(n)) for i, n in enumerate(uses) if n > 0]


class Plan:
    """Runs of sequences filled alike, and for each length the runs of its pieces' ranks."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next = capacity, 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # residual -> [(first sequence, sequences)]
        self.residuals: list[int] = []
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, ranks, first sequence, ranks a sequence, first offset
        self.ranks: dict[int, int] = {}

    def keep(self, residual: int, first: int, n: int) -> None:
        if residual > 0 and n > 0:
            if residual not in self.open:
                bisect.insort(self.residuals, residual)
                self.open[residual] = []
            self.open[residual].append((first, n))

    def place(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        rank = self.ranks.get(size, 0)
        self.rows.append((size, rank, n, first, each, offset))
        self.ranks[size] = rank + n

    def best_fit(self, size: int, n: int) -> None:
        while n:
            k = bisect.bisect_left(self.residuals, size)
            if k == len(self.residuals):
                each = self.capacity // size
                m = max(1, n // each)
                residual, first = self.capacity, self.next
                self.next += m
            else:
                residual = self.residuals[k]
                first, m = self.open[residual].pop()
                if not self.open[residual]:
                    del self.open[residual], self.residuals[k]
                each = residual // size
            full = min(m, n // each)
            offset = self.capacity - residual
            if full:
                self.place(size, full * each, first, each, offset)
                self.keep(residual - each * size, first, full)
                n -= full * each
                first, m = first + full, m - full
            if m and n:  # the last sequence takes fewer
                self.place(size, n, first, n, offset)
                self.keep(residual - n * size, first, 1)
                first, m, n = first + 1, m - 1, 0
            self.keep(residual, first, m)


def plan(counts: np.ndarray, capacity: int = 2048, small_part: int = 4, groups: int = 64) -> Plan:
    """Pack counts[s] pieces of each length s."""
    out = Plan(capacity)
    left = np.array(counts, dtype=np.int64)
    if left[capacity]:
        out.best_fit(capacity, int(left[capacity]))
        left[capacity] = 0
    found = grouped(left, capacity // small_part, groups)
    uses = configurations([r for r, _ in found], [sum(n for _, n in items) for _, items in found], capacity)
    sizes = [int(x) for x in np.flatnonzero(left)]

    def longest(limit: int, used: dict[int, int]) -> int:
        """The longest length up to the limit of which more are left than used."""
        k = bisect.bisect_right(sizes, limit) - 1
        while k >= 0 and left[sizes[k]] <= used.get(sizes[k], 0):
            if not left[sizes[k]]:
                del sizes[k]
            k -= 1
        return sizes[k] if k >= 0 else 0

    for config, n in uses:
        limits = [found[g][0] for g in range(len(found)) for _ in range(config[g])]
        while n:
            # Actual pieces take the places of a group; they are shorter than its rounded length, and the last place takes the longest piece that the room so gained allows.
            used: dict[int, int] = {}
            for limit in limits[:-1]:
                if size := longest(limit, used):
                    used[size] = used.get(size, 0) + 1
            if size := longest(capacity - sum(s * c for s, c in used.items()), used):
                used[size] = used.get(size, 0) + 1
            if not used:
                break
            m = min([n, *(int(left[s]) // c for s, c in used.items())])
            first, offset = out.next, 0
            out.next += m
            for s, c in used.items():
                out.place(s, c * m, first, c, offset)
                left[s] -= c * m
                offset += s * c
            out.keep(capacity - offset, first, m)
            n -= m
    for size in range(capacity, 0, -1):
        if left[size]:
            out.best_fit(size, int(left[size]))
    return out


# ------------------------------------------------------------------- packing


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, small_part: int = 4, groups: int = 64) -> DataFrame:
    """Pack every document's ids into sequences of at most `capacity`.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Rows are taken as they come: repeated rows are packed
    again, null ids stay null, null text is the empty document (end_id alone).
    Other columns are ignored. An empty table gives an empty result. Equal
    lengths are interchangeable, so ties need no rule.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(per_task.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in offsets.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    made = plan(counts, capacity, small_part, groups)
    rows = sorted(made.rows)
    table = spark.sparkContext.broadcast(np.asarray(rows, np.int64).reshape(-1, 6))

    def run(batches):
        sizes, ranks, _, firsts, each, offs = table.value.T
        span = int(ranks.max()) + 1 if len(ranks) else 1
        keys = sizes.astype(object) * span + ranks if span * (capacity + 1) > 2**62 else sizes * span + ranks
        for b in batches:
            size, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            k = np.searchsorted(keys, size * span + np.minimum(rank, span - 1), side="right") - 1
            within = rank - ranks[k]
            sequence, offset = firsts[k] + within // each[k], offs[k] + within % each[k] * size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
