"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each tokenizer gives a document's tokens as end events: (offset of the token's
last byte, id). The events of both are united, dealt by document, sorted by
offset, and swept. Where events of both fall on one offset, a group ends; each
stretch between two neighbouring events is a link of the tokens that cover it.
All that the sweep holds between rows is the open group.

Events travel in blocks, a row for each side and window of a document, with
the steps from end to end and the ids packed: a row for each event would cost
more than the tokenizers do.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import encode_text
from cairn.llm.common import by_row, chunks, give_back, long_bytes, materialize, mix64, small_batches
from cairn.llm.lm_score import packed, planes, unpacked, unplanes

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Last bytes of white space beyond ASCII, as (bytes before, first and last of the last byte).
WIDE_BLANKS = [(b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A), (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80)]
EVENTS = "row_key long, doc_id long, at long, side int, steps binary, ids binary"


class ByteLevel:
    """A byte-level BPE as the tokenizers library writes it; tokens are byte strings written in stand-in characters.

    Ids of such a vocabulary follow the order of the merges, so they are ranks
    and tiktoken gives the same ids in a fourth of the time; a file of which
    that is not so is left to the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in set(shown))
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        plain = lambda token: bytes(byte_of[c] for c in token)
        added = {x["content"]: x["id"] for x in read["added_tokens"]}
        ranks = {plain(t): i for t, i in read["model"]["vocab"].items() if t not in added}
        self.bytes = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes[i] = token
        pairs = (m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"])
        made = [ranks[plain(a) + plain(b)] for a, b in pairs]
        shape = read["pre_tokenizer"]
        self.ranked = made == sorted(made) and min(made) > max(ranks[bytes([b])] for b in range(256)) and shape["type"] == "ByteLevel" and shape["use_regex"] and not shape["add_prefix_space"] and not read["normalizer"]
        if self.ranked:
            self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [encode_text(self.model, t) for t in texts]
        return [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space before a text itself; texts are given with theirs.

    Texts are cut before a space that follows no white space, where no piece can
    lie, and each different cutting is encoded once in a chunk.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")
        # A merge over a unit's start would need a piece with a space behind another character.
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces run over the starts of words")

    def encode(self, texts: list[str]) -> list[list[int]]:
        lists = self.model.encode([u[1:] for u in texts], num_threads=1)
        # A space alone, as at a text's end, is an empty text to the model, before which it puts no space.
        return [ids if u != " " else [self.blank] for u, ids in zip(texts, lists, strict=True)]


_MODELS: dict = {}


def model(path: str):
    """One tokenizer per worker and file; .model files are sentencepiece's."""
    if path not in _MODELS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MODELS[path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return _MODELS[path]


def vocabulary(path: str) -> tuple[int, np.ndarray]:
    """Number of ids and bytes of each token."""
    found = model(path).bytes
    return len(found), np.array([len(x) for x in found], np.int64)


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie end to end from `starts`: at each text's start and at each space behind no white space."""
    space = np.flatnonzero(data == 32)
    space = space[space > 0]
    before = data[space - 1]
    blank = BLANK[before]
    for lead, low, high in WIDE_BLANKS:
        near = np.flatnonzero((before >= low) & (before <= high) & (space > len(lead)))
        for k, byte in enumerate(reversed(lead)):
            near = near[data[space[near] - 2 - k] == byte]
        blank[near] = True
    begins = np.zeros(len(data), bool)
    begins[space[~blank]] = True
    begins[starts] = True
    return np.flatnonzero(begins)


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and the n+1 offsets."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(at[-1])), at


def encoded(table: pa.Table, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their bytes, tokens before each text, whether each text's tokens are its bytes) of space+text of each row."""
    tokenizer = model(path)
    data, at = long_bytes(table.column("text"))
    full = np.diff(at) > 0
    start = at[:-1][full] + np.arange(full.sum())  # with a space put before each text that is not empty
    spaced = np.insert(data, at[:-1][full], np.uint8(32))
    cut = unit_starts(spaced, start) if isinstance(tokenizer, Pieces) else start
    units = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(cut, len(spaced)).astype(np.int64)), pa.py_buffer(spaced))
    if isinstance(tokenizer, Pieces):
        kinds = units.dictionary_encode()
        which, names = np.asarray(kinds.indices), kinds.dictionary.to_pylist()
    else:
        which, names = np.arange(len(cut)), units.to_pylist()
    lists = tokenizer.encode(names) if names else []
    right = np.array([b"".join([tokenizer.bytes[i] for i in ids]) == u.encode() for u, ids in zip(names, lists, strict=True)], bool)
    flat, first = flat_lists(lists)
    many = np.diff(first)[which]
    before = np.concatenate([[0], np.cumsum(many)])
    ids = flat[np.repeat(first[which] - before[:-1], many) + np.arange(before[-1])]
    unit_before = np.append(np.searchsorted(cut, start), len(cut))  # units before each text
    wrong = np.concatenate([[0], np.cumsum(~right[which])])[unit_before]
    ok = np.zeros(len(full), bool)
    ok[full] = wrong[1:] == wrong[:-1]
    tokens = np.zeros(len(full), np.int64)
    tokens[full] = np.diff(before[unit_before])
    return ids, vocabulary(path)[1][ids], np.concatenate([[0], np.cumsum(tokens)]), ok


def events(docs: DataFrame, path: str, side: int, window: int = 1 << 16, chunk: int = 2 << 20) -> DataFrame:
    """End events of (row_key, doc_id, text): for each window of bytes a row of them, in order, with `at` where its first token begins.

    A text without tokens has one row at -1 with null events: an empty one, and
    one whose tokens' bytes are not those of space+text.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        size, _ = vocabulary(path)
        kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        for table in chunks(batches, chunk):
            ids, lengths, starts, ok = encoded(table, path)
            keys, named = table.column("row_key").to_pylist(), table.column("doc_id").to_pylist()
            step_kind = np.dtype("u1") if lengths.max(initial=0) < 256 else np.dtype("<u4")
            steps, ids = lengths.astype(step_kind), ids.astype(kind)
            out: list[tuple] = []
            held = 0
            for k, good in enumerate(ok.tolist()):
                if not good:
                    out.append((keys[k], named[k], -1, None, None))
                    continue
                a, b = int(starts[k]), int(starts[k + 1])
                ends = np.cumsum(lengths[a:b])
                cuts = [0, *np.searchsorted(ends, np.arange(window, ends[-1] + 1, window)).tolist(), b - a]
                for i, j in zip(cuts, cuts[1:]):
                    if j > i:
                        out.append((keys[k], named[k], int(ends[i]) // window * window, bytes([step_kind.itemsize]) + steps[a + i : a + j].tobytes(), ids[a + i : a + j].tobytes()))
                        held += (j - i) * 3
                if held > 4 << 20:
                    yield _event_batch(out, side)
                    out, held = [], 0
            if out:
                yield _event_batch(out, side)
            del ids, lengths, steps
            give_back()

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, EVENTS)


def _event_batch(rows: list[tuple], side: int) -> pa.RecordBatch:
    key, doc, at, steps, ids = zip(*rows, strict=True)
    arrays = [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array([side] * len(rows), pa.int32()), pa.array(steps, pa.binary()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["row_key", "doc_id", "at", "side", "steps", "ids"])


def swept_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' events, dealt by document and in order of offset."""
    return a.unionByName(b).repartition("row_key").sortWithinPartitions("row_key", "at", "side")


@dataclass
class Closed:
    """What the sweep has closed: whole groups, of tokens of both sides end to end."""

    ids: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]  # number of each token's document
    group: tuple[np.ndarray, np.ndarray]  # of each token, from 0
    count: tuple[np.ndarray, np.ndarray]  # tokens up to each group's end
    links: tuple[np.ndarray, np.ndarray]  # places in the tokens of both sides
    ends: tuple[np.ndarray, np.ndarray]  # bytes from the first token's start to each token's end


class Sweep:
    """Documents' events in order of (document, offset) to closed groups; holds the open group."""

    def __init__(self):
        self.ids, self.steps, self.doc = ([np.zeros(0, np.int64)] * 2 for _ in range(3))
        self.broken: set[int] = set()

    def feed(self, docs: np.ndarray, sides: np.ndarray, steps: list[np.ndarray], ids: list[np.ndarray]) -> Closed:
        """Rows in order: document number, side, steps and ids of each."""
        for s in (0, 1):
            mine = np.flatnonzero(sides == s)
            own = np.repeat(docs[mine], np.fromiter((len(ids[k]) for k in mine), np.int64, len(mine)))
            self.doc[s] = np.concatenate([self.doc[s], own])
            for held, new in ((self.ids, ids), (self.steps, steps)):
                held[s] = np.concatenate([held[s], *[new[k] for k in mine]], dtype=np.int64)
        ends = [np.cumsum(x) for x in self.steps]
        # The events on a line of bytes, as a set of sides at each.
        line = np.zeros(max(int(e[-1]) if len(e) else 0 for e in ends), np.uint8)
        line[ends[0] - 1] = 1
        line[ends[1] - 1] |= 2
        stretch = np.flatnonzero(line)
        who = line[stretch]
        shared = np.flatnonzero(who == 3)
        closed = int(shared[-1]) + 1 if len(shared) else 0
        who = who[:closed]
        has = [(who & 1).astype(np.int64), (who >> 1).astype(np.int64)]
        sofar = [np.cumsum(h) for h in has]
        group = np.cumsum(who == 3) - (who == 3)
        upto = [int(x[-1]) if closed else 0 for x in sofar]
        out = Closed(
            ids=tuple(x[:n] for x, n in zip(self.ids, upto, strict=True)), doc=tuple(x[:n] for x, n in zip(self.doc, upto, strict=True)),
            group=tuple(group[h > 0] for h in has), count=tuple(x[shared] for x in sofar), links=tuple(x - h for x, h in zip(sofar, has, strict=True)),
            ends=tuple(e[:n] for e, n in zip(ends, upto, strict=True)),
        )
        for held in (self.ids, self.steps, self.doc):
            held[:] = [x[n:].copy() for x, n in zip(held, upto, strict=True)]
        return out


_DECIMALS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number below size: its digits behind an empty byte, as eight bytes with zeros at the end; and how many they are."""
    if size not in _DECIMALS:
        text = [str(k).encode() for k in range(size)]
        rows = np.frombuffer(b"".join(b"\0" + t.ljust(7, b"\0") for t in text), np.uint64)
        _DECIMALS[size] = rows, np.array([len(t) for t in text], np.int64)
    return _DECIMALS[size]


def written(closed: Closed, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups as decimal text, a1,a2|b1;a3|b2, in bytes; and where each group's text ends.

    `first` says of each group whether it is its document's first, before which there is no mark.
    """
    digits, length = decimals(size)
    (a, b), before = closed.count, [np.concatenate([[0], x[:-1]]) for x in closed.count]
    place = [np.arange(len(closed.ids[0])) + before[1][closed.group[0]], np.arange(len(closed.ids[1])) + a[closed.group[1]]]
    number = np.empty(len(place[0]) + len(place[1]), np.int64)
    for at, ids in zip(place, closed.ids, strict=True):
        number[at] = ids
    mark = np.full(len(number), ord(","), np.uint8)
    mark[before[0] + before[1]] = np.where(first, 0, ord(";"))
    mark[a + before[1]] = ord("|")
    rows = digits[number].view(np.uint8).reshape(-1, 8)
    rows[:, 0] = mark
    rows = rows.reshape(-1)
    ends = np.cumsum(length[number] + (mark > 0))
    return rows[rows != 0], ends[a + b - 1]


def rows_of(batches):
    """(row_key, doc_id, side, steps, ids) arrays of event rows, by a few MB, in order; both sides of a window stay together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= 3 << 20:
            table = pa.Table.from_batches(held)
            key, at = np.asarray(table.column("row_key")), np.asarray(table.column("at"))
            last = int(np.flatnonzero((key != key[-1]) | (at != at[-1])).max(initial=-1)) + 1
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held) if last else 0
    if held:
        yield pa.Table.from_batches(held)


def unpack(table: pa.Table, kinds: tuple[np.dtype, np.dtype]) -> tuple[np.ndarray, list, list]:
    sides = np.asarray(table.column("side"))
    steps, ids = [], []
    for s, x, y in zip(sides.tolist(), table.column("steps").to_pylist(), table.column("ids").to_pylist(), strict=True):
        steps.append(np.frombuffer(x, "u1" if x[0] == 1 else "<u4", offset=1))
        ids.append(np.frombuffer(y, kinds[s]))
    return sides, steps, ids


def id_kinds(paths: tuple[str, str]) -> tuple[np.dtype, np.dtype]:
    return tuple(np.dtype("<u2") if vocabulary(p)[0] <= 1 << 16 else np.dtype("<u4") for p in paths)


def aligned(docs: DataFrame, paths: tuple[str, str], what: str = "groups") -> DataFrame:
    """What the sweep emits, a row each, of all documents that have tokens.

    groups: (doc_id, start, end, a_ids, b_ids), the bytes of space+text that a
    group covers and its tokens; links: (doc_id, a_id, b_id, a_end, b_end), two
    tokens and the bytes where they end. Rows that repeat an id are aligned each
    time; null ids stay null. An empty table gives an empty result.
    """
    both = swept_order(*(events(by_row(docs), p, s) for s, p in enumerate(paths)))
    schema = {"groups": "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>", "links": "doc_id long, a_id int, b_id int, a_end long, b_end long"}[what]

    def run(batches):
        kinds = id_kinds(paths)
        sweep, names, key = Sweep(), [], None
        base, origin = 0, np.zeros(0, np.int64)  # where the open group begins, and each document, in all bytes
        for table in rows_of(batches):
            good, _ = whole(table, sweep)
            if not good.num_rows:
                continue
            number, keys, more = numbered(good, key)
            names += more
            origin = np.concatenate([origin, np.full(len(more), -1)])
            key = keys[-1] if keys else key
            c = sweep.feed(number, *unpack(good, kinds))
            if len(c.ids[0]):
                ends = [base + e for e in c.ends]
                start = np.concatenate([[base], ends[0][:-1]])
                at = runs_of(c.doc[0])
                new = at[origin[c.doc[0][at]] < 0]
                origin[c.doc[0][new]] = start[new]
                doc = pa.array(names, pa.int64())
                if what == "links":
                    i, j = c.links
                    cols = [doc.take(pa.array(c.doc[0][i])), pa.array(c.ids[0][i], pa.int32()), pa.array(c.ids[1][j], pa.int32()), pa.array(ends[0][i] - origin[c.doc[0][i]]), pa.array(ends[1][j] - origin[c.doc[1][j]])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "a_id", "b_id", "a_end", "b_end"])
                else:
                    of = c.doc[0][c.count[0] - 1]
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n]), pa.int32()), pa.array(x, pa.int32())) for n, x in zip(c.count, c.ids, strict=True)]
                    cols = [doc.take(pa.array(of)), pa.array(start[np.concatenate([[0], c.count[0][:-1]])] - origin[of]), pa.array(ends[0][c.count[0] - 1] - origin[of]), *lists]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "a_ids", "b_ids"])
                base = int(ends[0][-1])
            names, origin = names[-1:], origin[-1:]  # only the open document is still needed
            sweep.doc = [np.zeros(len(x), np.int64) for x in sweep.doc]
            give_back()

    return both.mapInArrow(run, schema)


def whole(table: pa.Table, sweep: Sweep) -> tuple[pa.Table, list[int | None]]:
    """The rows of documents that both sides have tokens for, and the ids of the others; a null row comes before a document's other ones."""
    null = table.filter(pc.equal(table.column("at"), -1))
    fresh = {k: d for k, d in zip(null.column("row_key").to_pylist(), null.column("doc_id").to_pylist(), strict=True) if k not in sweep.broken}
    sweep.broken |= {*fresh}
    good = table.filter(pc.invert(pc.is_in(table.column("row_key"), value_set=pa.array(sorted(sweep.broken), pa.int64())))) if sweep.broken else table
    sweep.broken &= {table.column("row_key")[-1].as_py()}
    return good, [*fresh.values()]


def numbered(table: pa.Table, open_key: int | None) -> tuple[np.ndarray, list[int], list[int | None]]:
    """A number for each row's document, from 0, which is that of open_key if there is one; keys and ids of the documents."""
    keys = np.asarray(table.column("row_key"))
    new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if open_key is None else open_key))
    number = np.zeros(len(keys), np.int64)
    number[new] = 1
    number = np.cumsum(number) - (open_key is None)
    return number, keys[new].tolist(), table.column("doc_id").take(pa.array(new)).to_pylist()


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


@dataclass
class Document:
    """What is known of a document: its counts, its different links as codes with how often each occurs, the digest of its groups."""

    doc_id: int | None
    counts: np.ndarray  # tokens of both sides, groups, links
    codes: list[np.ndarray]
    times: list[np.ndarray]
    digest: hashlib._Hash | None = None

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) < 2:
            return (self.codes[0], self.times[0]) if self.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        by = np.argsort(codes, kind="stable")
        at = runs_of(codes[by])
        return codes[by][at], np.add.reduceat(times[by], at)


def documents(batches, paths: tuple[str, str]):
    """Sweeps the events of whole partitions and yields each document as it is done."""
    kinds = id_kinds(paths)
    sizes = [vocabulary(p)[0] for p in paths]
    span = sizes[0] * sizes[1]
    sweep, held, key = Sweep(), [], None
    for table in rows_of(batches):
        good, without = whole(table, sweep)
        for d in without:
            yield Document(d, np.zeros(4, np.int64), [], [])
        if not good.num_rows:
            continue
        number, keys, names = numbered(good, key)
        held += [Document(d, np.zeros(4, np.int64), [], [], hashlib.sha256()) for d in names]
        key = keys[-1] if keys else key
        c = sweep.feed(number, *unpack(good, kinds))
        if len(c.ids[0]):
            of_group = c.doc[0][c.count[0] - 1]
            of_link = c.doc[0][c.links[0]]
            counts = np.stack([np.bincount(x, minlength=len(held)) for x in (*c.doc, of_group, of_link)], axis=1)
            codes = np.sort(of_link * span + c.ids[0][c.links[0]] * sizes[1] + c.ids[1][c.links[1]])
            at = runs_of(codes)
            times = np.diff(at, append=len(codes))
            codes, cut = codes[at] % span, np.searchsorted(codes[at], np.arange(len(held) + 1) * span)
            first = np.zeros(len(of_group), bool)
            first[runs_of(of_group)] = True
            if held[0].counts[2]:
                first[: np.searchsorted(of_group, 1)] = False
            text, ends = written(c, first, max(sizes))
            upto = np.concatenate([[0], ends])[np.searchsorted(of_group, np.arange(len(held) + 1))]
            text = memoryview(text)
            for k, d in enumerate(held):
                d.counts = d.counts + counts[k]
                if cut[k + 1] > cut[k]:
                    d.codes.append(codes[cut[k] : cut[k + 1]])
                    d.times.append(times[cut[k] : cut[k + 1]])
                    if len(d.codes) > 8:
                        d.codes, d.times = ([x] for x in d.pairs())
                d.digest.update(text[upto[k] : upto[k + 1]])
        yield from held[:-1]
        held = held[-1:]
        sweep.doc = [np.zeros(len(x), np.int64) for x in sweep.doc]
    yield from held


MET = "chunk long, bucket int, docs binary, codes binary, places binary, counts binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(codes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def chunk_rows(docs: list[Document], chunk: int, buckets: int) -> pa.RecordBatch:
    """A chunk of documents: one row with all that is known of them, and one for each bucket of its links, which asks for their counts.

    The links of a chunk are its different codes in order; documents name them by place.
    """
    pairs = [d.pairs() for d in docs]
    n = np.array([len(x) for x, _ in pairs], np.int64)
    codes = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    kinds = np.sort(codes)
    kinds = kinds[runs_of(kinds)]
    place = np.searchsorted(kinds, codes)
    counts = np.bincount(place, minlength=len(kinds))
    step = np.diff(place, prepend=0)
    starts = (np.cumsum(n) - n)[n > 0]
    step[starts] = place[starts]
    told = np.array([d.counts for d in docs], np.int64).reshape(-1, 4)
    sha = [d.digest.hexdigest() if d.counts[0] else "" for d in docs]
    table = pa.table({"doc_id": pa.array([d.doc_id for d in docs], pa.int64()), **{c: pa.array(told[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": pa.array(sha, pa.string()), "pairs": pa.array(n)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    times = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
    delta = lambda x: planes(np.diff(x, prepend=0).astype(np.uint64))
    rows = [(-1, sink.getvalue().to_pybytes(), delta(kinds), planes(step.astype(np.uint32)), packed(times))]
    where = bucket_of(kinds, buckets)
    by = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[by], np.arange(buckets + 1))
    rows += [(int(b), None, delta(kinds[x]), None, packed(counts[x])) for b in np.flatnonzero(np.diff(cut)) for x in (by[cut[b] : cut[b + 1]],)]
    bucket, docs_, codes_, places, counted = zip(*rows, strict=True)
    arrays = [pa.array([chunk] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (docs_, codes_, places, counted))]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "bucket", "docs", "codes", "places", "counts"])


def keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, 8), dtype=np.uint64).astype(np.int64)


def alignment_counts(docs: DataFrame, paths: tuple[str, str], chunk: int = 1 << 20, bucket: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is the number of documents, each row one, that hold its two
    ids linked. Texts that are null, empty or not what their tokens say have
    zeros and an empty digest. Rows that repeat an id and null ids are rows like
    others; other columns are ignored; an empty table gives an empty result.
    `chunk` is links of different kinds in a chunk of documents, `bucket` bytes
    of text for each bucket of counts. A chunk names each link once, however
    common it is, and one number for each id of the first vocabulary is all
    that goes through the driver.
    """
    spark = docs.sparkSession
    rows = by_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    buckets = 1 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket
    both = swept_order(*(events(rows, p, s) for s, p in enumerate(paths)))
    second = vocabulary(paths[1])[0]

    def met(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for d in documents(batches, paths):
            held.append(d)
            size += 16 + sum(map(len, d.codes))
            if size >= chunk:
                yield chunk_rows(held, at, buckets)
                held, size, at = [], 0, at + 1
                give_back()
        if held:
            yield chunk_rows(held, at, buckets)
        give_back()

    found = materialize(both.mapInArrow(met, MET), "aligned")

    def answer(key, table):
        """Counts of a bucket's links over all chunks, for each chunk in its order; and, with a null chunk, each first id's highest."""
        blobs = [keys_of(b) for b in table.column("codes").to_pylist()]
        own = np.concatenate([unpacked(b, 1)[0].astype(np.int64) for b in table.column("counts").to_pylist()])
        codes = np.concatenate(blobs)
        by = np.argsort(codes, kind="stable")
        at = runs_of(codes[by])
        sums = np.add.reduceat(own[by], at)
        kinds = codes[by][at]
        out = [packed(sums[np.searchsorted(kinds, b)]) for b in blobs]
        first = kinds // second
        ids = runs_of(first)
        n = len(out) + 1
        return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "ids": pa.array([*[None] * (n - 1), planes(first[ids])], pa.binary()), "counts": pa.array([*out, packed(np.maximum.reduceat(sums, ids))], pa.binary())})

    asked = found.filter("bucket >= 0").select("chunk", "bucket", "codes", "counts")
    answers = materialize(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, ids binary, counts binary"), "answers")

    def highest(batches):
        for b in batches:
            for ids, counts in zip(b.column("ids").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unplanes(ids, 8).astype(np.int64)), pa.array(unpacked(counts, 1)[0].astype(np.int64))], ["id", "most"])

    top = answers.filter("chunk is null").select("ids", "counts").mapInArrow(highest, "id long, most long").groupBy("id").agg(F.max("most").alias("most"))
    most = np.zeros(vocabulary(paths[0])[0], np.int64)
    for r in top.toLocalIterator():
        most[r["id"]] = r["most"]
    best = spark.sparkContext.broadcast(most)

    def told(rows, answers):
        out = []
        for docs_, codes, places, times in zip(*(rows.column(c).to_pylist() for c in ("docs", "codes", "places", "counts")), strict=True):
            table = pa.ipc.open_stream(docs_).read_all()
            kinds = keys_of(codes)
            where = np.argsort(bucket_of(kinds, buckets), kind="stable")
            blobs = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
            counts = np.zeros(len(kinds), np.int64)
            if blobs:
                counts[where] = np.concatenate([unpacked(b, 1)[0].astype(np.int64) for _, b in blobs])
            top = counts == best.value[kinds // second]
            n = np.asarray(table.column("pairs"))
            cut = np.concatenate([[0], np.cumsum(n)])
            step = unplanes(places, 4).astype(np.int64)
            total = np.cumsum(step)
            before = np.concatenate([[0], total])[cut[:-1]]
            place = total - np.repeat(before, n)
            weight = unpacked(times, 1)[0].astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (weight * top[place], weight * counts[place])]
            best_, sum_ = (pa.array(x[cut[1:]] - x[cut[:-1]]) for x in sums)
            out.append(pa.table({**{c: table.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": best_, "count_sum": sum_, "groups_sha256": table.column("groups_sha256")}))
        give_back()
        return pa.concat_tables(out)

    per_chunk = found.filter("bucket = -1").select("chunk", "docs", "codes", "places", "counts")
    return per_chunk.groupBy("chunk").cogroup(answers.filter("chunk is not null").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(told, RESULT)
