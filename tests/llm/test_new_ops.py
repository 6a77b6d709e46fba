"""Fill-in-the-middle, token alignment and fingerprints against brute force, with odd rows; long white space in byte BPE."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import align, bpe, fill_middle, merkle
from cairn.llm.queries import BYTE_RANKS, BYTE_TOKENIZER, PIECE_TOKENIZER, vocabulary

SCHEMA = "doc_id long, text string, row_key long, form string, digest string, side int, path string"
ODD = [(1, None), (2, ""), (3, "a b"), (4, "a\n\nb c. D, e!"), (5, "É ünï 🙂 x\u0000y 中文字符。好，了"), (6, "same text. here"), (6, "same text. here"), (6, "other text"), (None, "no id"), (None, "no id"), (7, "word " * 30_000), (8, " lead and\ttrail 　 wide    x "), (9, "low ▁ line <s> <|endoftext|> <unk>"), (10, "it's <P> marked"), (11, "x" * 5000), (12, "ab\r\ncd" * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "x", "x", 9, "x") for i, t in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 3


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " ", " \n"])
def test_long_white_space(blank):
    import public_tokenizers

    enc = bpe.encoding(vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)
    for n, size in ((700, 64), (65, 64), (64, 64), (2, 2)):
        run = blank * n
        for text in (run, f"a{run}", f"{run}b", f"it's{run}'s and{run}1{run}é", f"a{run} b c"):
            assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)
    run = blank * (5_000_000 // len(blank))
    for text in (run, f"a{run}b"):
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids) == text.encode()


# 11


def cut_by_hand(i, text):
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, empty):
    rng = random.Random(1)
    rows = ODD + [(k, "".join(rng.choice("ab<PSM>é中🙂 \n") for _ in range(rng.randrange(60)))) for k in range(100, 500)] + [(600, "é🙂a" * 200_000)]
    df = frame(spark, rows)
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("form"), F.col("output")))
    got = collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made.collect())
    assert got == collections.Counter((i, *cut_by_hand(i, t or ""), t or "") for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    told = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.digests(df).collect()}
    assert told == {(i, sha(cut_by_hand(i, t or "")[-1]), sha(t or "")) for i, t in rows}
    assert fill_middle.digests(empty).count() == 0


def test_runs():
    text = "aé中🙂" * 3 + "bbb" + "é" * 5
    runs = fill_middle.Runs(np.frombuffer(text.encode(), np.uint8))
    assert [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert len(runs) == len(text) and len(runs.units) == 15 and len(fill_middle.Runs(np.zeros(0, np.uint8))) == 0


# 12


@pytest.fixture(scope="module")
def paths():
    return vocabulary(BYTE_TOKENIZER), vocabulary(PIECE_TOKENIZER)


def aligned_by_hand(rows, paths):
    """Each row's tokens of both sides, groups and links, by the libraries themselves and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    a_bytes = align.ByteLevel(paths[0]).bytes
    piece = lambda t: bytes([int(b_model.id_to_piece(t)[3:5], 16)]) if b_model.is_byte(t) else b_model.id_to_piece(t).replace("▁", " ").encode()
    out = []
    for i, text in rows:
        ids = [a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)] if text else [[], []]
        parts = [[a_bytes[t] for t in ids[0]], [piece(t) for t in ids[1]]]
        if not text or any(b"".join(p) != f" {text}".encode() for p in parts):
            out.append((i, [], [], [], []))
            continue
        spans = []
        for p in parts:
            ends = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        links, groups, k, at = [], [], 0, [[], []]
        for (s, e), t in zip(spans[0], ids[0], strict=True):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((t, ids[1][j], e, spans[1][j][1]))
                j += 1
            at[0].append(t)
            if e in both:
                done = sum(len(g[1]) for g in groups)
                while done < len(spans[1]) and spans[1][done][1] <= e:
                    at[1].append(ids[1][done])
                    done += 1
                groups.append((at[0], at[1], e))
                at = [[], []]
        out.append((i, ids[0], ids[1], groups, links))
    return out


def counted_by_hand(found):
    count = collections.Counter(p for *_, links in found for p in {x[:2] for x in links})
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    text = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
    return collections.Counter((i, len(a), len(b), len(g), len(x), sum(count[p[:2]] == top[p[0]] for p in x), sum(count[p[:2]] for p in x), sha(text(g)) if g else "") for i, a, b, g, x in found)


@pytest.fixture(scope="module")
def aligned_rows(spark, paths):
    rng = random.Random(2)
    pool = ["the", " the", "  ", "\n", "Straße", "naïve", "中文", "🙂", "don't", "12345", "\t", "x" * 40, " ", "   ", "...", "▁"]
    rows = ODD + [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for k in range(100, 260)]
    return rows, aligned_by_hand(rows, paths)


def test_alignment_counts(spark, empty, paths, aligned_rows):
    rows, want = aligned_rows
    got = collections.Counter(map(tuple, align.alignment_counts(frame(spark, rows).repartition(3), paths, chunk=500, bucket=1000).collect()))
    assert got == counted_by_hand(want)
    assert any(not r[1] for r in want) and sum(bool(r[1]) for r in want) > 60
    assert align.alignment_counts(empty, paths).count() == 0


def test_groups_and_links(spark, empty, paths, aligned_rows):
    rows, want = aligned_rows
    df = frame(spark, rows)
    groups = collections.Counter((r["doc_id"], r["end"], tuple(r["a_ids"]), tuple(r["b_ids"])) for r in align.aligned(df, paths).collect())
    assert groups == collections.Counter((i, e, tuple(a), tuple(b)) for i, _, _, g, _ in want for a, b, e in g)
    links = collections.Counter(map(tuple, align.aligned(df, paths, "links").collect()))
    assert links == collections.Counter((i, *x) for i, *_, links in want for x in links)
    assert align.aligned(empty, paths).count() == align.aligned(empty, paths, "links").count() == 0


def test_windows_do_not_change_results(paths):
    """Documents cut into events of a few bytes, fed a few rows at a time."""
    text = "word naïve 中文 " * 40
    table = pa.table({"text": pa.array([text, "b " * 30])})
    ids, lengths, starts, ok = zip(*(align.encoded(table, p) for p in paths), strict=True)
    assert all(x.all() for x in ok)
    feeds = []
    for d in range(2):
        rows = []
        for s in range(2):
            own, step = ids[s][starts[s][d] : starts[s][d + 1]], lengths[s][starts[s][d] : starts[s][d + 1]]
            at = (np.cumsum(step) // 7).tolist()
            rows += [(w, s, step[np.array(at) == w], own[np.array(at) == w]) for w in sorted(set(at))]
        feeds += [(d, *r[1:]) for r in sorted(rows, key=lambda r: r[:2])]
    whole = align.Sweep().feed(*columns(feeds))
    sweep, parts = align.Sweep(), []
    for k in range(0, len(feeds), 3):
        c = sweep.feed(*columns(feeds[k : k + 3]))
        parts.append(c)
    assert not len(sweep.ids[0]) and not len(sweep.ids[1])
    for s in (0, 1):
        assert np.array_equal(whole.ids[s], np.concatenate([c.ids[s] for c in parts]))
        assert np.array_equal(whole.ids[s][whole.links[s]], np.concatenate([c.ids[s][c.links[s]] for c in parts]))
    assert len(whole.count[0]) == sum(len(c.count[0]) for c in parts)


def columns(rows):
    d, s, step, own = zip(*rows, strict=True)
    return np.array(d), np.array(s), list(step), list(own)


# 13


def fingerprint_by_hand(text):
    paragraphs = [[(sha(x), len(x)) for x in re.findall(merkle.CLAUSE, p)] for p in text.split("\n")]
    digests = [sha("".join(s for s, _ in p)) for p in paragraphs]
    sections, at = [], 0
    for k, (p, d) in enumerate(zip(paragraphs, digests, strict=True), 1):
        if not p or d[0] in "01" or k == len(paragraphs):
            sections.append((sha("".join(digests[at:k])), k - at))
            at = k
    return "/".join([
        sha("".join(s for s, _ in sections)), " ".join(f"{s[:16]}:{n}" for s, n in sections), " ".join(f"{d[:16]}:{len(p)}:{sum(n for _, n in p)}" for d, p in zip(digests, paragraphs, strict=True)),
        " ".join(f"{s[:10]}:{n}" for p in paragraphs for s, n in p),
    ])


def likeness_by_hand(a, b):
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    x, y = ({t for t in p.split("/")[3].split(" ") if t} for p in (a, b))
    size = lambda z: sum(int(t.split(":")[1]) for t in z)
    return 2.0 * size(x & y) / (size(x) + size(y)) if x or y else 0.0


def test_fingerprints(spark, empty):
    rng = random.Random(3)
    rows = [(i, t) for i, t in ODD if i not in (6, None)] + [(k, "".join(rng.choice(["One clause, ", "two. ", "three\n", "\n\n", "four; ", "five"]) for _ in range(rng.randrange(50)))) for k in range(100, 160)]
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    want = set()
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, third = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - third] + texts[after][:third]
        own, other = fingerprint_by_hand(t), fingerprint_by_hand(edited)
        want.add((i, len(t), sha(edited), own, other, round(likeness_by_hand(own, other), 12), round(likeness_by_hand(own, fingerprint_by_hand(texts[after])), 12)))
    got = {(*tuple(r)[:5], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in merkle.fingerprints(frame(spark, rows)).collect()}
    assert got == want
    assert merkle.fingerprints(empty).count() == 0


def test_fingerprints_of_repeated_rows(spark):
    got = sorted(((r["doc_id"], r["n_chars"], r["near_next"]) for r in merkle.fingerprints(frame(spark, [(6, "a. b"), (6, "a. b"), (5, "z"), (None, "n")])).collect()), key=str)
    assert got == [(5, 1, 0.0), (6, 4, 0.0), (6, 4, 1.0), (None, 1, 0.0)]
    assert [(r["near_edited"], r["near_next"]) for r in merkle.fingerprints(frame(spark, [(1, "alone, abc")])).collect()] == [(pytest.approx(0.7), 1.0)]


def test_edits_are_located(spark):
    old = "First paragraph, long.\nSecond one.\n\nThird here.\nFourth."
    new = old.replace("Second one", "Second changed").replace("Fourth.", "")
    df = spark.createDataFrame([(1, old, new), (2, old, old), (3, old, ""), (4, "", old), (5, None, old)], "id long, a string, b string")
    prints = df.select("id", merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = {}
    for r in merkle.edits(prints, "id", "a", "b").collect():
        got.setdefault(r["id"], []).append(old[r["start"] : r["start"] + r["chars"]])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["Fourth.", "Second one."], 3: ["First paragraph, long.", "Fourth.", "Second one.", "Third here."]}
