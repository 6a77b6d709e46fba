"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann, bpe, common, exact_dedup, jaccard_join, license_scan, lm_score, packing, suffix_dedup, toxicity, warc
from cairn.llm.queries import BYTE_RANKS, WORD_TOKENIZER, vocabulary

SCHEMA = "doc_id long, text string, keep_id long, digest string, rep long, v string, leaf int"
ODD = [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (5, "É ünï 🙂 x"), (6, "MIT License; the GENERAL public license"), (6, "MIT License; the GENERAL public license"), (7, "word " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "x", 9, "x", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1


def test_packing(spark, empty):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_TOKENIZER)
    one = Tokenizer.from_file(path)
    rows = [*ODD, (None, "no id"), (8, "It's 10 o'clock <|endoftext|> don''t İx ΑΣ a\u0085b")]
    got = packing.pack(frame(spark, rows), path).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    for i, t in rows:
        n = len(one.encode(t or "", add_special_tokens=False).ids) + 1
        assert total[i] == n * sum(x == i for x, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_pieces_hold_the_ids_in_order(spark):
    """piece, start, length and ids_crc32 against the tokenizer's own ids; null ids and repeated rows left to the test above."""
    from tokenizers import Tokenizer

    path = vocabulary(WORD_TOKENIZER)
    one = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "word " * 5000), (5, "".join(chr(0x4E00 + n) for n in range(3000))), (6, "x" * 9000)]
    by = {}
    for r in packing.pack(frame(spark, rows), path).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*one.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        for r in pieces:
            cut = ids[r["piece"] * 2048 :][:2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * 2048, len(cut), zlib.crc32(cut.tobytes()))


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048), minlength=2049)
    made = packing.plan(counts)
    placed = np.zeros(2049, int)
    for size, _, n, *_ in made.rows:
        placed[size] += n
    assert (placed == counts).all()
    assert made.next <= 1.01 * -(-int((counts * np.arange(2049)).sum()) // 2048)


# 2


def test_archives(spark):
    rows = [(1, "u", "same"), (2, "u\nv", "same"), (3, None, None), (4, "w", ""), (None, "z", "other"), (5, "ü", "é" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, roll_bytes=1000).collect()}
    assert len(got) == len(rows)
    latest = {}
    for p, _, h in rows:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if p is None else p)
    for p, _, h in rows:
        raw = (h or "").encode()
        assert got[p]["payload_bytes"] == len(raw)
        assert got[p]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[p]["refers_to"] == (latest[h or ""] if p is not None and p < latest[h or ""] else None)
        assert got[p]["record_type"] == ("response" if got[p]["refers_to"] is None else "revisit")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert all(r["record_type"] == "response" for r in warc.archive_round_trip(pages, min_bytes=10).collect())


def test_archives_of_others(spark, tmp_path):
    records = [warc.warc_record(k, "http://x/", b"payload %d" % k, 9, "D", None if k else 1) for k in range(4)]
    one, two = b"".join(records[:2]), b"".join(records[2:])
    line = lambda k, name, at: f'com,x)/ 2020 {{"offset": "{at}", "length": "{len(records[k])}", "filename": "{name}"}}\n'
    index = line(0, "a.warc.gz", 0) + line(1, "a.warc.gz", len(records[0])) + line(3, "b.warc.gz", len(records[2])) + line(2, "b.warc.gz", 0)
    import gzip

    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", one)
        z.writestr("datapackage.json", "{}")
        z.writestr("indexes/index.cdx.gz", gzip.compress(index.encode()))
        z.writestr("archive/b.warc.gz", two)
    found = warc.read_index(str(tmp_path / "x.wacz"))
    raw = (tmp_path / "x.wacz").read_bytes()
    assert [raw[at : at + n] for _, at, n in found] == [records[k] for k in (0, 1, 3, 2)]
    refers = spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")
    with pytest.raises(Exception, match="agree with its headers"):  # the digest in these headers is not the payload's
        warc.read_archives(spark, refers).collect()


def test_equal_pages_and_long_ones(spark):
    pages = spark.createDataFrame([(1, "u", "p" * 3_000_000), (2, "u", "p" * 3_000_000), (2, "u", "p" * 3_000_000), *((k, "u", "same") for k in range(10, 2000))], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, roll_bytes=1 << 16).collect()
    assert len(got) == pages.count()
    assert {r["refers_to"] for r in got if 10 <= r["page_id"] < 1999} == {1999}
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] < 10) == [(1, "revisit", 2, 3_000_000), (2, "response", None, 3_000_000), (2, "response", None, 3_000_000)]


def test_archives_of_a_repeated_attempt(spark, tmp_path):
    """Tasks that run again, with rows in another order, leave the packages that a manifest names as they are."""
    rows = [(k, "u", f"page {k % 40}") for k in range(200)]
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = [tuple(r) for r in warc.write_archives(pages, folder, roll_bytes=2000).collect()]
    again = [tuple(r) for r in warc.write_archives(pages.orderBy(F.desc("page_id")), folder, roll_bytes=2000).collect()]
    assert not {p for p, _ in first} & {p for p, _ in again}
    for found in (first, again):
        manifest = spark.createDataFrame(found, "path string, records long")
        assert sorted(r["page_id"] for r in warc.read_archives(spark, manifest).collect()) == list(range(200))


def test_zip64_directory():
    raw = warc.package([("urn:page:1", warc.warc_record(1, "u", b"payload", 7, "D", None))])
    # The same package with a ZIP64 end record: the plain one's fields are full.
    at = raw.rfind(warc.END)
    entries, length, start = (int.from_bytes(raw[at + a : at + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    wide = warc.END64 + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + bytes(8) + entries.to_bytes(8, "little") * 2 + length.to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = warc.LOCATOR64 + bytes(4) + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
    end = warc.END + bytes(4) + b"\xff\xff" * 2 + b"\xff" * 8 + bytes(2)
    big = raw[:at] + wide + locator + end
    members = warc.zip_members(io.BytesIO(big), len(big))
    assert members == warc.zip_members(io.BytesIO(raw), len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        start = warc.stored_start(io.BytesIO(raw), members[warc.ARCHIVE])
        assert raw[start : start + members[warc.ARCHIVE][1]] == z.read(warc.ARCHIVE)


# 3


def test_byte_bpe(spark, empty):
    import public_tokenizers

    path = vocabulary(BYTE_RANKS)
    enc = bpe.encoding(path, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    rows = [*ODD, (9, "".join(rnd.choice(["a", " ", "  ", "\n", "'s", "é", "1", "!", "\t\t "]) for _ in range(5000))), (10, "x" * 3000)]
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(frame(spark, rows), path, public_tokenizers.PATTERN, piece_chars=64).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    decoded = bpe.decode_documents(bpe.encode_documents(frame(spark, rows), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in decoded.collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip_digests(empty, path, public_tokenizers.PATTERN).count() == 0


# 4


def test_exact_dedup(spark, empty):
    rows = [*ODD, (8, "a\t\n b"), (0, " "), (9, " a b"), (None, "alone")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        if r["doc_id"] is not None:
            same = [i for i, t in rows if norm(t) == norm(dict(rows)[r["doc_id"]])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["doc_id"] == min(same))
            assert r["text_sha256"] == hashlib.sha256(norm(dict(rows)[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_goes_by_content(spark, monkeypatch):

    monkeypatch.setattr(exact_dedup, "digest", lambda body: F.length(body).cast("string"))  # many texts share one digest
    rows = [(i, f"t{i % 7}") for i in range(200)] + [(500 + i, "hot  text") for i in range(3000)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, rows).repartition(7)).collect()}
    assert all((got[i]["keep_id"], got[i]["group_size"]) == (i % 7, len(range(i % 7, 200, 7))) for i in range(200))
    assert all((got[i]["keep_id"], got[i]["group_size"]) == (500, 3000) for i in range(500, 3500))


# 5


def brute_decode(model, token):
    """Best reading over all paths, without dynamic programming."""
    paths, previous = [(0.0, "")], ""
    for c in token:
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(r, 0.7) for r in toxicity.LEET.get(c, "")]
        options += [("", 0.4)] * (c == previous) + [("", 0.5)] * (c in toxicity.SEPARATORS or not c.isalnum())
        paths = [(cost + price, text + r) for cost, text in paths for r, price in options or [("", 2.0)]]
        previous = c

    def loss(text):
        p = f"^^{text}$"
        return sum(model.step(*p[i : i + 3]) for i in range(len(p) - 2))

    return min(cost + loss(text) for cost, text in paths), {text: cost + loss(text) for cost, text in sorted(paths, reverse=True)}


def test_decoder_finds_the_best_path(spark):
    docs = frame(spark, [(k, "an idiot and a fool sat on the old wall together, so silly") for k in range(5)] + [(9, None)])
    model = toxicity.CharModel(toxicity.trigrams(docs))
    for token in ("1d10t", "f00l", "s!lly", "i d-i o.t", "siiilly", "@ll", "7|_", "x9*"):
        best, costs = brute_decode(model, token)
        assert abs(costs[model.decode(token)] - best) < 1e-9


def test_trigrams_by_arrays():
    from collections import Counter

    rnd = random.Random(7)
    for text in ("", "a", "ab c", " x\ny1z_w ", "é'ü 🙂 語文", "".join(rnd.choice("abé ü1_-\n語") for _ in range(5000))):
        want: Counter = Counter()
        for w in toxicity.WORD.findall(text):
            p = f"^^{w}$"
            want.update(p[i : i + 3] for i in range(len(p) - 2))
        got = toxicity.counted(text)
        assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == dict(want)


def test_trigrams_are_bounded(spark):
    rows = [(k, "".join(chr(0x4E00 + (k * 37 + j) % 3000) for j in range(200)) + " word word") for k in range(40)]
    grams = toxicity.trigrams(frame(spark, rows))
    assert len({c for g in grams for c in g}) <= toxicity.ALPHABET and toxicity.OTHER * 3 in grams
    assert grams["^^w"] == 80 and sum(n for g, n in grams.items() if g.endswith("$")) == 120


def test_toxicity_on_mostly_toxic_labels(spark):
    from zlib import crc32

    rows = [(i, f"idiot word{i % 50} text" if i % 4 else f"word{i % 50} text") for i in range(3000)] + [(None, "idiot"), (4000, "idiot " * 50_000), (1, "idiot word1 text")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(3000)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    df = frame(spark, rows)
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", toxicity.held_out(df["doc_id"]).alias("h")).collect()}
    assert all(h == (i is None or crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_toxicity(spark, empty):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rnd.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 8 == 0
        rows.append((i, " ".join(rnd.choices(words, k=40) + (["idiot", "worthless"] if bad else []))))
        marks.append((i, int(bad), 1))
    rows += [(9001, "you are an 1d10t and so w0rthle$$"), (9002, "what an i d i o t they said"), (9003, None), (9004, ""), (9005, "call 0800 123 or pay $5 to win!!!"), (9006, "an idiooot he was")]
    labels = spark.createDataFrame([*marks, (9003, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert all(got[i]["predicted"] == m for i, m, _ in marks)
    assert [got[i]["predicted"] for i in (9001, 9002, 9003, 9004, 9005, 9006)] == [1, 1, 0, 0, 0, 1]
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, rows[:5]), labels.limit(0)).collect()} == {0}


# 6


def brute_repeats(docs, n=100):
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                mark[i : i + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        out[d] = (len(raw), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_suffix_dedup(spark, empty, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rnd = random.Random(6)
    rows = [*ODD[:6], (12, "word " * 30_000), (7, "ab" * 400), (8, "ab" * 350), (9, "x" * 99), (10, "x" * 250)]
    rows += [(20 + i, "".join(rnd.choice(["aab", "abab ", "b", "é"]) for _ in range(rnd.randint(0, 150)))) for i in range(40)]
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    for i in range(30):
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        a = rnd.randint(0, 300)
        rows.append((100 + i, "".join(t)[a : a + rnd.randint(50, 1400)]))
    # One line, shorter than the length, in many texts between other characters: its buckets go on through all rounds.
    line = "".join(rnd.choice("lmnopq ") for _ in range(90))
    rows += [(500 + i, "".join(rnd.choice("ab") for _ in range(30)) + line + "".join(rnd.choice("ab") for _ in range(30))) for i in range(300)]
    found = suffix_dedup.digests(suffix_dedup.suffix_dedup(frame(spark, [*rows, rows[0], rows[-1], (20, None), (None, "x" * 500)]).repartition(5)))
    dict_rows = dict(rows) | {20: ""}
    got = [tuple(r) for r in found.collect()]
    assert {r[0]: r[1:] for r in got} == brute_repeats(dict_rows)
    assert len(got) == len(dict_rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.widths(76) == [38, 10, 3, 1]


# 7


def test_nearest(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(600, 16)).astype(np.float32)
    m[100:140] = m[0]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(m)] + [(900, None, 1), (950, [0.0] * 16, 1), (1000, [float("nan")] * 16, 1), (1050, [None] * 16, 1), (1100, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")

    got = ann.nearest(df, F.col("vec_id") % 50 == 0, branching=4, leaf_size=50, block=64).collect()
    x = m.astype(float)
    n = np.sqrt((x * x).sum(axis=1))
    hits = 0
    for q in range(0, 600, 50):
        score = (x * x[q]).sum(axis=1) / (n * n[q])
        want = [int(i) for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want))
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert hits >= 0.9 * 60
    assert {r["query_id"] for r in got} == set(range(0, 600, 50))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_in_small_leaves(spark):

    rng = np.random.default_rng(8)
    m = np.concatenate([np.tile(rng.normal(size=16), (600, 1)), rng.normal(size=16) + 0.01 * rng.normal(size=(300, 16)), 3 * rng.normal(size=(4, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, (F.col("vec_id") < 200) | (F.col("vec_id") >= 900), branching=4, leaf_size=50).collect()
    assert {q: sum(r["query_id"] == q for r in got) for q in (0, 900, 901, 902, 903)} == dict.fromkeys((0, 900, 901, 902, 903), 5)
    # 9 of 10 queries are done at once, the tenth late.
    when = [[0] * 5] * 90 + [[6] * 5] * 10
    assert ann.visits_for(when, 0.8) == 7
    assert ann.visits_for([[0, 0, 0, 0, 9]] * 20, 0.8) == 1


# 8


def test_license_scan(spark, empty):
    mit = license_scan.PASSAGES[0][0]
    rows = [*ODD, (8, "x MIT-license, mit LICENSE!"), (9, "General public\nLicense general public"), (10, mit.replace("free of", "free, really, of")), (None, "apache license")]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r["doc_id"]] or ""
        w = re.findall(license_scan.WORD, t.translate({i: i + 32 for i in range(65, 91)}))
        at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
    assert {r["doc_id"]: r["labels"] for r in got}[10] == "mit-text"
    assert license_scan.license_scan(empty).count() == 0


def test_license_words_are_compared(spark, monkeypatch):
    """Where hashes agree by chance, words decide."""
    docs = frame(spark, [(1, "an mit license and a general public license, a public license"), (2, "mit x license general public x license"), (3, license_scan.PASSAGES[3][0]), (4, " ".join(f"w{n}" for n in range(300)))])
    right = sorted(license_scan.license_scan(docs).collect())
    assert [(r["n_base"], r["labels"]) for r in right] == [(2, "gpl,mit"), (0, ""), (0, "bsd-text"), (0, "")]
    for name in ("bigrams", "fourgrams"):
        plain = getattr(license_scan, name)
        monkeypatch.setattr(license_scan, name, lambda c, plain=plain: F.transform(plain(c), lambda x: F.pmod(x, F.lit(7)) + 1))
    weak = sorted(license_scan.license_scan(docs).collect())
    assert [r[:6] for r in weak] == [r[:6] for r in right]


# 9


def test_lm_score(spark, empty):
    rows = [(i, "red green blue red green blue") for i in range(10)] + [(20 + i, "one two three four five") for i in range(10)] + [(50, None), (51, ""), (None, "red green")]
    ids = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(frame(spark, rows), ids).collect()}
    assert got[0]["score"] > 0 > got[20]["score"]
    assert (got[50]["n_tokens"], got[50]["score"], got[51]["score"]) == (0, 0.0, 0.0)
    # One loss by hand: "red" at a start, in the target model.
    n, v = 60, 1 << 18
    first = -np.log(0.6 * 1 + 0.4 * (20 + 1) / (n + v))
    rest = [-np.log(0.6 * 1 + 0.4 * (20 + 1) / (n + v))] * 5
    assert abs(got[0]["target_loss"] - np.mean([first, *rest])) < 1e-9
    assert lm_score.cross_entropy_difference(empty, ids).count() == 0


@pytest.mark.parametrize("word", ["word", "w" * 300])
def test_lm_score_chunk_takes_little_memory(word):
    """A chunk's keys are found in a few times the text's size, also where a word is very long."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 30000, 400))) + " " + word for _ in range(2000)]
    table = pa.table({"text": pa.array(texts)})
    tracemalloc.start()
    try:
        out = lm_score.ask(table, np.arange(len(texts)) % 3 == 0, 0, 8, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 10
    assert peak < 12 * sum(map(len, texts))


def test_lm_score_counts_are_exact(spark):
    from collections import Counter

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{k}" for k in (rng.pareto(0.4, 4000) * 50 % 500_000).astype(int))) for i in range(300)]
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(frame(spark, rows), ids).collect()}
    small = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(frame(spark, rows), ids, chunk=1 << 18, bucket=1 << 19).collect()}
    texts = {d: t.split() for d, t in rows}
    v = max(1 << 18, len({w for t in texts.values() for w in t}))
    for column, part in (("target_loss", range(0, 300, 3)), ("background_loss", range(300))):
        one = Counter(w for d in part for w in texts[d])
        two = Counter(p for d in part for p in zip(["", *texts[d]], texts[d], strict=False))
        history = Counter(w for d in part for w in ["", *texts[d][:-1]])
        n = sum(one.values())
        for d in (0, 1, 150, 299):
            loss = []
            for a, b in zip(["", *texts[d]], texts[d], strict=False):
                w = 0.6 if history[a] else 0.0
                loss.append(-np.log(w * two[a, b] / max(history[a], 1) + (1 - w) * (one[b] + 1) / (n + v)))
            assert abs(got[d][column] - np.mean(loss)) < 1e-9
            assert abs(small[d][column] - np.mean(loss)) < 1e-9
    few = frame(spark, [*ODD, (None, "a b"), (None, "b a c"), (None, None), (40, "a b c a"), (40, "a b c a")])
    ids = spark.createDataFrame([(40,), (1,), *((k,) for k in range(900, 960))], "doc_id long")
    one, many = (sorted((r[0] or -1, r[1], *(round(x, 9) for x in r[2:])) for r in lm_score.cross_entropy_difference(few, ids, chunk=c, bucket=c).collect()) for c in (1 << 20, 8))
    assert one == many and len(one) == few.count()


# 10


def brute_join(docs, n=5):
    sets = {}
    for d, t in docs.items():
        w = re.findall(license_scan.WORD, (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    links = {d: {e for e in docs if e != d and sets[d] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) - 1e-9} for d in docs}
    group = {}
    for d in sorted(docs):
        todo = [d] if d not in group else []
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = d
                todo += links[x]
    return {d: (group[d], len(links[d])) for d in docs}


@pytest.mark.parametrize(("cell", "shingles", "small"), [(2048, 1 << 20, 64), (16, 1 << 20, 4), (2048, 700, 4)])
def test_jaccard_join(spark, empty, cell, shingles, small):
    rnd = random.Random(10)
    vocabulary_ = [f"w{k}" for k in range(2000)]
    rows = [*ODD[:6], (7, "A B!"), (8, "a, b"), (9, "word " * 30_000), (10, "word " * 30_000 + "end")]
    at = 20
    for size in (2, 3, 40, 80):
        base = rnd.choices(vocabulary_, k=rnd.randint(20, 120))
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary_)
            rows.append((at, " ".join(t)))
            at += 1
    passage = rnd.choices(vocabulary_, k=60)
    rows += [(at + k, " ".join(rnd.choices(vocabulary_, k=40) + passage)) for k in range(60)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(frame(spark, [*rows, rows[-1], (None, "x y")]), cell=cell, cell_shingles=shingles, small=small).collect()}
    assert got == brute_join(dict(rows))
    assert jaccard_join.jaccard_join(empty).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_runs_reach_the_target(spark, threshold):
    width, depth, target = 2, 4, 0.9999
    runs = jaccard_join.runs_for(target, threshold, width, depth)
    places = [jaccard_join.place_of(r, level, k, width, depth) for r in range(runs) for level in range(depth) for k in range(width)]
    assert sorted(places) == list(range(runs * depth * width))
    signed = jaccard_join.signatures(frame(spark, [(1, "a b c d e f g")]), 5, len(places)).first()
    assert len(set(signed["sketch"])) > 1 and len(signed["sketch"]) == len(places)
    # Two sets stay together where, at every level, one of the coordinates that all its nodes share agrees.
    agree = np.random.default_rng(3).random((100_000, depth, width)) < threshold
    together = agree.any(axis=2).all(axis=1).mean()
    assert abs(jaccard_join.survival(threshold, width, depth) - together) < 0.01
    assert (1 - jaccard_join.survival(threshold, width, depth)) ** runs <= 1 - target


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_sieve_follows_the_threshold(threshold):
    runs = jaccard_join.runs_for(0.9999, threshold, 2, 4)
    equal = np.random.default_rng(4).binomial(runs * 8, threshold, 1_000_000)
    assert (equal < jaccard_join.least_for(threshold, runs * 8, 1e-6)).mean() < 1e-5
    assert (equal < jaccard_join.least_for(threshold, runs * 8, 1e-2) + 1).mean() > 0.009


def test_long_words_hash_alike():
    t = "short " + "é" * 400 + " short"
    a = jaccard_join.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    b = jaccard_join.word_hashes(np.frombuffer(b"x short", np.uint8), np.array([0, 7]))[0]
    assert a[0] == a[2] == b[1]


def test_unique_docs(spark):
    rows = common.unique_docs(frame(spark, [(1, "b"), (1, "a"), (2, None), (None, "c")])).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "a"), (2, "")]


@pytest.mark.parametrize("kind", [np.uint64, np.int64])
@pytest.mark.parametrize("split", [0, 4])
def test_shared_counts(kind, split):
    rng = np.random.default_rng(5)
    pool = rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, 300, dtype=kind)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 40, 200, 300, 7, 0, 150)]
    left, right = (sets[:split], sets[split:]) if split else (sets, sets)
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    for at_once in (1, 50, 1 << 20):
        got = jaccard_join.shared_counts(sets, split, columns=16, at_once=at_once)
        # Values of one set alone are left out of the count, but for a set with itself.
        both = np.array(want)
        if not split:
            np.fill_diagonal(both, 0)
            np.fill_diagonal(got, 0)
        assert (got == both).all()
