"""Toxicity scores of text restored by a noisy-channel decoder.

Words whose spelling looks disguised (symbols and digits between letters,
letters set apart, letters repeated) are lattices: each character may stand for
itself, for the letters it is used for, or for nothing. A Viterbi search under a
character trigram model finds the likeliest reading. A text's evidence is the
features (words and word beginnings) of what is written and of what is read;
each feature has a cautious estimate of how often texts with it are toxic.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import give_back, materialize, small_batches

#: What characters commonly stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l", "*": "aeiou", "#": "h"}
SEPARATORS = set("._-*~'`,:;/\\|^ \t\n")
WORD = regex.compile(r"[^\W\d_]+")
EDGE = "".join(c for c in "!.,;:?\"'()[]{}<>*#%&$+-_=/\\|~^`…«»“”„‚’")
SPACED = regex.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?!\S)")
REPEATED = regex.compile(r"(.)\1\1")
ALPHABET = 64  # characters the model tells apart; others share one place
OTHER = "\ufffd"  # stands for those in trigrams


def disguised(token: str) -> bool:
    """Letters with a symbol or digit between them, or one character three times in a row."""
    core = token.strip(EDGE)
    if core.isalpha():
        return REPEATED.search(core) is not None
    letters = sum(c.isalpha() for c in token)
    return letters >= 1 and len(token) > 2 and any(c in LEET or c in SEPARATORS for c in (core if letters > 1 else token))


class CharModel:
    """Interpolated character trigrams; ^ stands before and $ after a word."""

    def __init__(self, counts: dict[str, int]) -> None:
        singles: Counter = Counter()
        for gram, n in counts.items():
            if gram[2] != OTHER:
                singles[gram[2]] += n
        self.index = {c: k + 1 for k, (c, _) in enumerate(sorted(singles.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 2])}
        self.index.setdefault("^", ALPHABET - 1)
        three = np.zeros((ALPHABET, ALPHABET, ALPHABET))
        for gram, n in counts.items():
            three[tuple(self.index.get(c, 0) for c in gram)] += n
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * ALPHABET)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)
        self.loss = -np.log(p3)

    def step(self, a: str, b: str, c: str) -> float:
        i = self.index
        return float(self.loss[i.get(a, 0), i.get(b, 0), i.get(c, 0)])

    def decode(self, token: str) -> str:
        """Likeliest reading of a disguised token by Viterbi search; a state is the last two characters read."""
        states: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
        previous = ""
        for c in token:
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
            for r in LEET.get(c, ""):
                options.append((r, 0.7))
            if c == previous:
                options.append(("", 0.4))
            if c in SEPARATORS or not c.isalnum():
                options.append(("", 0.5))
            if not options:
                options.append(("", 2.0))
            new: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for r, price in options:
                    state = (b, r) if r else (a, b)
                    total = cost + price + (self.step(a, b, r) if r else 0.0)
                    if state not in new or total < new[state][0]:
                        new[state] = (total, text + r)
            states, previous = new, c
        return min((cost + self.step(a, b, "$"), text) for (a, b), (cost, text) in states.items())[1]


def features(word: str) -> list[str]:
    """The word itself and its beginnings of 4 to 6 letters."""
    return [f"w {word}", *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def lower_bound(hits: int, n: int, z: float = 2.0) -> float:
    """Wilson's lower bound of a share."""
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class Scorer:
    """Scores texts; what tokens and words amount to is kept, up to a bound."""

    MOST = 200_000

    def __init__(self, strength: dict[str, float], trigrams: dict[str, int]) -> None:
        self.strength, self.model = strength, CharModel(trigrams)
        self.tokens: dict[str, tuple] = {}

    def word(self, word: str) -> float:
        return max(self.strength.get(f, 0.0) for f in features(word))

    def evidence(self, token: str) -> tuple:
        """(word, strength) of a token's words and of its reading that say anything."""
        low = token.lower()
        words = set(WORD.findall(low))
        if disguised(low):
            words |= set(WORD.findall(self.model.decode(low)))
            words |= set(WORD.findall(self.model.decode(low.strip(EDGE))))
        return tuple((w, s) for w in words if (s := self.word(w)) > 0)

    def score(self, text: str) -> float:
        found: dict[str, float] = {}
        if len(self.tokens) > self.MOST:
            self.tokens.clear()
        kept = self.tokens
        for token in set(text.split()):
            got = kept.get(token)
            if got is None:
                got = kept[token] = self.evidence(token)
            if got:
                found.update(got)
        for m in SPACED.finditer(text):
            found.update(self.evidence(m[0]))
        if not found:
            return 0.01
        top = max(found.values())
        if top < 0.5:
            return max(0.01, top)
        miss = 1.0
        for s in found.values():
            if s >= 0.5:
                miss *= 1 - s
        return min(1.0, max(top, 1 - miss))


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text is divisible by 5. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


PLANES = 0x30000  # code points that the table of letters has


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point is in words; those past the table are taken for letters, as nearly all of them are."""
    table = np.zeros(PLANES + 1, bool)
    table[[ord(c) for c in WORD.findall("\n".join(map(chr, range(PLANES))))]] = True
    table[PLANES] = True
    return table


def counted(text: str) -> pa.RecordBatch:
    """(name, n): trigrams of the words of a text, ^^ before and $ after each, over arrays of its characters."""
    codes = np.concatenate([[10], np.frombuffer(text.encode("utf-32-le"), np.uint32), [10]]).astype(np.int64)
    inside = letters()[np.minimum(codes, PLANES)]
    codes[~inside] = ord("^")
    found, ids = np.unique(codes, return_inverse=True) if len(codes) < 1000 else _ranked(codes)
    at = np.flatnonzero(inside)
    start, end = ~inside[at - 1], at[~inside[at + 1]]
    edge = np.searchsorted(found, ord("^"))
    before = np.where(start, edge, ids[at - 2])
    n = np.int64(len(found) + 1)  # the last place is for $
    keys = np.concatenate([(before * n + ids[at - 1]) * n + ids[at], (ids[end - 1] * n + ids[end]) * n + len(found)])
    if n**3 <= 1 << 22:
        total = np.bincount(keys, minlength=int(n**3))
        keys = np.flatnonzero(total)
        total = total[keys]
    else:
        keys, total = np.unique(keys, return_counts=True)
    names = [*map(chr, found), "$"]
    grams = [names[k // (n * n)] + names[k // n % n] + names[k % n] for k in keys.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total, pa.int64())], ["name", "n"])


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different code points in order and each one's rank, as np.unique gives them, without sorting."""
    there = np.bincount(codes) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[codes]


def trigrams(docs: DataFrame) -> dict[str, int]:
    """Character trigrams of the words of all documents, with how often the words have them.

    Characters beyond the most frequent ones are one, so the result has at most
    ALPHABET ** 3 entries whatever the corpus.
    """

    def count(batches):
        for b in batches:
            held, size = [], 0
            for text in b.column("text").to_pylist():
                held.append((text or "").lower())
                size += len(held[-1])
                if size > 1 << 20:
                    yield counted("\n".join(held))
                    held, size = [], 0
            if held:
                yield counted("\n".join(held))

    small_batches(docs.sparkSession)
    every = materialize(docs.select("text").mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")), "trigrams")
    top = every.groupBy(F.substring("name", 3, 1).alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(ALPHABET - 2).collect()
    known = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({"^", *(r["c"] for r in top)}))
    folded = every.groupBy(F.regexp_replace("name", f"[^{known}]", OTHER).alias("name")).agg(F.sum("n").alias("n"))
    return dict(folded.collect())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> tuple[dict[str, float], dict[str, int]]:
    """Feature strengths from at most max_rows labelled rows that are not held out, and character trigrams of all documents.

    Labels with a null doc_id or toxic value are left out; of several labels of
    a document the largest counts. With no such rows no strengths are learnt.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def count(batches):
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, mark in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                (toxic if mark else clean).update({f for w in words for f in features(w)})
        rows = [(x, toxic[x], clean[x]) for x in sorted(toxic.keys() | clean.keys())]
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "toxic", "clean"])

    small_batches(spark)
    counts = texts.join(marks, "doc_id").select("text", "toxic").mapInArrow(count, "name string, toxic long, clean long")
    total = counts.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic > 2 * clean")
    # At most what max_rows texts hold, and of features only those that lean to toxic texts.
    strength = {}
    rows = total.collect()
    share = marks.agg(F.avg("toxic")).first()[0] or 0.5
    for name, hits, clean in rows:
        if (s := lower_bound(hits, hits + clean)) >= 0.2:
            # So many features are tried that some meet toxic texts only by chance: such ones stay under the threshold.
            n = hits + clean
            chance = math.log(len(rows)) + math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(clean + 1) + hits * math.log(share)
            strength[name] = s if chance < math.log(0.05) else min(s, 0.45)
    strong = {f for f, s in strength.items() if s >= 0.5}

    def own(batches):
        for b in batches:
            lists = [sorted({f for w in set(WORD.findall((t or "").lower())) for f in features(w)} & strong) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["found"])

    toxic = texts.join(marks.filter("toxic > 0"), "doc_id").select("text").distinct()
    lists = [r["found"] for r in toxic.mapInArrow(own, "found array<string>").collect()]  # of at most max_rows texts
    return covering(strength, lists), trigrams(docs)


def covering(strength: dict[str, float], lists: list[list[str]]) -> dict[str, float]:
    """Strong features stay strong only where they explain toxic texts of their own, or go with different other ones.

    Copies of a toxic text share all of its words; those beside the words that
    make it toxic would else look as strong as these.
    """
    where: dict[str, list[int]] = {}
    for k, found in enumerate(lists):
        for f in found:
            where.setdefault(f, []).append(k)
    reasons: list[set[str]] = [set() for _ in lists]
    out = dict(strength)
    for f in sorted((f for f, s in strength.items() if s >= 0.5), key=lambda f: (-strength[f], len(f), f)):
        docs = where.get(f, [])
        fresh = sum(not reasons[k] for k in docs)
        kinds = len({frozenset(reasons[k]) for k in docs})
        if fresh >= max(3, 0.05 * len(docs)) or kinds >= 4:
            for k in docs:
                reasons[k].add(f)
        else:
            out[f] = 0.45
    return out


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from 0.5 up).

    Only the text is an input of a score. Null and empty texts score 0.01, the
    least there is. Repeated rows and null ids each get a row of their own;
    other columns are ignored; an empty table gives an empty result.
    """
    strength, grams = fit(docs, labels, max_rows)
    learnt = docs.sparkSession.sparkContext.broadcast((strength, grams))

    def run(batches):
        scorer = Scorer(*learnt.value)
        for b in batches:
            score = np.array([scorer.score(t or "") for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        del scorer
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double, predicted int")
