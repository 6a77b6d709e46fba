"""Fill-in-the-middle transformation: texts cut in three by code points and put in another order.

A text is kept as UTF-8 bytes beside its runs: maximal stretches of characters
of one class, which is here the number of bytes that a character takes. Each
run has the count of characters and of bytes before it, so a cut behind the
u-th character is found by binary search among the runs and one multiplication
within its run; no text is decoded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import long_bytes, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a character by its first byte; 0 for bytes inside one.
WIDTH = np.zeros(256, np.uint8)
WIDTH[:0x80], WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 1, 2, 3, 4


class Runs:
    """Runs of characters of one width: characters and bytes before each, and the width; with the text's end as a last one."""

    def __init__(self, data: np.ndarray):
        width = WIDTH[data]
        at = np.flatnonzero(width)
        of = width[at]
        first = np.flatnonzero(np.diff(of, prepend=np.uint8(0)))
        self.units = np.append(first, len(at))
        self.bytes = np.append(at[first], len(data))
        self.width = np.append(of[first], 1)

    def __len__(self) -> int:
        """Characters of the text."""
        return int(self.units[-1])

    def offset(self, unit: int) -> int:
        """Where in the bytes the text's first `unit` characters end."""
        run = int(np.searchsorted(self.units, unit, side="right")) - 1
        return int(self.bytes[run] + (unit - self.units[run]) * self.width[run])


def draws(doc_id: int | None, salt: str = "1:") -> list[int]:
    """Four numbers of 32 bits that follow from the id alone (a null id counts as an empty one)."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arranged(text: bytes, runs: Runs, doc_id: int | None, rate: int = 90, spm: int = 20) -> tuple[bytes, str, int | None, int | None]:
    """(output, form, characters of the prefix, characters of the middle) of one text."""
    one, two, three, four = draws(doc_id)
    if not text or three % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", None, None
    low, high = sorted((one % (len(runs) + 1), two % (len(runs) + 1)))
    i, j = runs.offset(low), runs.offset(high)
    if four % 100 < spm:
        return SUFFIX + text[j:] + PREFIX + text[:i] + MIDDLE + text[i:j], "spm", low, high - low
    return PREFIX + text[:i] + SUFFIX + text[j:] + MIDDLE + text[i:j], "psm", low, high - low


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row.

    `rate` of 100 texts are arranged, `spm` of 100 of those with the suffix
    first; which ones, and where they are cut, follows from doc_id alone, so
    repeated rows come out alike. Null and empty texts and such as hold a
    marker stay plain, with null lengths. A null doc_id is drawn for as an empty
    one. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, at = long_bytes(b.column("text"))
            n, made = [], []
            for k, i in enumerate(b.column("doc_id").to_pylist()):
                own = data[at[k] : at[k + 1]]
                runs = Runs(own)
                n.append(len(runs))
                made.append(arranged(own.tobytes(), runs, i, rate, spm))
            output, form, prefix, middle = zip(*made, strict=True) if made else ((), (), (), ())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: its parts lie between the markers, which no arranged text holds itself."""
    three = F.lit(3)
    after = lambda marker: F.locate(marker, output)
    part = lambda start, end: F.substring(output, start + three, end - start - three)
    rest = lambda start: F.substring(output, start + three, F.length(output))
    p, s, m = after("<P>"), after("<S>"), after("<M>")
    psm = F.concat(part(p, s), rest(m), part(s, m))
    spm = F.concat(part(p, m), rest(m), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle's rows with digests of the output and of the text rebuilt from it."""
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
