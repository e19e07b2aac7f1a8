"""Fill-in-middle: a wavelet matrix over character classes counts units and locates both cuts of every text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Classes of a code point: a letter A-Z a-z after another, a letter that begins a run, white space, anything else.
INSIDE, FIRST, SPACE, OTHER = range(4)
CLASS_BITS = 2
#: Classes whose code points begin a unit: runs of letters and single others; single code points; words alone.
TOKENS, CHARACTERS, WORDS = (FIRST, SPACE, OTHER), (INSIDE, FIRST, SPACE, OTHER), (FIRST,)

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text that share a matrix (a longer text has its own); it takes some 20 bytes a code point while it is made.
SLICE_BYTES = 2_000_000


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, for many positions at once.

    Level by level from the highest bit, the symbols are parted stably into zeros and ones. A level
    keeps its bits in 64-bit words with the ones before each word, so a rank is a look-up and a
    population count a level.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits = len(symbols), bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
            self.levels.append((words, before, self.size - int(before[-1])))

    def rank(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``ends`` symbols."""
        left, right = np.zeros(1, np.int64), np.asarray(ends, np.int64)
        for level, (words, before, zeros) in enumerate(self.levels):
            left_ones, right_ones = _ones(words, before, left), _ones(words, before, right)
            if symbol >> (self.bits - 1 - level) & 1:
                left, right = zeros + left_ones, zeros + right_ones
            else:
                left, right = left - left_ones, right - right_ones
        return right - left

    def begun(self, starters: tuple[int, ...], ends: np.ndarray) -> np.ndarray:
        """Units that begin among the first ``ends`` symbols: the ranks of the classes that begin one."""
        return sum(self.rank(symbol, ends) for symbol in starters)

    def cut(self, starters: tuple[int, ...], first: np.ndarray, last: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The furthest position in [first, last] before which at most ``units`` units begin, counted from
        ``first``: where those units end. Found by bisection on the ranks."""
        low, high = first.astype(np.int64), last.astype(np.int64)
        most = self.begun(starters, low) + units
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.begun(starters, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _ones(words: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at, rest = ends >> 6, (ends & 63).astype(np.uint64)
    mask = (np.uint64(1) << rest) - np.uint64(1)
    return before[at] + np.bitwise_count(words[at] & mask)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point of the texts on end, and where each text begins (with the end of all)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    space = (points == 32) | ((points - np.uint32(9)) < 5)
    goes_on = letter.copy()
    goes_on[1:] &= letter[:-1]
    goes_on[bounds[:-1][bounds[:-1] < len(points)]] = False
    out = np.full(len(points), OTHER, np.uint8)
    out[space] = SPACE
    out[letter] = FIRST
    out[goes_on] = INSIDE
    return out, bounds


def draws(key, seed: str = "1:") -> list[int]:
    """Four unsigned 32-bit numbers from the hash of the seed and the decimal key (null: no digits)."""
    text = hashlib.sha256(f"{seed}{'' if key is None else key}".encode()).hexdigest()
    return [int(text[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1:", starters: tuple[int, ...] = TOKENS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every whole text cut into prefix, middle and suffix.

    ``n`` is the number of units of a text, by default runs of ASCII letters and single other code
    points. Both cuts stand after a number of units drawn from the hash of ``seed`` and doc_id, so they
    are the same in every run. The form is plain (the text as it is, lengths null) for an empty text,
    one that holds a mark, or ``plain_percent`` of the others by hash; else spm for ``spm_percent`` of
    the rest, psm for the others.

    Null text is empty, hence plain. A null doc_id is drawn like an empty one. Repeated rows give
    repeated rows, an empty table none; further columns of ``docs`` never reach Python, so their names
    do not matter. Texts share a matrix up to SLICE_BYTES; a longer text is one task's work and memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            symbols, bounds = classes(texts)
            matrix = WaveletMatrix(symbols, CLASS_BITS)
            first, last = bounds[:-1], bounds[1:]
            units = matrix.begun(starters, last) - matrix.begun(starters, first)
            numbers = [draws(k, seed) for k in keys]
            ends = np.array([[h[0] % (n + 1), h[1] % (n + 1)] for h, n in zip(numbers, units.tolist())], np.int64)
            ends.sort(axis=1)
            a = (matrix.cut(starters, first, last, ends[:, 0]) - first).tolist()
            b = (matrix.cut(starters, first, last, ends[:, 1]) - first).tolist()
            forms, outputs = [], []
            for text, h, i, j in zip(texts, numbers, a, b):
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= 100 - plain_percent:
                    forms.append("plain")
                    outputs.append(text)
                elif h[3] % 100 < spm_percent:
                    forms.append("spm")
                    outputs.append("".join((SUFFIX, text[j:], PREFIX, text[:i], MIDDLE, text[i:j])))
                else:
                    forms.append("psm")
                    outputs.append("".join((PREFIX, text[:i], SUFFIX, text[j:], MIDDLE, text[i:j])))
            prefix = [None if f == "plain" else i for f, i in zip(forms, a)]
            middle = [None if f == "plain" else j - i for f, i, j in zip(forms, a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: a text with marks is never cut, so each mark is there once."""
    psm = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{SUFFIX}|{MIDDLE}", 3)
    spm = F.split(F.substring(output, len(SUFFIX) + 1, 2**31 - 1), f"{PREFIX}|{MIDDLE}", 3)
    joined = F.when(form == "psm", F.concat(F.get(psm, 0), F.get(psm, 2), F.get(psm, 1)))
    return joined.when(form == "spm", F.concat(F.get(spm, 1), F.get(spm, 2), F.get(spm, 0))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    rebuilt = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256")
    )
