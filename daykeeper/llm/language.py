"""Language of a text by a string kernel: blended n-gram presence, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-grams of 1 to ORDERS characters fall into 2 ** BITS places; a text's set holds the places it fills.
ORDERS = 4
BITS = 17
#: Rows that the model is fitted on at most, of each language and in all (more only beyond so many languages).
FIT_PER_LANGUAGE = 300
FIT_ROWS = 6_000
#: Characters of all these rows together; each gives an even share at most, from its first letter on.
FIT_CHARS = 60_000_000
LANDMARKS = 96
RIDGE = 1e-3
UNKNOWN = "und"
#: What ``accept`` turns away scores under LEAST_SCORE, or under half of what 95 % of the language's held-out
#: rows reach, if that is less. Texts of under JUDGED_PLACES places are not judged, nor are languages with
#: under HELD_ROWS held-out rows. On held-out rows of sf0.1 the least clean text of 60 places had 0.25, random
#: letters had 0.16 at most.
LEAST_SCORE = 0.17
JUDGED_PLACES = 60
HELD_ROWS = 10

_SPACE = 0x20


def _letters() -> np.ndarray:
    """Per code point below U+10000: itself for a letter or mark (lower case), else a space."""
    table = np.full(0x10000, _SPACE, np.uint32)
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points, a single space for anything but letters; whether there is a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be"), np.uint32)
    high = raw >= 0x10000
    out = _TABLE[0][np.minimum(raw, 0xFFFF)]
    if high.any():
        out = np.where(high, raw, out)
    keep = out != _SPACE
    keep[1:] |= out[:-1] != _SPACE
    return out[keep], has_letter(text)


def presence(text: str, flags: np.ndarray) -> bool:
    """Sets the places of the text's n-grams in ``flags``; False if the text has no letter."""
    codes, letter = _codes(f" {text} ")
    if not letter:
        return False
    h = codes * np.uint32(2654435761)
    flags[h >> np.uint32(32 - BITS)] = 1
    grams = codes
    for n in range(2, ORDERS + 1):
        if len(codes) < n:
            break
        grams = grams[:-1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        flags[((grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BITS)] = 1
    return True


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


@dataclass
class LanguageModel:
    """``places``: the n-gram places of any landmark; ``landmarks``: their rows over these, each divided by
    the root of its set's size; ``weights``: from kernel values with the landmarks to a score per language."""

    languages: list[str]
    places: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, flags: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, flags.sum(axis=1, dtype=np.int64)))
        return (flags[:, self.places].astype(np.float32) @ self.landmarks.T).astype(np.float64) / size[:, None]

    def predict(self, texts: list[str | None], block: int = 128) -> tuple[list[str], list[float]]:
        return self.judge(texts, block)[:2]

    def judge(self, texts: list[str | None], block: int = 128) -> tuple[list[str], list[float], list[int]]:
        """Languages, scores and the places that each text fills."""
        names, scores, filled = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not self.languages:
            return names, scores, filled
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            flags = np.zeros((len(part), 1 << BITS), np.uint8)
            good = [k for k, t in enumerate(part) if t and presence(t, flags[k])]
            if not good:
                continue
            values = self.kernel(flags[good]) @ self.weights
            best = values.argmax(axis=1)
            for k, b, v, n in zip(good, best, values[np.arange(len(good)), best], flags[good].sum(axis=1, dtype=np.int64)):
                names[at + k] = self.languages[b]
                scores[at + k] = float(min(1.0, max(0.0, v)))
                filled[at + k] = int(n)
        return names, scores, filled


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, block: int = 128) -> LanguageModel:
    """One-versus-rest kernel ridge regression on (text, language) rows; every landmark is one of the rows.

    Only the landmarks' sets are held; the rows are gone through in blocks, once for the sizes of their
    sets and once for their kernel values with the landmarks.
    """
    sizes, digests = [], []
    flags = np.zeros(1 << BITS, np.uint8)
    for text, _ in rows:
        flags[:] = 0
        sizes.append(int(flags.sum()) if presence(text, flags) else 0)
        digests.append(hashlib.blake2b(np.packbits(flags), digest_size=16).digest())
    kept = [k for k, size in enumerate(sizes) if size]
    languages = sorted({rows[k][1] for k in kept})
    if not kept:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    by: dict[str, list[int]] = {}
    for k in kept:
        by.setdefault(rows[k][1], []).append(k)
    each = max(1, landmarks // len(languages))
    # The longest rows of a language cover most of its n-grams; equal sets count once.
    different = {lang: {digests[k]: k for k in reversed(own)}.values() for lang, own in by.items()}
    chosen = [k for lang in languages for k in sorted(different[lang], key=lambda k: (-sizes[k], k))[:each]]

    def sets(of: list[int]) -> np.ndarray:
        out = np.zeros((len(of), 1 << BITS), np.uint8)
        for at, k in enumerate(of):
            presence(rows[k][0], out[at])
        return out

    marks = sets(chosen)
    places = np.flatnonzero(marks.any(axis=0))
    size = np.sqrt(marks.sum(axis=1, dtype=np.int64))
    model = LanguageModel(languages, places, (marks[:, places] / size[:, None]).astype(np.float32), np.zeros((0, 0)))
    cross = np.vstack([model.kernel(sets(kept[at : at + block])) for at in range(0, len(kept), block)])
    inner = model.kernel(marks)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = cross @ root
    target = np.array([[float(rows[k][1] == lang) for lang in languages] for k in kept])
    # Every language weighs the same, however many rows it has.
    weigh = np.array([1.0 / len(by[rows[k][1]]) for k in kept])[:, None]
    gram = features.T @ (features * weigh) + ridge * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(gram, features.T @ (target * weigh))
    return model


def training_rows(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, most_rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """Different (text, lang) rows of every language: ``per_language`` of each (all, where there are fewer), or
    the same smaller share where that makes more than ``most_rows``; one row of each at least.

    They are the rows with the smallest hashes of the text; copies count once, letterless texts never. The
    driver gets FIT_CHARS characters of them in all.
    """
    usable = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text", F.lit(7)).alias("key"))
    about = usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("different")).collect()
    if not about:
        return []
    share = max(1, min(per_language, most_rows // len(about)))
    spark = docs.sparkSession
    # Twice the share and some more are drawn by the approximate count, so that the share is among them.
    rates = spark.createDataFrame([(r["lang"], (2.0 * share + 40) / max(1, r["different"])) for r in about], "of string, rate double")
    place = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(rates), F.col("lang") == F.col("of")).where(place < F.col("rate")).select("lang", "key").distinct().collect()
    by: dict[str, list[int]] = {}
    for r in drawn:
        by.setdefault(r["lang"], []).append(r["key"])
    chosen = [(lang, key) for lang, keys in by.items() for key in sorted(keys, key=lambda key: (key % (1 << 30), key))[:share]]
    most_chars = max(1, FIT_CHARS // len(chosen))
    chosen = spark.createDataFrame(chosen, "of string, chosen long")
    picked = usable.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (F.col("key") == F.col("chosen")))
    picked = picked.groupBy("lang", "key").agg(F.first("text").alias("text"))
    # A text without a letter near its start gives what follows the first one.
    picked = picked.select("lang", "key", F.substr("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(most_chars)).alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(picked, key=lambda r: (r["key"] % (1 << 30), r["key"], r["lang"]))]


def identify(docs: DataFrame, training: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``docs`` with lang_pred and score (0 to 1).

    Learns from ``training`` (text, lang) alone; of ``docs`` only text is read for the prediction. Null,
    empty and letterless texts are ``und`` with score 0, and so is everything where there is nothing to
    learn from. Every language of ``training`` that has a text with a letter is learned. Columns of ``docs``
    called lang_pred or score are replaced. The model (LANDMARKS rows over 2 ** BITS places, 50 MB, at most;
    beyond so many languages one row of each) is broadcast.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    rows = training_rows(training)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))
    from pyspark.sql.types import DoubleType, StringType, StructType

    place = kept.index("text") if "text" in kept else len(kept)
    read = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if "text" in kept else ["text"]))
    schema = StructType(read.schema.fields[: len(kept)]).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = model.predict(batch.column(place).to_pylist())
            columns = batch.columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return read.mapInArrow(run, schema)


def least_scores(rows: list[tuple[str, str]]) -> tuple[LanguageModel, dict[str, float]]:
    """A model of four fifths of each language's rows, and the score under which a text is none of the
    language, set on the last fifth."""
    by: dict[str, list[tuple[str, str]]] = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    held = [row for own in by.values() for row in own[: len(own) // 5]]
    model = fit([row for own in by.values() for row in own[len(own) // 5 :]])
    reached: dict[str, list[float]] = {}
    for (_, lang), name, score, filled in zip(held, *model.judge([text for text, _ in held])):
        if name == lang and filled >= JUDGED_PLACES:
            reached.setdefault(lang, []).append(score)
    return model, {lang: min(LEAST_SCORE, float(np.quantile(of, 0.05)) / 2) for lang, of in reached.items() if len(of) >= HELD_ROWS}


def accept(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is in a language of ``training``, with all columns.

    Text in another language and letter noise score below what held-out rows of the nearest language reach
    (``least_scores``). That a text has no letter does not depend on ``training``: where nothing can be
    learned from it, every text with a letter stays.
    """
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(least_scores(training_rows(training)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            judged = zip(texts, *model.judge(texts))
            kept = [has_letter(t) and (filled < JUDGED_PLACES or score >= least.get(name, 0.0)) for t, name, score, filled in judged]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
