"""Token sequences filled by best fit; lower bounds certify partitions, the rest exchange documents."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daykeeper.session import durable

from .common import map_rows

#: Pieces in a packing partition, on the average.
PARTITION_PIECES = 50_000
ROUNDS = 4
#: Encoded words in a generation of a Python worker's store (some 200 bytes each; two generations are held),
#: and the longest that are kept.
CACHE_ENTRIES = 300_000
KEPT_LENGTH = 20
#: A line is a Latin word with ASCII punctuation after it, or else any other part of a text.
_PART = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)\n|([^\n]+)\n")


class WordBpe:
    """Token ids of whole texts by a ``tokenizers`` file that drops white space between words.

    A text is cut at spaces, tabs and line ends, where no token can cross; each different part is
    encoded by the library once per slice of texts, and short ones are kept for later slices. Of Latin
    words with ASCII punctuation after them, both are pre-tokens of their own; the words go to the
    library many at a time in lower case and as the characters of their bytes, which is all that the
    file's normaliser, pattern and byte level make of them: every word ends with a token that marks its
    end, so the ids fall apart into words again.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.words = Tokenizer(self.model.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {chr(k): byte_level.pre_tokenize_str(chr(k))[0][0] for k in range(128, 256) if chr(k).isalpha()}
        char_of = {byte: char for letter, chars in shown.items() for byte, char in zip(letter.encode(), chars)}
        self.byte_chars = "".join(char_of.get(k, chr(k)) for k in range(256))
        self.last = np.zeros(self.model.get_vocab_size(), bool)
        for token, k in self.model.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}
        self.last_cache: dict[bytes, bytes] = {}
        self.cache_entries = cache_entries

    def _one(self, part: str) -> bytes:
        return np.array(self.model.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str], block: int = 4_000) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), block):
            part = words[at : at + block]
            text = " ".join(part).lower().encode()
            text = codecs.charmap_decode(text, "strict", self.byte_chars)[0]
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):
                flat = ids.tobytes()
                out += [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
            else:
                out += [self._one(w) for w in part]
        return out

    def _learn(self, parts: list[bytes]) -> None:
        found = _PART.findall(b"".join([part + b"\n" for part in parts]).decode())
        words = list({word for word, _, _ in found if word})
        ids = dict(zip(words, self._words(words)))
        marks = {m: self._one(m) if m else b"" for m in {m for _, m, _ in found}}
        self.cache.update([(raw, ids[word] + marks[m]) for raw, (word, m, _) in zip(parts, found) if word])
        other = [(raw, part) for raw, (_, _, part) in zip(parts, found) if part]
        coded = self.model.encode_batch_fast([part for _, part in other], add_special_tokens=False) if other else []
        self.cache.update([(raw, np.array(e.ids, "<u4").tobytes()) for (raw, _), e in zip(other, coded)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = []
        for text in texts:
            raw = text.encode()
            # The tokenizer takes A-Z as a-z, but for the names of its special tokens.
            parts.append(raw.split() if b"<|" in raw else raw.lower().split())
        if len(self.cache) > self.cache_entries:
            # What comes again is taken over from the last generation, the rest goes with it.
            self.last_cache, self.cache = self.cache, {}
        cache, old = self.cache, self.last_cache
        new = set().union(*parts).difference(cache)
        again = new & old.keys()
        cache.update([(p, old[p]) for p in again])
        new = list(new - again)
        self._learn(new)
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del cache[p]
        return out


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids with ``end_id`` after them, cut only where
    longer than ``capacity``. Null text is empty (just the end id)."""

    def work():
        coder = WordBpe(tokenizer_path)
        tail = int(end_id).to_bytes(4, "little")

        def step(rows):
            out = []
            for (key, _), ids in zip(rows, coder.encode([t or "" for _, t in rows])):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            return out

        return step

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_rows(docs, ["doc_id", "text"], work, schema, 4_000_000)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions u(eps) of Martello and Toth and of the plain sum.

    For every threshold eps up to half the capacity: items above capacity - eps count as whole
    sequences, items below eps as nothing, the others by their length.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = count * np.arange(capacity + 1)
    below_n, below = np.cumsum(count), np.cumsum(size)
    best = -(-int(below[-1]) // capacity)
    for eps in range(1, capacity // 2 + 1):
        whole = int(below_n[-1] - below_n[capacity - eps])
        middle = int(below[capacity - eps] - below[eps - 1])
        best = max(best, whole - (-middle // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still takes it.

    Open bins are kept by their free space; a bit set of the free spaces in use gives the smallest one
    that is large enough, so an item costs a few word operations.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, opened = 0, 0
    for k, need in zip(order.tolist(), lengths[order].tolist()):
        fits = used >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                used ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[k] = b
        room -= need
        if room:
            if not free[room]:
                used |= 1 << room
            free[room].append(b)
    return bins


def _spread(df: DataFrame, groups: int, salt: int) -> DataFrame:
    key = F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(salt)), F.lit(groups)).cast("int")
    return df.withColumn("part", key)


def pack(pieces: DataFrame, capacity: int = 4096, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The columns of ``pieces`` with sequence_id and offset.

    Pieces go to partitions of about ``partition_pieces`` by hash. A partition packs its pieces by best
    fit decreasing and compares its bins with the lower bound of its lengths: with no gap it is
    certified and final. Partitions with a gap keep their bins but for the emptiest ones, which hand
    back their pieces: those of all such partitions meet in fewer partitions and are packed again. The
    last round keeps what it has. Every piece gets exactly one place; repeated rows are packed each.
    """
    kept_columns = pieces.columns
    rows = durable(pieces.select("*", F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    done = []
    for k in range(rounds):
        if not total:
            break
        groups = max(1, round(total / partition_pieces))
        last = k == rounds - 1 or groups == 1
        out = durable(_pack_round(_spread(rows, groups, k), capacity, k, last))
        done.append(out.where("sequence_id >= 0"))
        if last:
            break
        rows = out.where("sequence_id < 0").drop("sequence_id", "offset")
        total = rows.count()
    if not done:
        done = [rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.select(*kept_columns, "sequence_id", "offset")


def _pack_round(spread: DataFrame, capacity: int, salt: int, last: bool) -> DataFrame:
    from pyspark.sql.types import LongType, StructType

    fields = [f for f in spread.schema.fields if f.name != "part"]
    schema = StructType(list(fields)).add("sequence_id", LongType()).add("offset", LongType())

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        opened = int(bins.max()) + 1
        filled = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        order = np.lexsort((-lengths, bins))
        ends = np.cumsum(lengths[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = ends - lengths[order] - base
        sequence = (np.int64(salt) << 58) + (np.int64(part) << 32) + bins
        gap = opened - lower_bound(lengths, capacity)
        if gap and not last:
            # Bins that are not full hold the gap; the emptiest quarter of them, eight per missing bin at
            # least, goes back whole.
            slack = np.argsort(filled, kind="stable")
            slack = slack[filled[slack] < capacity]
            again = np.zeros(opened, bool)
            again[slack[: max(8 * gap, len(slack) // 4)]] = True
            sequence = np.where(again[bins], -1, sequence)
        return pa.table({f.name: table.column(f.name) for f in fields} | {"sequence_id": sequence, "offset": offset})

    return spread.groupBy("part").applyInArrow(run, schema)
