"""Byte-level BPE through a sentencepiece model written directly from a rank file."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import accumulate, chain

import numpy as np

from pyspark.sql import DataFrame

from .common import map_rows

#: Encoded texts between spaces that a Python worker keeps before it starts afresh.
CACHE_ENTRIES = 400_000
#: Longer ones seldom come again and are not kept.
KEPT_LENGTH = 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Bytes as characters: printable ASCII as it is, every other byte 256 code points higher.
_BYTE_CHARS = {b: chr(256 + b) for b in range(256) if not 0x20 < b < 0x7F}
_BYTES = {c: b for b, c in _BYTE_CHARS.items()}


def byte_text(piece: str) -> str:
    """The UTF-8 bytes of a piece, one character each."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _BYTE_CHARS[0x20])
    return piece.encode().decode("latin-1").translate(_BYTE_CHARS)


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file: <unk>, then each token in order of rank with score -rank; identity normalisation.

    Field numbers are those of the public sentencepiece_model.proto.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)]
    for token in sorted(ranks, key=ranks.__getitem__):
        pieces.append(_block(1, token.decode("latin-1").translate(_BYTE_CHARS).encode()) + b"\x15" + struct.pack("<f", -float(ranks[token])) + _number(3, 1))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    plain = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, plain)


def splitter(pattern: str):
    """``findall`` of the pattern. Texts of Latin letters take the standard library's engine.

    The rewritten classes agree with the pattern's on U+0000 to U+024F without the characters that the
    two engines class differently (superscripts, fractions, information separators); any other text, and
    any pattern that does not hold just these classes, goes through ``regex`` as it is.
    """
    import regex

    full = regex.compile(pattern).findall
    same = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    try:
        fast = re.compile(same).findall
    except re.error:
        return full
    odd = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search
    return lambda text: full(text) if odd(text) else fast(text)


class ByteBpe:
    """Encoder and decoder of one worker; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.split = splitter(pattern)
        self.joined = re.compile(r"\s ").search
        self.whole = {}
        for token, rank in ranks.items():
            try:
                self.whole[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:  # part of a character, never a pre-token
                continue
        self.tokens = [bytes([_BYTES.get(c, ord(c) & 255) for c in self.model.id_to_piece(k + 1)]) for k in range(len(ranks))]
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _code(self, pieces: list[str]) -> dict[str, bytes]:
        """Each different pre-token's ids; a pre-token that is itself a token is not merged again."""
        coded = self.model.encode([byte_text(p) for p in pieces], num_threads=1) if pieces else []
        ends = list(accumulate(map(len, coded), initial=0))
        flat = (np.fromiter(chain.from_iterable(coded), np.uint32, ends[-1]) - np.uint32(1)).astype("<u4").tobytes()
        whole = self.whole.get
        return {p: whole(p) or flat[4 * a : 4 * b] for p, a, b in zip(pieces, ends, ends[1:])}

    def _cut(self, unit: str) -> list[str]:
        if unit[1:].isalpha() and unit[0] == " ":
            return [unit]
        if unit[1:-1].isalpha() and unit[0] == " " and unit[-1] in ".,":
            return [unit[:-1], unit[-1]]
        return self.split(unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Where no white space stands before a space, every space opens a pre-token, so the text between
        two spaces is split and encoded once per slice of texts; short ones are kept for later slices.
        """
        units = []
        for text in texts:
            if self.joined(text):
                units.append([text])
            else:
                first, *rest = text.split(" ")
                units.append([first, *[" " + r for r in rest]])
        cache = self.cache
        new = list(set().union(*units).difference(cache))
        if len(cache) > self.cache_entries:
            cache.clear()
            new = list(set().union(*units))
        cut = [self._cut(u) for u in new]
        known = self._code(list(set().union(*cut)))
        now = {u: b"".join([known[p] for p in pieces]) if len(pieces) != 1 else known[pieces[0]] for u, pieces in zip(new, cut)}
        cache.update(now)
        out = [b"".join(map(cache.__getitem__, unit)) for unit in units]
        for unit in new:
            if len(unit) > KEPT_LENGTH:
                del cache[unit]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode_texts(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: the key, ids (binary, little-endian uint32), n_tokens and the decoded text (binary).

    Null texts count as empty: no ids. Repeated rows give repeated rows. The rank file must lie at the
    same path on every executor.
    """

    def work():
        coder = ByteBpe(read_ranks(ranks_path), pattern)

        def step(rows):
            coded = coder.encode([t or "" for _, t in rows])
            return [(k, ids, len(ids) // 4, coder.decode(ids)) for (k, _), ids in zip(rows, coded)]

        return step

    return map_rows(df, [key, text], work, f"{key} {dict(df.dtypes)[key]}, ids binary, n_tokens bigint, decoded binary", 4_000_000)


def digest_tokens(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_texts``, but with the SHA-256 of ids and decoded bytes in place of them."""

    def work():
        coder = ByteBpe(read_ranks(ranks_path), pattern)

        def step(rows):
            out = []
            for (k, _), ids in zip(rows, coder.encode([t or "" for _, t in rows])):
                out.append((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            return out

        return step

    return map_rows(df, [key, text], work, f"{key} {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", 4_000_000)
