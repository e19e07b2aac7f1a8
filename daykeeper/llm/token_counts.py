"""Token counts of whole texts: batch encoding that returns lengths only, in batches balanced by bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices

#: Characters of text in a batch, in a piece of a long text before the next safe boundary, and bytes read at a time.
BATCH_CHARS, PIECE_CHARS, SLICE_BYTES = 250_000, 20_000, 1_000_000
#: Parts whose lengths a Python worker keeps in each of two generations, and the longest that is kept (bytes).
KEPT_PARTS, KEPT_BYTES = 250_000, 24
#: Words that go to the library as one text.
BLOCK_WORDS = 4_000

#: One space between two characters that are not white space.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: The same for sentencepiece, which writes a space as this mark and keeps marks that a text holds.
_SINGLE_MARK = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class JsonCounter:
    """Lengths by the tokenizers library, of a file whose pre-tokens never reach over a space into the text before it.

    A cut before a single space is safe where the file drops white space or keeps it at the head of the
    next pre-token, and where no added token holds a space or takes white space beside it. Every other
    file is encoded in whole texts.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as stream:
            settings = json.load(stream)
        self.cuts = _SINGLE if _parts_at_spaces(settings) else None
        # A byte-level file keeps the space at the head of what follows; the other kind drops it.
        byte_level = (settings.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.head = " " if byte_level else ""
        self.drops_space = bool(self.cuts) and not byte_level
        steps = settings.get("normalizer") or {}
        self.lowers = self.drops_space and any(s["type"] == "Lowercase" for s in steps.get("normalizers", [steps]))
        suffix, vocabulary = settings["model"].get("end_of_word_suffix"), self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.names = [t["content"].encode().lower() for t in settings.get("added_tokens") or []]

    def parts(self, text: str) -> list[bytes]:
        """What stands between safe boundaries. Where white space is dropped, every run of its ASCII characters is
        one; where letters are lowered, A-Z may be beforehand, but for the names of added tokens."""
        if not self.drops_space:
            return _split(text, self.cuts, self.head)
        raw = text.encode()
        lowered = raw.lower() if self.lowers else raw
        return (raw if any(name in lowered for name in self.names) else lowered).split()

    def stem(self, part: bytes) -> bytes | None:
        """A part of which just a mark is taken off that is always a pre-token of its own after a letter."""
        return part[:-1] if self.drops_space and part[-1:] in (b".", b",") and part[-2:-1].isalpha() else None

    def lengths(self, texts: list[str]) -> list[int]:
        """Words of plain letters go to the library as one text a block, where the file marks a word's last token;
        the number of marks shows whether each was one word. All else is a text of its own."""
        if not self.drops_space or self.last is None:
            return self._each(texts)
        out = np.zeros(len(texts), np.int64)
        plain = np.array([t.isalpha() and (t.isascii() or max(t) <= "\xff") for t in texts], bool)
        words = np.flatnonzero(plain)
        rest = [np.flatnonzero(~plain)]
        for at in range(0, len(words), BLOCK_WORDS):
            block = words[at : at + BLOCK_WORDS]
            coded = self.model.encode_batch_fast([" ".join([texts[k] for k in block.tolist()])], add_special_tokens=False)[0]
            ends = np.flatnonzero(self.last[np.array(coded.ids, np.int64)])
            if len(ends) == len(block) and ends[-1] == len(coded) - 1:
                out[block] = np.diff(ends, prepend=-1)
            else:
                rest.append(block)
        others = np.concatenate(rest)
        out[others] = self._each([texts[k] for k in others.tolist()])
        return out.tolist()

    def _each(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


def _parts_at_spaces(settings: dict) -> bool:
    for token in settings.get("added_tokens") or []:
        if token["lstrip"] or token["rstrip"] or re.search(r"\s", token["content"]):
            return False
    steps = settings.get("normalizer") or {}
    known = {"NFC", "Lowercase"}
    for step in steps.get("normalizers", [steps] if steps else []):
        if step["type"] not in known and (step["type"], step.get("pattern"), step.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    before = settings.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    head = steps[0]
    if head.get("type") == "ByteLevel":
        # Its own pattern takes a space only at the head of a pre-token. A prefix space would be added to every piece.
        return len(steps) == 1 and head.get("use_regex", True) and not head.get("add_prefix_space", True)
    # What the pattern leaves out is dropped; none of its alternatives takes white space.
    return (
        head.get("type") == "Split" and head["behavior"] == "Removed" and bool(head["invert"]) and _takes_no_space(head["pattern"].get("Regex", " "))
        and all(s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    )


def _takes_no_space(pattern: str) -> bool:
    """Every alternative is plain letters after an apostrophe, or a class of letters, digits or neither without space."""
    plain = r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+"
    return all(re.fullmatch(plain, part) for part in pattern.split("|"))


class PieceCounter:
    """Lengths by the sentencepiece library.

    A piece that holds the mark of a space after another character could reach over a cut, and a
    normaliser other than identity could; then whole texts are encoded. A cut takes the space away, since
    every text gets one put before it.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.head = ""
        crossing = any("▁" in self.model.id_to_piece(k).lstrip("▁") for k in range(self.model.get_piece_size()))
        # A space is put before every text, spaces are kept as they are, and other characters too.
        kept = self.model.encode(" a") != self.model.encode("a") and self.model.normalize("\ufb01 \u2460").endswith("\ufb01▁\u2460")
        prefixed = self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.cuts = _SINGLE_MARK if kept and prefixed and not crossing else None

    def parts(self, text: str) -> list[bytes]:
        return _split(text, self.cuts, self.head)

    def stem(self, part: bytes) -> bytes | None:
        return None

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def _split(text: str, cuts: re.Pattern | None, head: str) -> list[bytes]:
    first, *others = cuts.split(text) if cuts else [text]
    return [first.encode(), *[(head + p).encode() for p in others]]


def counter(path: str) -> JsonCounter | PieceCounter:
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def pieces(text: str, cuts: re.Pattern | None, head: str = "", most: int = PIECE_CHARS) -> list[str]:
    """The text cut at the first safe boundary at or after every ``most`` characters; whole where there is none.
    ``head`` takes the place of the space at the boundary."""
    if cuts is None or len(text) <= most:
        return [text]
    out, at, start = [], 0, ""
    while len(text) - at > most:
        found = cuts.search(text, at + most)
        if not found:
            break
        out.append(start + text[at : found.start()])
        at, start = found.end(), head
    out.append(start + text[at:])
    return out


def balanced(sizes: list[int], most: int = BATCH_CHARS) -> list[tuple[int, int]]:
    """Ranges of items whose sizes add up to at most ``most`` and differ as little as their order allows: the
    total goes into the least number of equal shares. A larger item is alone in its range."""
    ends = np.array(list(accumulate(sizes)), np.int64)
    if not len(ends):
        return []
    share = -(-int(ends[-1]) // max(1, -(-int(ends[-1]) // most)))
    out, at, before = [], 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + share, "right")))
        out.append((at, end))
        at, before = end, int(ends[end - 1])
    return out


class Lengths:
    """Lengths of parts, kept while they come again: what the last generation does not use goes with it."""

    def __init__(self, coder, kept: int = KEPT_PARTS):
        self.coder, self.kept = coder, kept
        self.known: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}

    def of(self, texts: list[str], batch: int = BATCH_CHARS) -> list[int]:
        """Tokens of each text: its parts between all safe boundaries, each different one encoded once a batch."""
        parts = [self.coder.parts(t) for t in texts]
        if len(self.known) > self.kept:
            self.last, self.known = self.known, {}
        known, last = self.known, self.last
        new = set().union(*parts).difference(known)
        known.update([(p, last[p]) for p in new & last.keys()])
        new = list(new.difference(known))
        stems = {p: stem for p in new if (stem := self.coder.stem(p))}
        coded = list({stems.get(p, p) for p in new}.difference(known) | {p[-1:] for p in stems})
        for first, end in balanced([len(p) for p in coded], batch):
            known.update(zip(coded[first:end], self.coder.lengths([p.decode() for p in coded[first:end]])))
        known.update([(p, known[stem] + known[p[-1:]]) for p, stem in stems.items()])
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for part in [p for p in {*new, *coded} if len(p) > KEPT_BYTES]:
            del known[part]
        return out


def lengths_of(texts: list[str], lengths: Lengths, most: int = PIECE_CHARS, batch: int = BATCH_CHARS) -> list[int]:
    """Tokens of each text: those of its pieces, batch by batch, added up."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        cut = pieces(text, lengths.coder.cuts, lengths.coder.head, most)
        parts += cut
        owner += [k] * len(cut)
    out = [0] * len(texts)
    for first, end in balanced([len(p) for p in parts], batch):
        for k, n in zip(owner[first:end], lengths.of(parts[first:end], batch)):
            out[k] += n
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, make: Callable = counter) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every whole text.

    Tokens are those of the library for the file (tokenizers for .json, sentencepiece for .model) without
    begin, end or added special tokens, truncation or padding; names of special tokens inside texts are
    what the library takes them for. Only lengths leave Python.

    Null text is empty and has no tokens. Repeated rows give repeated rows, an empty table none; further
    columns of ``docs`` never reach Python. Every task opens the file once; it must be there on all
    executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(make(tokenizer_path))
        for batch in text_slices(batches, 1, SLICE_BYTES):
            counts = np.array(lengths_of([t or "" for t in batch.column(1).to_pylist()], lengths), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
