"""Personal data: fixed patterns as a base, further spans by a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_rows, text_slices

# Kinds in the order of the contract, and its patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """The contract's matches: leftmost, not overlapping within a kind, by start and then kind."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        # A local part ends at this sign, so its leftmost start is where the run of its characters begins.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the random field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9]+|[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]|@")
_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s?@\s?")
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?")
_HOST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\Z")
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}\Z")
_PLAIN_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\Z|00[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}\Z")
_CUES = {"tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "mail", "email", "contact", "card", "karte", "carte", "tarjeta", "ip", "address"}
#: Tokens in an entity at most: the bound of the method.
SPAN_TOKENS = 28


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens of the stretches in which an entity can stand: those up to SPAN_TOKENS before and after digits, at
    signs and their spelled forms. Stretches that meet are one, and a token is never cut, so the segments of
    all stretches are those of the whole text."""
    trigger = _TRIGGER.search(text)
    while trigger:
        tokens, ends = [], []
        stream = _TOKEN.finditer(text, _back(text, trigger.start()))
        while trigger:
            while not ends or ends[-1] < trigger.end() or len(ends) < bisect_left(ends, trigger.end()) + SPAN_TOKENS:
                m = next(stream, None)
                if m is None:
                    break
                tokens.append(m.span())
                ends.append(m.end())
            trigger = _TRIGGER.search(text, trigger.end())
            # A trigger whose stretch begins before this one's end goes on in this one.
            if trigger and trigger.start() >= ends[-1] and _back(text, trigger.start()) > ends[-1]:
                break
        yield tokens


def _back(text: str, at: int, reach: int = 300) -> int:
    """Where the SPAN_TOKENS-th token before ``at`` begins."""
    while True:
        first = max(0, at - reach)
        starts = [m.start() for m in _TOKEN.finditer(text, first, at)]
        if first == 0:
            return starts[-SPAN_TOKENS] if len(starts) >= SPAN_TOKENS else 0
        # The first may be the rest of a token.
        if len(starts) > SPAN_TOKENS:
            return starts[-SPAN_TOKENS]
        reach *= 4


def features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Of the whole span: its shape as the kind, what the kind's check says, and its surroundings."""
    digits = _digits(span)
    out = [f"{kind}|bias"]
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", span))
        out += [f"email|shape={bool(_HOST.match(plain))}", f"email|spelled={plain != span}"]
    elif kind == "ip":
        parts = span.split(".")
        out.append(f"ip|valid={len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) < 256 for p in parts)}")
    elif kind == "card":
        out += [f"card|luhn={12 <= len(digits) <= 19 and luhn(digits)}", f"card|grouped={bool(re.fullmatch(r'[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}', span))}"]
    else:
        out += [
            f"phone|size={9 <= len(digits) <= 15}",
            f"phone|plus={span[:1] == '+'}",
            f"phone|shape={bool(_PLAIN_PHONE.match(span))}",
            f"phone|grouped={bool(_GROUPED.match(span))}",
        ]
    touch = (before[-1:].isalnum() or before[-1:] in ("_", "@", "#", "/")) or after[:1].isalnum() or (after[:1] in "@%/" and after[:1] != "")
    out.append(f"{kind}|touches={touch}")
    joined = bool(re.search(r"[0-9][.-]\Z", before)) or bool(re.match(r"[.-][0-9]", after))
    out.append(f"{kind}|joined={joined}")
    words = re.findall(r"[^\W\d_]+", before[-24:].lower())[-2:]
    out.append(f"{kind}|cue={bool(_CUES.intersection(words))}")
    return out


def candidates(text: str, tokens: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Tokens (given ones, or those of the whole text) and the candidate segments over them (first token, token
    after the last, kind, features)."""
    if tokens is None:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
    found = []
    for a, (left, _) in enumerate(tokens):
        first = text[left]
        if not (first.isalnum() or first in "+("):
            continue
        if left > 1 and first.isalnum() and text[left - 1] in "._%-" and text[left - 2].isalnum():
            continue
        ats = 0
        for b in range(a + 1, min(len(tokens), a + SPAN_TOKENS) + 1):
            right = tokens[b - 1][1]
            last = text[right - 1]
            if last == "\n":
                break
            if not last.isalnum():
                continue
            span = text[left:right]
            ats = len(_AT.findall(span))
            if ats > 1:
                break
            digits = sum(map(str.isdecimal, span))
            letters = any(map(str.isalpha, span))
            kinds = []
            if ats == 1 and not re.search(r"\s\S+\s", _DOT.sub(".", _AT.sub("@", span))) and (first.isalnum()):
                kinds.append("email")
            if not letters and digits >= 4:
                if first.isdecimal() and span.count(".") == 3:
                    kinds.append("ip")
                if first.isdecimal() and 12 <= digits <= 19:
                    kinds.append("card")
                if 9 <= digits <= 15:
                    kinds.append("phone")
            if digits > 19 and not letters:
                break
            for kind in kinds:
                found.append((a, b, kind, features(kind, span, text[max(0, left - 24) : left], text[right : right + 2])))
    return tokens, found


def decode(tokens: int, segments: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best segmentation: a token alone outside any entity scores 0, an entity the sum of its weights."""
    ending: dict[int, list[tuple[float, int, str]]] = {}
    for a, b, kind, names in segments:
        ending.setdefault(b, []).append((sum([weights.get(n, 0.0) for n in names]), a, kind))
    best, back = [0.0] * (tokens + 1), [None] * (tokens + 1)
    for b in range(1, tokens + 1):
        best[b] = best[b - 1]
        for score, a, kind in ending.get(b, ()):
            if best[a] + score > best[b]:
                best[b], back[b] = best[a] + score, (a, kind)
    out, b = [], tokens
    while b > 0:
        if back[b] is None:
            b -= 1
        else:
            a, kind = back[b]
            out.append((a, b, kind))
            b = a
    return out[::-1]


def _log_add(x: float, y: float) -> float:
    high, low = (x, y) if x > y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def expected(tokens: int, segments, weights: dict[str, float]) -> tuple[float, list[float]]:
    """Log of the partition sum over all segmentations, and each candidate's probability."""
    scores = [sum([weights.get(n, 0.0) for n in s[3]]) for s in segments]
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (a, b, _, _) in enumerate(segments):
        ending.setdefault(b, []).append(k)
        starting.setdefault(a, []).append(k)
    forward, backward = [0.0] * (tokens + 1), [0.0] * (tokens + 1)
    for b in range(1, tokens + 1):
        forward[b] = forward[b - 1]
        for k in ending.get(b, ()):
            forward[b] = _log_add(forward[b], forward[segments[k][0]] + scores[k])
    for a in range(tokens - 1, -1, -1):
        backward[a] = backward[a + 1]
        for k in starting.get(a, ()):
            backward[a] = _log_add(backward[a], backward[segments[k][1]] + scores[k])
    total = forward[tokens]
    return total, [math.exp(forward[a] + s + backward[b] - total) for (a, b, _, _), s in zip(segments, scores)]


def examples(count: int = 260, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Labelled sentences made from a fixed seed: every kind in plain and spelled forms, and look-alikes."""
    rng = random.Random(seed)
    words = "the order was sent on monday to our office and we could read it with them after lunch near river".split()
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        cut = rng.choice(["", " ", "-", ".", "."])
        return cut.join(body[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        host = f"{rng.choice(['mail', 'post', 'example', 'uni-x'])}{num(1)}"
        at = rng.choice(["@", "@", " [at] ", "(at)", " (at) ", "[at]", " @ "])
        dot = rng.choice([" [dot] ", "(dot)", ".", "."]) if at not in ("@", " @ ") else "."
        return f"{rng.choice(words)}{rng.choice(['', '.', '_'])}{num(2)}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"

    def phone() -> str:
        a, b, c = rng.choice("23456789") + num(2), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {num(2)} {num(3)} {num(4)}", f"0049 {num(2)} {num(3)} {num(4)}"])

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def other() -> str:
        wrong = num(15)
        return rng.choice(
            [
                f"19{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(3)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(3)}-{num(4)}",
                wrong + next(c for c in "0123456789" if not luhn(wrong + c)), f"{300 + rng.randrange(600)}.{num(2)}.{num(1)}.{num(1)}", num(10), num(12), f"{num(3)} {num(3)} {num(3)}", f"{num(4)} {num(4)} {num(4)}",
                f"{num(2)}.{num(2)}.{num(4)}", f"id{num(9)}", f"a{num(3)}-{num(3)}-{num(4)}", f"{num(1)}.{num(3)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)} @ {num(2)}", f"{num(5)}-{num(4)}", num(30),
            ]
        )

    out = []
    for _ in range(count):
        text, spans = " ".join(rng.choices(words, k=rng.randrange(1, 4))) + " ", []
        for _ in range(rng.randrange(1, 3)):
            kind, make = rng.choice([("email", email), ("ip", ip), ("card", card), ("phone", phone), ("", other), ("", other), ("", other)])
            piece = make()
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", ", ", ". "]) + " ".join(rng.choices(words, k=rng.randrange(1, 4))) + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 40, rate: float = 0.35, penalty: float = 0.002) -> dict[str, float]:
    """Weights of the field by gradient ascent on the conditional likelihood of the examples."""
    data = []
    for text, spans in examples():
        tokens, segments = candidates(text)
        at_start, at_end = {s: k for k, (s, _) in enumerate(tokens)}, {e: k + 1 for k, (_, e) in enumerate(tokens)}
        gold = {(at_start.get(s), at_end.get(e), kind) for s, e, kind in spans}
        data.append((len(tokens), segments, [(s[0], s[1], s[2]) in gold for s in segments]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for tokens, segments, truth in data:
            _, chance = expected(tokens, segments, weights)
            for segment, p, yes in zip(segments, chance, truth):
                for name in segment[3]:
                    slope[name] = slope.get(name, 0.0) + yes - p
        for name, g in slope.items():
            g -= penalty * len(data) * weights.get(name, 0.0)
            squares[name] = squares.get(name, 0.0) + g * g
            weights[name] = weights.get(name, 0.0) + rate * g / (1e-9 + math.sqrt(squares[name])) * 2
    return weights


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the field adds; an added one overlaps no base span."""
    base = base_spans(text)
    added: list[Span] = []
    # The furthest end of the base spans so far: those of two kinds may overlap.
    starts, furthest = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    for tokens in windows(text):
        _, segments = candidates(text, tokens)
        if not segments:
            continue
        for a, b, kind in decode(len(tokens), segments, weights):
            s, e = tokens[a][0], tokens[b - 1][1]
            before = bisect_left(starts, e)
            if not before or furthest[before - 1] <= s:
                added.append((s, e, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every whole text.

    Null and empty texts have none. Repeated rows give repeated rows.
    """
    weights = trained()

    def work():
        def step(rows):
            out = []
            for key, text in rows:
                base, spans = all_spans(text or "", weights)
                out.append((key, [{"kind": k, "start": s, "end": e} for s, e, k in base], [{"kind": k, "start": s, "end": e} for s, e, k in spans]))
            return out

        return step

    item = "array<struct<kind: string, start: int, end: int>>"
    return map_rows(docs, ["doc_id", "text"], work, f"doc_id {dict(docs.dtypes)['doc_id']}, base {item}, spans {item}")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, SHA-256 of the base spans, all spans as text.

    Null and empty texts have none. Repeated rows give repeated rows, an empty table none; further columns
    never reach Python.
    """
    weights = trained()

    def work():
        def step(rows):
            out = []
            for key, text in rows:
                base, spans = all_spans(text or "", weights)
                counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                out.append((key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return out

        return step

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_rows(docs, ["doc_id", "text"], work, schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, one mark each."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text masked; null texts stay null, all other columns as they are."""
    import pyarrow as pa

    weights = trained()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, place, 1_000_000):
            texts = [None if t is None else mask(t, all_spans(t, weights)[1]) for t in batch.column(place).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
