"""Fill-in-middle, token counts and periodic runs against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from daykeeper.llm import fill_middle, periodic_runs, token_counts
from daykeeper.llm.common import load, text_slices
from daykeeper.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Hello world, don't stop 123 times!\n\n  ok", "en", 1), (2, None, None, None), (3, "", "en", 2), (4, "  \n", None, 3), (5, "long " * 40_000, "en", 4),
        (1, "Hello world, don't stop 123 times!\n\n  ok", "en", 1), (None, "é ▁ 日本 ² \x1c x", "de", 5), (7, "a <M> b <S> c", "en", 6), (8, "x" * 30_000, "en", 7), (9, "<|endoftext|>" * 3, "en", 8),
        (None, None, None, None), (10, "𝒳y ź " * 9, "en", 9), (11, "<P", "en", 9), (12, "S><", "en", 9),
    ]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, form STRING, n BIGINT").repartition(3)


def rows_of(frame, *names):
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str)


# --- fill-in-middle ---------------------------------------------------------------------------


def test_wavelet_matrix_ranks_and_cuts():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        ends = np.arange(size + 1)
        for symbol in range(8):
            assert matrix.rank(symbol, ends).tolist() == [int((symbols[:e] == symbol).sum()) for e in ends]
    symbols = rng.integers(0, 4, 500).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(symbols, 2)
    for _ in range(200):
        a, b = sorted(rng.integers(0, 501, 2).tolist())
        want = int(rng.integers(0, 300))
        begins = [k for k in range(a, b) if symbols[k] in (1, 3)]
        assert matrix.cut((1, 3), np.array([a]), np.array([b]), np.array([want]))[0] == (begins[want] if want < len(begins) else b)


def plain_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, len(units), "plain", None, None, text)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return (key, len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out)


def test_fill_in_middle_equals_the_definition(spark, docs, monkeypatch):
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    rng = random.Random(4)
    made = [(k, "".join(rng.choices("ab ZÀé<SPM>1\n日😀", k=rng.randrange(30)))) for k in range(2_000)]
    odd = spark.createDataFrame(made, "doc_id BIGINT, text STRING")
    for frame in (docs, odd):
        want = sorted((plain_fim(r["doc_id"], r["text"]) for r in frame.collect()), key=str)
        assert rows_of(fill_middle.fill_in_middle(frame), *names) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fill_middle.fill_in_middle(odd)
    back = back.select("doc_id", fill_middle.restored(back["output"], back["form"]).alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted(made, key=str)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_by_other_units(spark):
    frame = spark.createDataFrame([(k, "one two, three  four.") for k in range(60)], "doc_id BIGINT, text STRING")
    for starters, n in ((fill_middle.CHARACTERS, 21), (fill_middle.WORDS, 4)):
        got = fill_middle.fill_in_middle(frame, plain_percent=0, spm_percent=50, starters=starters).collect()
        assert {r["n"] for r in got} == {n} and {r["form"] for r in got} == {"psm", "spm"}
    starts = {0, 4, 9, 16, 21}
    assert {r["prefix_chars"] for r in got} <= starts and {r["prefix_chars"] + r["middle_chars"] for r in got} <= starts


# --- token counts -----------------------------------------------------------------------------


def library_counts(texts, path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library_with_cuts_everywhere(name):
    path = public_tokenizers.path(name)
    coder = token_counts.counter(path)
    assert coder.cuts is not None
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab Z  ▁'s1é\n\t日😀́ \x1c<|>Σ", k=rng.randrange(60))) for _ in range(3_000)]
    texts += [f"{a}{s}{b}" for a in ("a", "a.", "é,", "don't.", "<|ENDOFTEXT|>.", "1", "<|endoftext|>", "▁", "é") for s in (" ", "  ", "  ", " \n") for b in ("'s", "b", "́", "<|startoftext|>", "1")]
    want = library_counts(texts, path)
    assert token_counts.lengths_of(texts, token_counts.Lengths(coder, kept=200), most=0, batch=50) == want
    coder.cuts, coder.drops_space = None, False
    assert token_counts.lengths_of(texts, token_counts.Lengths(coder)) == want


def test_counts_of_rows(spark, docs):
    got = rows_of(token_counts.count_tokens(docs, WORD_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    rows = docs.collect()
    counts = library_counts([r["text"] or "" for r in rows], WORD_BPE)
    assert got == sorted(((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, counts)), key=str)
    assert token_counts.count_tokens(docs.limit(0), WORD_BPE).count() == 0
    few = token_counts.count_tokens(docs, WORD_BPE, limit=3).where("over_limit").count()
    assert few == sum(n > 3 for n in counts)


def test_pieces_and_batches_lose_nothing():
    text = "abc de  f " * 400
    cut = token_counts.pieces(text, token_counts._SINGLE, " ", 50)
    assert "".join(cut) == text and len(cut) > 50 and all(len(p) < 60 for p in cut)
    assert token_counts.pieces("x" * 900, token_counts._SINGLE, "", 50) == ["x" * 900]
    rng = random.Random(2)
    sizes = [rng.randrange(1, 20_000) for _ in range(500)] + [900_000]
    ranges = token_counts.balanced(sizes)
    assert [k for a, b in ranges for k in range(a, b)] == list(range(501))
    sums = [sum(sizes[a:b]) for a, b in ranges]
    assert max(sums[:-2]) <= token_counts.BATCH_CHARS and min(sums[:-2]) > 0.85 * token_counts.BATCH_CHARS
    assert token_counts.balanced([]) == [] and token_counts.balanced([0, 0]) == [(0, 2)]


def test_files_without_safe_cuts_are_encoded_whole(tmp_path):
    import json

    settings = json.load(open(WORD_BPE))
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "NFKC"}}, {"added_tokens": [{**settings["added_tokens"][0], "lstrip": True}]}):
        assert not token_counts._parts_at_spaces({**settings, **change})


def test_token_counts_of_the_tables(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in load(spark, SF, "documents").collect()}
    want = dict(zip(texts, library_counts(list(texts.values()), WORD_BPE)))
    got = QUERIES["op12_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {k: (len(texts[k].encode()), n, n > 2048) for k, n in want.items()}


def test_slices_hold_a_bounded_number_of_bytes():
    import pyarrow as pa

    texts = ["x" * 10] * 1000 + [None, "y" * 5_000, ""] + ["z" * 90] * 20
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])
    parts = list(text_slices(iter([batch]), 1, 1_000))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(texts)))
    sums = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert all(s <= 1_000 or p.num_rows == 1 for s, p in zip(sums, parts)) and len(parts) < 16


# --- periodic runs ----------------------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(least, times * q):
                found.setdefault((start, at + q), q)
            at += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = []
    for _ in range(rng.randrange(6)):
        letters = rng.choice(["a", "ab", "abc", "abcdef"])
        unit = rng.choices(letters, k=rng.randrange(1, 14))
        words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)] if rng.random() < 0.6 else rng.choices(letters, k=rng.randrange(40))
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    seen = 0
    for least, times in ((24, 3), (5, 3), (9, 4)):
        for _ in range(500):
            texts = [some_words(rng) for _ in range(rng.randrange(1, 5))]
            texts += [list(texts[0])] * rng.randrange(2)
            want = [plain_runs(t, least, times) for t in texts]
            assert periodic_runs.runs_by_text(texts, least, times) == want
            seen += sum(map(len, want))
    assert seen > 1_000
    with pytest.raises(ValueError):
        periodic_runs.runs_by_text([["a"]], 5, 2)
    a, b = "a", "ab"
    while len(b) < 3_000:
        a, b = b, b + a
    assert periodic_runs.runs_by_text([list(b)]) == [plain_runs(list(b))]


def test_runs_with_equal_hashes_are_still_exact(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda x: x & np.uint64(1))
    rng = random.Random(5)
    texts = [some_words(rng) for _ in range(60)]
    assert periodic_runs.runs_by_text(texts) == [plain_runs(t) for t in texts]


def test_long_runs_are_quick():
    for words in (["a"] * 100_000, list("ab") * 50_000, [str(k % 3_000) for k in range(100_000)]):
        assert periodic_runs.runs_by_text([words]) == [[(0, 100_000, len(set(words)))]]


def plain_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if key is None else str(key)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_rows(spark, docs):
    rng = random.Random(8)
    more = [(k, " ".join(some_words(rng)) + "\x1c日 é x\x85y") for k in range(300)]
    for frame in (docs.where("doc_id is null or doc_id <> 5"), spark.createDataFrame(more, "doc_id BIGINT, text STRING")):
        want = sorted((plain_row(r["doc_id"], r["text"]) for r in frame.collect()), key=str)
        assert rows_of(periodic_runs.digests(frame), *RUN_COLUMNS) == want
    assert periodic_runs.digests(docs.limit(0)).count() == 0
    assert sum(w[1] > 1 for w in want) > 20
    long = periodic_runs.digests(docs.where("doc_id = 5")).first()
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 40_000, 1)


def test_run_rows_of_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in load(spark, SF, "documents").collect()}
    short = {k for k, t in texts.items() if len(t or "") < 6_000}
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k in short:
        assert tuple(got[k][c] for c in RUN_COLUMNS) == plain_row(k, texts[k])
    assert any(got[k]["n_runs"] for k in short)
