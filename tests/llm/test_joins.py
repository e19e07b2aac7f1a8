"""Joins, search, packing, archives and the pipeline against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from daykeeper.llm import near_vectors, ngram_join, packing, top_k, web_archive
from daykeeper.llm.common import connected, load
from daykeeper.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def classes(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_single_nodes(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    nodes = {x for e in edges for x in e} | {500}
    got = connected(spark.createDataFrame([(n,) for n in nodes], "id BIGINT"), spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()
    assert {r["id"]: r["label"] for r in got} == {n: 1 if n <= 40 else 100 if n < 160 else 199 if n < 201 else 500 for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_classes(rows):
    """rows (doc_id, text) sorted by doc_id, without null ids."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    both = Counter()
    for held in where.values():
        for x, i in enumerate(held):
            for j in held[x + 1 :]:
                both[i, j] += 1
    pairs = [(i, j) for (i, j), n in both.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    root = classes(len(rows), pairs)
    return {(rows[i][0], len(sets[i]), rows[root[i]][0]) for i in range(len(rows))}


def near_copies(seed=3):
    """A large group of near copies whose links form chains, a passage that many share, copies, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            text[at] = word()
        rows.append(" ".join(text))
        base = text if k % 7 == 0 else base
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.choice([10, 14, 16, 40]))) for _ in range(40)]
    rows += ["a b", "A b", "a  b\n", "a b c d e", "a b c d f", "", None, "   ", rows[3], rows[3].upper(), "é x", "É x"]
    return [(k * 3 % 1009, t) for k, t in enumerate(rows)]


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rows = near_copies()
    extra = [(None, rows[0][1], "x"), (None, None, "x")]
    table = spark.createDataFrame([(*r, "x") for r in rows] + extra, "doc_id BIGINT, text STRING, sign STRING")
    want = brute_classes(sorted(rows))
    for fragment in (2_000_000, 500):
        monkeypatch.setattr(ngram_join, "FRAGMENT_NGRAMS", fragment)
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", 12_000_000 if fragment > 500 else 3_000)
        got = [tuple(r) for r in ngram_join.components(table).collect()]
        assert {r for r in got if r[0] is not None} == want and len(got) == len(rows) + 2
        assert {r[2] for r in got if r[0] is None} == {None}


def test_ngram_join_of_empty_and_repeated_rows(spark):
    schema = "doc_id BIGINT, text STRING"
    assert ngram_join.components(spark.createDataFrame([], schema)).count() == 0
    got = ngram_join.components(spark.createDataFrame([(5, "a b"), (5, "a b"), (2, None), (9, "long " * 30_000)], schema)).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 2), (5, 1, 5), (5, 1, 5), (9, 1, 9)]


def test_ngram_join_of_the_tables(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in load(spark, SF, "documents").collect())
    assert {tuple(r) for r in QUERIES["op1_ngram_join"](spark, SF).collect()} == brute_classes(rows)


def brute_links(rows):
    """n_links per (doc_id, set) of rows (doc_id, text), row by row."""
    sets = [shingles(t) for _, t in rows]
    linked = lambda a, b: a and 100 * len(a & b) >= 80 * len(a | b)
    return sorted((rows[i][0], len(a), sum(bool(linked(a, b)) for j, b in enumerate(sets) if i != j)) for i, a in enumerate(sets))


@pytest.mark.parametrize("block", [128, 7])
def test_ngram_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_LEAST", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 4_096 if block > 7 else 50)
    rows = near_copies() + [(3000 + k, "one two three four five six seven") for k in range(9)]
    table = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id BIGINT, text STRING")
    got = ngram_join.links(table).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got if r["doc_id"] is not None) == brute_links(rows)
    assert [(r["component_id"], r["n_links"]) for r in got if r["doc_id"] is None] == [(None, 0)]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_classes(sorted(rows))
    assert max(r["n_links"] for r in got) > 20 and ngram_join.links(table.limit(0)).count() == 0


def test_ngram_links_of_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, SF, "documents").collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in QUERIES["op1_ngram_links"](spark, SF).collect()) == brute_links(rows)


def clusters(seed=1, n=400, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    near = centres[rng.integers(0, 12, n // 2)] + rng.normal(scale=0.16, size=(n // 2, width))
    tight = np.repeat(rng.normal(size=(1, width)), n // 4, axis=0) + rng.normal(scale=0.01, size=(n // 4, width))
    return np.concatenate([near, tight, rng.normal(size=(n - len(near) - len(tight), width))]).astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [4096, 60])
def test_near_vectors_equal_brute_force(spark, block):
    v = clusters()
    rows = [(int(k * 7 % 997), [float(x) for x in row], "c") for k, row in enumerate(v)]
    odd = [(2000, None, "c"), (2001, [0.0] * 16, "c"), (2002, [float("nan")] * 16, "c"), (2003, [None] * 16, "c"), (2004, [float("inf")] + [1.0] * 15, "c"), (2005, [], "c")]
    table = spark.createDataFrame(rows + odd + [rows[0]], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label STRING")
    got = [tuple(r) for r in near_vectors.near_duplicates(table, block=block).collect()]
    order = np.argsort([r[0] for r in rows])
    ids = np.array([r[0] for r in rows])[order]
    unit = (v / np.linalg.norm(v, axis=1, keepdims=True))[order]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    root = classes(len(ids), np.argwhere(links))
    want = {(int(ids[k]), int(links[k].sum()), int(ids[root[k]]), root[k] == k) for k in range(len(ids))}
    assert set(got) == want | {(k, 0, k, True) for k in range(2000, 2006)} and len(got) == len(rows) + 7


def test_cover_tree_levels_cover_and_nest():
    unit = clusters(4)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    levels = near_vectors.grow(unit)
    above = set()
    for radius, level in zip(near_vectors.RADII, levels):
        away = np.linalg.norm(unit - unit[level.centre[level.node]], axis=1)
        assert away.max() <= radius + 1e-9 and (away <= level.reach[level.node] + 1e-9).all()
        assert above <= set(level.centre.tolist())
        above = set(level.centre.tolist())
    assert (levels[-1].node == np.arange(len(unit))).all()


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert near_vectors.near_duplicates(table).count() == 0
    one = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert sorted(map(str, near_vectors.near_duplicates(one).collect())) == sorted(
        ["Row(vec_id=1, n_links=0, component_id=1, kept=True)", "Row(vec_id=None, n_links=0, component_id=None, kept=False)"]
    )


@pytest.mark.parametrize("chunk", [2048, 30])
def test_search_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(top_k, "CHUNK", chunk)
    monkeypatch.setattr(top_k, "BLOCK", chunk)
    if chunk == 30:
        # A grid of many cells instead of one.
        monkeypatch.setattr(top_k, "GROUP", 1)
        monkeypatch.setattr(top_k, "CELL", 1)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(1, 8)), 80, axis=0), np.zeros((5, 8))]).astype(np.float32)
    rows = [(k, [float(x) for x in row], "c") for k, row in enumerate(v)]
    odd = [(1000, None, "c"), (1001, [float("nan")] * 8, "c"), (1050, [None] * 8, "c"), (None, [1.0] * 8, "c")]
    table = spark.createDataFrame(rows + odd, "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING")
    q = np.floor(256 * v.astype(float)).astype(int)
    want = set()
    for k in range(0, len(v), 10):
        score = q @ q[k]
        best = [j for j in np.lexsort((np.arange(len(v)), -score)) if j != k][:5]
        want |= {(k, place + 1, int(j), int(score[j])) for place, j in enumerate(best)}
    assert {tuple(r) for r in top_k.search(table, F.col("vec_id") % 10 == 0).collect()} == want
    assert top_k.search(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = table.where("vec_id < 3")
    assert top_k.search(few, F.col("vec_id") == 0).count() == 2


def test_search_scores_vectors_of_any_size(spark):
    rng = np.random.default_rng(5)
    sizes = [1.0, 300_000.0, 1e9, 1e4]
    rows = [(k, [float(x) for x in (rng.normal(size=6) * sizes[k % 4]).astype(np.float32)]) for k in range(120)]
    rows += [(200, [3e38] * 6), (210, [-3e38] * 6), (220, [float(1 << 24)]), (230, [])]
    probe = [(0, [300_000.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [5.0, 0.0])]
    for table, step in ((rows, 10), (probe, 50), (rows[1:120:4] + rows[120:], 1)):
        whole = {k: [math.floor(256 * Fraction(x)) for x in v] + [0] * (6 - len(v)) for k, v in table}
        want = []
        for k in whole:
            if k % step == 0:
                scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[k], whole[j])))), j) for j in whole if j != k]
                want += [(k, place + 1, j, -score) for place, (score, j) in enumerate(sorted(scored)[:5])]
        frame = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<FLOAT>")
        assert sorted(map(tuple, top_k.search(frame, F.col("vec_id") % step == 0).collect())) == sorted(want)


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_documents(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(
        [(1, "Hello, world!", 9), (2, None, 9), (3, "", 9), (4, "word " * 9000, 9), (1, "Hello, world!", 9), (None, "É ΑΣ <|endoftext|>", 9)], "doc_id BIGINT, text STRING, piece INT"
    )
    rows = packing.pack(packing.pieces_of(docs, TOKENIZER)).collect()
    model = Tokenizer.from_file(TOKENIZER)
    check_packed(rows, 4096)
    for key, text in ((1, "Hello, world!"), (2, ""), (3, ""), (4, "word " * 9000), (None, "É ΑΣ <|endoftext|>")):
        ids = model.encode(text, add_special_tokens=False).ids + [1]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == key)
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        want = [(k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
        assert own == sorted(want * (2 if key == 1 else 1))
    assert packing.pack(packing.pieces_of(docs.limit(0), TOKENIZER)).count() == 0


def test_packing_rounds_reach_few_sequences(spark):
    rng = random.Random(4)
    lengths = [rng.choice([5, 60, 300, 700, 1500, 2049, 2100, 3000, 4096]) for _ in range(3000)]
    table = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id BIGINT, piece INT, length BIGINT")
    rows = packing.pack(table, partition_pieces=300).collect()
    bound = packing.lower_bound(np.array(lengths), 4096)
    used = check_packed(rows, 4096)
    alone = int(packing.best_fit_decreasing(np.array(lengths), 4096).max()) + 1
    assert len(rows) == 3000 and bound <= used <= alone + 3


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(6)

    def optimum(items, capacity):
        best = len(items)

        def place(k, free):
            nonlocal best
            if len(free) >= best:
                return
            if k == len(items):
                best = len(free)
                return
            for at in {f: i for i, f in enumerate(free) if f >= items[k]}.values():
                place(k + 1, [*free[:at], free[at] - items[k], *free[at + 1 :]])
            place(k + 1, [*free, capacity - items[k]])

        place(0, [])
        return best

    for _ in range(150):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))), reverse=True)
        found = optimum(items, 20)
        bins = packing.best_fit_decreasing(np.array(items), 20)
        assert packing.lower_bound(np.array(items), 20) <= found <= bins.max() + 1
        assert np.bincount(bins, weights=items).max() <= 20


def test_archive_round_trip(spark):

    long, other = "<p>" + "x" * 200, "é" * 60
    rows = [(5, "http://b.org/1", long), (3, "http://a.org/1", long), (9, None, long), (7, "http://a.org/2", other), (8, "x\ny://h/\r\n", other), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "http://a.org/1", long)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id BIGINT, url STRING, html STRING, offset STRING")
    got = sorted(map(tuple, web_archive.archive_round_trip(pages, file_lines=2).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        revisit = len(raw) >= 100 and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert web_archive.archive_round_trip(pages.limit(0)).count() == 0


def test_sets_of_few_words_in_all():
    for count in range(12):
        for words in range(1, 7):
            sets = ngram_join.ngram_sets([" ".join(f"w{k}" for k in range(count)), None, ""], words)
            assert [len(s) for s in sets] == [max(1, count - words + 1) if count else 0, 0, 0]


def test_archives_of_pages_without_id(spark, monkeypatch):
    long, other = "p" * 200, "q" * 200
    rows = [(None, "u", long), (4, "v", long), (None, "w", other), (None, "w", other), (None, None, "x")]
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in web_archive.archive_round_trip(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect() if r["page_id"])
    assert got == [(4, 200, "response", None)]
    by_size = [(r["payload_bytes"], r["record_type"], r["refers_to"]) for r in web_archive.archive_round_trip(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect() if r["page_id"] is None]
    assert sorted(by_size, key=str) == sorted([(200, "revisit", 4), (200, "response", None), (200, "response", None), (1, "response", None)], key=str)
    named = spark.createDataFrame([("None", "u", long), (None, "u", other), ("a>b", "u", other)], "page_id STRING, url STRING, html STRING")
    assert sorted(((r["page_id"], r["record_type"]) for r in web_archive.archive_round_trip(named).collect()), key=str) == [("None", "response"), ("a>b", "response"), (None, "revisit")]


def test_index_files_are_bounded_without_an_end():
    assert [web_archive.index_files(n) for n in (0, 1, 8_000, 8_001, 10**12)] == [1, 1, 1, 2, web_archive.MOST_FILES]


def test_damaged_records_are_noticed():
    raw = web_archive.write_record(1, "u", b"payload", "0" * 64, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        web_archive.read_record(raw)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"wort{k} the und" for k in range(60))
    rows = [
        (1, "the cat and the dog " * 8, "en", "s", 1), (2, text + " mail a@b.org", "de", "s", 1), (3, text + " mail a@b.org end", "de", "s", 1), (4, "1234 ...", "en", "s", 1), (5, None, None, None, None),
        (6, "der hund und die katze " * 8, "de", "s", 1), (2, text + " mail a@b.org", "de", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r["doc_id"] for r in docs.collect())
    assert seen["language"] == [1, 2, 2, 3, 6] and seen["near_duplicates"] == [1, 2, 6] and seen["packing"] == [1, 2, 6]
    masked = spark.read.parquet(str(tmp_path / "personal_data")).where("doc_id = 2").first()
    assert masked["text"].endswith("mail <email>") and masked["n_chars"] == len(masked["text"])


def test_pipeline_keeps_documents_where_no_language_can_be_learned(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    for label in (None, "en"):
        rows = [(1, "the cat and the dog", None, "s", 1), (2, "1234 ...", label, "s", 1), (3, None, label, None, None), (4, "", None, "s", 0), (5, "日本", None, "s", 2)]
        out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), str(tmp_path))
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 5] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_turns_away_noise_and_unlearned_languages(spark, tmp_path):
    import corpus_pipeline

    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 9))) for _ in range(60)) for _ in range(20)]
    others = ["съешь ещё этих мягких французских булок да выпей чаю " * 2, "日本語の文章はこのように書かれています。" * 4]
    odd = [(10**6 + k, text, None, "s", len(text)) for k, text in enumerate(noise + others)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"))
    kept = Counter(r["doc_id"] for r in corpus_pipeline.identify_language(spark, table, str(tmp_path)).select("doc_id").collect())
    assert kept == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
