"""Per-row operators against brute force and round trips: byte BPE, personal data, language, pages, urls."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape

import public_tokenizers
import pytest

from daykeeper.llm import byte_bpe, language, main_text, personal_data, url_filter
from daykeeper.llm.common import load
from daykeeper.llm.queries import ORACLE, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Hello world, don't stop 123 times!\n\n  ok", "en", "clash"), (2, None, None, None), (3, "", "en", "x"), (4, "  \n", None, "x"), (5, "long " * 40_000, "en", "x"),
        (1, "Hello world, don't stop 123 times!\n\n  ok", "en", "clash"), (None, "é ▁ 日本 ² \x1c x", "de", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, score STRING")


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes_back(spark, docs):
    want = reference_encoding()
    got = byte_bpe.encode_texts(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == 7
    for r in got:
        assert list(memoryview(bytes(r["ids"])).cast("I")) == want.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"])
    coder = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, cache_entries=50)
    rng = random.Random(1)
    odd = ["".join(rng.choices("a '\n s1.\té²\x85▁Σ日", k=15)) for _ in range(3000)]
    assert [list(memoryview(c).cast("I")) for c in coder.encode(odd)] == [want.encode_ordinary(t) for t in odd]


def test_byte_bpe_of_the_tables(spark):
    want = reference_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in load(spark, SF, "documents").collect()}
    got = QUERIES["op7_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = want.encode_ordinary(texts[r["doc_id"]])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and personal_data.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choices("a@.1+-( )2_é0", k=rng.randrange(30)))
        assert plain_base(text) == personal_data.base_spans(text)
    assert personal_data.base_spans("4111 1111 1111 1111, x@y.org 300.1.1.1") == [(0, 19, "card"), (21, 28, "email")]
    assert personal_data.base_spans("1" * 50_000 + "a" * 50_000) == []


def test_the_field_adds_spans_and_keeps_base_ones():
    weights = personal_data.trained()
    held_out = personal_data.examples(200, seed=99)
    exact = sum({*personal_data.all_spans(t, weights)[1]} == {*spans} for t, spans in held_out)
    assert exact >= 190
    for text, kinds in (
        ("write to jane.doe [at] mail3 [dot] org today", ["email"]), ("call (212) 555-0199 at noon", ["phone"]), ("in 1999 we sold 12.50 of 3.4.5 on 2024-01-02", []), ("no 6791628068594161 here", []),
    ):
        assert [k for _, _, k in personal_data.all_spans(text, weights)[1]] == kinds
    text = "mail a@b.org and 10.0.0.1 or +1 (269) 555-3296 4524132264652876 x"
    base, spans = personal_data.all_spans(text, weights)
    assert set(base) <= set(spans)
    assert personal_data.mask("a@b.c d", [(0, 5, "email")]) == "<email> d"


def test_spans_do_not_depend_on_windows():
    weights = personal_data.trained()
    rng = random.Random(12)
    made = [t for t, _ in personal_data.examples(150, seed=77)]
    texts = [(" ".join(rng.choices(["word", "a", "x-y", "nine", "\n"], k=rng.randrange(60)))).join(rng.sample(made, 6)) for _ in range(60)]
    texts += ["5 " + "w" * k + " word" * 8 + " jane.doe [at] mail3 [dot] org" for k in range(12)] + ["1 " * 300, "n" * 60 + ".b [at] mail3 [dot] org", "7" * 700 + " " + "z" * 900 + " 8"]
    for text in texts:
        tokens, segments = personal_data.candidates(text)
        read = [t for w in personal_data.windows(text) for t in w]
        assert read == sorted(set(read)) and set(read) <= set(tokens)
        whole = [(tokens[a][0], tokens[b - 1][1], k) for a, b, k in personal_data.decode(len(tokens), segments, weights)]
        base = personal_data.base_spans(text)
        added = [s for s in whole if not any(s[0] < y and x < s[1] for x, y, _ in base)]
        assert sorted(base + added) == sorted(personal_data.all_spans(text, weights)[1])
    for k in range(12):
        text = texts[60 + k]
        assert [text[s:e] for s, e, kind in personal_data.all_spans(text, weights)[1] if kind == "email"] == ["jane.doe [at] mail3 [dot] org"]
    assert personal_data.mask(texts[73], personal_data.all_spans(texts[73], weights)[1]) == "<email>"


def test_decoding_equals_enumeration():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        spans = sorted({(a, rng.randrange(a + 1, n + 1)) for a in (rng.randrange(n) for _ in range(8))})
        segments = [(a, b, "email", [f"{a},{b}"]) for a, b in spans]
        weights = {s[3][0]: rng.choice([-1.0, 0.5, 1.0, 2.0, 3.5]) for s in segments}

        def best(at):
            if at == n:
                return 0.0
            return max([best(at + 1)] + [weights[s[3][0]] + best(s[1]) for s in segments if s[0] == at])  # noqa: B023

        got = personal_data.decode(n, segments, weights)
        assert sum(weights[f"{a},{b}"] for a, b, _ in got) == best(0)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_segment_scores_sum_to_one_over_all_segmentations():
    tokens, segments = personal_data.candidates("call 212-555-0199 or 10.0.0.1 x")
    weights = personal_data.trained()
    import math

    def total(at):
        if at == len(tokens):
            return 1.0
        return total(at + 1) + sum(math.exp(sum(weights.get(n, 0) for n in s[3])) * total(s[1]) for s in segments if s[0] == at)

    assert math.isclose(math.log(total(0)), personal_data.expected(len(tokens), segments, weights)[0], rel_tol=1e-9)


def test_personal_data_handles_odd_rows(spark, docs):
    got = personal_data.span_digests(docs).collect()
    assert len(got) == 7 and {r["spans"] for r in got} == {""}
    assert personal_data.find_spans(docs.limit(0)).count() == 0
    masked = {r["doc_id"]: r for r in personal_data.mask_texts(docs).collect()}
    assert masked[2]["text"] is None and masked[3]["text"] == "" and masked[1]["score"] == "clash"


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in load(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(got) == len(langs)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_handles_odd_rows(spark, docs):
    got = language.identify(docs, docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and {by[k]["lang_pred"] for k in (2, 3, 4)} == {"und"} and by[1]["lang_pred"] in ("en", "de")
    assert by[2]["score"] == 0.0 and set(got[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    rows = []
    for k in range(30):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåø", 9)
        word = lambda: "".join(rng.choices(letters, k=5))  # noqa: B023, E731
        rows += [(" ".join(word() for _ in range(40)), f"l{k:02}") for _ in range(40 if k < 25 else 3)]
    table = spark.createDataFrame([*rows, *[("123", "none")] * 50], "text STRING, lang STRING")
    learned = language.training_rows(table)
    assert len(learned) == 25 * 40 + 5 * 3 and set(learned) == set(rows)
    few = language.training_rows(table, per_language=10, most_rows=90)
    assert Counter(lang for _, lang in few) == {f"l{k:02}": 3 for k in range(30)}
    least = language.training_rows(table, per_language=10, most_rows=5)
    assert Counter(lang for _, lang in least) == {f"l{k:02}": 1 for k in range(30)}
    got = language.identify(table.where("lang <> 'none'"), table).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and len({r["lang_pred"] for r in got}) == 30


def test_copies_do_not_crowd_the_fit(spark, monkeypatch):
    rows = [("uno dos tres cuatro cinco " * 30, "es")] * 500 + [(f"palabra {chr(97 + k)} otra", "es") for k in range(20)] + [(f"word {chr(97 + k)} other", "en") for k in range(20)]
    learned = language.training_rows(spark.createDataFrame(rows, "text STRING, lang STRING"), per_language=30, most_rows=60)
    assert len(learned) == 41 and Counter(lang for _, lang in learned) == {"es": 21, "en": 20}
    model = language.fit([(f"{k} abcd efgh ijkl", "x") for k in range(9)] + [("ab", "x"), ("cd", "y")], landmarks=6)
    assert len(model.landmarks) == 3
    monkeypatch.setattr(language, "FIT_CHARS", 50)
    short = language.training_rows(spark.createDataFrame([("9" * 99 + "abc " * 50, "x"), ("d" * 80, "y")], "text STRING, lang STRING"))
    assert sorted(short) == [(("abc " * 50)[:25], "x"), ("d" * 25, "y")]


def test_kernel_counts_shared_places():
    import numpy as np

    model = language.fit([("abab cd", "x"), ("zzyy", "y")], landmarks=2)
    flags = np.zeros((1, 1 << language.BITS), np.uint8)
    language.presence("ab cd", flags[0])
    marks = np.zeros((2, 1 << language.BITS), np.uint8)
    language.presence("abab cd", marks[0])
    language.presence("zzyy", marks[1])
    want = (flags @ marks.T.astype(int)) / np.sqrt(flags.sum() * marks.sum(axis=1, dtype=int))
    assert np.allclose(model.kernel(flags), want)


def test_main_text_is_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in load(spark, "/root/testdata/sf0.01", "pages").collect()}
    for r in QUERIES["op8_main_text"](spark, "/root/testdata/sf0.01").collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?(p|h\d|br)>", " ", re.sub(r"</?b>", "", inner))
        want = " ".join(unescape(re.sub(r"<!--.*?-->|<[^>]*>", "", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_main_text_of_other_pages(spark):
    page = (
        "<header>Shop <a href=x>Home</a></header><nav><a>a</a></nav><div id='content'><h2>Title here</h2><p>" + "word " * 40 + "</p><p>x &lt; y&nbsp; z</p><p>" + "more " * 30
        + "</p></div><div class='comments'><p>" + "I like it " * 10 + "</p></div><aside>Buy</aside><form>Name</form><script>var a = '<p>no</p>'</script>"
    )
    assert main_text.main_text(page) == "Title here " + "word " * 40 + "x < y z " + ("more " * 30).strip()
    assert main_text.main_text("<article>a<b>b</b> c<!-- no --><p>d</article") == "ab c d"
    assert main_text.main_text("<article><p>one</p><div class='ad'>buy</div><p>two") == "one two"
    body = "<h2>Head line</h2><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p>"
    want = "Head line " + "word " * 60 + ("more " * 40).strip()
    for name in ("class='content has-sidebar'", "id='page' class='no-comments'", "class=header-image", "class='social-studies'", "id=tags-page", "class='form'", "id='search-results menu'"):
        assert main_text.main_text(f"<body><nav><a>a</a></nav><div {name}>{body}</div><footer>f</footer>") == want, name
        assert main_text.main_text(f"<body><div class='sidebar'><article>{body}</article></div>") == want
    for name in ("class='ad-slot'", "id=commentsList", "class='site-footer'", "class='main-menu'", "class='cookie-notice box'", "class='related-posts'"):
        page = f"<nav><a>a</a></nav><div id=content>{body}</div><div {name}><p>" + "other words here " * 8 + "</p></div>"
        assert main_text.main_text(page) == want, name
    assert main_text.main_text(f"<div id=content>{body}</div><div class=comments><p>" + "I like it " * 90 + "</p></div>") == want
    assert main_text.main_text(f"<div id=c>{body}</div><a href=x><div><h3>Other story</h3><p>Read this one as well</p></div></a><a href=y><div><p>And also read this one</p></div></a>") == want
    assert main_text.main_text("<article><button>Buy <p>one <math><mi>x</mi> = 2</math></p><option>two<p>three</article>") == "Buy one x = 2 two three"
    assert main_text.main_text("<article><p>a</p><button>no</button><svg><text>no</text></svg><p>b <a href=x>c<p>d</article>") == "a b c d"
    assert main_text.main_text("<article><p>a</p><script>b</article>") == "a"
    odd = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p", "t"), (3, "u", "<p", "t"), (None, "u", "<script>", "t")], "page_id BIGINT, url STRING, html STRING, text STRING")
    got = main_text.extract(odd).collect()
    assert len(got) == 5 and {(r["text"], r["n_chars"]) for r in got} == {("", 0)}
    assert main_text.extract(odd.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [
        "http://a.example.net/en/1", "http://a.example.net/de/1", "http://x.org/fr/", "http://x.org/fr", "http://EXAMPLE.com/de/?q", "http://example.com/dex", "http://net", "http://net/", "nothing", None, "", "http://x.net?a/b", "://org/fr/x#y",
        "http://myexample.net/en/", "http://a.b.c.example.com/de/x",
    ]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id BIGINT, url STRING, rule STRING")
    by_trie = url_filter.filter_urls(pages, URL_RULES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in by_trie.collect()}
    n, a, b = (None, "allow"), ("example.net/en/", "allow"), ("net/", "block")
    assert [got[k] for k in range(len(urls))] == [a, b, ("org/fr/", "allow"), n, ("example.com/de/", "block"), n, n, b, n, n, n, n, ("org/fr/", "allow"), b, ("example.com/de/", "block")]
    assert by_trie.count() == 16 and url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    key = lambda df: sorted(map(str, df.collect()))
    assert key(url_filter.filter_urls(pages, URL_RULES, trie_rules=0)) == key(by_trie)
    partial = [("x.org", "/ab", "block"), ("x.org", "/abc/d", "allow")]
    more = spark.createDataFrame([(1, "h://x.org/abx"), (2, "h://x.org/abc/de"), (3, "h://x.org/a")], "page_id BIGINT, url STRING")
    assert [r["rule"] for r in url_filter.filter_urls(more, partial).orderBy("page_id").collect()] == ["x.org/ab", "x.org/abc/d", None]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    import duckdb

    from compare import TABLES, compare

    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert compare(spark, db, name, SF) is None
