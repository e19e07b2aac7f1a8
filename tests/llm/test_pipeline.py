"""The corpus pipeline as a whole: run(), empty tables, columns of any name."""

import public_tokenizers

import corpus_pipeline
from daykeeper.llm import ngram_join, packing
from daykeeper.llm.common import load

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def test_near_duplicates_with_columns_of_any_name(spark):
    text = " ".join(f"wort{k}" for k in range(80))
    rows = [(k, t, "x", 1, "a", "b", 2, "c") for k, t in ((1, text), (2, text + " end"), (3, "other words"), (3, "other words"), (3, "a third text"), (None, text), (None, None), (9, None), (4, ""))]
    names = "doc_id BIGINT, text STRING, kept_id STRING, rows BIGINT, component_id STRING, text_sign STRING, copies BIGINT, `n.shingles` STRING"
    out = ngram_join.keep_first(spark.createDataFrame(rows, names))
    assert out.columns == spark.createDataFrame(rows, names).columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, text), (3, "a third text"), (3, "other words"), (None, None), (None, text), (4, ""), (9, None)], key=str)
    assert {(r["kept_id"], r["rows"], r["copies"]) for r in out.collect()} == {("x", 1, 2)}


def test_stages_of_an_empty_table_and_with_extra_columns(spark, tmp_path):
    extra = ", rows BIGINT, kept_id STRING, label STRING, n BIGINT, score DOUBLE, lang_pred STRING, `place` INT, sequence_id STRING, `offset` STRING, piece STRING"
    row = (7, "the cat and the dog " * 8, "en", "s", 160, 1, "k", "l", 2, 0.5, "p", 3, "q", "o", "r")
    for k, rows in enumerate(([], [row, (8, None, *row[2:])])):
        docs = spark.createDataFrame(rows, SCHEMA + extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{k}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert [r["doc_id"] for r in docs.collect()] == ([7] if rows else [])


def test_run_equals_its_stages_done_plainly(spark):
    """Packed are exactly the documents that language and near-duplicates keep, with masked texts' own token ids."""
    got = corpus_pipeline.run(spark, SF).collect()
    docs = load(spark, SF, "documents")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    rows = {r["doc_id"]: r["text"] or "" for r in kept.select("doc_id", "text").collect()}
    sets = {}
    for key, text in rows.items():
        words = text.encode().lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {k: k for k in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    first = {k for k in keys if find(k) == k}
    assert {r["doc_id"] for r in got} == first and len(first) < len(rows) <= docs.count()
    masked = corpus_pipeline.mask_personal_data(spark, kept.where(kept["doc_id"].isin(sorted(first))), SF)
    want = packing.pieces_of(masked, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in want)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = {}
    for sequence, offset, length in places:
        assert offset == at.get(sequence, 0) and offset + length <= 4096
        at[sequence] = offset + length
