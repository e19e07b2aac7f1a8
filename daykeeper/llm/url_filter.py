"""URL rules over a trie of reversed host labels and path segments; the longest fitting rule wins."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie goes to every executor up to so many rules (about 200 bytes each); beyond, rules are joined.
TRIE_RULES = 200_000

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    ends = [at for at in map(rest.find, "/?#") if at >= 0]
    cut = min(ends, default=len(rest))
    tail = rest[cut:]
    stops = [at for at in map(tail.find, "?#") if at >= 0]
    return rest[:cut].translate(_LOWER), tail[: min(stops, default=len(tail))]


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Rules (host, path, verdict) as nested dicts: host labels from the right, then path segments.

    All but the last segment of a rule's path are edges; the last one is a text that the url's segment
    must start with (empty after a closing slash). Of equal host and path, block wins.
    """
    root: dict = {"labels": {}, "paths": None}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"segments": {}, "starts": {}}
        *whole, last = path.split("/")
        step = node["paths"]
        for segment in whole:
            step = step["segments"].setdefault(segment, {"segments": {}, "starts": {}})
        if step["starts"].get(last, ("", ""))[1] != "block":
            step["starts"][last] = (f"{host}{path}", verdict)
    return root


def judge(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most characters that fits (host and all subdomains, path by its start).

    Of equal length, the one with the longer host.
    """
    best, size = None, -1
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")) if host else ():
        node = node["labels"].get(label)
        if node is None:
            break
        step = node["paths"]
        for segment in segments:
            if step is None:
                break
            for start, found in step["starts"].items():
                if segment.startswith(start) and len(found[0]) >= size:
                    best, size = found, len(found[0])
            step = step["segments"].get(segment)
    return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null where none fits), verdict (the rule's, else ``default``).

    ``rules`` hold host, path and ``allow`` or ``block``. Null urls and urls without ``://`` have empty
    host and path, which no rule fits. Repeated pages give repeated rows; an empty table gives none.
    """
    if len(rules) > trie_rules:
        return _by_join(pages, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    schema = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [judge(trie, *p) or (None, default) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(run, schema)


def _by_join(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same for rule lists too large to broadcast: every host suffix meets the rules of that host."""
    spark = pages.sparkSession
    schema = "suffix string, rule_path string, rule_verdict string, rule_text string"
    table = spark.createDataFrame([(h.translate(_LOWER), p, v, f"{h}{p}") for h, p, v in rules], schema)
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = (
        pages.select("page_id", rest.alias("rest"))
        .withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
        .withColumn("host", F.translate("raw", string.ascii_uppercase, string.ascii_lowercase))
        .withColumn("path", F.regexp_extract(F.expr("substring(rest, char_length(raw) + 1)"), r"^[^?#]*", 0))
        .select("page_id", "host", "path")
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # Equal places are judged once, whatever number of pages has them.
    places = split.select("host", "path").distinct()
    offered = places.withColumn("suffix", F.explode(suffixes)).join(table, "suffix")
    fits = F.col("path").startswith(F.col("rule_path"))
    rank = F.struct(
        F.char_length("rule_text").alias("n"), F.char_length("suffix").alias("h"), (F.col("rule_verdict") == "block").alias("b"),
        F.col("rule_text").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = offered.where(fits).groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
