"""Documents whose sets of word n-grams are alike: a similarity join over fragments of the n-gram order.

The order of all n-grams is by document frequency, then hash. It is cut into fragments; what two
documents share is counted in each fragment by itself and summed per pair. Before that, two passes find
the documents that can have a partner at all:

1. Every task hashes the n-gram sets of its documents and sends each fragment of the hash range the
   n-grams once, however many of its documents hold them, so no list in a fragment is longer than the
   number of slices. A fragment answers which of them other slices hold too. A document of whose n-grams
   fewer than the threshold's share occur elsewhere has no partner and goes.
2. Documents with equal sets become one vertex; the pass is repeated on the vertices.

On what is left, the rarest n-grams of a document (its prefix) must meet those of a partner. Documents
in a prefix list are first compared with one of them only, and what these links connect is done; lists
that still hold several components go on with other members, and the last round compares all pairs
across components. So a large group of near copies costs a few comparisons a member, not all pairs, and
no component is missed.

For the number of links all pairs inside a component count. ``links`` cuts each component into blocks,
compares every two blocks in a task of their own and hands on sums per vertex, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, free_name, stored

#: Words in an n-gram and the similarity in percent.
WORDS, PERCENT = 5, 80
#: n-grams in a fragment of the hash range on the average, and bytes of text hashed at a time.
FRAGMENT_NGRAMS = 1_000_000
SLICE_BYTES = 5_000_000
#: Fragments of the n-gram order in which overlaps are counted.
ORDER_FRAGMENTS = 4
#: Rounds in which a list is compared with a single member, before all pairs across components.
STAR_ROUNDS = 2
#: For counted links: vertices of a block at least and at most (a component has 32 blocks in between), bytes
#: of their sets, and columns of an overlap matrix that are multiplied at a time.
BLOCK_LEAST, BLOCK_MOST, BLOCK_BYTES, COLUMNS = 128, 2_048, 4_000_000, 4_096

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SEVERAL = 0xFFFF


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def ngram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of ``words``-grams as sorted 64-bit hashes.

    A-Z count as a-z; words are what space and U+0009 to U+000D separate. A text with fewer words is one
    n-gram by itself; null, empty and blank texts have the empty set.
    """
    from xxhash import xxh64_intdigest

    cut = [t.encode().lower().split() if t else [] for t in texts]
    flat = [w for ws in cut for w in ws]
    h = np.fromiter(map(xxh64_intdigest, flat), np.uint64, len(flat))
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _P + h[k : k + len(rolled)]
    rolled = _mix(rolled)
    out, at = [], 0
    for ws in cut:
        n = len(ws)
        if n >= words:
            own = np.sort(rolled[at : at + n - words + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            value = np.array([n], np.uint64)
            for k in range(at, at + n):
                value = value * _Q + h[k : k + 1]
            out.append(_mix(value))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(own: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    if not len(own):
        return 0
    total, parity = _mix(np.array([own.sum(dtype=np.uint64)])), _mix(np.array([np.bitwise_xor.reduce(own)]))
    return int((total * _Q + parity + np.uint64(len(own))).astype(np.int64)[0])


Member = tuple[int, int, np.ndarray]


def _slices_of_texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[Member]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or (size < SLICE_BYTES and end - at < 60_000)):
                size += len(texts[end] or "")
                end += 1
            sets = ngram_sets(texts[at:end], words)
            yield [(i, signature(s), s) for i, s in zip(ids[at:end], sets)]
            at = end


def _slices_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Member]]:
    for batch in batches:
        ids, signs, sets = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or (size < 8 * 2_000_000 and end - at < 60_000)):
                size += len(sets[end])
                end += 1
            yield [(i, g, np.frombuffer(s, "<u8")) for i, g, s in zip(ids[at:end], signs[at:end], sets[at:end])]
            at = end


_SENT = "fragment int, slice bigint, kind int, a binary, b binary, c binary, d binary"


def _send(members: list[Member], number: int, seen: set[int], fragments: int) -> Iterator[dict]:
    """One slice: for each fragment its n-grams (low 32 bits of the hash) and the document of each; an
    n-gram of several documents of the slice goes once, and they are told here that it is shared."""
    keys = np.array([m[0] for m in members], "<i8")
    signs = np.array([m[1] for m in members], "<i8")
    sizes = np.array([len(m[2]) for m in members], "<i4")
    shared = np.zeros(len(members), "<i4")
    first = []
    for k, (_, sign, own) in enumerate(members):
        if len(own) and sign not in seen:
            seen.add(sign)
            first.append(k)
    copies = np.ones(len(members), np.int8)
    copies[first] = 0
    if first:
        h = np.concatenate([members[k][2] for k in first])
        doc = np.repeat(np.array(first, np.int64), sizes[first])
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        same = np.r_[False, h[1:] == h[:-1]]
        run = same | np.r_[same[1:], False]
        shared += np.bincount(doc[run], minlength=len(members)).astype("<i4")
        doc[run] = _SEVERAL
        h, doc = h[~same], doc[~same].astype("<u2")
        fragment = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        for s, e in zip(starts, np.r_[starts[1:], len(h)]):
            yield {"fragment": int(fragment[s]), "slice": number, "kind": 0, "a": low[s:e].tobytes(), "b": doc[s:e].tobytes(), "c": b"", "d": b""}
    yield {
        "fragment": number % fragments, "slice": number, "kind": 1, "a": keys.tobytes(), "b": sizes.tobytes(), "c": signs.tobytes(),
        "d": shared.tobytes() + copies.tobytes(),
    }


def _answer(table: pa.Table) -> pa.Table:
    """One fragment: per slice the documents that hold n-grams of other slices, and how many."""
    rows = table.to_pylist()
    sent = [r for r in rows if r["kind"] == 0]
    out = [{"slice": r["slice"], "kind": 1, "a": r["a"], "b": r["b"], "c": r["c"], "d": r["d"]} for r in rows if r["kind"] == 1]
    if sent:
        h = np.concatenate([np.frombuffer(r["a"], "<u4") for r in sent])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        at = 0
        for r in sent:
            doc = np.frombuffer(r["b"], "<u2")
            doc = doc[twice[at : at + len(doc)] & (doc != _SEVERAL)]
            at += len(r["b"]) // 2
            if len(doc):
                which, count = np.unique(doc, return_counts=True)
                out.append({"slice": r["slice"], "kind": 0, "a": which.astype("<u2").tobytes(), "b": count.astype("<i4").tobytes(), "c": b"", "d": b""})
    return pa.Table.from_pylist(out, schema=_ANSWER)


_ANSWER = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
_COUNTED = "doc_id bigint, n int, sign bigint, shared int, copied boolean"


def _count(table: pa.Table) -> pa.Table:
    """One slice: its documents with the number of their n-grams that others hold."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 1)
    keys = np.frombuffer(own["a"], "<i8")
    shared = np.frombuffer(own["d"][: 4 * len(keys)], "<i4").copy()
    for r in rows:
        if r["kind"] == 0:
            shared[np.frombuffer(r["a"], "<u2")] += np.frombuffer(r["b"], "<i4")
    return pa.table(
        {
            "doc_id": keys, "n": np.frombuffer(own["b"], "<i4"), "sign": np.frombuffer(own["c"], "<i8"), "shared": shared,
            "copied": np.frombuffer(own["d"][4 * len(keys) :], np.int8).astype(bool),
        }
    )


def _counted(rows: DataFrame, slices, total: int) -> DataFrame:
    """Per document: n-grams, signature, how many n-grams another document has too (never fewer than
    there are: two n-grams whose 32 bits within a fragment agree count as shared)."""
    fragments = max(1, -(-total // FRAGMENT_NGRAMS))
    schema = pa.schema(
        [("fragment", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcd"]]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[int] = set()
        base = TaskContext.get().partitionId() << 32
        for k, members in enumerate(slices(batches)):
            yield pa.RecordBatch.from_pylist(list(_send(members, base + k, seen, fragments)), schema=schema)

    sent = rows.mapInArrow(send, _SENT)
    answers = sent.groupBy("fragment").applyInArrow(_answer, "slice bigint, kind int, a binary, b binary, c binary, d binary")
    return answers.groupBy("slice").applyInArrow(_count, _COUNTED)


def _enough(n: Column, percent: int) -> Column:
    """The fewest n-grams that a partner must share with a document of n."""
    return F.floor((n * percent + 99) / 100)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("sign", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _slices_of_texts(batches, words):
            columns = [[m[0] for m in members], [m[1] for m in members], [m[2].astype("<u8").tobytes() for m in members]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, sign bigint, own binary")


def _ngrams(vertices: DataFrame) -> DataFrame:
    """(vertex, n, h): a row for every n-gram of every vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.frombuffer(x.as_py(), "<i8") for x in part.column(1)]
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(np.array(sizes, np.int32), sizes)),
                        pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)),
                    ],
                    names=["vertex", "n", "h"],
                )

    return vertices.select("vertex", "own").mapInArrow(run, "vertex bigint, n int, h bigint")


def _between(low: float, high: float):
    return lambda t: (t["place"] >= low) & (t["place"] < high)


def _may_link(percent: int) -> Column:
    """What sizes, shared n-grams and places of a common n-gram (n, s, pos and m, t, at) allow.

    Two documents that link share at least ``need`` n-grams, so the first common one stands, in the order
    of either, before the last ``need`` - 1: a common n-gram that stands later proves nothing.
    """
    least = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    need = F.floor(((F.col("n") + F.col("m")) * percent + 99 + percent) / (100 + percent))
    places = (F.col("pos") + need <= F.col("n")) & (F.col("at") + need <= F.col("m"))
    return least & places & (F.least("s", "t") >= need)


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) whose overlaps, counted fragment by fragment, sum to the threshold."""
    left = segments.select(F.col("vertex").alias("a"), F.col("fragment").alias("f"), F.col("own").alias("x"))
    right = segments.select(F.col("vertex").alias("b"), F.col("fragment").alias("f"), F.col("own").alias("y"))
    met = pairs.join(left, "a").join(right, ["b", "f"])
    partial = met.select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("both"))
    summed = partial.groupBy("a", "b", "n", "m").agg(F.sum("both").alias("both"))
    return summed.where(F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent).select("a", "b")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) per row.

    Two documents link when 100 * shared >= percent * union of their sets. Null, empty and blank texts
    have the empty set and link with nothing. Rows with equal sets (copies among them) link at once and
    are compared with others as one. A null doc_id has a null component and links with nothing. Extra
    columns are not read. Empty table: no rows.
    """
    counted, classes, _, unkeyed = _classes(docs, words, percent)
    out = counted.join(classes, counted.sign == classes["class"], "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(unkeyed)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near-duplicates: of every component the row with the smallest doc_id.

    Rows without doc_id stay; of rows that repeat a doc_id and its text, one stays. All columns are kept,
    whatever their names. Empty table: no rows.
    """
    key, copies, sign = (free_name(docs, n) for n in ("kept_id", "copies", "text_sign"))
    classes = components(docs, words, percent)
    kept = classes.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias(copies))
    kept = kept.select(F.col("doc_id").alias(key), copies)
    joined = docs.join(kept, F.col("doc_id").cast("long") == F.col(key))
    alone = joined.where(F.col(copies) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = joined.where(F.col(copies) > 1).withColumn(sign, F.sha2(F.coalesce("text", F.lit("")), 256))
    repeated = repeated.dropDuplicates(["doc_id", sign]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of ``components`` and n_links: with how many other rows the row links.

    Copies count one by one: a row links with each further row of its own set and with each row of every
    set that reaches the threshold. Null doc_ids and empty sets have 0.
    """
    counted, classes, vertices, unkeyed = _classes(docs, words, percent)
    near = _link_counts(vertices, classes, percent).select(F.col("sign").alias("near_sign"), "near")
    found = classes.join(near, classes["class"] == near.near_sign, "left")
    found = stored(found.select("class", "component", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    out = counted.join(found, counted.sign == found["class"], "left")
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), n_links)
    return out.unionByName(unkeyed.withColumn("n_links", F.lit(0).cast("long")))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is counted per row; (class, component, copies) of the sets that several rows have or that may
    link; (vertex, sign, own) of those that may link; the finished rows without doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = stored(_counted(known, lambda b: _slices_of_texts(b, words), total // 6 + 1))
    unkeyed = _sets(rows.where("doc_id is null"), words).select("doc_id", F.expr("octet_length(own) div 8").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))

    possible = (F.col("n") > 0) & (F.col("shared") >= _enough(F.col("n"), percent))
    groups = counted.where("n > 0").groupBy("sign").agg(
        F.min("doc_id").alias("vertex"), F.count(F.lit(1)).alias("rows"), F.max((possible & ~F.col("copied")).cast("int")).alias("live"), F.max("n").alias("n")
    )
    groups = stored(groups)
    labels, vertices = _linked(known, groups.where("live = 1"), words, percent)
    classes = groups.join(labels, groups.vertex == labels.id, "left").where("rows > 1 or id is not null")
    classes = stored(classes.select(F.col("sign").alias("class"), F.coalesce("label", "vertex").alias("component"), F.col("rows").alias("copies")))
    return counted, classes, vertices, unkeyed


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``.

    Values of few sets add their pairs one by one; those of many are columns of 0 and 1, multiplied in
    fragments of COLUMNS whose partial overlaps are summed.
    """
    both = np.zeros((len(left), len(right)), np.int64)
    of_left = np.repeat(np.arange(len(left)), [len(s) for s in left])
    of_right = np.repeat(np.arange(len(right)), [len(s) for s in right])
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    in_left, in_right = column[: len(of_left)], column[len(of_left) :]
    held = np.bincount(in_left, minlength=column.max() + 1) * np.bincount(in_right, minlength=column.max() + 1)
    many = held * 64 > both.size
    number = np.cumsum(many) - 1
    for at in range(0, int(many.sum()), COLUMNS):
        sides = []
        for rows, columns, height in ((of_left, in_left, len(left)), (of_right, in_right, len(right))):
            own = many[columns] & (number[columns] >= at) & (number[columns] < at + COLUMNS)
            side = np.zeros((height, COLUMNS), np.float32)
            side[rows[own], number[columns[own]] - at] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    few = (held > 0) & ~many
    own = few[in_left]
    rows, columns = of_left[own], in_left[own]
    order = np.argsort(in_right, kind="stable")
    first = np.searchsorted(in_right[order], columns)
    runs = np.searchsorted(in_right[order], columns, "right") - first
    at = 0
    ends = np.cumsum(runs)
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
        run = runs[at:end]
        step = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        met = of_right[order[np.repeat(first[at:end], run) + step]]
        both += np.bincount(np.repeat(rows[at:end], run) * len(right) + met, minlength=both.size).reshape(both.shape)
        at = end
    return both


def _link_counts(vertices: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(sign, near): how many rows have a set that links with the set of ``sign`` and is not equal to it.

    Links never leave a component. A block of a component meets itself and each other block in a task;
    small components share tasks, and what is compared across them does not link.
    """
    members = vertices.join(classes, vertices.sign == classes["class"]).select("component", "sign", "copies", "own")
    members = stored(members)
    size = F.count(F.lit(1)).alias("size")
    sizes = members.groupBy("component").agg(size, F.sum(F.octet_length("own")).alias("bytes")).where("size > 1")
    width = F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), F.col("size") / 32))
    blocks = F.greatest(F.ceil(F.col("size") / width), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = stored(sizes.select(F.col("component").alias("of"), "size", "bytes", blocks.alias("blocks")))
    small = sizes.where("blocks = 1").agg(F.sum("size"), F.sum("bytes")).first()
    tasks = max(1, (small[0] or 0) // BLOCK_LEAST, (small[1] or 0) // BLOCK_BYTES)

    placed = members.join(sizes, members.component == sizes.of).withColumn("block", F.pmod(F.xxhash64("sign", F.lit(3)), "blocks").cast("int"))
    placed = placed.select("component", "sign", "copies", "own", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    alone = F.col("blocks") == 1
    part = F.when(alone, F.pmod(F.xxhash64("component", F.lit(4)), F.lit(tasks))).otherwise(F.col("component"))
    placed = placed.select(alone.alias("alone"), part.alias("part"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sign", "copies", "own")

    def count(table: pa.Table) -> pa.Table:
        block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
        sign, copies = table.column("sign").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("own").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = np.zeros(len(sets), np.int64)
        if len(left) and len(right):
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            linked = both * 100 >= (n[left][:, None] + n[right] - both) * percent
            if low[0] == high[0]:
                np.fill_diagonal(linked, False)
                near[left] = linked @ copies[right]
            else:
                near[left], near[right] = linked @ copies[right], copies[left] @ linked
        return pa.table({"sign": sign, "near": near})

    partial = placed.groupBy("alone", "part", "low", "high").applyInArrow(count, "sign bigint, near bigint")
    return stored(partial.groupBy("sign").agg(F.sum("near").alias("near")))


def _linked(docs: DataFrame, live: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, label) of the vertices that link with another and (vertex, sign, own) of those that still may;
    ``live``: vertices that may."""
    ids = live.select(F.col("vertex").alias("doc_id"), F.col("sign").alias("live_sign"))
    own = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _sets(own, words).join(ids, "doc_id").where("sign = live_sign").groupBy("doc_id", "sign").agg(F.first("own").alias("own"))
    sets = stored(sets)
    total = sets.agg(F.sum(F.octet_length("own"))).first()[0] or 0
    again = _counted(sets.select("doc_id", "sign", "own"), _slices_of_sets, total // 8 + 1)
    again = again.where(F.col("shared") >= _enough(F.col("n"), percent)).select("doc_id", "sign")
    vertices = stored(sets.join(again, ["doc_id", "sign"]).select(F.col("doc_id").alias("vertex"), "sign", "own"))

    ngrams = _ngrams(vertices)
    frequent = stored(ngrams.groupBy("h").count().where("count > 1").select(F.col("h").alias("g"), F.col("count").cast("int").alias("df")))
    # The order of an n-gram: its frequency, then its hash as a fraction.
    place = F.col("df") + (F.col("h").cast("double") / 2.0**64 + 0.5)
    held = ngrams.join(frequent, ngrams.h == frequent.g).select("vertex", "n", F.struct(place.alias("place"), F.col("h").alias("h")).alias("token"))
    ordered = held.groupBy("vertex", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens")).withColumn("s", F.size("tokens"))
    ordered = stored(ordered.where(F.col("s") >= _enough(F.col("n"), percent)))

    cuts = frequent.select((F.col("df") + (F.col("g").cast("double") / 2.0**64 + 0.5)).alias("place"))
    cuts = cuts.agg(F.percentile_approx("place", [k / ORDER_FRAGMENTS for k in range(1, ORDER_FRAGMENTS)])).first()[0] or []
    edges = [float("-inf"), *cuts, float("inf")]
    segment = [
        F.struct(F.lit(k).alias("fragment"), F.transform(F.filter("tokens", _between(a, b)), lambda t: t["h"]).alias("own"))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    segments = ordered.select("vertex", F.explode(F.array(*segment)).alias("part")).select("vertex", "part.fragment", "part.own").where(F.size("own") > 0)
    segments = stored(segments)

    length = F.col("n") - _enough(F.col("n"), percent) + 1 - (F.col("n") - F.col("s"))
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), length).cast("int"))
    lists = ordered.select("vertex", "n", "s", F.posexplode(prefix).alias("pos", "token"))
    # N-grams that no other document has come first in the order.
    lists = stored(lists.select("vertex", "n", "s", (F.col("n") - F.col("s") + F.col("pos")).alias("pos"), F.col("token.h").alias("h")))

    ids = stored(ordered.select(F.col("vertex").alias("id")).distinct())
    labels, links, checked = ids.select("id", F.col("id").alias("label")), None, None
    for k in range(STAR_ROUNDS + 1):
        now = lists.join(labels, lists.vertex == labels.id).drop("id")
        if k:
            mixed = now.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("h").alias("mixed"))
            now = now.join(mixed, F.col("h") == F.col("mixed"), "left_semi")
        now = stored(now)
        if now.isEmpty():
            break
        other = now.select(F.col("vertex").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("pos").alias("at"), "h", F.col("label").alias("other"))
        if k < STAR_ROUNDS:
            mark = F.struct((F.col("b") if k == 0 else F.xxhash64("b", F.lit(k))).alias("turn"), "b", "m", "t", "at", "other")
            hubs = stored(other.groupBy("h").agg(F.min(mark).alias("hub")).select(F.col("h").alias("g"), "hub.b", "hub.m", "hub.t", "hub.at", "hub.other"))
            met = now.join(hubs, now.h == hubs.g)
        else:
            met = now.join(other, "h").where("vertex < b")
        pairs = met.where((F.col("label") != F.col("other")) & _may_link(percent))
        swap = F.col("vertex") > F.col("b")
        pairs = pairs.select(
            F.least("vertex", "b").alias("a"), F.greatest("vertex", "b").alias("b"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m")
        ).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        checked = pairs.select("a", "b") if checked is None else checked.unionByName(pairs.select("a", "b"))
        new = stored(_verified(pairs, segments, percent))
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = connected(ids, links)
    return labels, vertices
