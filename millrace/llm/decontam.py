"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards of bounded words, whole documents each,
and indexes the shard's words. The phrases are the windows of the benchmark
items. Each shard is searched for all of them at once: backward search through
the wavelet matrix's ranks gives the rows of a phrase, sampled suffix positions
its places, and places merge to removal spans. Words that no item holds can't be
in an occurrence; they part a document into runs, and runs shorter than the
shortest phrase need no index.

The benchmark is sent to the tasks in blocks of bounded size. One block is one
pass; a larger benchmark adds passes, each over the written result of the one
before, which carries the spans found so far. So a task holds one block, however
large the benchmark is.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, fresh, table, text_batches

WINDOW = 10
#: Words of a shard, unless one document has more.
SHARD_WORDS = 400_000
#: Characters of the benchmark sent with one pass.
BLOCK_CHARS = 4_000_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORDS = re.compile(rb"[^ ]+")


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of anything but ASCII that is no letter or digit."""
    return (data or b"").translate(_KEEP).split()


class Phrases:
    """Windows of a block of benchmark items, as word ids: distinct rows, filled with 0 on the left."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        own = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(data)], np.int32) for _, data in items]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rows = [np.lib.stride_tricks.sliding_window_view(x, window) if len(x) >= window else np.r_[np.zeros(window - len(x), np.int32), x][None, :] for x in own if len(x)]
        of = np.repeat([number[name] for (name, _), x in zip(items, own) if len(x)], [len(r) for r in rows]).astype(np.int32)
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True) if rows else (np.zeros((0, window), np.int32), np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(axis=1)
        # Items of each row, one after the other.
        pairs = np.unique(np.stack([which.ravel(), of], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.of, self.starts = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.shortest = int(self.lengths.min()) if len(self.rows) else 0

    def items(self, phrases: np.ndarray) -> set[str]:
        """Names of the items that hold any of the phrases."""
        return {self.names[k] for p in set(phrases.tolist()) for k in self.of[self.starts[p] : self.starts[p + 1]].tolist()}


def search_shard(ids: np.ndarray, doc_ends: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, length) of each occurrence in a shard of documents.

    ``ids`` has a 0 for a word that is in no item, ``doc_ends`` the end of each document.
    """
    from millrace.llm.fm_index import FMIndex

    none = np.zeros(0, np.int64)
    if not len(ids) or not len(phrases.rows):
        return none, none, none
    known = ids > 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[0] = True
    edge[doc_ends] = True
    begin = np.flatnonzero(known & (edge[:-1] | np.r_[True, ~known[:-1]]))
    end = np.flatnonzero(known & (edge[1:] | np.r_[~known[1:], True])) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    sizes = end - begin + 1
    at = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) + np.repeat(begin - at, sizes)  # of each word of the runs in the shard; a run's last one is its 0
    text = ids[np.minimum(place, len(ids) - 1)]
    text[at + sizes - 1] = 0
    index = FMIndex(text, len(phrases.ids))
    low, high = index.search(phrases.rows)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    phrase = np.repeat(found, counts)
    rows = np.arange(counts.sum()) + np.repeat(low[found] - (np.cumsum(counts) - counts), counts)
    return phrase, place[index.locate(rows)], phrases.lengths[phrase]


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) spans as one."""
    if not len(start):
        return []
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.r_[True, start[1:] > reach[:-1]]
    return list(zip(start[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]].tolist()))


def _search(texts: list[bytes | None], block: Phrases):
    """(words, (phrase, start, length) arrays) of each text; texts are gathered into shards."""
    known, ids, total, out = block.ids.get, [], 0, []

    def shard():
        ends = np.cumsum([len(x) for x in ids])
        phrase, start, length = search_shard(np.concatenate(ids) if ids else np.zeros(0, np.int64), ends, block)
        doc = np.searchsorted(ends, start, side="right")
        order = np.argsort(doc, kind="stable")
        phrase, start, length, doc = phrase[order], start[order], length[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        for d, x in enumerate(ids):
            own = slice(bounds[d], bounds[d + 1])
            out.append((len(x), phrase[own], start[own] - (ends[d] - len(x)), length[own]))
        ids.clear()

    for t in texts:
        words = words_of(t)
        ids.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
        total += len(words)
        if total >= SHARD_WORDS:
            shard()
            total = 0
    shard()
    return out


def _pass(phrases, data: str, before: bool):
    """For mapInArrow over (data, n_words, spans, items, and the other columns): adds what one block of the benchmark finds."""

    def run(batches):
        import pyarrow as pa

        block = phrases.value
        spans_type, items_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
        for batch in batches:
            sizes, spans, items = [], [], []
            for d, (size, phrase, start, length) in enumerate(_search(batch.column(data).cast(pa.large_binary()).to_pylist(), block)):
                s, e = start, start + length
                names = block.items(phrase)
                if before:
                    old = batch.column("spans")[d].as_py()
                    s, e = np.r_[s, [x["start"] for x in old]].astype(np.int64), np.r_[e, [x["end"] for x in old]].astype(np.int64)
                    names |= set(batch.column("items")[d].as_py())
                sizes.append(size)
                spans.append([{"start": a, "end": b} for a, b in merge_spans(s, e)])
                items.append(sorted(names))
            new = {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, spans_type), "items": pa.array(items, items_type)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return run


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans, and what stands between them."""
    places, out, since = [m.span() for m in _WORDS.finditer(data.translate(_KEEP))], [], 0
    for start, end in spans:
        out.append(data[since : places[start][0]])
        since = places[end - 1][1]
    return b"".join([*out, data[since:]])


def _blocks(benchmark: DataFrame, item: str, text: str, chars: int):
    """The benchmark's items in blocks of about ``chars`` characters, one in memory at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).filter("i is not null and t is not null").toLocalIterator():
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] | None = None, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns ``keep`` (all, if None) of each row with n_words, spans (merged [start, end) of word places) and items (sorted names).

    A null text has no words, an empty one neither. Items without an id or
    without words have no windows; items of one id are one item. Repeated rows
    are searched each for itself. Columns named n_words, spans, items are
    replaced. Empty tables give no rows, or rows without spans.
    """
    added = ("n_words", "spans", "items")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in added)
    data = fresh("data")
    df = text_batches(docs).select(F.col(text).cast("binary").alias(data), *keep, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    sc, schema, told = docs.sparkSession.sparkContext, df.schema, None
    for block in _blocks(benchmark, item, item_text, block_chars):
        if told:
            df = checkpointed(df)
            told.unpersist()
        before, told = told is not None, sc.broadcast(Phrases(block, window))
        df = df.mapInArrow(_pass(told, data, before), schema)
    if not told:
        df = df.mapInArrow(_pass(sc.broadcast(Phrases([], window)), data, before=False), schema)
    return df.drop(data)


def hits(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with the words of the spans taken out of the text; a text without spans stays as it is, to the letter.

    What a cut brings together can be a phrase again, so a text that was cut is
    searched again until it holds none. A benchmark of several blocks is searched
    whole before each cut, so the outcome doesn't depend on the blocks. Edge cases
    are those of ``find``; no column is replaced but the text.
    """
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    place = docs.columns.index(text)
    blocks = _blocks(benchmark, item, item_text, block_chars)
    block = next(blocks, None)
    if next(blocks, None) is not None:
        return _cut_in_rounds(docs, benchmark, text, item, item_text, window, block_chars)

    def cutting(told):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                texts = batch.column(place).cast(pa.large_binary()).to_pylist()
                todo = [i for i, t in enumerate(texts) if t]
                while todo:
                    found = _search([texts[i] for i in todo], told.value)
                    hit = [(i, start, start + length) for i, (_, _, start, length) in zip(todo, found) if len(start)]
                    for i, s, e in hit:
                        texts[i] = cut_words(texts[i], merge_spans(s, e))
                    todo = [i for i, _, _ in hit]
                new = pa.array(texts, pa.binary()).cast(batch.column(place).type)
                yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

        return run

    return text_batches(docs).mapInArrow(cutting(sc.broadcast(Phrases(block, window))), schema) if block else docs


def _cut_in_rounds(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, block_chars: int) -> DataFrame:
    """``cut_spans`` over several blocks: rows with spans of any block are cut once and searched again by all."""
    names = [fresh("c") for _ in docs.columns]
    place = docs.columns.index(text)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column(place).cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist())
            new = pa.array([cut_words(t, [(x["start"], x["end"]) for x in spans]) for t, spans in rows], pa.binary()).cast(batch.column(place).type)
            yield pa.RecordBatch.from_arrays([new if k == place else batch.column(k) for k in range(len(names))], names=names)

    rest, out = docs.toDF(*names), None
    while out is None or not rest.isEmpty():
        found = checkpointed(find(rest, benchmark, names[place], item, item_text, None, window, block_chars))
        clean = found.filter(F.size("spans") == 0).select(names)
        out = clean if out is None else out.unionByName(clean)
        rest = checkpointed(text_batches(found.filter(F.size("spans") > 0)).mapInArrow(cut, rest.schema))
    return out.toDF(*docs.columns)


def query(spark, sf_dir):
    rows = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    n_hit = hits(F.col("spans"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
