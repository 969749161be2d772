"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of rows of a hashed table: one for the word and
one for each of its beginnings of 3 to 6 bytes, so that inflected forms share
rows. Filters of 1, 2 and 3 words run over the whole text, their largest
responses are pooled, and a logistic layer scores them. Embeddings, filters and
output are trained by Adagrad; the first embedding component starts from the
smoothed log odds of its row.

Learning reads all labelled rows. Their texts are dealt to shards by a hash of
the id, so that the outcome doesn't depend on how the table is partitioned. The
log odds come from counts over all shards. Then, in ``ROUNDS`` rounds, the task
of a shard goes on with the parameters over its texts, a bounded number of words
at once, and the shards' changes are averaged: those of a row of the table by the
steps that changed it, others by the documents. The driver holds one set of
parameters. Scoring reads every text, in one pass without a shuffle. A filter's
response is a sum of one term per word, so the terms of each distinct word are
computed once per batch of new words and then looked up.

Labels, language, source and id are no inputs of a score. The threshold above
which a document is rejected is calibrated for each language on all labelled rows
that a first fitting leaves out, from counts by label and threshold reached; a
language without enough of them, or none, takes the common threshold. The final
fitting reads those rows too.
"""

from __future__ import annotations

import copy
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import checkpointed, crc_bucket, fresh, table, text_batches

#: Labelled documents of a shard, where that makes no more than so many shards; words of a shard's texts that a task holds at once.
SHARD, SHARDS, HELD = 16_000, 128, 1_000_000
#: Bits for each labelled id in the marks that rule other documents out before they are joined, and bits of a block of marks.
MARKS, MARKED = 32, 1 << 16
ROWS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.08
#: Rounds that the epochs are dealt to; after each the shards' parameters are averaged.
ROUNDS = 2
BEGINNINGS = (3, 4, 5, 6)
#: Thresholds that are tried.
TRIED = np.linspace(0.2, 0.8, 61)
#: Words whose terms a task keeps, positions that it scores at once, and texts that it reads at once.
CACHE, CHUNK, SCORED = 80_000, 40_000, 128

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_KEEP).split()


def rows_of(words: list[bytes]) -> np.ndarray:
    """Rows of the table for each word, by hash; ROWS (a row of zeros) stands for a beginning longer than the word."""
    out = np.full((len(words), 1 + len(BEGINNINGS)), ROWS, np.int32)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % ROWS
    if len(words):
        longest = max(BEGINNINGS)
        head = np.array([w[:longest] for w in words], f"S{longest}").view(np.uint8).reshape(len(words), longest).astype(np.uint64)
        size, h = np.fromiter(map(len, words), np.int64, len(words)), np.full(len(words), 1469598103934665603, np.uint64)
        for i in range(longest):
            h = (h ^ head[:, i]) * np.uint64(1099511628211)
            if i + 1 in BEGINNINGS:
                long = size > i
                out[long, 1 + BEGINNINGS.index(i + 1)] = ((h ^ (h >> np.uint64(29))) % np.uint64(ROWS))[long]
    return out


class Model:
    """Parameters: table, filters of every width, output."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((ROWS + 1, DIM), np.float32)
        self.table[:ROWS] = rng.normal(0, 0.05, (ROWS, DIM))
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.filters[0][0, 0, :] = 1.0  # the filters of one word start by reading the log odds
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.shift = np.full(FILTERS * len(WIDTHS), 0.1, np.float32), np.float32(-1.0)

    def rest(self) -> np.ndarray:
        """All parameters but the table, in one array."""
        return np.concatenate([x.ravel() for x in (*self.filters, *self.bias, self.out, np.array([self.shift]))]).astype(np.float64)

    def add(self, table: np.ndarray, rest: np.ndarray) -> None:
        """Add to the table's rows, and to the other parameters as ``rest`` lays them out."""
        self.table[:ROWS] += table.astype(np.float32)
        at = 0
        for x in (*self.filters, *self.bias, self.out):
            x += rest[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        self.shift = np.float32(self.shift + rest[at])

    def terms(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the responses: for every width and place in the filter, a term per filter."""
        e = self.table[rows_of(words)].sum(axis=1)
        return np.concatenate([e @ f[k] for f in self.filters for k in range(len(f))], axis=1) if len(words) else np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)

    def pooled(self, terms: np.ndarray, tokens: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Largest response of every filter in each document, 0 at least. ``tokens`` are rows of ``terms``; row 0 is no word."""
        out = np.full((n_docs, len(self.out)), -np.inf, np.float32)
        for a in range(0, len(tokens), CHUNK):
            own = tokens[a : a + CHUNK]
            ahead = np.r_[tokens[a : a + CHUNK + max(WIDTHS) - 1], np.zeros(max(WIDTHS) - 1, tokens.dtype)]
            g, at, made = terms[ahead], 0, []
            for w, b in zip(WIDTHS, self.bias):
                made.append(sum(g[k : k + len(own), at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(w)) + b)
                at += w * FILTERS
            real = np.flatnonzero(own > 0)
            if len(real):
                r, d = np.concatenate(made, axis=1)[real], doc[a : a + CHUNK][real]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                out[d[first]] = np.maximum(out[d[first]], np.maximum.reduceat(r, first, axis=0))
        return np.maximum(out, 0)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled.astype(np.float64) @ self.out + self.shift, -30, 30)))


class Reader:
    """Turns texts into tokens, keeping the terms of the words seen."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.at, self.terms = {}, [np.zeros((1, FILTERS * sum(WIDTHS)), np.float32)]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if len(self.at) > CACHE:
            self.clear()
        gap, tokens, sizes, at = np.zeros(max(WIDTHS) - 1, np.int64), [], [], self.at
        for t in texts:
            words = words_of(t)
            if new := [w for w in dict.fromkeys(words) if w not in at]:
                at.update(zip(new, range(len(at) + 1, len(at) + 1 + len(new))))
                self.terms.append(self.model.terms(new))
            tokens += [np.fromiter(map(at.get, words, repeat(0)), np.int64, len(words)), gap]
            sizes.append(len(words) + len(gap))
        if len(self.terms) > 1:
            self.terms = [np.concatenate(self.terms)]
        if not texts:
            return np.zeros(0)
        return self.model.score(self.model.pooled(self.terms[0], np.concatenate(tokens), np.repeat(np.arange(len(texts)), sizes), len(texts)))


def begun(seen: np.ndarray, n: np.ndarray, seed: int = 1) -> tuple[Model, Model]:
    """A model that starts from the log odds of each row, and the sums of squares of its steps. ``seen`` counts documents that hold a row, ``n`` documents, by label."""
    m, sums = Model(seed), Model(seed)
    n = np.maximum(n, 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5 * n[0] / n[1]) / (n[0] + 1))
    m.table[:ROWS, 0] = np.where(seen.sum(axis=0) > 1, 0.3 * odds, 0)
    for x in (sums.table, *sums.filters, *sums.bias, sums.out):
        x[:] = 1e-3
    sums.shift = np.float32(1e-3)
    return m, sums


def peaks(m: Model, e: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in each document and the place of its first word. ``e`` are embeddings of ``tokens``'s numbers, with zeros in the last row; places go chunk by chunk."""
    pooled, places, n = np.full((len(starts), len(m.out)), -np.inf, np.float32), np.zeros((len(starts), len(m.out)), np.int64), len(tokens)
    for a in range(0, n, CHUNK):
        size = min(CHUNK, n - a)
        own = tokens[a : a + size + max(WIDTHS) - 1]
        g = e[np.r_[own, np.full(size + max(WIDTHS) - 1 - len(own), -1)]]
        met = [(d, max(s, a) - a, min(s + z, a + size) - a) for d, (s, z) in enumerate(zip(starts.tolist(), sizes.tolist())) if z and s < a + size and s + z > a]
        for k, (w, f, b) in enumerate(zip(WIDTHS, m.filters, m.bias)):
            r, at = sum(g[j : j + size] @ f[j] for j in range(w)) + b, slice(k * FILTERS, (k + 1) * FILTERS)
            for d, low, high in met:
                top = r[low:high].argmax(axis=0)
                best = r[low + top, np.arange(FILTERS)]
                more = best > pooled[d, at]
                pooled[d, at], places[d, at] = np.where(more, best, pooled[d, at]), np.where(more, a + low + top, places[d, at])
    return pooled, places


def learn(m: Model, sums: Model, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator) -> np.ndarray:
    """Steps of Adagrad over documents, numbers of ``rows``' words each; returns how many steps changed each row of the table."""
    gap, times, number = max(WIDTHS) - 1, np.zeros(ROWS + 1, np.int64), np.zeros(len(rows), np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            sizes = np.array([len(docs[i]) for i in own])
            starts = np.cumsum(sizes + gap) - sizes - gap
            read = np.concatenate([docs[i] for i in own])
            words = np.flatnonzero(np.bincount(read, minlength=len(rows)))
            number[words] = np.arange(len(words))
            back, mine = number[read], rows[words]
            e = np.concatenate([sum(m.table.take(mine[:, j], axis=0) for j in range(mine.shape[1])), np.zeros((1, DIM), np.float32)])
            tokens, ends = np.full((sizes + gap).sum() + gap, -1, np.int64), np.cumsum(sizes)
            for s, z, end in zip(starts, sizes, ends):
                tokens[s : s + z] = back[end - z : end]
            pooled, places = peaks(m, e, tokens[: len(tokens) - gap], starts, sizes)
            alive = (pooled > 0) & (sizes > 0)[:, None]
            pooled = np.where(alive, pooled, 0)
            delta = (m.score(pooled) - labels[own]).astype(np.float32) * weight[labels[own]] / len(own)
            d_pool = delta[:, None] * m.out * alive
            d_out, d_shift = pooled.T @ delta + 1e-5 * m.out, float(delta.sum())
            d_e = np.zeros_like(e)
            for k, (w, f, b) in enumerate(zip(WIDTHS, m.filters, m.bias)):
                d, p = d_pool[:, k * FILTERS : (k + 1) * FILTERS], places[:, k * FILTERS : (k + 1) * FILTERS]
                d_f = np.zeros_like(f)
                for j in range(w):
                    x = tokens[p + j]
                    d_f[j] = np.einsum("df,dfc->cf", d, e[x])  # documents, filters, components
                    np.add.at(d_e, x, d[:, :, None] * f[j].T[None])
                d_b = d.sum(axis=0)
                sums.filters[k] += d_f**2
                sums.bias[k] += d_b**2
                f -= RATE * d_f / np.sqrt(sums.filters[k])
                b -= RATE * d_b / np.sqrt(sums.bias[k])
            sums.out += d_out**2
            sums.shift = np.float32(sums.shift + d_shift**2)
            m.out -= RATE * d_out / np.sqrt(sums.out)
            m.shift = np.float32(m.shift - RATE * d_shift / np.sqrt(sums.shift))
            hit = np.flatnonzero(np.abs(d_e[:-1]).sum(axis=1))
            r, back = np.unique(mine[hit], return_inverse=True)
            total = np.zeros((len(r), DIM), np.float32)
            np.add.at(total, back.ravel(), np.repeat(d_e[hit], rows.shape[1], axis=0))
            total[r == ROWS] = 0
            sums.table[r] += total**2
            m.table[r] -= RATE * total / np.sqrt(sums.table[r])
            times[r] += 1
    return times


def held(batches):
    """(shard, label, numbers of each document's words, words) of rows shard, label, packed text that stand by shard, at most ``HELD`` words and a text at once."""
    now, labels, docs, ids, n = None, [], [], {}, 0
    for b in batches:
        for shard, y, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            if docs and (shard != now or n > HELD):
                yield now, np.array(labels), docs, list(ids)
                labels, docs, ids, n = [], [], {}, 0
            words, now = words_of(zlib.decompress(t)), shard
            docs.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            labels.append(y)
            n += len(words)
    if docs:
        yield now, np.array(labels), docs, list(ids)


def summed(rows: DataFrame, by_shard, parts: int = 128) -> np.ndarray | None:
    """Sum of the arrays that ``by_shard`` makes of batches, (shard, array) each, in the order of the shards, added up in double and given in single precision. It comes to the driver as Arrow batches, which its JVM hands on as they are, without a copy for each form a row takes."""

    def run(batches):
        import pyarrow as pa

        for shard, x in by_shard(batches):
            pieces = [c.astype(np.float32).tobytes() for c in np.array_split(x, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([shard] * parts, pa.int32()), pa.array(pieces, pa.binary())], names=["part", "shard", "c"])

    def add(key, data):
        import pyarrow as pa

        data = data.sort_by("shard")
        total = sum(np.frombuffer(c.as_py(), np.float32).astype(np.float64) for c in data.column("c"))
        return pa.table({"part": data.column("part").slice(0, 1), "shard": data.column("shard").slice(0, 1), "c": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, shard int, c binary"
    got = rows.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).select("part", "c").toArrow()
    pieces = dict(zip(got.column("part").to_pylist(), got.column("c")))
    return np.concatenate([np.frombuffer(pieces[k].as_buffer(), np.float32) for k in sorted(pieces)]) if pieces else None


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents that hold each row of the table, documents) by whether they stand apart and label."""

    def seen(batches):
        now, out = None, None
        for shard, kinds, docs, words in held(batches):
            if shard != now:
                if now is not None:
                    yield now, out.ravel()
                now, out = shard, np.zeros((4, ROWS + 1))
            found = rows_of(words)
            for d, kind in zip(docs, kinds):
                out[kind, found[d].ravel()] += 1  # an index that comes twice counts once
        if now is not None:
            yield now, out.ravel()

    kind, n = (F.col("y") + 2 * F.col("apart").cast("int")).alias("kind"), np.zeros(4)
    for r in rows.groupBy(kind).count().collect():
        n[r.kind] = r["count"]
    got = summed(rows.select("shard", kind, "t"), seen)
    return (np.zeros((4, ROWS)) if got is None else got.astype(np.float64).reshape(4, ROWS + 1)[:, :ROWS]).reshape(2, 2, ROWS), n.reshape(2, 2)


def train(rows: DataFrame, seen: np.ndarray, n: np.ndarray, seed: int = 1, epochs: int = EPOCHS, rounds: int = ROUNDS) -> Model:
    """Fit a model to rows shard, y, t (packed) that stand by shard, with ``counted`` of them by label; without both labels it scores everything by the share of label 1."""
    if not n.all():
        m = Model(seed)
        m.out[:], m.shift = 0, np.float32(4.0 if n[1] else -4.0)
        return m
    given = rows.select("shard", "y", "t")
    m, sums = begun(seen, n, seed)
    weight = (n.sum() / (2 * n)).astype(np.float32)
    for k in range(rounds):
        told = rows.sparkSession.sparkContext.broadcast((m, sums))
        passes = epochs * (k + 1) // rounds - epochs * k // rounds

        def changes(batches, told=told, k=k, passes=passes):
            def change():
                """Changes of each row times the steps that made them, of the others times the documents."""
                by = times[:ROWS, None].astype(np.float64)
                rows_of_table = [(by * (x.table[:ROWS].astype(np.float64) - y.table[:ROWS])).astype(np.float32).ravel() for x, y in ((own, first), (own_sums, first_sums))]
                return np.concatenate([*rows_of_table, times[:ROWS], *(docs_read * (x.rest() - y.rest()) for x, y in ((own, first), (own_sums, first_sums))), [docs_read]], dtype=np.float32)

            first, first_sums = told.value
            now = None
            for shard, labels, docs, words in held(batches):
                if shard != now:
                    if now is not None:
                        yield now, change()
                    now, own, own_sums, times, docs_read = shard, copy.deepcopy(first), copy.deepcopy(first_sums), np.zeros(ROWS + 1, np.int64), 0
                    rng = np.random.default_rng([seed, k, shard])
                times += learn(own, own_sums, docs, rows_of(words), labels, weight, passes, rng)
                docs_read += len(docs)
            if now is not None:
                yield now, change()

        total = summed(given, changes)
        told.destroy()  # else the driver holds the parameters of every round
        size, rest = ROWS * DIM, len(m.rest())
        times, docs_read = np.maximum(total[2 * size : 2 * size + ROWS], 1)[:, None], total[-1]
        for x, at, rest_at in ((m, 0, 2 * size + ROWS), (sums, size, 2 * size + ROWS + rest)):
            x.add(total[at : at + size].reshape(ROWS, DIM) / times, total[rest_at : rest_at + rest] / docs_read)
    return m


def best_threshold(reached: np.ndarray, common: float = 0.5) -> float:
    """The threshold of ``TRIED`` of the fewest errors, the nearest to ``common`` of those. ``reached`` counts documents by label and by how many thresholds their score reaches."""
    upto = np.cumsum(reached, axis=1)[:, :-1]
    errors = upto[1] + reached[0].sum() - upto[0]
    near = np.flatnonzero(errors == errors.min())
    return float(TRIED[near[np.abs(TRIED[near] - common).argmin()]])


def marked(ids: DataFrame, docs: DataFrame, doc_id: str, n: int) -> DataFrame:
    """Rows of ``docs`` but most of those whose id is not among the ``n`` ids of a column: no other row is lost."""
    i = ids.columns[0]
    if ids.schema[i].dataType != docs.schema[doc_id].dataType:
        return docs
    size = max(1 << (MARKS * max(n, 1) - 1).bit_length(), MARKED)
    at, block, bits = (fresh(x) for x in ("at", "block", "bits"))

    def mark(key, data):
        import pyarrow as pa

        own = np.zeros(MARKED, np.uint8)
        own[data.column(0).to_numpy() % MARKED] = 1
        return pa.table({block: pa.array([key[0].as_py()], pa.int64()), bits: pa.array([np.packbits(own).tobytes()], pa.binary())})

    places = ids.select(F.pmod(F.xxhash64(i), F.lit(size)).alias(at)).withColumn(block, F.floor(F.col(at) / MARKED).cast("long"))
    marks = np.zeros(size // 8, np.uint8)
    for r in places.groupBy(block).applyInArrow(mark, f"{block} long, {bits} binary").collect():
        marks[r[0] * MARKED // 8 : (r[0] + 1) * MARKED // 8] = np.frombuffer(r[1], np.uint8)
    told = docs.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def among(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        return pd.Series((told.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0)

    return docs.filter(among(F.pmod(F.xxhash64(doc_id), F.lit(size))))


class Classifier:
    """A model with a threshold for each language."""

    def __init__(self, model: Model, common: float, by_lang: dict[str, float]):
        self.model, self.common, self.by_lang = model, common, by_lang


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 0, folds: int = 5, least: int = 20) -> Classifier:
    """Learn from all rows; those whose crc32(id as text) mod ``folds`` is 1 set the thresholds, by a first fitting to the others. Where ``held_out`` is given, rows whose remainder by it is 0 teach nothing.

    An id whose labels contradict each other, a null label and an id without a
    document teach nothing; of rows of one id one is read. A language takes a threshold of its own from
    ``least`` rows with label 1 on.
    """
    i, y, z, read = (fresh(x) for x in ("id", "y", "z", "read"))
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(i)).agg(F.min(label).alias(y), F.max(label).alias(z))
    taught = lambda x: crc_bucket(F.col(x), held_out) != 0 if held_out else F.lit(True)
    known = known.filter((F.col(y) == F.col(z)) & F.col(y).isin(0, 1) & taught(i)).select(i, F.col(y).cast("int").alias(y))
    n = known.count()
    shards = int(min(max(-(-n // SHARD), 1), SHARDS))
    given = text_batches(docs).select(F.col(doc_id).alias(read), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("t")).filter(taught(read))
    given = marked(known.select(i), given, read, n)

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            t = pa.array([zlib.compress(x.as_py() or b"", 1) for x in b.column(2).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], t], names=b.schema.names)

    def met(batches):
        """The first document of each id that has a label, with it; rows of an id stand together, the label ahead."""
        import pyarrow as pa

        last, label = None, None
        for b in batches:
            keep, ys = [], []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if y is not None:
                    last, label = x, y
                hit = y is None and label is not None and x == last
                keep.append(hit)
                ys.append(label if hit else None)
                if hit:
                    label = None
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(ys, pa.int32()), *b.columns[2:]], names=b.schema.names)
            yield out.filter(pa.array(keep, pa.bool_()))

    # Documents and labels are dealt together, so that texts are shuffled once for the join, the choice of a row of an id, and the shards.
    found = given.mapInArrow(pack, given.schema).select(F.col(read).alias("id"), F.lit(None).cast("int").alias("y"), "t", "lang")
    found = found.unionByName(known.select(F.col(i).alias("id"), y, F.lit(None).cast("binary").alias("t"), F.lit(None).cast(found.schema["lang"].dataType).alias("lang")).withColumnRenamed(y, "y"))
    found = found.withColumn("apart", crc_bucket(F.col("id"), folds) == 1).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("id"), "id", F.col("y").isNull(), "t", "lang")
    rows = checkpointed(dealt.mapInArrow(met, dealt.schema))
    seen, docs_of = counted(rows)
    first, apart = train(rows.filter(~F.col("apart")), seen[0], docs_of[0]), rows.filter("apart")
    told = rows.sparkSession.sparkContext.broadcast(first)

    def reach(batches):
        import pyarrow as pa

        reader = Reader(told.value)
        for b in batches:
            got = [reader.scores([zlib.decompress(t) for t in b.column(2).slice(a, SCORED).to_pylist()]) for a in range(0, b.num_rows, SCORED)]
            reached = np.searchsorted(TRIED, np.concatenate(got or [np.zeros(0)]), side="right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(reached, pa.int32())], names=["lang", "y", "reached"])

    told_of = apart.select("lang", "y", "t")
    counts = checkpointed(told_of.mapInArrow(reach, T.StructType([told_of.schema["lang"], told_of.schema["y"], T.StructField("reached", T.IntegerType())])).groupBy("lang", "y", "reached").count())
    told.destroy()

    def table_of(cells) -> np.ndarray:
        out = np.zeros((2, len(TRIED) + 1), np.int64)
        for c in cells:
            out[c.y, c.reached] += c.n
        return out

    common = table_of(counts.groupBy("y", "reached").agg(F.sum("count").alias("n")).collect())
    common = best_threshold(common) if common.any() else 0.5
    cells = counts.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.collect_list(F.struct("y", "reached", F.col("count").alias("n"))).alias("cells"), F.sum(F.col("y") * F.col("count")).alias("ones"), F.sum((1 - F.col("y")) * F.col("count")).alias("zeros"))
    by_lang = {r.lang: best_threshold(table_of(r.cells), common) for r in cells.filter((F.col("ones") >= least) & (F.col("zeros") >= least)).collect()}
    # With the thresholds set, the model learns from those rows too.
    return Classifier(train(rows, seen.sum(axis=0), docs_of.sum(axis=0)), common, by_lang)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", lang: str = "lang", out: tuple[str, str, str] = ("score", "threshold", "rejected"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if None) with score, the threshold of the row's language, and whether the score reaches it.

    A null text is an empty one: no filter responds, and the score is that of
    the output's bias. Rows are scored each for itself, repeated ones alike, so
    there are no ties; very long texts are read whole, a chunk at a time. Columns with the names
    in ``out`` are replaced. An empty table gives an empty table.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in out)
    told = docs.sparkSession.sparkContext.broadcast(classifier.model)
    # A text that is kept goes through Python once.
    data, at = text if text in keep else fresh("data"), fresh("lang")
    held = [] if text in keep else [F.col(text).cast("binary").alias(data)]
    given, apart = text_batches(docs).select(*held, F.col(lang).alias(at), *keep), bool(held)

    def run(batches):
        import pyarrow as pa

        reader = Reader(told.value)
        for b in batches:
            texts, got = b.column(data).cast(pa.large_binary()), []
            for a in range(0, b.num_rows, SCORED):
                got.append(reader.scores(texts.slice(a, SCORED).to_pylist()))
            kept = [n for n in b.schema.names if n != data or not apart]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(np.concatenate(got or [np.zeros(0)]))], names=[*kept, out[0]])

    schema = T.StructType([*(f for f in given.schema if f.name != data or not apart), T.StructField(out[0], T.DoubleType())])
    scored = given.mapInArrow(run, schema)
    threshold = F.lit(classifier.common)
    for name, t in sorted(classifier.by_lang.items()):
        threshold = F.when(F.col(at) == name, F.lit(t)).otherwise(threshold)
    scored = scored.withColumn(out[1], threshold)
    return scored.withColumn(out[2], F.col(out[0]) >= F.col(out[1])).drop(at)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), held_out=5), keep=("doc_id",))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")
