"""Quality classifier by co-training of two views.

The text view reads what is written: hashed words and word shapes, linear in
their shares of the text. The page view reads no word: language, source, the
number of characters, bytes for each, and how long the lines are. Each is a
logistic model trained in numpy. In every round each view scores all unlabelled
documents and names those it is surest of, with the label it gives them, and
these pseudo-labels go to the other view's training set. At the end each view is
calibrated on labelled rows that it has not seen, and the calibrated log odds are
combined by a small logistic model fitted on the same rows.

The driver holds ``PER_CLASS`` labelled documents of each label, picked by a
hash of the id, and the pseudo-labelled ones, ``PASSED`` of a label for a view
and round. What the views read of every document, its distinct rows with their
counts and its page features, is written once, about half the text's size; each
round reads that in a pass without a shuffle, which leaves an id and two numbers
of each document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, crc_bucket, fresh, table, text_batches, written

PER_CLASS = 3000
ROWS = 1 << 15
#: Rounds, and the pseudo-labels of each label that a view passes on in one.
ROUNDS, PASSED = 4, 150
#: Words whose weights a task keeps.
CACHE = 400_000

#: Letters and digits by their kind; what follows one of its kind is left out of a word's shape.
_KINDS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_AGAIN = re.compile(rb"([Aa0])\1+")


def rows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word, and of its shape."""
    joined = b" ".join(words)
    low, shapes = joined.lower().split(b" "), _AGAIN.sub(rb"\1", joined.translate(_KINDS)).split(b" ")
    each = np.fromiter(map(zlib.crc32, low), np.int64, len(low)) % ROWS, np.array([zlib.crc32(s[:16], 7) for s in shapes], np.int64) % ROWS
    return each if words else (each[0][:0], each[1][:0])


def pages_of(data: list[bytes], langs: list, sources: list, n_chars: list) -> np.ndarray:
    """What is recorded of each page: logs of its lengths, shares of its lines by length, and one-hot hashes of language and source."""
    if not data:
        return np.zeros((0, 57))
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    # All texts one after the other, each closed by a line end.
    ends = np.flatnonzero(np.frombuffer(b"\n".join([*data, b""]), np.uint8) == 10)
    lines = (np.diff(np.r_[-1, ends]) - 1).astype(float)
    last = np.searchsorted(ends, np.cumsum(sizes + 1) - 1)
    first = np.r_[0, last[:-1] + 1]
    count = (last - first + 1).astype(float)
    mean, square = np.add.reduceat(lines, first) / count, np.add.reduceat(lines * lines, first) / count
    n = np.array([s if c is None else max(c, 0) for s, c in zip(sizes.tolist(), n_chars)], float)
    x = [np.log1p(v) for v in (n, sizes / np.maximum(n, 1), count, mean, np.maximum.reduceat(lines, first), np.sqrt(np.maximum(square - mean * mean, 0)), lines[last])]
    x += [np.add.reduceat((lines < k).astype(float), first) / count for k in (1, 20, 80, 200)]
    x += [v * v for v in x[:6]]
    hot, at = np.zeros((len(data), 40)), np.arange(len(data))
    hot[at, [zlib.crc32((v or "").encode()) % 8 for v in langs]] = 0.5
    hot[at, [8 + zlib.crc32((v or "").encode()) % 32 for v in sources]] = 0.5
    return np.c_[np.stack(x, axis=1), hot]


def page_features(data: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    return pages_of([data], [lang], [source], [n_chars])[0]


class Logistic:
    """Logistic regression by full-batch Newton steps with a ridge, for dense rows."""

    def __init__(self, width: int, ridge: float = 1e-2):
        self.w, self.mean, self.scale, self.ridge = np.zeros(width + 1), np.zeros(width), np.ones(width), ridge

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 12) -> "Logistic":
        if not len(y):
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        ridge = np.full(z.shape[1], self.ridge * len(y))
        ridge[-1] = 1e-6
        self.w[:] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            v = p * (1 - p) + 1e-6
            step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self


class TextView:
    """Logistic regression over the shares of hashed words and shapes, by Adagrad over the documents."""

    def __init__(self):
        self.w, self.shift = np.zeros(ROWS), 0.0

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[i] @ v for i, v in docs]) + self.shift if docs else np.zeros(0)

    def fit(self, docs, y, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> "TextView":
        self.w[:], self.shift = 0, 0.0
        g, gs, rng = np.full(ROWS, 1e-4), 1e-4, np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(docs)).tolist():
                i, v = docs[k]
                d = 1 / (1 + np.exp(-np.clip(self.w[i] @ v + self.shift, -30, 30))) - y[k]
                x = d * v + 1e-5 * self.w[i]
                g[i] += x * x
                self.w[i] -= rate * x / np.sqrt(g[i])
                gs += d * d
                self.shift -= rate * d / np.sqrt(gs)
        return self


def text_counts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, how often each is met)."""
    return np.unique(np.concatenate(rows_of(words)), return_counts=True)


def text_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ten times their shares of the text)."""
    i, n = text_counts(words)
    return i, 10.0 * n / max(len(words), 1)


def pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Three bytes for each row and count; a row that is met more often than a byte holds stands there several times."""
    times = -(-counts // 255)
    rows, last = np.repeat(rows, times), np.cumsum(times) - 1
    parts = np.full(len(rows), 255, np.uint8)
    parts[last] = counts - 255 * (times - 1)
    return rows.astype("<u2").tobytes() + parts.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``text_features`` of what was packed; every word has two rows."""
    n = len(data) // 3
    rows, which = np.unique(np.frombuffer(data, "<u2", n).astype(np.int64), return_inverse=True)
    counts = np.bincount(which, np.frombuffer(data, np.uint8, n, 2 * n), minlength=len(rows))
    return rows, 10.0 * counts / max(counts.sum() / 2, 1)


def packed_raw(text: "TextView", data: list[bytes]) -> np.ndarray:
    """What ``TextView.raw`` gives for packed texts, all at once."""
    sizes = np.array([len(d) // 3 for d in data], np.int64)
    rows = np.frombuffer(b"".join(d[: 2 * n] for d, n in zip(data, sizes.tolist())), "<u2")
    counts = np.frombuffer(b"".join(d[2 * n :] for d, n in zip(data, sizes.tolist())), np.uint8).astype(float)
    doc = np.repeat(np.arange(len(data)), sizes)
    words = np.bincount(doc, counts, minlength=len(data)) / 2
    return 10.0 * np.bincount(doc, text.w[rows] * counts, minlength=len(data)) / np.maximum(words, 1) + text.shift


class Weights:
    """A word's weight in the text view, kept for the words seen."""

    def __init__(self, text: TextView):
        self.text, self.of = text, {}

    def raw(self, texts: list[list[bytes]]) -> list[float]:
        """What ``TextView.raw`` gives for the words of each text."""
        if len(self.of) > CACHE:
            self.of.clear()
        seen, w = self.of, self.text.w
        if new := list(set().union(*texts).difference(seen)):
            words, shapes = rows_of(new)
            seen.update(zip(new, (w[words] + w[shapes]).tolist()))
        return [10.0 * sum(map(seen.__getitem__, t)) / max(len(t), 1) + self.text.shift for t in texts]


class CoTrained:
    """Both views, their calibration, and how they are combined."""

    def __init__(self, text: TextView, page: Logistic, calibrations: list[Logistic], combine: Logistic):
        self.text, self.page, self.calibrations, self.combine = text, page, calibrations, combine

    def scores(self, text_raw: np.ndarray, page_raw: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated page view, both."""
        each = np.stack([c.raw(np.clip(r, -20, 20)[:, None]) for c, r in zip(self.calibrations, (text_raw, page_raw))], axis=1)
        raw = np.c_[each, self.combine.raw(np.clip(each, -10, 10))]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def learn(texts, pages, y, part, ask=None, rounds: int = ROUNDS, passed: int = PASSED) -> CoTrained:
    """Co-train on labelled documents (those with ``part`` 1 calibrate).

    ``ask(text view, page view, n0, n1, round)`` gives (by the text view, by the
    page view) the unlabelled documents each is surest of: (features of the text,
    of the page, label), documents of an earlier round left out.
    """
    y, part = np.asarray(y, float), np.asarray(part)
    own, rest = np.flatnonzero(part != 1), np.flatnonzero(part == 1)
    width = pages.shape[1]
    text, page = TextView(), Logistic(width)
    to_text, to_page = [], []

    def fit():
        text.fit([texts[i] for i in own] + [t for t, _, _ in to_text], np.r_[y[own], [v for *_, v in to_text]])
        page.fit(np.concatenate([pages[own], np.array([p for _, p, _ in to_page], float).reshape(-1, width)]), np.r_[y[own], [v for *_, v in to_page]])

    fit()
    share, wanted = (y[own].mean() if len(own) else 0.5), max(1, min(passed, len(own) // 20))
    for r in range(rounds if ask and len(own) else 0):
        by_text, by_page = ask(text, page, max(1, round(wanted * 2 * (1 - share))), max(1, round(wanted * 2 * share)), r)
        to_page += by_text
        to_text += by_page
        fit()
    basis = rest if len(rest) and 0 < y[rest].sum() < len(rest) else own
    t, p = text.raw([texts[i] for i in basis]), page.raw(pages[basis]) if len(basis) else np.zeros(0)
    calibrations = [Logistic(1, 1e-4).fit(np.clip(r, -20, 20)[:, None], y[basis]) for r in (t, p)]
    each = np.stack([c.raw(np.clip(r, -20, 20)[:, None]) for c, r in zip(calibrations, (t, p))], axis=1)
    return CoTrained(text, page, calibrations, Logistic(2, 1e-3).fit(np.clip(each, -10, 10), y[basis]))


def _given(docs: DataFrame, text: str, lang: str, source: str, n_chars: str | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with what the views read in columns of their own names, and those names: data, lang, source, n_chars."""
    names = [fresh(x) for x in ("data", "lang", "source", "chars")]
    chars = F.col(n_chars).cast("long") if n_chars and n_chars in docs.columns else F.length(text).cast("long")
    return text_batches(docs).withColumns(dict(zip(names, (F.col(text).cast("binary"), F.col(lang).cast("string"), F.col(source).cast("string"), F.coalesce(chars, F.lit(0)))))), names


def _read(batch):
    """(bytes, words, page features) of the rows of a batch that begins with the columns of ``_given``."""
    import pyarrow as pa

    data = [x.as_py() or b"" for x in batch.column(0).cast(pa.large_binary())]
    return [d.split() for d in data], pages_of(data, *(batch.column(k).to_pylist() for k in (1, 2, 3)))


def _features(found: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``keys`` with what the views read of each row: x (packed rows of the text) and p (page features)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words, pages = _read(b)
            seen, xs = {}, []
            new = list(set().union(*words))
            for w, r, t in zip(new, *rows_of(new)):
                seen[w] = r, t
            for own in words:
                met = np.array([seen[w] for w in own], np.int64).ravel()
                xs.append(pack(*np.unique(met, return_counts=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(xs, pa.binary()), pa.array([p.astype("<f4").tobytes() for p in pages], pa.binary())], names=[*keys, "x", "p"])

    schema = found.select(keys).schema.add("x", "binary").add("p", "binary")
    return found.select(*names, *keys).mapInArrow(run, schema)


def _collected(features: DataFrame, keys: list[str]) -> list[tuple]:
    """Rows (the keys, features of text and page) at the driver, one of each id, the first key."""
    rows = features.groupBy(*keys).agg(F.min(F.struct("x", "p")).alias("f")).select(*keys, "f.x", "f.p").collect()
    return [(*r[: len(keys)], unpack(bytes(r.x)), np.frombuffer(r.p, "<f4").astype(float)) for r in sorted(rows, key=lambda r: r[0])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str | None = "n_chars", held_out: int = 5, per_class: int = PER_CLASS, rounds: int = ROUNDS, passed: int = PASSED) -> CoTrained:
    """Learn from rows whose crc32(id as text) mod ``held_out`` is not 0; those with remainder 1 calibrate.

    An id whose labels contradict each other, a null label and an id without a
    document teach nothing; of rows of one id one is read. Unlabelled documents
    are never held out. Equal scores go by id. Without a column ``n_chars`` the
    text's length is taken.
    """
    i, y, z, part, read = (fresh(x) for x in ("id", "y", "z", "part", "read"))
    bucket = crc_bucket(F.col(i), held_out)
    every = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(i)).agg(F.min(label).alias(y), F.max(label).alias(z))
    known = every.filter((F.col(y) == F.col(z)) & (bucket != 0))
    picked = [known.filter(F.col(y) == v).orderBy(F.xxhash64(i), i).limit(per_class).select(i, F.lit(v).alias(y), bucket.cast("int").alias(part)) for v in (0, 1)]
    given, names = _given(docs, text, lang, source, n_chars)
    given = given.withColumn(read, F.col(doc_id))
    own = _collected(_features(given.join(F.broadcast(picked[0].unionByName(picked[1])), F.col(read) == F.col(i)), names, [i, y, part]), [i, y, part])
    width = len(page_features(b"", None, None, 0))
    spark, used, kind = docs.sparkSession, [], given.schema[read].dataType.simpleString()
    # The labelled ones are among them here, so that no text is shuffled; they are left out where only ids and numbers are left.
    every_one = written(_features(given.filter(F.col(read).isNotNull() & (crc_bucket(F.col(read), held_out) != 0)), names, [read]), "views") if rounds and len(own) else None

    def ask(text_view, page_view, n0, n1, r):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                pages = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").reshape(-1, width).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed_raw(text_view, b.column(1).to_pylist())), pa.array(page_view.raw(pages))], names=["id", "t", "p"])

        free = every_one.mapInArrow(run, f"id {kind}, t double, p double").join(every.select(F.col(i).alias("id")), "id", "left_anti").groupBy("id").agg(F.min("t").alias("t"), F.min("p").alias("p"))
        free = checkpointed(free.join(F.broadcast(spark.createDataFrame([(u,) for u in used], f"id {kind}")), "id", "left_anti") if used else free)
        chosen: list[list] = []
        for by in ("t", "p"):
            low, high = free.filter(F.col(by) < -1).orderBy(by, "id").limit(n0 * 3 + n1), free.filter(F.col(by) > 1).orderBy(F.col(by).desc(), "id").limit(n1 * 3 + n0)
            taken = {k for k, _ in (chosen[0] if chosen else [])}
            chosen.append([pair for d, v, n in ((low, 0.0, n0), (high, 1.0, n1)) for pair in [(x.id, v) for x in d.select("id").collect() if x.id not in taken][:n]])
        used.extend(k for own in chosen for k, _ in own)
        wanted = spark.createDataFrame([(k, by, v) for by, own in enumerate(chosen) for k, v in own], f"`{i}` {kind}, `{part}` int, `{y}` double")
        rows = _collected(every_one.join(F.broadcast(wanted), F.col(read) == F.col(i)).select(i, part, y, "x", "p"), [i, part, y])
        return tuple([(t, p, v) for _, k, v, t, p in rows if k == by] for by in (0, 1))

    pages = np.array([r[4] for r in own], float).reshape(-1, width)
    return learn([r[3] for r in own], pages, [r[1] for r in own], [r[2] for r in own], ask, rounds, passed)


def score(docs: DataFrame, model: CoTrained, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str | None = "n_chars", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if None) with text_score, page_score and score, probabilities of label 1.

    A null text is an empty one: the text view gives its bias, the page view
    what it makes of a page without text. Null language and source are empty
    names, a null n_chars is 0. Rows are scored each for itself, repeated ones
    alike; very long texts are read whole. Columns of the three names are
    replaced. An empty table gives an empty table.
    """
    added = ("text_score", "page_score", "score")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in added)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = told.value
        weights = Weights(m.text)
        for b in batches:
            words, pages = _read(b)
            out = m.scores(np.array(weights.raw(words)), m.page.raw(pages)) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*b.columns[4:], *[pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)]], names=[*b.schema.names[4:], *added])

    given, names = _given(docs, text, lang, source, n_chars)
    given = given.select(*names, *keep)
    schema = given.drop(*names).schema
    for name in added:
        schema = schema.add(name, "double")
    return given.mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
