"""LM scoring: a causal self-attention model over subword ids, mixed with the corpus's word counts.

Words are spelled in the first ``VOCAB`` pieces of a public byte-level BPE, with
a leading space. The attention model (attention_lm) starts from weights learned
at the driver on windows of a few thousand documents. Then the whole training
corpus is gone through: each task goes on with the weights over every window of
its texts; the tasks' changes are averaged by their windows. So every id of the
corpus is a target once, and the driver holds one set of weights.

The model's probability of a word is the product over the word's pieces, given
that a word begins, times the probability that the word is over; that is a
distribution over words and the end mark. The score's distribution is a mixture
of it with the words' share of the training corpus, which is counted over all
training documents. Everything is added up in logarithms, so that no word is too
unlikely to count.

Counting sums (word, n) in tasks before the shuffle. The most frequent words,
up to ``HEAD_WORDS``, are sent to all executors; their terms are added up where
the text is scored. Tokens of other words go to a join with the counts, one row
each, and come back as sums per row.
"""

from __future__ import annotations

import base64
import copy
import math
import os
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import attention_lm
from millrace.llm.common import LOWER, UPPER, checkpointed, crc_bucket, fresh, table, text_batches

#: A public vocabulary of byte pieces by rank; its first VOCAB pieces are used.
RANKS, VOCAB = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 2048
#: Words that are sent to all executors, at most; documents and windows of each that the first weights are learned from, at most; steps of that.
HEAD_WORDS, SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS = 150_000, 3000, 64, 2500
#: Bytes of text for each stretch where a caller asks for stretches, the step size in the tasks, windows of a step, and windows that are mixed before steps are taken.
SPAN, RATE, STEP, MIXED = 4096, 0.002, 64, 4096
#: Share of the corpus counts in the mixture.
SHARE = 0.3
#: Distinct words that a task counts before it passes them on, or keeps spelled; words of texts that are scored at once.
FLUSH, CACHE, GROUP = 250_000, 250_000, 40_000
LN10 = math.log(10)
#: Stands for the end mark among the words; no word holds a space.
END = b" "

_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_LOW).split()  # bytes.split: ASCII white space


class Speller:
    """Pieces of words; ``end`` is the id of the end mark."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.end = len(ranks)
        self.encoding = tiktoken.Encoding("pieces", pat_str=r" [^ ]*", mergeable_ranks=ranks, special_tokens={})
        self.leading = np.zeros(len(ranks) + 1, bool)
        self.leading[self.end] = True
        for piece, i in ranks.items():
            self.leading[i] = piece[:1] == b" "

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words, pieces of each): a word's first piece, and no other, begins with a space."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int32)
        return pieces, np.diff(np.r_[np.flatnonzero(self.leading[pieces]), len(pieces)])


def read_ranks(path: str = RANKS, vocab: int = VOCAB) -> dict[bytes, int]:
    """The first ``vocab`` pieces of a vocabulary file, which the driver reads."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary of pieces at {path}: name one by the parameter ranks")
    with open(path, "rb") as f:
        pairs = (line.split() for line in f)
        return {base64.b64decode(a): int(b) for a, b in pairs if int(b) < vocab}


class Numbers(dict):
    """Numbers of words, in the order in which they are asked for first; ``new`` are those since it was emptied."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Texts:
    """Texts as ids, with the distinct words kept: pieces, and what the head says of them."""

    def __init__(self, speller: Speller, head: dict[bytes, int] | None = None):
        self.speller, self.head = speller, head or {}
        self.clear()

    def clear(self):
        self.at, self.names, self.room = Numbers(), [], {}
        self.pieces, self.sizes, self.counts, self.starts = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def grow(self, name: str, new: np.ndarray) -> None:
        """Append to an array that has room to spare."""
        now = getattr(self, name)
        room = self.room.get(name)
        if room is None or len(room) < len(now) + len(new):
            room = self.room[name] = np.empty(2 * (len(now) + len(new)), now.dtype)
            room[: len(now)] = now
        room[len(now) : len(now) + len(new)] = new
        setattr(self, name, room[: len(now) + len(new)])

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, words of each text)."""
        if len(self.at) > CACHE:
            self.clear()
        number, out, sizes = self.at.__getitem__, [], []
        for t in texts:
            words = words_of(t)
            out.append(np.fromiter(map(number, words), np.int64, len(words)))
            sizes.append(len(words))
        if new := self.at.new:
            pieces, n = self.speller.spell(new)
            self.names += new
            self.grow("starts", len(self.pieces) + np.cumsum(n) - n)
            self.grow("sizes", n)
            self.grow("pieces", pieces)
            self.grow("counts", np.fromiter(map(self.head.get, new, repeat(-1)), np.int64, len(new)))
            self.at.new = []
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(sizes, np.int64)

    def ids(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids with an end mark before each text, ids of each text, place of each word's first piece, its pieces)."""
        n = self.sizes[words] if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(n) - n + doc + 1
        per = np.bincount(doc, n, minlength=len(sizes)).astype(np.int64) + 1
        ids = np.full(int(per.sum()), self.speller.end, np.int64)
        if len(words):
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(first, n) + within] = self.pieces[np.repeat(self.starts[words], n) + within]
        return ids, per, first, n


def word_scores(model: attention_lm.Model, speller: Speller, ids, per, first, n) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of each word, and of each text's end."""
    lp, lead = attention_lm.score_texts(model, ids, per, speller.end)
    total = np.r_[0.0, np.cumsum(lp)]
    words = total[first + n - 1] - total[first - 1] - lead[first - 1] + lead[first + n - 1] if len(first) else np.zeros(0)
    last = np.cumsum(per) - 1
    return words, lp[last] - lead[last]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, the end mark included."""

    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen = Counter()
        for b in batches:
            seen[END] += b.num_rows
            for x in b.column(0).cast(pa.large_binary()):
                seen.update(words_of(x.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen = Counter()
        yield out()

    return text_batches(docs).select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def head_of(counts: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """(least count, words) of the frequent words: all words from that count on, ``most`` at most."""
    least, held = 1 << 62, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most).collect():
        held += r.words
        if held > most:
            break
        least = r.n
    return least, {bytes(r.word): r.n for r in counts.filter(F.col("n") >= least).select("word", "n").collect()} if least < 1 << 62 else {}


def train(docs: DataFrame, speller: Speller, doc_id: str, text: str, docs_at_most: int = SAMPLE_DOCS, windows_at_most: int = SAMPLE_WINDOWS, steps: int = STEPS, seed: int = 1) -> attention_lm.Model:
    """First weights, from documents picked by a hash of the id, one row of an id; windows of a document are picked evenly over its whole text."""
    pad, length = len(speller.leading), attention_lm.LENGTH
    ids_of = fresh("id")
    chosen = docs.select(F.col(doc_id).alias(ids_of)).distinct().orderBy(F.xxhash64(ids_of), ids_of).limit(docs_at_most)
    told = docs.sparkSession.sparkContext.broadcast(speller_ranks(speller))

    def run(batches):
        import pyarrow as pa

        texts = Texts(Speller(told.value))
        for b in batches:
            xs = []
            for x in b.column(0).cast(pa.large_binary()):
                ids, per, _, _ = texts.ids(*texts.read([x.as_py()]))
                total = int((-(-per // attention_lm.STRIDE)).sum())
                for w in np.unique(np.linspace(0, total - 1, min(total, windows_at_most)).astype(int)).tolist():
                    x, t, _ = attention_lm.windows(ids, per, speller_end, pad, w, w + 1)
                    xs.append(np.concatenate([x[0], t[0]]).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary())], names=["w"])

    speller_end = speller.end
    found = docs.join(F.broadcast(chosen), docs[doc_id].eqNullSafe(F.col(ids_of))).select(F.col(ids_of), F.col(text).cast("binary").alias("t"))
    found = found.groupBy(ids_of).agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t")
    rows = sorted(bytes(r.w) for r in found.mapInArrow(run, "w binary").collect())
    rows = np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), length + attention_lm.STRIDE).astype(np.int64)
    x, t = rows[:, :length], rows[:, length:]
    model = attention_lm.Model(speller.leading, np.bincount(t[t >= 0], minlength=pad).astype(float), seed)
    model.train(x, t, steps, seed=seed)
    return model


def spans_of(data: bytes | None, span: int = SPAN, size: int = 320) -> list[tuple[bytes, bool, bool]]:
    """(bytes, whether the text begins there, whether it ends there) of a stretch in every ``span`` bytes of a text, where a hash of them says; a shorter rest has one with a chance of its share."""
    data, out = data or b"", []
    for at in range(0, max(len(data), 1), span):
        own = data[at : at + span]
        place = zlib.crc32(own) % span
        if place > len(own):
            continue
        begin = 0 if at + place < size // 4 else at + place
        part = data[begin : begin + size]
        if begin:
            part = part[part.find(b" ") :] if b" " in part else b""
        ends = begin + size >= len(data)
        if not ends:
            part = part[: part.rfind(b" ") + 1]
        out.append((part, begin == 0, ends))
    return out


def span_windows(spans, texts: Texts, end: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of the stretches, as ``attention_lm.windows`` gives them for whole texts; those without a target are left out."""
    length, stride, context = attention_lm.LENGTH, attention_lm.STRIDE, attention_lm.CONTEXT
    ids, per, _, _ = texts.ids(*texts.read([p for p, _, _ in spans]))
    x, t, at = np.full((len(spans), length), pad, np.int64), np.full((len(spans), stride), -1, np.int64), 0
    for k, ((_, begins, ends), n) in enumerate(zip(spans, per.tolist())):
        own = ids[at if begins else at + 1 : at + n].tolist()
        at += n
        lead = context if begins else 0
        given, aims = own[: length - lead], (own + [end] * ends)[context + 1 - lead : length + 1 - lead]
        x[k, lead : lead + len(given)], t[k, : len(aims)] = given, aims
    real = t.max(axis=1, initial=-1) >= 0
    return x[real], t[real]


def every_window(data: list[bytes | None], texts: Texts, end: int, pad: int):
    """Inputs and targets of all windows of whole texts, at most ``MIXED`` at once."""
    since, held = 0, 0
    for i, d in enumerate(data):
        held += len(d or b"") // 6
        if held > GROUP or i + 1 == len(data):
            ids, per, _, _ = texts.ids(*texts.read(data[since : i + 1]))
            total = int((-(-per // attention_lm.STRIDE)).sum())
            for w in range(0, total, MIXED):
                yield attention_lm.windows(ids, per, end, pad, w, w + MIXED)[:2]
            since, held = i + 1, 0


def refine(model: attention_lm.Model, docs: DataFrame, speller: Speller, text: str, span: int | None = None, rate: float = RATE) -> attention_lm.Model:
    """Go on with the weights on every window of the texts, in the tasks, and average their changes by windows. ``span`` asks for a window of every so many bytes only; the query does not."""
    told, pad, end, parts, salts = docs.sparkSession.sparkContext.broadcast((speller_ranks(speller), model)), len(speller.leading), speller.end, 32, 64

    def run(batches):
        import pyarrow as pa

        ranks, first = told.value
        own = copy.deepcopy(first)
        texts, adam, held, n, since, rng = Texts(Speller(ranks)), attention_lm.Adam(own), [], 0, 0, np.random.default_rng(1)

        def step():
            """Steps over the windows held, in a mixed order, as those of a text stand together."""
            nonlocal held, n, since
            x, t = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = rng.permutation(len(x))
            for a in range(0, len(x), STEP):
                adam.step(x[order[a : a + STEP]], t[order[a : a + STEP]], rate)
            n += len(x)
            held, since = [], 0

        for b in batches:
            data = [d.as_py() for d in b.column(0).cast(pa.large_binary())]
            found = every_window(data, texts, end, pad) if span is None else [span_windows([s for d in data for s in spans_of(d, span)], texts, end, pad)]
            for x, t in found:
                held.append((x, t))
                since += len(x)
                if since >= MIXED:
                    step()
        if since:
            step()
        if n:
            change = np.concatenate([(own.p[k] - first.p[k]).ravel() for k in sorted(first.p)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([zlib.crc32(change.tobytes()) % salts] * parts, pa.int32()), pa.array([float(n)] * parts), pa.array([c.astype(np.float64).tobytes() for c in np.array_split(change * n, parts)], pa.binary())], names=["part", "salt", "n", "c"])

    def add(key, data):
        import pyarrow as pa

        total = sum(np.frombuffer(c.as_py()) for c in data.column("c"))
        return pa.table({"part": data.column("part").slice(0, 1), "salt": pa.array([0], pa.int32()), "n": pa.array([float(sum(data.column("n").to_pylist()))]), "c": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, salt int, n double, c binary"
    changes = text_batches(docs).select(F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)
    rows = changes.groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).orderBy("part").collect()
    if rows:
        change, at = np.concatenate([np.frombuffer(r.c) for r in rows]) / rows[0].n, 0
        for k in sorted(model.p):
            p = model.p[k]
            model.p[k] = (p + change[at : at + p.size].reshape(p.shape)).astype(np.float32)
            at += p.size
    return model


def speller_ranks(speller: Speller) -> dict[bytes, int]:
    return dict(speller.encoding._mergeable_ranks)


def score(docs: DataFrame, learn: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, vocab: int = VOCAB, share: float = SHARE, head_words: int = HEAD_WORDS, steps: int = STEPS) -> DataFrame:
    """Columns ``keep`` of each row of ``docs`` with n_tokens, n_known, train_tokens, base_score, score, learning from ``learn``.

    A null text is an empty one: the end mark alone. Repeated rows, and rows of
    one id, are scored each for itself, and count each in learning; there are no
    ties to settle. Very long texts are scored whole, window by window. Bytes that are no UTF-8 are
    spelled as U+FFFD. Without rows to learn from the counts are 0 and the model
    is untrained. Columns not named are not read; those in ``keep`` that have the
    name of a result are left out. An empty table gives an empty table.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    speller = Speller(read_ranks(ranks, vocab))
    model = refine(train(learn, speller, doc_id, text, steps=steps), learn, speller, text)
    counts = checkpointed(count_words(learn, text))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least, head = head_of(counts, head_words)
    model.prepare()
    told = docs.sparkSession.sparkContext.broadcast((speller_ranks(speller), model, head))
    row, data = fresh("row"), fresh("data")
    given = docs.select(F.col(text).cast("binary").alias(data), F.monotonically_increasing_id().alias(row), *keep)
    kept = given.columns[1:]
    tokens, known_of, base_of, model_of, word_of, log_of, count_of, held_of = (fresh(x) for x in ("tokens", "known", "base", "model", "word", "a", "c", "w"))
    names = [*kept, tokens, known_of, base_of, model_of, word_of, log_of]
    uniform, rest_of = (share / n, math.log(1 - share)) if n else (0.0, 0.0)

    def run(batches):
        import pyarrow as pa

        pieces, net, frequent = told.value
        texts = Texts(Speller(pieces), frequent)
        end_count = frequent.get(END, -1)

        def terms(c, a):
            """log10 of the mixture for words of counts c and log probabilities a."""
            seen = np.log(np.where(c > 0, uniform * c, 1.0))
            return np.where(c > 0, np.logaddexp(seen, a + rest_of), a + rest_of) / LN10

        def group(batch, data):
            words, sizes = texts.read(data)
            a, ends = word_scores(net, texts.speller, *texts.ids(words, sizes))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            c = texts.counts[words] if len(words) else words
            known = c >= 0
            add = lambda x: np.bincount(doc[known], x, minlength=len(sizes)).astype(float)
            base, score, n_known = add(np.log10(c[known] + 0.1)), add(terms(c[known], a[known])), add(np.ones(known.sum())).astype(np.int64)
            if end_count >= 0:
                base, score, n_known = base + np.log10(end_count + 0.1), score + terms(end_count, ends), n_known + (end_count > 0)
            none = pa.nulls(len(sizes))
            key = pa.array([b"  %d" % i for i in batch.column(row).to_pylist()], pa.binary())  # meets no word, and no other row
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(score), key, none.cast(pa.float64())], names=names)
            rest = np.flatnonzero(~known)
            which, word, log_p = doc[rest], [texts.names[i] for i in words[rest].tolist()], a[rest]
            if end_count < 0:
                which, word, log_p = np.r_[which, np.arange(len(sizes))], word + [END] * len(sizes), np.r_[log_p, ends]
            if len(word):
                empty = [pa.nulls(len(word), f.type) for f in batch.schema][2:]
                yield pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(which)), *empty, *[pa.nulls(len(word), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array(word, pa.binary()), pa.array(log_p)], names=names)

        for b in batches:
            since, held, data = 0, 0, []
            column = b.column(0).cast(pa.large_binary())
            for i in range(b.num_rows):
                data.append(column[i].as_py())
                held += len(data[-1] or b"") // 6
                if held > GROUP or i + 1 == b.num_rows:
                    yield from group(b.slice(since, i + 1 - since), data)
                    since, held, data = i + 1, 0, []

    schema = given.select(*kept).schema
    for name, kind in ((tokens, "long"), (known_of, "long"), (base_of, "double"), (model_of, "double"), (word_of, "binary"), (log_of, "double")):
        schema = schema.add(name, kind)
    for f in schema:
        f.nullable = True
    told_of = given.mapInArrow(run, schema)
    rare = counts.filter(F.col("n") < least).select(F.col("word").alias(held_of), F.col("n").alias(count_of))
    met = told_of.join(rare, F.col(word_of) == F.col(held_of), "left").withColumn(count_of, F.coalesce(count_of, F.lit(0)))
    own = F.col(log_of).isNotNull()
    model_says = F.col(log_of) + F.lit(rest_of)
    seen = F.log(F.lit(uniform) * F.col(count_of))
    mixture = F.when(F.col(count_of) > 0, F.greatest(seen, model_says) + F.log1p(F.exp(-F.abs(seen - model_says)))).otherwise(model_says) / F.lit(LN10)
    sums = met.groupBy(row).agg(
        *[F.max(c).alias(c) for c in kept if c != row], F.max(tokens).alias("n_tokens"), (F.max(known_of) + F.sum(F.when(own & (F.col(count_of) > 0), 1).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.log10(F.col(count_of) + F.lit(0.1))).otherwise(F.col(base_of))).alias(base_of), F.sum(F.when(own, mixture).otherwise(F.col(model_of))).alias("score"),
    )
    whole = float(np.log10(n + 0.1 * (v + 1)))
    return sums.select(*keep, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col(base_of) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    out = score(docs.withColumn("held_out", held_out), docs.filter(~held_out), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
