"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

A fingerprint is made from the word shingles of the whole text. Equal
fingerprints are one node from then on. To find all pairs within a radius of r
bits, the 64 bits are cut into k > r blocks: two fingerprints within the radius
agree on k - r blocks at least, so a pair is met under one of the C(k, r)
choices of k - r blocks. Rows of one choice and value form a bin, and the pairs
of a bin are compared exactly in tiles by numpy exclusive-or and bit counts.
Rows of a bin stand in the order of their population counts, and tile pairs
whose counts are further apart than the radius are skipped: the distance is at
least the difference of the counts. Nothing is approximate.

A bin above ``tile_rows`` rows is dealt to a grid of tile pairs, each a task
unit of its own. A tile pair emits a spanning forest of its links, never all of
them, and skips what is already connected. Components come from those forests.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.llm.common import LOWER, UPPER, checkpointed, fresh, null_safe_join, table, text_batches
from millrace.llm.components import components

SHINGLE, RADIUS = 3, 3
#: Rows of a bin that one task takes as a tile.
TILE_ROWS = 1024
#: Rows and columns of the blocks in which numpy compares a tile.
BLOCK = 256
#: Crowded bins up to this many are told to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_BINS = 100_000


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8."""
    import numpy as np
    import xxhash

    words = (data or b"").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()  # bytes.split: ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(whole)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths + 1) - 1
        starts, ends = (last - lengths)[: len(words) - shingle + 1].tolist(), last[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str, keep: tuple[str, ...], out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and the fingerprint of ``text`` as a long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = batch.column(0).cast(pa.large_binary())
            got = pa.array([fingerprint(x.as_py(), shingle) for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], names=[*batch.schema.names[1:], out])

    given = text_batches(docs).select(F.col(text).cast("binary").alias(fresh("text")), *keep)
    schema = given.select(*keep).schema.add(out, "long")
    return given.mapInArrow(run, schema)


def blocks_for(n: int, radius: int) -> int:
    """Blocks to cut 64 bits into, so that bins of n random fingerprints stay near 2^8 rows at most."""
    for k in range(radius + 1, radius + 5):
        if n <= 1 << (64 * (k - radius) // k + 8):
            return k
    return radius + 4


def _bins(fps: DataFrame, k: int, radius: int) -> DataFrame:
    """fp with choice and value of each bin it is in."""
    edges = [64 * i // k for i in range(k + 1)]
    choices = []
    for c, kept in enumerate(combinations(range(k), k - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in kept)
        mask -= (1 << 64) * (mask >> 63)
        choices.append(F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")))
    return fps.select("fp", F.explode(F.array(*choices)).alias("bin")).select("fp", "bin.choice", "bin.value")


class _Forest:
    """Union-find over the rows of a bin, which keeps the links that join two parts."""

    def __init__(self, n):
        self.up, self.links = list(range(n)), []

    def root(self, x):
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x, y):
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _spread(near, rows, cols, forest):
    """Walk the components of one block of links, from row to column and back, each once."""
    import numpy as np

    left, right = near.any(axis=1), near.any(axis=0)
    while left.any():
        first = int(left.argmax())
        todo, left[first] = [(0, first)], False
        while todo:
            side, x = todo.pop()
            new = np.flatnonzero(near[x] & right) if side == 0 else np.flatnonzero(near[:, x] & left)
            (right if side == 0 else left)[new] = False
            for y in new.tolist():
                forest.link(*((rows + x, cols + y) if side == 0 else (rows + y, cols + x)))
                todo.append((1 - side, y))


def compare_tile(fp, pop, tile, radius):
    """Spanning links (row, row) of one tile or tile pair whose rows stand by side, then population count."""
    import numpy as np

    n, forest = len(fp), _Forest(len(fp))
    cut = int(np.searchsorted(tile, 1))  # rows before it are of the first tile of a pair
    firsts = [(a, min(a + BLOCK, cut or n)) for a in range(0, cut or n, BLOCK)]
    seconds = [(b, min(b + BLOCK, n)) for b in range(cut, n, BLOCK)] if 0 < cut < n else firsts
    if cut == n:
        seconds = firsts
    for a, a_end in firsts:
        for b, b_end in seconds:
            if seconds is firsts and b < a:
                continue
            if pop[b] - pop[a_end - 1] > radius or pop[a] - pop[b_end - 1] > radius:
                continue
            if len({forest.root(x) for x in (*range(a, a_end), *range(b, b_end))}) == 1:
                continue
            near = np.bitwise_count(fp[a:a_end, None] ^ fp[None, b:b_end]) <= radius
            if a == b:
                near &= ~np.tri(a_end - a, dtype=bool)
                near |= near.T
            if near.any():
                _spread(near, a, b, forest)
    return forest.links


def _compare(radius: int):
    """For mapInArrow over rows sorted by bin, tile pair, side and population count."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(bins, fp, pop, side):
            starts = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(fp)])
            group, (a, b) = np.repeat(np.arange(len(starts)), sizes), ([], [])
            small = sizes <= 32
            # Small bins: all at once, each row against the one d rows on, until the counts are too far apart.
            row = np.flatnonzero(small[group] & (bins[:, 2] == bins[:, 3]))
            for d in range(1, 32):
                row = row[row + d < len(fp)]
                row = row[(group[row] == group[row + d]) & (pop[np.minimum(row + d, len(fp) - 1)] - pop[row] <= radius)]
                if not len(row):
                    break
                hit = row[np.bitwise_count(fp[row] ^ fp[row + d]) <= radius]
                a.append(fp[hit])
                b.append(fp[hit + d])
            for g in np.flatnonzero(~small | (bins[starts, 2] != bins[starts, 3])).tolist():
                at = slice(starts[g], starts[g] + sizes[g])
                if bins[starts[g], 2] != bins[starts[g], 3] and side[at].min() == side[at].max():
                    continue  # one side of this tile pair is empty
                if found := compare_tile(fp[at], pop[at], side[at], radius):
                    x = np.array(found)
                    a.append(fp[at][x[:, 0]])
                    b.append(fp[at][x[:, 1]])
            a, b = np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rest = None
        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            now = [np.stack(c[:4], axis=1).astype(np.int64), np.ascontiguousarray(c[6]).view(np.uint64), c[5].astype(np.int64), c[4].astype(np.int64)]
            if rest:
                now = [np.concatenate(x) for x in zip(rest, now)]
            last = int(np.flatnonzero((now[0] == now[0][-1]).all(axis=1))[0]) if len(now[0]) else 0
            if last:
                yield links(*(x[:last] for x in now))
            rest = [x[last:] for x in now]
        if rest and len(rest[0]):
            yield links(*rest)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that connect whatever lies within the radius."""
    k = blocks or blocks_for(fps.count(), radius)
    bins = _bins(fps, k, radius)
    crowded = checkpointed(bins.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile_rows).select("choice", "value", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles")))
    bins = null_safe_join(bins, crowded, ["choice", "value"], "left", small=crowded.count() <= BROADCAST_BINS)
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    bins = bins.select("fp", "choice", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    bins = bins.select("choice", "value", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), F.bit_count("fp").alias("pop"), "fp")
    order = ("choice", "value", "t", "u")
    found = bins.repartition(*order).sortWithinPartitions(*order, "side", "pop", "fp").mapInArrow(_compare(radius), "a long, b long")
    return found.distinct()


def groups(prints: DataFrame, doc_id: str, radius: int = RADIUS, tile_rows: int = TILE_ROWS, blocks: int | None = None) -> DataFrame:
    """(fp, part, component_id, first): each distinct fingerprint with its component, named by a fingerprint and by the smallest id in it, and the smallest id of its own rows."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(doc_id).alias("first")))
    roots = components(near_links(nodes.select("fp"), radius, tile_rows, blocks))
    nodes = nodes.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = checkpointed(nodes)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return nodes.join(least, "root").select("fp", F.col("root").alias("part"), "component_id", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS, blocks: int | None = None) -> DataFrame:
    """(doc_id, same, fp, part, component_id), one row per input row; ``same`` is a hash of the text, ``part`` a fingerprint that names the component.

    Null and empty texts, and those of white space alone, have fingerprint zero
    and are linked like any other. Repeated rows are linked to each other.
    Ties need no rule: component_id is a minimum. Null ids count as larger than
    any other; a component of null ids alone has a null component_id. Other
    columns are not read. An empty table gives an empty table.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    prints = checkpointed(fingerprints(given, "text", ("doc_id", "same"), "fp", shingle))
    return prints.join(groups(prints, "doc_id", radius, tile_rows, blocks).drop("first"), "fp").select("doc_id", "same", "fp", "part", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Where rows of one id are in a group, the least hash of the text decides, and
    of rows that agree in that too any one is kept. A group of null ids alone
    keeps one row. Columns stay as they are.
    """
    linked = near_duplicates(docs, doc_id, text, shingle, radius)
    keep = linked.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("k"))
    own_id, own_same, at = fresh("id"), fresh("same"), fresh("at")
    keep = keep.select(F.col("k.doc_id").alias(own_id), F.col("k.same").alias(own_same))
    found = docs.join(keep, docs[doc_id].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text]) == F.col(own_same)), "left_semi")
    first = W.partitionBy(doc_id, F.xxhash64(text)).orderBy(F.lit(0))
    return found.withColumn(at, F.row_number().over(first)).filter(F.col(at) == 1).drop(at)


#: Documents whose keys are sent to all executors (50 bytes each), at most; more are met by a shuffle.
BROADCAST_KEYS = 200_000
#: Least hashes that make a bin, and bins of a document: two at a similarity of 0.8 meet in none with a chance of 8 in a million, two at 0.3 in one with a chance of 4 in a thousand.
ROWS, BANDS = 8, 64
#: Members of a bin that all others of it are compared with in a round.
LEADS = 32
#: Bytes of the texts of a round's leads up to which they are sent to all executors; more are met by a shuffle.
BROADCAST_TEXTS = 4_000_000
#: How far a similarity estimated from one bit of each least hash may fall short, in standard deviations, before texts are not compared.
SIGMAS = 6.0


def words_low(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()


def similarity(a: bytes | None, b: bytes | None, shingle: int) -> float:
    """Jaccard similarity of the sets of word shingles of two texts; texts without words are equal."""

    def shingles(data):
        w = words_low(data)
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


@lru_cache
def factors():
    """Odd factors, each of which orders hashes in another way."""
    import numpy as np

    return np.random.default_rng(5).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def bins_of(data: bytes | None, shingle: int):
    """(bins, sketch) of a text: hashes of ``ROWS`` least hashes of its set of shingles for each bin, and one bit of every least hash. A text without words has one bin."""
    import numpy as np
    import xxhash

    words = words_low(data)
    if not words:
        return np.zeros(1, np.int64), np.zeros(ROWS * BANDS // 64, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.array(list({digest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))}), np.uint64)
    by = factors()
    least = np.min([(h[at : at + 256, None] * by).min(axis=0) for at in range(0, len(h), 256)], axis=0)
    bins = np.array([digest(b"%d " % i + x.tobytes()) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
    # A product's low bit is that of the hash, so a bit from the middle of another product is taken.
    return bins, np.packbits(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(1)).astype(bool), bitorder="little").view(np.int64)


def far_bits(least: float) -> int:
    """Bits by which the sketches of two texts at a similarity of ``least`` may differ: they agree in (1 + least) / 2 of them on average."""
    n, p = ROWS * BANDS, (1 - least) / 2
    return int(n * p + SIGMAS * (n * p * (1 - p)) ** 0.5)


def meeting(docs: DataFrame, doc_id: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """((k, bin), (k, sketch)) of the documents that share a bin with another; k is (no id, id, hash of the text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [bins_of(x.as_py(), shingle) for x in batch.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array([x[i] for x in got], pa.list_(pa.int64())) for i in (0, 1)]], names=["id", "same", "node", "bins", "sketch"])

    given = text_batches(docs).select(F.col(text).cast("binary").alias("t"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("node"))
    prints = checkpointed(given.mapInArrow(run, given.drop("t").schema.add("bins", ArrayType(LongType())).add("sketch", ArrayType(LongType()))))
    bins = prints.select("node", F.explode("bins").alias("bin"))
    shared = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bin")
    keys = prints.select("node", F.struct(F.col("id").isNull().alias("none"), "id", "same").alias("k"))
    linked = checkpointed(bins.join(shared, "bin").join(keys, "node").select("k", "bin").distinct())
    # Equal keys are equal texts, so any of their sketches will do.
    sketches = prints.select(F.struct(F.col("id").isNull().alias("none"), "id", "same").alias("k"), "sketch").dropDuplicates(["k"])
    return linked, sketches


def alike(pairs: DataFrame, sketches: DataFrame, bits: int) -> DataFrame:
    """Those of the pairs (k, lead) whose sketches differ in ``bits`` at most."""
    # A lead can have a large group: where pairs are few, the leads' sketches (some 100 bytes each) go to the pairs.
    sent = F.broadcast if pairs.count() <= BROADCAST_KEYS else (lambda d: d)
    of_lead = sketches.select(F.col("k").alias("lead"), F.col("sketch").alias("other")).join(sent(pairs.select("lead").distinct()), "lead", "left_semi")
    near = sketches.join(sent(pairs), "k").select("k", "lead", "sketch")
    near = near.join(sent(of_lead), "lead")
    differ = F.aggregate(F.zip_with("sketch", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    return checkpointed(near.filter(differ <= bits).select("k", "lead"))


def near_pairs(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (k, lead) whose similarity is ``least`` or more."""
    sent = F.broadcast if pairs.count() <= BROADCAST_KEYS else (lambda d: d)
    of = docs.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("same")).alias("own"), F.col(text).cast("binary").alias("t"))
    leads = checkpointed(of.join(sent(pairs.select(F.col("lead").alias("own")).distinct()), "own", "left_semi").dropDuplicates(["own"]).select(F.col("own").alias("lead"), F.col("t").alias("bt")))
    # One lead can have a large group of copies: where the leads are few, no text is sent to where its lead is.
    few = leads.agg(F.coalesce(F.sum(F.octet_length("bt") + 64), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_TEXTS
    # Rows of one id and text are one document; a pair that is compared twice is only once in the outcome.
    texts = of.join(sent(pairs), F.col("own") == F.col("k")).select("k", "lead", "t").join(F.broadcast(leads) if few else leads, "lead").select("k", "lead", "t", "bt")

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            x, y = b.column(2).cast(pa.large_binary()), b.column(3).cast(pa.large_binary())
            near = pa.array([similarity(p.as_py(), q.as_py(), shingle) >= least for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:2], schema=b.select(["k", "lead"]).schema).filter(near)

    return checkpointed(text_batches(texts).mapInArrow(compare, pairs.select("k", "lead").schema).distinct())


def settle(near: DataFrame, unsure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k that go, pairs left) of pairs (k, lead) with lead < k: in the order of the keys, a document goes if one that stays is near it.

    What ``unsure`` (k) holds can go, but stays only once it has been compared with all before it.
    """
    gone = None
    while True:
        later = near.select("k").unionByName(unsure).distinct()
        new = near.join(later.select(F.col("k").alias("lead")), "lead", "left_anti").select("k").distinct()
        new = checkpointed(new)
        if new.isEmpty():
            return (new if gone is None else gone), near
        gone = new if gone is None else gone.unionByName(new)
        near = checkpointed(near.join(new, "k", "left_anti").join(new.select(F.col("k").alias("lead")), "lead", "left_anti").select("k", "lead"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, leads: int = LEADS) -> DataFrame:
    """``docs`` without those that are near copies, by exact similarity, of a document that stays.

    In the order of ids, a document goes if the set similarity of its shingles
    with one that stays is ``least`` or more; so no two that are compared and
    stay are that similar, whatever group they are of. Compared are documents
    that share a bin of least hashes and whose sketches don't rule it out. The
    documents that are the first of each of their bins stay for certain; the
    others of those bins are compared with them, which settles large groups of
    copies by one comparison a member. Then the first ``leads`` of each bin are
    compared with all of it; what that leaves open goes to a round with four
    times as many leads. So pairs grow with the members, not with their square.
    Rows of one id and one text are one document here. Edge cases are those of
    ``dedup``.
    """
    linked, sketches = meeting(docs, doc_id, text, shingle)
    gone, bits = None, far_bits(least)

    def close(pairs: DataFrame) -> DataFrame:
        return near_pairs(docs, alike(checkpointed(pairs.filter(F.col("k") > F.col("lead")).select("k", "lead").distinct()), sketches, bits), doc_id, text, shingle, least)

    first = F.row_number().over(W.partitionBy("bin").orderBy("k"))
    if not linked.isEmpty():
        ahead = checkpointed(linked.withColumn("rank", first).filter(F.col("rank") == 1).select("bin", F.col("k").alias("lead")))
        bins_in, bins_led = linked.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ahead.groupBy(F.col("lead").alias("k")).agg(F.count(F.lit(1)).alias("led"))
        stay = checkpointed(bins_led.join(bins_in, "k").filter("led = n").select("k"))
        gone = checkpointed(close(linked.join(ahead.join(stay.select(F.col("k").alias("lead")), "lead", "left_semi"), "bin")).select("k").distinct())
        linked = checkpointed(linked.join(gone, "k", "left_anti").join(stay, "k", "left_anti"))
    while not linked.isEmpty():
        ahead = checkpointed(linked.withColumn("rank", first).filter(F.col("rank") <= leads).select("bin", F.col("k").alias("lead")))
        unsure = checkpointed(linked.join(ahead.withColumnRenamed("lead", "k"), ["bin", "k"], "left_anti").select("k").distinct())
        new, open_pairs = settle(close(linked.join(ahead, "bin")), unsure)
        gone = gone.unionByName(new)
        rest = unsure.unionByName(open_pairs.select("k")).distinct().join(new, "k", "left_anti")
        linked, leads = checkpointed(linked.join(rest, "k", "left_semi")), 4 * leads
    if gone is None:
        return docs
    gone = checkpointed(gone.distinct())
    sent = F.broadcast if gone.count() <= BROADCAST_KEYS else (lambda d: d)
    gone_id, gone_same = fresh("id"), fresh("same")
    gone = gone.select(F.col("k.id").alias(gone_id), F.col("k.same").alias(gone_same))
    return docs.join(sent(gone), docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_same)), "left_anti")


def query(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
