"""Near duplicates by a signature-coordinate inverted join.

1. Every text becomes the set of its distinct word shingles, its MinHash signature of ``K`` coordinates, and a 128-bit
   digest of the set. Texts with one set are one class, which is a node of its own, with one text that stands for it.
2. A representative is posted under its coordinate-value pairs. Two sets of similarity 0.8 agree in at least ``T``
   coordinates (but for a chance of about one in a million), so they meet under at least one of each other's first
   ``K - T + 1`` pairs in any fixed order: that prefix alone is posted. The order is by frequency, rarest first, from a
   sketch of all postings.
3. Lists are merged with skips. Members that differ in the low bit of so many coordinates that ``T`` collisions can't
   be left are passed over; in the first pass a member goes to the first and to the nearest member left, in the second
   only members of different components meet. A list of over ``BLOCK`` members, by an exact count, is split into pairs of blocks.
4. For each pair that met, its collisions are counted over all ``K`` coordinates; pairs of at least ``T`` are retained,
   and confirmed on the full sets. Confirmed links become components.
5. The second pass posts the documents that met any other once more, to find the links between different components.
   It posts them under the rarest fifth of their own shingles (two sets of similarity 0.8 share one of these): a pair
   that first meets at places i and j of sets of n and m can share min(n - i, m - j) at most. So in a large group of
   documents that are all somewhat alike, but less than 0.8, no pair needs a look, where coordinates alone would give
   all of the group's pairs. Pairs that pass are counted and confirmed as in 4.

Pairs within a group of copies are never all made: a member adds two pairs a list, and what the first pass has joined is
skipped by the second. No list, partner or candidate is capped.

Defined results: a text without words has the empty set and links with nothing. A row without doc_id links with
nothing, and its component_id is null; it is kept. Rows with one doc_id are one document: where it has several texts,
their classes are joined, and all its rows have one component_id. Extra columns are passed over.
``one_of_each`` numbers the rows, so that rows with one doc_id, or with none, are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import linked
from .common import clean_text, drop_written, mix, slices, words, written

K, T = 96, 58
#: Of K coordinates' low bits, sets of similarity 0.8 differ in 10 on average; more than this is a chance of about 1e-6.
MOST_BITS = 26
#: Counters of the frequency sketch: the bound of what is broadcast (4 bytes each).
SKETCH = 1 << 20
#: Members of a list (or of two blocks of it) that one task compares.
BLOCK = 50_000
#: Long lists whose lengths are broadcast (16 bytes each); more are joined by a shuffle.
LONG_LISTS = 1_000_000

_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 2**62, K, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_G = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of all words where there are fewer than ``size``."""
    w = words(texts, lower=True)
    h, off = w.hash, w.offsets
    run = h.copy()
    for j in range(1, size):
        run = mix(run[: len(h) - j] * _G + h[j:]) if j < len(h) else run[:0]
    out = []
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(run[lo : hi - size + 1]))
        elif hi > lo:
            x = h[lo]
            for y in h[lo + 1 : hi]:
                x = mix(np.array([x * _G + y]))[0]
            out.append(np.array([x ^ _G], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K 32-bit coordinates of each set (zeros for the empty set)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), K), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(np.append(0, sizes[full][:-1]))
        for j in range(K):
            out[full, j] = np.minimum.reduceat(flat * _ODD[j], starts) >> np.uint64(32)
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_500_000):
            sets = shingle_sets(part.column("text"), size)
            sig = signatures(sets)
            n = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([int(mix(s ^ _G).sum()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            d2 = np.array([int(mix(s * _G).sum()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n), pa.array(d1), pa.array(d2), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "th", "n_shingles", "d1", "d2", "sig"])

    return run


def _sig_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _tokens(sig: np.ndarray) -> np.ndarray:
    """Coordinate and value in one long, spread over all bits."""
    return mix((np.arange(K, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount((_tokens(_sig_array(batch.column(0))) & np.uint64(SKETCH - 1)).astype(np.int64).ravel(), minlength=SKETCH)
    found = np.flatnonzero(total)
    for lo in range(0, len(found), 100_000):
        part = found[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])


def _collected(counts: DataFrame) -> np.ndarray:
    found = counts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def frequency_sketch(reps: DataFrame) -> np.ndarray:
    """How often coordinate-value pairs occur, by slot: SKETCH numbers, whatever the number of documents."""
    return _collected(reps.select("sig").mapInArrow(_frequencies, "slot long, n long"))


def _bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, in two longs."""
    bits = np.packbits((sig & 1).astype(np.uint8), axis=1)
    return np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(np.int64)


POSTING = "token long, node long, comp long, n int, own int, b1 long, b2 long"
_FIELDS = tuple(x.split()[0] for x in POSTING.split(", "))


def _postings(tok, often, *fields) -> pa.RecordBatch:
    """A row for each posting. What one document has leads to no other; a sketch never counts too few."""
    use = often > 1
    return pa.RecordBatch.from_arrays([pa.array(tok[use].view(np.int64)), *(pa.array(f[use]) for f in fields), pa.array(often[use])], names=[*_FIELDS, "often"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with the exact ``length`` of their list where it is too long for one task: these go to pairs of blocks of it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 10_000):
            part = batch.slice(lo, 10_000)
            length = part.column("length").fill_null(0).to_numpy(zero_copy_only=False)
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in _FIELDS]
            one = length <= BLOCK
            out = [[c[one] for c in cols] + [np.zeros(one.sum(), np.int8)]]
            for i in np.flatnonzero(~one):
                g = 2 * int(length[i]) // BLOCK + 1
                mine = int(mix(np.array([cols[1][i]], np.int64).view(np.uint64))[0] % np.uint64(g))
                x, y = np.minimum(mine, np.arange(g)), np.maximum(mine, np.arange(g))
                key = mix(cols[0][i : i + 1].view(np.uint64) ^ mix((x * g + y + 1).astype(np.uint64)))
                # side 0 meets all others, sides 1 and 2 meet each other alone
                side = np.where(x == y, 0, np.where(x == mine, 1, 2)).astype(np.int8)
                out.append([key.view(np.int64), *(np.full(g, c[i]) for c in cols[1:]), side])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[*_FIELDS, "side"])


def _post(shared):
    prefix = K - T + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = _sig_array(part.column("sig"))
                tok = _tokens(sig)
                often = counts[(tok & np.uint64(SKETCH - 1)).astype(np.int64)]
                by_token = np.argsort(tok, axis=1, kind="stable")
                order = np.take_along_axis(by_token, np.argsort(np.take_along_axis(often, by_token, 1), axis=1, kind="stable"), 1)[:, :prefix]
                tok, often = np.take_along_axis(tok, order, 1).ravel(), np.take_along_axis(often, order, 1).ravel()
                bits = _bits(sig)
                node, comp, size, own = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), prefix) for c in ("node", "comp", "n", "own"))
                b1, b2 = np.repeat(bits[:, 0], prefix), np.repeat(bits[:, 1], prefix)
                yield _postings(tok, often, node, comp, size, own, b1, b2)

    return run


@dataclass
class Lists:
    """Rows of posting lists, which lie one after the other."""

    token: np.ndarray
    node: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    own: np.ndarray
    bits: np.ndarray
    side: np.ndarray
    percent: int

    def match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows are of two components, are to meet here, can share enough, and differ in few enough bits."""
        ok = (self.comp[i] != self.comp[j]) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
        most = np.minimum(self.n[i] - self.own[i], self.n[j] - self.own[j])
        ok &= 100 * most >= self.percent * (self.n[i] + self.n[j] - most)
        return ok & (self.apart(i, j) <= MOST_BITS)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the rows differ."""
        return np.bitwise_count(self.bits[i, 0] ^ self.bits[j, 0]).astype(np.int16) + np.bitwise_count(self.bits[i, 1] ^ self.bits[j, 1])


SMALL = 8


def _pairs_of(x: Lists, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole lists, whose rows are by node."""
    token, node = x.token, x.node
    n = len(token)
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(start, n))
    ia, ib = [], []
    small = np.repeat(size <= SMALL, size)
    for lag in range(1, SMALL):
        i = np.flatnonzero(small[: n - lag] & (token[: n - lag] == token[lag:])) if n > lag else np.empty(0, np.int64)
        j = i + lag
        ok = x.match(i, j)
        ia.append(i[ok])
        ib.append(j[ok])
    for lo, length in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        step = max(1, 1_000_000 // length)
        idx = np.arange(lo, lo + length)
        for at in range(lo, lo + length, step):
            rows = np.arange(at, min(at + step, lo + length))
            ok = x.match(rows[:, None], idx[None, :])
            if first:
                # a member goes to the first that it matches, and to the nearest: copies of one text that were changed
                # in places of their own are nearer to that text than to each other
                r = np.flatnonzero(ok.any(1))
                apart = np.where(ok[r], x.apart(rows[r, None], idx[None, :]), np.int16(1000))
                ia += [idx[ok[r].argmax(1)], idx[apart.argmin(1)]]
                ib += [rows[r], rows[r]]
            else:
                r, c = np.nonzero(ok & (idx[None, :] < rows[:, None]))
                ia.append(idx[c])
                ib.append(rows[r])
    i, j = np.concatenate(ia), np.concatenate(ib)
    return node[i], node[j]


def _merge_lists(first: bool, percent: int):
    names = ("token", "node", "comp", "n", "own", "b1", "b2", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _pairs_of(Lists(*cols[:3], cols[3].astype(np.int64), cols[4].astype(np.int64), np.stack(cols[5:7], 1).view(np.uint64), cols[7], percent), first)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            rows += batch.num_rows
            if rows >= 100_000:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                # the last list may go on in the next batch
                cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
                held, rows = [[c[cut:] for c in cols]], rows - cut
                if cut:
                    yield flush([c[:cut] for c in cols])
        if held:
            yield flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _met(posts: DataFrame, counts: np.ndarray, first: bool, percent: int) -> DataFrame:
    """``a, b`` of the postings' lists. ``counts``, the sketch, tells whether any list may be too long; lengths are exact."""
    spark = posts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = posts.drop("often").withColumn("side", F.lit(0).cast("byte"))
    if counts.max(initial=0) > BLOCK:
        long = written(posts.where(F.col("often") > BLOCK).groupBy("token").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") > BLOCK), "long")
        n = long.count()
        if n:
            told = posts.drop("often").join(F.broadcast(long) if n <= LONG_LISTS else long, "token", "left")
            lists = told.mapInArrow(_split, f"{POSTING}, side byte")
    lists = lists.repartition(parts, "token").sortWithinPartitions("token", "node")
    return lists.mapInArrow(_merge_lists(first, percent), "a long, b long").distinct()


def candidate_pairs(nodes: DataFrame, shared, first: bool, percent: int = 80) -> DataFrame:
    """``a, b`` (a <= b) of ``node, comp, n, own, sig`` rows that meet under a coordinate-value pair."""
    return _met(nodes.select("node", "comp", "n", "own", "sig").mapInArrow(_post(shared), f"{POSTING}, often int"), shared.value, first, percent)


def _shingle_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for part in slices(batches, "text", 1_000_000):
            for x in shingle_sets(part.column("text"), size):
                np.add.at(total, (x & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        found = np.flatnonzero(total)
        for lo in range(0, len(found), 100_000):
            piece = found[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], names=["slot", "n"])

    return run


def _post_shingles(shared, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for part in slices(batches, "text", 1_000_000):
            bits = _bits(_sig_array(part.column("sig")))
            node, comp = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp"))
            held = []
            for i, x in enumerate(shingle_sets(part.column("text"), size)):
                often = counts[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[: len(x) + 1 + (-percent * len(x)) // 100]  # n - ceil(t n) + 1
                held.append((x[order], often[order], np.full(len(order), i), np.arange(len(order), dtype=np.int32), np.full(len(order), len(x), np.int32)))
            tok, often, row, place, n = (np.concatenate(c) for c in zip(*held, strict=True))
            yield _postings(mix(tok), often, node[row], comp[row], n, place, bits[row, 0], bits[row, 1])

    return run


def late_pairs(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b`` of different components that meet under a rare shingle. Every node has one text."""
    found = texts.select("text").mapInArrow(_shingle_frequencies(size), "slot long, n long")
    shared = texts.sparkSession.sparkContext.broadcast(_collected(found))  # SKETCH numbers
    posts = nodes.select("node", "comp").join(texts, "node").mapInArrow(_post_shingles(shared, size, percent), f"{POSTING}, often int")
    return _met(posts, shared.value, False, percent)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each pair of signatures agrees."""
    return (a == b).sum(1)


def _confirm(size: int, percent: int):
    """Retains pairs with ``T`` collisions or more, and of these the ones whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a", 1_000_000, 400):
            count = collisions(_sig_array(part.column("sig_a")), _sig_array(part.column("sig_b")))
            part = part.filter(pa.array(count >= T))
            x, y = shingle_sets(part.column("text_a"), size), shingle_sets(part.column("text_b"), size)
            same = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - same
            keep = pa.array((100 * same >= percent * union) & (same > 0), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


@dataclass(frozen=True)
class Result:
    """``rows``: doc_id, n_shingles, component_id, kept of every row; ``links``: the confirmed links of representatives."""

    rows: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> Result:
    """Classes of documents that links of at least ``percent`` similarity join, over shingles of ``size`` words.

    The match threshold is set for 80 percent or more. ``component_id`` is the smallest doc_id that can be reached.
    """
    if percent < 80:
        raise ValueError("the match threshold holds for a similarity of 0.8 or more")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(clean_text(text_col)).alias("th"), clean_text(text_col).alias("text"))
    sketch = written(source.mapInArrow(_sketch(size), "doc_id long, th long, n_shingles long, d1 long, d2 long, sig binary"), "sketch")
    with_words = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = sketch.where(with_words).groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("text"), F.min("sig").alias("sig"), F.min("n_shingles").cast("int").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "text.doc_id", "text.th", "n", "sig"), "classes")
    nodes = classes.select("node", F.col("node").alias("comp"), "n", F.lit(0).alias("own"), "sig")
    shared = spark.sparkContext.broadcast(frequency_sketch(classes))  # SKETCH numbers

    met = written(candidate_pairs(nodes, shared, True, percent), "pairs")
    wanted = written(met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    # joins with texts are shuffles at every size, so that the disk they take follows the input
    asked = wanted.join(classes.select("node", "doc_id", "th", "sig"), "node")
    texts = written(source.join(asked.hint("merge"), ["doc_id", "th"]).select("node", "sig", "text"), "texts")
    if not _unique(texts):  # of repeated rows one is enough
        texts = texts.dropDuplicates(["node"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"), F.col("sig").alias(f"sig_{k}")).hint("merge")
        both = pairs.where("a <> b").join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "text_a", "text_b", "sig_a", "sig_b").mapInArrow(_confirm(size, percent), "a long, b long")

    links = written(confirmed(met), "links")
    joined = written(linked(links), "joined")
    again = written(wanted.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "again")
    pairs = written(late_pairs(again, texts, size, percent), "pairs")
    late = written(confirmed(pairs), "links")
    links = links.unionByName(late)
    # documents of several texts hold their classes together
    several = written(sketch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    held = several.join(sketch.where(with_words).select("doc_id", "d1", "d2").distinct(), "doc_id").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node")
    held = written(held, "held")
    bonds = held.groupBy("doc_id").agg(F.min("node").alias("a")).join(held.withColumnRenamed("node", "b"), "doc_id").select("a", "b").where("a <> b")
    changed = late.head(1) or held.head(1)
    comps = written(linked(links.unionByName(bonds)), "joined") if changed else joined
    drop_written(met, wanted, texts, again, pairs)
    # a component is named by its smallest doc_id
    least = comps.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("home"))
    moved = comps.join(least, "component").select("node", "home")
    home = classes.select("d1", "d2", "node", "doc_id").join(moved, "node", "left").select("d1", "d2", "node", F.coalesce("home", "doc_id").alias("home"))
    columns = ["doc_id", "n_shingles", F.col("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    rows = sketch.where(with_words).select("doc_id", "n_shingles", "d1", "d2").join(home.drop("node"), ["d1", "d2"]).withColumnRenamed("home", "component_id").select(*columns)
    of_id = held.join(home, "node").groupBy("doc_id").agg(F.min("home").alias("home"))
    alone = sketch.where(~with_words).join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("home", "doc_id")).select(*columns)
    named = lambda k: classes.select(F.col("node").alias(k), F.col("doc_id").alias(f"id_{k}"))
    told = links.join(named("a"), "a").join(named("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return Result(rows.unionByName(alone), told)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies; every row is a node of its own, whatever its id.

    The row with the smallest id stays, one without id only where no other has one; equal ids go by a hash of the text,
    then by place. A text without words links with nothing and stays.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, size, percent, number, text_col).rows.select(F.col("doc_id").alias(number), "component_id")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(clean_text(text_col)).alias("text"), F.col(number).alias("row"))
    best = found.join(rows.select(number, rank.alias("rank")), number).groupBy("component_id").agg(F.min("rank").alias("rank"))
    return rows.join(best.select(F.col("rank.row").alias(number)), number, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def _unique(texts: DataFrame) -> bool:
    n, d = texts.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    return n == d
