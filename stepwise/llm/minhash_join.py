"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of distinct 2-word shingles (64-bit hashes) and
   a signature of ``COORDINATES`` minima.  Equal sets are one class, kept by
   its smallest id; only classes go on.
2. Classes are posted under the values of their ``PAIRS`` pairs of neighbouring
   coordinates (two words of chance in common are much rarer than one).  Two sets that
   reach the threshold agree in at least ``MATCHES`` coordinates (but for a
   chance of 3.2e-7 at exactly 0.8, 9.8e-8 at 0.81, 2.9e-10 at 0.85), hence in at least
   ``k = MATCHES - PAIRS`` whole pairs, so they share one of the
   ``m - k + 1`` rarest of the ``m`` pair values that any other class has,
   too: only that prefix is posted, and classes with too few shared values
   are skipped altogether.
3. Posting lists are not expanded into pairs.  In rounds, as long as they find
   links, every member of a list meets one pivot of the list; of the pivots it met, a member is
   held against the one whose 4-bit sketch agrees most and one drawn at
   random, so a round confirms two pairs a class at most.  Links are confirmed
   on the full sets and joined into components.
4. Lists that still hold several components are split into windows of two
   neighbouring size classes (sets that differ more in size cannot be linked);
   lists of mostly the same members are joined, so a set travels about once a
   group; they are merged in blocks: a task counts the collisions of the signatures of two
   blocks and confirms those pairs of different components with ``MATCHES`` or
   more on the full sets, each in the first list they share; it passes on one
   link for each two components that it joins.  So no link between components
   is lost, and a group of copies passes on no more than its size.

Defined results: a text without words (or null) has an empty set, n_shingles
0, and is its own component; rows with a null id have null component and are
kept; rows that share an id are one document with all their links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.common import discard, map_batches, materialise
from stepwise.llm.components import connected_components

COORDINATES = 64
PAIRS = COORDINATES // 2
MATCHES = 34
BLOCK = 4000
#: Most bytes of sets in a block; a size class bounds its sets.
BLOCK_BYTES = 32 << 20
CACHE_WORDS = 400_000
#: Bits of a posting key below the number of its pair.
KEY_BITS = 58
#: Rounds go on while one finds at least this share of the first round's links; what they leave open, the blocks settle.
ROUND_SHARE = 0.02
#: Pairs of a round, or ids, that are broadcast: at most 16 MB.
SMALL_PAIRS = 1_000_000
#: A list joins a longer one that this share of its members are in; what it brings along is compared there, too.
MERGE_SHARE = 0.8
PIVOT_ROUNDS = 10
#: Sizes of one class differ by less than this factor; linked sets (80 % or more) are in one class or in neighbours.
CLASS_RATIO = 1.26

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out * _B + h[k:k + len(out)] + _A)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """``COORDINATES`` minima as signed 32-bit numbers."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(sh), 512):  # small enough for the processor's cache
        low = np.minimum(low, ((sh[None, lo:lo + 512] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(sh: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(sh.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


SKETCH = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<int>, z0 bigint, z1 bigint, z2 bigint, z3 bigint"
NIBBLES = ["z0", "z1", "z2", "z3"]
_SHIFTS = np.arange(0, 64, 4, dtype=np.uint64)


def nibbles(sig: np.ndarray) -> list[int]:
    """The lowest four bits of each coordinate, 16 to a signed 64-bit number."""
    low = (sig & 15).astype(np.uint64).reshape(len(NIBBLES), -1)
    return (low << _SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _agreement(a: str, b: str) -> Column:
    """Number of equal nibbles of the sketches in the structs ``a`` and ``b``: no less than their equal coordinates."""
    differ = F.lit(0)
    for z in NIBBLES:
        x = F.col(f"{a}.{z}").bitwiseXOR(F.col(f"{b}.{z}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(COORDINATES) - differ


def _size_class(n: str) -> Column:
    return F.floor(F.log(F.col(n)) / math.log(CLASS_RATIO)).cast("int")


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, signature (nulls for an empty set)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig, z = [], [], [], [], []
            for text in batch.column("_text").to_pylist():
                sh = shingles(text, size)
                a, b = _digest(sh) if len(sh) else (None, None)
                n.append(len(sh)), d1.append(a), d2.append(b)
                sig.append(signature(sh) if len(sh) else None)
                z.append(nibbles(sig[-1]) if len(sh) else [None] * len(NIBBLES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, d1, d2)), pa.array(sig, pa.list_(pa.int32())),
                 *(pa.array([x[k] for x in z], pa.int64()) for k in range(len(NIBBLES)))],
                names=["doc_id", "n_shingles", "d1", "d2", "sig", *NIBBLES])

    return map_batches(rows, run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(doc_id, sh)``: the shingle sets of the documents in ``ids(doc_id)``; up to ``SMALL_PAIRS`` ids go to the documents."""
    if ids.limit(SMALL_PAIRS + 1).count() <= SMALL_PAIRS:
        ids = F.broadcast(ids)
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
            .join(ids, "doc_id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["doc_id", "sh"])

    return map_batches(rows, run, "doc_id bigint, sh array<bigint>")


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """``(doc_id, key, b)``: the rarest shared pair values of each class; a key is the pair's number and 58 bits of its values' hash."""
    least = max(1, matches - PAIRS)
    keys = (f"transform(sequence(0, {PAIRS - 1}), c -> shiftleft(cast(c as bigint), {KEY_BITS})"
            f" | shiftrightunsigned(xxhash64(sig[2 * c], sig[2 * c + 1]), {64 - KEY_BITS}))")
    every = classes.select("doc_id", "b", F.explode(F.expr(keys)).alias("key"))
    often = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = every.join(often, "key").repartition("doc_id").dropDuplicates(["doc_id", "key", "b"])  # dealt once, for the window too
    own = Window.partitionBy("doc_id")
    return (shared.withColumn("m", F.count(F.lit(1)).over(own))
            .withColumn("rank", F.row_number().over(own.orderBy("n", "key")))
            .where((F.col("m") >= least) & (F.col("rank") <= F.col("m") - least + 1)).select("doc_id", "key", "b"))


def _pair_bit(key: str = "key") -> Column:
    """The bit of a key's pair in masks."""
    return F.expr(f"shiftleft(1L, cast(shiftright({key}, {KEY_BITS}) as int))")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, small: int = SMALL_PAIRS) -> DataFrame:
    """The ``(x, y)`` whose full sets reach the similarity.

    Up to ``small`` pairs (16 bytes each) go to the sets, so that only sets of
    pairs travel; more are shuffled with them.
    """
    if pairs.limit(small + 1).count() <= small:
        near = F.broadcast(pairs)
        a = sets.select(F.col("doc_id").alias("x"), F.col("sh").alias("a")).join(near, "x")
        b = sets.select(F.col("doc_id").alias("y"), F.col("sh").alias("b")).join(near, "y")
        both = a.join(b, ["x", "y"])
    else:
        a = sets.select(F.col("doc_id").alias("x"), F.col("sh").alias("a"))
        b = sets.select(F.col("doc_id").alias("y"), F.col("sh").alias("b"))
        both = pairs.join(a, "x").join(b, "y")
    low, high = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    both = both.where(100 * low >= percent * high)
    inter = F.size(F.array_intersect("a", "b"))
    return (both.select("x", "y", inter.alias("i"), (F.size("a") + F.size("b")).alias("t"))
            .where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("x", "y").distinct())


def _pivot_pairs(posts: DataFrame, faces: DataFrame, comp: DataFrame, seed: int, matches: int, percent: int) -> DataFrame:
    """Of the pivots of its lists that are in other components, each class's most alike one and one drawn at random.

    The first round has the same pivot in most lists of a group; later ones
    draw one for each list.
    """
    now = posts.select("key", "doc_id").join(_labelled(faces, comp), "doc_id")
    me = F.struct("doc_id", "comp", "n", *NIBBLES)
    draw = F.xxhash64(F.lit(seed), "doc_id") if seed == 0 else F.xxhash64(F.lit(seed), "key", "doc_id")
    pivot = (now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                    F.min(F.struct(draw.alias("draw"), me.alias("p"))).alias("p"))
             .where("lo <> hi").select("key", "p.p"))
    met = now.select("key", me.alias("m")).join(pivot, "key").where("m.comp <> p.comp")
    near = 100 * F.least("m.n", "p.n") >= percent * F.greatest("m.n", "p.n")
    score = F.when(near, _agreement("m", "p")).otherwise(0)
    met = met.select(F.col("m.doc_id").alias("a"), F.col("p.doc_id").alias("y"), score.alias("score"))
    chance = F.xxhash64(F.lit(seed), "y")
    two = met.groupBy("a").agg(F.max(F.struct("score", chance.alias("h"), "y")).alias("best"),
                               F.max(F.when(F.col("score") >= matches, F.struct(chance.alias("h"), "y"))).alias("some"))
    two = two.where(F.col("best.score") >= matches).select("a", F.explode(F.array("best.y", "some.y")).alias("y"))
    return two.select(F.least("a", "y").alias("x"), F.greatest("a", "y").alias("y")).distinct()


def _labelled(faces: DataFrame, comp: DataFrame) -> DataFrame:
    return (faces.join(comp.select(F.col("id").alias("doc_id"), "comp"), "doc_id", "left")
            .withColumn("comp", F.coalesce("comp", "doc_id")))


def _open_windows(posts: DataFrame, faces: DataFrame, comp: DataFrame) -> DataFrame:
    """Windows ``w`` (size classes w - 1 and w) of posting lists that hold more than one component,
    and sets of class w: ``(key, w, doc_id, comp, members)``."""
    now = posts.join(_labelled(faces, comp).select("doc_id", "comp").distinct(), "doc_id")
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    now = now.join(open_, "key").withColumn("w", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    mixed = (now.groupBy("key", "w").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("b").alias("b"),
                                         F.count(F.lit(1)).alias("members"))
             .where("lo <> hi and b = w"))
    return now.drop("b").join(mixed.select("key", "w", "members"), ["key", "w"])


def _merged(lists: DataFrame, share: float = MERGE_SHARE) -> DataFrame:
    """Lists of a window that hold mostly the same members, joined: ``(key, w, doc_id, comp, coords, members)``.

    Every class names the longest list that it is in.  A list goes to the one
    that at least ``share`` of its members name (all, if it is contained in
    it), and stays by itself otherwise.  A list goes as a whole, so two
    classes that met in a list still meet; ``coords`` are the pairs of
    coordinates of the lists that were joined.
    """
    longest = lists.groupBy("w", "doc_id").agg(F.max(F.struct("members", "key")).alias("top"))
    named = lists.join(longest, ["w", "doc_id"]).groupBy("w", "key", "members", F.col("top.key").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    mode = named.groupBy("w", "key", "members").agg(F.max(F.struct("n", "to")).alias("m"))
    home = materialise(mode.select("w", "key", F.when(F.col("m.n") >= share * F.col("members"), F.col("m.to")).otherwise(F.col("key")).alias("to")),
                       "homes")
    # a list may go to one that itself goes on; following once more keeps these together
    further = home.select("w", F.col("key").alias("to"), F.col("to").alias("home"))
    home = home.join(further, ["w", "to"]).select("w", "key", "home")
    moved = lists.drop("members").join(home, ["w", "key"])
    groups = materialise(moved.groupBy("home", "w", "doc_id", "comp").agg(F.bit_or(_pair_bit()).alias("coords")), "groups")
    size = groups.groupBy("home", "w").agg(F.bit_or("coords").alias("coords"), F.count(F.lit(1)).alias("members"))
    return groups.drop("coords").join(size, ["home", "w"]).withColumnRenamed("home", "key")


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal coordinates of the signatures ``a`` (n, K) and ``b`` (m, K)."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _dealt(lists: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """Rows of the lists with their payload, dealt to pairs of blocks and sorted by them.

    Long windows fall into several blocks; each pair of blocks is one group
    of rows, so no task holds more than two blocks at a time.
    """
    most = F.floor(F.lit(BLOCK_BYTES / 8) / F.pow(F.lit(CLASS_RATIO), F.col("w") + 1))
    fits = F.greatest(F.lit(1), F.least(F.lit(block), most))
    rows = lists.join(payload, "doc_id").withColumn("nb", F.ceil(F.col("members") / fits).cast("int"))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumns({"i": F.least("s", "o"), "j": F.greatest("s", "o")}).drop("nb", "o", "members")
    return rows.repartition("key", "w", "i", "j").sortWithinPartitions("key", "w", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one pair of blocks each."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "w", "i", "j")])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and tuple(group[:, lo]) != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = tuple(group[:, lo])
            held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class _Signatures:
    """One group: signatures and what decides which of its pairs are held against each other here."""

    def __init__(self, t: pa.Table, matches: int, percent: int):
        self.ids, self.comp, self.n, self.b = (t.column(c).to_numpy() for c in ("doc_id", "comp", "n", "b"))
        s, i, j = (t.column(c).to_numpy() for c in ("s", "i", "j"))
        self.left, self.right = np.flatnonzero(s == i), np.flatnonzero(s == j)
        self.same = len(self.left) and i[0] == j[0]
        self.w = t.column("w")[0].as_py()
        bits = np.arange(PAIRS, dtype=np.uint64)
        self.own = (t.column("coords").to_numpy()[:1].view(np.uint64) >> bits & np.uint64(1)).astype(bool)
        self.sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.posted = (t.column("mask").to_numpy().view(np.uint64)[:, None] >> bits & np.uint64(1)).astype(bool)
        self.matches, self.percent = matches, percent

    def alike(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different ``label`` that agree in ``matches`` coordinates, a strip of rows at a time."""
        ids, n, b, right = self.ids, self.n, self.b, self.right
        for lo in range(0, len(self.left), 128):
            part = self.left[lo:lo + 128]
            hit = (label[part][:, None] != label[right][None, :]) & (np.maximum(b[part][:, None], b[right][None, :]) == self.w)
            hit &= (100 * np.minimum(n[part][:, None], n[right][None, :])
                    >= self.percent * np.maximum(n[part][:, None], n[right][None, :]))
            if self.same:
                hit &= ids[part][:, None] < ids[right][None, :]
            if not hit.any():
                continue
            hit &= _collisions(self.sig[part], self.sig[right]) >= self.matches
            p, q = np.nonzero(hit)
            p, q = part[p], right[q]
            shared = (self.sig[p] == self.sig[q]).reshape(-1, PAIRS, 2).all(axis=2) & self.posted[p] & self.posted[q]
            first = ~shared.any(axis=1) | self.own[shared.argmax(axis=1)]
            if first.any():
                yield p[first], q[first]


def _alike_members(lists: DataFrame, sigs: DataFrame, matches: int, block: int, percent: int) -> DataFrame:
    """``(key, w, doc_id)`` of the members that have a partner with ``matches`` collisions; their sets are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            group = _Signatures(t, matches, percent)
            found = np.zeros(len(group.ids), bool)
            for p, q in group.alike(group.comp):
                found[p] = found[q] = True
            if found.any():
                some = t.filter(pa.array(found))
                yield pa.RecordBatch.from_arrays([some.column(c).combine_chunks() for c in ("key", "w", "doc_id")], names=["key", "w", "doc_id"])

    return map_batches(_dealt(lists, sigs, block), run, "key bigint, w int, doc_id bigint").distinct()


def _block_links(lists: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, block: int, percent: int) -> DataFrame:
    """Links that join different components within a window of a list.

    Signatures alone tell first which members have a partner at all; only
    their sets travel.  Pairs that agree in ``matches`` coordinates are
    confirmed on their sets, in the window of the larger set's class and a
    list that holds the first pair of coordinates that both posted (sets with mask 0:
    in every list), unless links found before in the same group join them.
    """
    need = materialise(_alike_members(lists, sigs, matches, block, percent), "alike")
    ids = need.select("doc_id").distinct()
    if ids.limit(SMALL_PAIRS + 1).count() <= SMALL_PAIRS:
        ids = F.broadcast(ids)
    rows = _dealt(lists.join(need, ["key", "w", "doc_id"]), sigs.join(sets.join(ids, "doc_id", "left_semi"), "doc_id"), block)

    def links_of(t: pa.Table) -> Iterator[tuple[int, int]]:
        group = _Signatures(t, matches, percent)
        ids = group.ids
        sh = t.column("sh").combine_chunks()
        at, values = sh.offsets.to_numpy(), sh.values.to_numpy().view(np.uint64)
        size = np.diff(at)
        label = group.comp.copy()
        for p, q in group.alike(label):
            for x in np.unique(p).tolist():
                y = q[p == x]
                y = y[label[y] != label[x]]
                if not len(y):
                    continue
                mine, others = values[at[x]:at[x + 1]], np.concatenate([values[at[k]:at[k + 1]] for k in y.tolist()])
                found = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
                inter = np.add.reduceat(found.astype(np.int64), np.cumsum(size[y]) - size[y])
                for k in y[100 * inter >= percent * (len(mine) + size[y] - inter)].tolist():
                    if label[k] != label[x]:
                        label[label == label[k]] = label[x]
                        yield min(ids[x], ids[k]), max(ids[x], ids[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            found = list(links_of(t))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["x", "y"])

    return map_batches(rows, run, "x bigint, y bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked id), kept."""
    sk = materialise(sketches(docs, id_col, text_col, shingle_words), "sketches")
    some = sk.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = some.join(classes, (some.d1 == classes.d1) & (some.d2 == classes.d2) & (some.doc_id == classes.rep)).select(
        "doc_id", F.col("n_shingles").alias("n"), _size_class("n_shingles").alias("b"), "sig", *NIBBLES)
    posts = materialise(postings(reps, matches), "postings")
    masks = materialise(posts.groupBy("doc_id").agg(F.bit_or(_pair_bit()).alias("mask")), "masks")
    sets = materialise(full_sets(docs, masks.select("doc_id"), id_col, text_col, shingle_words), "sets")
    member = some.join(classes, ["d1", "d2"]).select("doc_id", "rep")
    # an id whose rows have different texts ties their classes together
    several = materialise(member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y"), "tied")
    comp = several.select(F.col("x").alias("id"), F.col("x").alias("comp"))
    if not several.isEmpty():
        comp = connected_components(member.join(several.select("doc_id", "x"), "doc_id").select("x", F.col("rep").alias("y")))
    # an id with several texts may have several signatures, so its postings do not tell what a signature posted
    plain = F.when(F.col("x").isNull(), F.col("mask")).otherwise(F.lit(0).cast("bigint"))
    sigs = materialise(reps.join(masks, "doc_id").join(several.select("doc_id", "x"), "doc_id", "left")
                       .withColumn("mask", plain).drop("x").distinct(), "signatures")
    faces = sigs.select("doc_id", "n", *NIBBLES)
    first = 0
    for seed in range(PIVOT_ROUNDS):
        pairs = materialise(_pivot_pairs(posts, faces, comp, seed, matches, percent), "pairs")
        links = materialise(confirmed(pairs, sets, percent), "links")
        found = links.count()
        first = found if seed == 0 else first
        if found:
            before, comp = comp, connected_components(links, comp)
            discard(before)
        discard(links, pairs)
        if found <= ROUND_SHARE * first:
            break
    lists = materialise(_open_windows(posts, faces, comp), "lists")
    links = materialise(_block_links(_merged(lists), sigs, sets, matches, block, percent), "links")
    discard(lists, posts, sets, sigs)
    before, comp = comp, connected_components(links, comp)
    discard(before, links)
    out = (sk.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
           .join(comp.withColumnRenamed("id", "rep"), "rep", "left"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))
