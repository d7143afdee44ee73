"""Similarity self-join of texts on word shingles, by vertical partitioning.

1. One pass hashes the distinct shingles of each text, gives each text the
   size and a 128-bit digest of its set, and counts shingles in a table of
   fixed width. Texts of equal sets are one class with an id of its own, so
   repeated rows and ids that have several texts count once for each set.
2. The global order of shingles is (level, hash); the level grows with what
   the count of a shingle's cell has above the usual, so common shingles come
   last. By the threshold, two linked sets share a shingle within the first
   ``n - ceil(t n) + 1`` of each, the prefix. Shingles in the prefixes of
   several classes make buckets.
3. In each bucket one set leads, and every other set is compared with it,
   unless sizes or parities of hash residues already show that they differ too
   much. For that, the global order is cut into fragments, sets are stored as
   one segment per fragment, partial overlaps are counted fragment by fragment
   and summed per pair.
4. Sets linked with a leader are linked among each other through it and leave
   the bucket. By the triangle inequality of Jaccard distance, they cannot be
   linked with a set more than twice the allowed distance away. The others
   choose another leader, up to ``rounds`` times in all, and buckets whose sets
   are joined already are done with.
5. What is left are pairs of sets not joined so far. With one set linked with
   a leader and one at middle distance, their overlap follows from the
   shingles in which each differs from the leader, and the linked set has few.
   Where at most ``FEW`` sets of a bucket are linked with no leader of it, or
   after the last round, these are joined on the prefix and counted in fragments.
6. Connected components of the links, by random contraction.

No step pairs up the members of a group of copies or what is joined already,
and no link between groups is lost. Grouped tables are staged before they are
joined, so that Spark can split a hot key.

Rows: texts without words, empty or null, have size 0 and are linked with
nothing; with fewer words than a shingle, the whole sequence is one shingle;
copies, ties and repeated rows fall into one class; rows of one id with
different texts are texts of their own, each with a row in the result, and are
not linked by their id; a row without an id is its class's, if that has an id,
and else linked with nothing; an empty table gives an empty result; other columns are
ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, byte_slices, list_column, map_arrow, mix64, stage, sum_blobs

#: Cells of the count table and of the pieces in which tasks send it; fragments of rare shingles.
CELLS, PIECE, RARE_FRAGMENTS = 1 << 22, 1 << 16, 4
#: Bits of the table of ids, and bytes of its pieces.
FLAGS, FLAG_PIECE = 1 << 26, 1 << 17
#: Open sets of a bucket up to which they are paired without another leader; four times as many after each round.
FEW = 32
#: What names the set of a row where texts are read again.
KEY = ["doc_id", "one", "two"]
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts)
    with np.errstate(over="ignore"):
        count = max(0, len(words) - size + 1)
        rolled = np.zeros(count, np.uint64)
        for k in range(size):
            rolled += words.hash[k : k + count] * _FACTORS[k]
        rolled = mix64(rolled)
        out = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                x = np.sort(rolled[a : b - size + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
            elif b > a:
                out.append(mix64(np.sum(words.hash[a:b] * _FACTORS[: b - a], keepdims=True) + np.uint64(b - a)))
            else:
                out.append(rolled[:0])
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the digest of each set."""
    with np.errstate(over="ignore"):
        return tuple(np.array([mix64(s ^ seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in (np.uint64(0), _FACTORS[0]))


def _new(ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of the first row of each id and set."""
    return np.sort(np.unique(np.stack([ids, one, two]), axis=1, return_index=True)[1]) if len(ids) else np.zeros(0, np.int64)


def _cells(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(CELLS - 1)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for cells about as full as any, then one more for each doubling of what a cell has above that.

    The bulk of a full table is the same everywhere, so what is above it is the
    count of a common shingle, exact to the scatter of the cells.
    """
    usual = np.median(counts)
    return np.ceil(np.log2(np.maximum((counts - usual) / (8 * np.sqrt(usual) + 48), 1.0))).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, one, two`` and what else ``docs`` has, of each row; ``key, blob``: pieces of the counts of a task."""
    extra = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    names = ["doc_id", "n", "one", "two", *(f.name for f in extra), "key", "blob"]
    kinds = [pa.int64()] * (4 + len(extra)) + [pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(at, n), size)
                one, two = _digests(sets)
                if sets:
                    np.add.at(counts, _cells(np.concatenate(sets)), np.uint32(1))
                others = [batch.column(2 + i).slice(at, n) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), *others, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        for k in range(0, CELLS, PIECE):
            part = counts[k : k + PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in kinds[:-2]), pa.array([k // PIECE], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    return map_arrow(docs, run, ", ".join(f"{name} {'int' if name == 'key' else 'binary' if name == 'blob' else 'long'}" for name in names))


def _ordered(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = level[_cells(s)]
    if own.any():
        order = np.lexsort((s, own))
        return s[order], own[order]
    return s, own


def _prefixes(docs: DataFrame, sets: DataFrame, size: int, percent: int, level) -> DataFrame:
    """``set_id, n, head, parities`` of each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(level.value, np.uint8)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                found = shingle_sets(batch.column(1).slice(at, n), size)
                one, two = _digests(found)
                ids = batch.column(0).slice(at, n)
                keep = [i for i in _new(np.asarray(ids), one, two).tolist() if len(found[i])]
                heads = [_ordered(found[i], table)[0][: prefix_length(len(found[i]), percent)] for i in keep]
                flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(keep, pa.int64())), pa.array(one[keep]), pa.array(two[keep]), list_column(flat, np.array([len(h) for h in heads], np.int64)), pa.array([_parities(found[i]) for i in keep], pa.binary()),
                ], ["doc_id", "one", "two", "head", "parities"])

    found = map_arrow(docs, run, "doc_id long, one long, two long, head array<long>, parities binary")
    return found.join(sets, KEY).groupBy(KEY).agg(*(F.first(c).alias(c) for c in ("set_id", "n", "head", "parities"))).select("set_id", "n", "head", "parities")


def _parities(s: np.ndarray) -> bytes:
    """One bit per residue of the hashes: whether an odd number of shingles has it. One to two bits per shingle."""
    size = 1 << max(6, (max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _within(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb, limit)`` without those that parities show to be more than ``limit`` hundredths apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, limit, x, y = (batch.column(i).to_pylist() for i in range(7))
            keep = [_least_difference(p, q) * (200 - most) <= most * (m + n) for p, q, m, n, most in zip(x, y, na, nb, limit)]
            yield pa.RecordBatch.from_arrays(batch.columns[:5], ["a", "b", "na", "nb", "limit"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(parities.select(F.col("set_id").alias("a"), F.col("parities").alias("x")), "a").join(parities.select(F.col("set_id").alias("b"), F.col("parities").alias("y")), "b")
    return map_arrow(both.select("a", "b", "na", "nb", "limit", "x", "y"), run, "a long, b long, na long, nb long, limit int")


def _flags(ids: DataFrame) -> bytes:
    """A bit for each residue of hashed ids: FLAGS bits for any number of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FLAGS // 8, np.uint8)
        for batch in batches:
            at = _flag(np.asarray(batch.column(0)))
            np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(flags), FLAG_PIECE):
            if flags[k : k + FLAG_PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // FLAG_PIECE], pa.int32()), pa.array([zlib.compress(flags[k : k + FLAG_PIECE].tobytes(), 1)], pa.binary())], ["key", "blob"])

    whole = bytearray(FLAGS // 8)
    pieces = map_arrow(ids.coalesce(32), run, "key int, blob binary")
    for r in sum_blobs(pieces, "uint8", 16, np.bitwise_or).collect():  # FLAGS bits
        whole[r["key"] * FLAG_PIECE : (r["key"] + 1) * FLAG_PIECE] = zlib.decompress(r["blob"])
    return bytes(whole)


def _flag(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(FLAGS - 1)).astype(np.int64)


def _segments(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, level) -> DataFrame:
    """``set_id, fragment, segment`` of the sets in ``pairs(a, b)``.

    A table of flags, of fixed size, lets the scan skip most other texts, so
    that sets are moved and texts are not. Beyond a quarter as many ids as
    flags, texts are joined first.
    """
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = stage(sets.join(ids, "set_id", "left_semi").select("set_id", *KEY), "wanted")
    flags = None
    if wanted.count() * 4 <= FLAGS:
        flags = docs.sparkSession.sparkContext.broadcast(_flags(wanted.select("doc_id")))
    else:
        docs = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(level.value, np.uint8)
        bits = np.uint64(64 - (RARE_FRAGMENTS - 1).bit_length())
        marked = np.frombuffer(flags.value, np.uint8) if flags else None
        for batch in batches:
            if flags:
                at = _flag(np.asarray(batch.column(0)))
                batch = batch.filter(pa.array(marked[at >> 3] >> (at & 7) & 1).cast(pa.bool_()))
            for at, n in byte_slices(batch.column(1)):
                found = shingle_sets(batch.column(1).slice(at, n), size)
                one, two = _digests(found)
                ids = batch.column(0).slice(at, n)
                keep = _new(np.asarray(ids), one, two)
                flat = np.concatenate([found[i] for i in keep.tolist()]) if len(keep) else np.zeros(0, np.uint64)
                fragment = np.where(table[_cells(flat)] > 0, RARE_FRAGMENTS, (flat >> bits).astype(np.int64))
                group = np.repeat(np.arange(len(keep)), [len(found[i]) for i in keep.tolist()]) * (RARE_FRAGMENTS + 1) + fragment
                many = np.bincount(group, minlength=len(keep) * (RARE_FRAGMENTS + 1))
                segments = list_column(flat[np.argsort(group, kind="stable")].view(np.int64), many)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(keep)), pa.array(one[keep]), pa.array(two[keep]), list_column(segments, np.full(len(keep), RARE_FRAGMENTS + 1)),
                ], [*KEY, "segments"])

    found = map_arrow(docs, run, "doc_id long, one long, two long, segments array<array<long>>")
    once = found.join(wanted, KEY).groupBy(KEY).agg(F.first("set_id").alias("set_id"), F.first("segments").alias("segments"))
    return once.select("set_id", F.posexplode("segments").alias("fragment", "segment")).where(F.size("segment") > 0)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``id, component``: the smallest id that each id reaches.

    Each round moves every vertex to the neighbour of least hash, itself
    included, and the edges with it, until no edge is left. By random hashes a
    constant part of the vertices goes in a round, long chains included.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    e = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("label", F.col("id"))
    moves = 0
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), "m")["id"].alias("to"))
        to = stage(to, "moves")
        labels = labels.join(to, labels["label"] == to["a"], "left").select("id", F.coalesce("to", "label").alias("label"))
        moves += 1
        if moves % 4 == 0:
            labels = stage(labels, "labels")
        moved = e.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        e = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    labels = stage(labels, "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(id, component)`` after ``edges(a, b)`` have joined some of them; ids without links have no row."""
    end = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    mapped = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = stage(components(mapped), "components")
    moved = labels.join(found.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return stage(moved.union(found.join(labels.select("id"), "id", "left_anti")), "components")


def _component(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``df`` with the component of ``column``."""
    return df.join(labels.select(F.col("id").alias(column), "component"), column, "left").withColumn("component", F.coalesce("component", column))


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb, limit)`` with the segments of both sets, a row for each fragment that either has."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("segment").alias("sa"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("segment").alias("sb"))
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(RARE_FRAGMENTS))))
    none = F.array().cast("array<long>")
    both = each.join(left, ["a", "fragment"], "left").join(right, ["b", "fragment"], "left")
    return both.select("a", "b", "na", "nb", "limit", "fragment", F.coalesce("sa", none).alias("sa"), F.coalesce("sb", none).alias("sb"))


def links(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(classes, edges) of ``docs(doc_id, text)``.

    ``classes(doc_id, n, set_id, first_id)`` has every row, with the id of its
    set (null without words) and the smallest ``doc_id`` of its copies;
    ``edges(a, b)`` has links between set ids that join whatever is linked.
    ``rounds`` is the number of leaders that a bucket has before what is left
    in it is paired; it changes how much is compared, not what is found.
    """
    classes, edges, _ = _join(docs, size, percent, rounds)
    return classes, edges


def _join(docs: DataFrame, size: int, percent: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, edges, labels): ``labels(id, component)`` has the sets with links; ``classes`` carries columns ``h1`` and ``h2`` along."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in ("h1", "h2") if c in docs.columns]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    described = stage(_describe(docs, size), "described")
    rows = described.where("key is null").select("doc_id", "n", "one", "two", *extra)
    sets = rows.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("doc_id"))
    sets = stage(sets.select(F.monotonically_increasing_id().alias("set_id"), "n", *KEY), "sets")
    same = sets.select("n", "one", "two", "set_id", F.col("doc_id").alias("first_id"))
    classes = stage(rows.join(same, ["n", "one", "two"], "left").select("doc_id", "n", "set_id", F.coalesce("first_id", "doc_id").alias("first_id"), *extra), "classes")

    counts = np.zeros(CELLS, np.uint64)
    for r in sum_blobs(described.where("key is not null").select("key", "blob"), "uint32", min(parts, CELLS // PIECE), total="uint64").collect():
        counts[r["key"] * PIECE : (r["key"] + 1) * PIECE] = np.frombuffer(zlib.decompress(r["blob"]), np.uint64)  # CELLS counts for any corpus
    level = spark.sparkContext.broadcast(levels(counts.astype(np.float64)).tobytes())

    docs = docs.where("doc_id is not null").select("doc_id", "text")  # a set is read again under an id; without any, it has no links
    heads = stage(_prefixes(docs, sets, size, percent, level), "prefixes")
    parities = heads.select("set_id", "parities")
    tokens = heads.select("set_id", "n", F.posexplode("head").alias("pos", "token"))
    several = stage(tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "several")
    members = stage(tokens.join(several, "token").select("token", "set_id", "n", "pos", F.lit(True).alias("open"), F.lit(True).alias("many"), F.col("set_id").alias("component")), "members")

    far = 200 - 2 * percent  # twice the allowed distance, in hundredths
    labels = compared = parted = None
    rest: list[DataFrame] = []
    for k in range(rounds + 1):
        led = _lead(members.where("many") if k < rounds else members.where(F.lit(False)), k)
        pairs = led.where("set_id <> leader").select(F.col("set_id").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("n_leader").alias("nb"), F.lit(far).alias("limit"))
        pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * (100 - far))
        if k:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti").union(_pairs(members.where("not many") if k < rounds else members, percent))
        pairs = stage(_within(pairs.groupBy("a", "b", "na", "nb").agg(F.max("limit").alias("limit")), parities), "alike")
        new_parted = stage(_parted(pairs, stage(_segments(docs, sets, pairs, size, level), "segments"), far), "parted")
        new = stage(_compared(new_parted, percent, far), "compared")
        compared, parted = (compared.union(new), parted.union(new_parted)) if k else (new, new_parted)
        star = new.where("relation = 0").select("a", "b")
        if k and (k == rounds or members.where("many").isEmpty()):
            rest.append(star)
            break
        labels = _merged(labels, star) if k else stage(components(star), "components")
        members = stage(_left(led, compared, labels, FEW << 2 * k), "members")
        if members.isEmpty():
            break

    rest.append(stage(_around(compared, parted, labels, percent), "around"))
    rest = reduce(DataFrame.union, rest)
    return classes, compared.where("relation = 0").select("a", "b").union(rest).distinct(), _merged(labels, rest)


def _lead(members: DataFrame, k: int) -> DataFrame:
    """``members`` with a leader for each token: first the set nearest the start of its order, then any open one."""
    order = [F.col("pos"), F.col("n"), F.col("set_id")] if k == 0 else [F.xxhash64("set_id", F.lit(k)), F.col("set_id"), F.col("n")]
    best = members.where("open").groupBy("token").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("set_id").alias("leader"), F.col("n").alias("n_leader"))).alias("lead"))
    return members.join(stage(best.select("token", "lead.leader", "lead.n_leader"), "leaders"), "token")


def _left(led: DataFrame, compared: DataFrame, labels: DataFrame, few: int) -> DataFrame:
    """What is left of the buckets for another leader.

    The leader and what is linked with it are closed: their links with the
    others are decided, or left to ``_around`` if the other is at middle
    distance. Closed sets stay beside such others, as another leader may join
    them. Buckets without two sets in different components are done with, and
    those with at most ``few`` open sets need no leader.
    """
    relation = compared.select(F.col("a").alias("set_id"), F.col("b").alias("leader"), "relation").distinct()
    after = led.where("set_id <> leader").join(relation, ["set_id", "leader"], "left").withColumn("relation", F.coalesce("relation", F.lit(2)))
    after = _component(after.select("token", "set_id", "n", "pos", "relation", (F.col("open") & (F.col("relation") > 0)).alias("open")), labels, "set_id")
    own = F.when(F.col("open"), F.col("component"))
    state = after.groupBy("token").agg(
        F.count(own).alias("n_open"), F.coalesce(F.bool_or(F.col("open") & (F.col("relation") == 1)), F.lit(False)).alias("some_mid"),
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min(own).alias("o0"), F.max(own).alias("o1"),
    )
    state = state.where("n_open > 1 and o0 <> o1 or n_open > 0 and some_mid and c0 <> c1").select("token", "some_mid", (F.col("n_open") > few).alias("many"))
    return after.join(stage(state, "state"), "token").where("open or some_mid and many").select("token", "set_id", "n", "pos", "open", "many", "component")


def _linked(common: Column, na: Column, nb: Column, percent: int) -> Column:
    return common * 100 >= (na + nb - common) * percent


def _parted(pairs: DataFrame, segments: DataFrame, far: int) -> DataFrame:
    """``a, b, na, nb, limit, fragment, common, differ``: the partial overlap in each fragment, and what differs unless it is too much."""
    differ = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    differ = F.when(F.size(differ) * (200 - far) <= (F.col("na") + F.col("nb")) * far, differ)
    return _overlaps(pairs, segments).select("a", "b", "na", "nb", "limit", "fragment", F.size(F.array_intersect("sa", "sb")).alias("common"), differ.alias("differ"))


def _compared(parted: DataFrame, percent: int, far: int) -> DataFrame:
    """``a, b, na, nb, d, relation`` of the pairs: 0 linked, 1 at middle distance from a leader; ``d`` shingles differ."""
    total = parted.groupBy("a", "b", "na", "nb", "limit").agg(F.sum("common").alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    close = ((union - F.col("common")) * 100 <= union * far) & ((F.col("limit") == far) | _linked(F.col("common"), F.col("na"), F.col("nb"), percent))
    relation = F.when(_linked(F.col("common"), F.col("na"), F.col("nb"), percent), 0).otherwise(1)
    return total.where(close).select("a", "b", "na", "nb", (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("d"), relation.alias("relation"))


def _around(compared: DataFrame, parted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between a set linked with a leader and a set at middle distance from it, where nothing joins them so far.

    With ``d`` shingles in which a set differs from the leader, two sets differ
    in ``d + d' - 2 c`` where ``c`` of those are the same. As ``d'`` alone is
    too much, they share one, and the first shared in order of rarity leaves
    room for the ``c`` needed.
    """
    undecided = lambda: [F.max("relation").alias("r1"), F.min("relation").alias("r0"), F.min("component").alias("c0"), F.max("component").alias("c1")]
    open_ = "r1 = 1 and r0 = 0 and c0 <> c1"
    ring = _component(compared.select("a", "b", "na", "d", "relation"), labels, "a")
    ring = ring.join(stage(ring.groupBy("b").agg(*undecided()).where(open_).select("b"), "undecided"), "b", "left_semi")
    tokens = stage(ring.join(parted.select("a", "b", F.explode("differ").alias("token")), ["a", "b"]), "ring-tokens")
    often = tokens.groupBy("b", "token").agg(F.count("*").alias("m"), *undecided()).where(open_).select("b", "token", "m")
    shared = tokens.join(stage(often, "often"), ["b", "token"])
    # shingles that nothing undecided shares need no row: the place counts the others
    per_set = Window.partitionBy("a", "b").orderBy("m", "token")
    shared = shared.withColumns({"place": F.row_number().over(per_set), "many": F.count("*").over(Window.partitionBy("a", "b"))}).withColumn("rest", F.col("many") - F.col("place") + 1)
    rows = stage(shared.select("b", "token", "a", "na", "d", "relation", "component", "rest"), "differing")
    x, y = rows.where("relation = 0").alias("x"), rows.where("relation = 1").alias("y")
    allowed = (F.col("x.na") + F.col("y.na")) * (100 - percent)  # differing * (100 + percent) may reach this
    room = F.least("x.rest", "y.rest")
    fits = (F.col("x.d") + F.col("y.d") - 2 * room) * (100 + percent) <= allowed
    pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & fits)
    candidates = stage(pairs.select(F.col("x.b").alias("leader"), F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.na").alias("na"), F.col("y.na").alias("nb"), F.col("x.d").alias("da"), F.col("y.d").alias("db")).distinct(), "candidates")
    own = rows.groupBy(F.col("b").alias("leader"), "a").agg(F.collect_list("token").alias("ta"))
    counted = candidates.join(own, ["leader", "a"]).join(own.select("leader", F.col("a").alias("b"), F.col("ta").alias("tb")), ["leader", "b"]).withColumn("c", F.size(F.array_intersect("ta", "tb")))
    differing = F.col("da") + F.col("db") - 2 * F.col("c")
    return counted.where(differing * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of open sets of a bucket that nothing joins so far and that may be linked."""
    rest = members.where("open")
    x, y = rest.alias("x"), rest.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    room = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    fits = _linked(room, nx, ny, percent) & (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.component") != F.col("y.component")) & fits)
    return pairs.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), nx.alias("na"), ny.alias("nb"), F.lit(100 - percent).alias("limit"))


def _grouped(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``classes`` that have words, and ``group``, the set that stands for all that links join."""
    found = labels.select(F.col("id").alias("set_id"), F.col("component").alias("joined"))
    return classes.where("set_id is not null").join(found, "set_id", "left").withColumn("group", F.coalesce("joined", "set_id")).drop("joined")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_shingles, component_id``: the smallest id that links reach."""
    classes, _, labels = _join(docs, size, percent, rounds)
    least = stage(_grouped(classes, labels).groupBy("group").agg(F.min("first_id").alias("component_id")), "least")
    linked = labels.join(least, labels["component"] == least["group"]).select(F.col("id").alias("set_id"), "component_id")
    return classes.join(linked, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that links join with a row of smaller id.

    Of rows with one id, the text of least hash comes first, and of rows equal
    in id and text one stays. Rows without an id or without words stay.
    """
    hashes = lambda text: [F.xxhash64(text), F.xxhash64(F.lit(7), text)]
    marked = docs.select("doc_id", "text", *(h.alias(name) for h, name in zip(hashes("text"), ("h1", "h2"))))
    classes, _, labels = _join(marked, size, percent, rounds)
    row = F.struct("doc_id", "h1", "h2")
    grouped = _grouped(classes, labels).where("doc_id is not null")
    rows = stage(grouped.groupBy("group", row.alias("row")).agg(F.count("*").alias("times")), "group-rows")
    first = stage(rows.groupBy("group").agg(F.min("row").alias("first")), "first-rows")
    rows = stage(rows.join(first, "group").where("row <> first or times > 1").select("row.*", (F.col("row") != F.col("first")).alias("goes")), "marked-rows")
    one, two = hashes("text")
    of = lambda d, r: (d["doc_id"].cast("long") == r["doc_id"]) & (one == r["h1"]) & (two == r["h2"])
    gone, twice = rows.where("goes"), rows.where("not goes")
    left = docs.join(gone, of(docs, gone), "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, of(left, twice), "left_anti").union(left.join(twice, of(left, twice), "left_semi").dropDuplicates(["doc_id", "text"]))
