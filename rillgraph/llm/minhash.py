"""MinHash near-duplicates by an inverted index on signature coordinates.

Documents with one set of shingles form a class. Each class is posted under each (coordinate, value) pair of its
signature. Two classes with ``least`` equal coordinates share one of the ``COORDS - least + 1`` rarest postings of
each (prefix), so only those are merged and the longest lists are skipped. Of what the lists bring together equal
coordinates are counted; pairs with enough of them, whose sketch of 1024 one-bit signatures allows the similarity too,
are confirmed on the whole sets.

Lists are first merged as stars around their most central member. Members of one list that are then in different components
are merged in blocks: a task holds two blocks of a list, counts the collisions of the pairs that meet in this list first
and returns the members that have a likely partner, and a second pass over those alone returns links that span
what their whole sets join. So no row is written for a pair, however many pairs of a large group come near the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.operators.skew import split_join
from rillgraph.llm.words import as_bytes, chunks, hash_words, mix
from rillgraph.operators.components import connected_components
from rillgraph.runtime import Scratch

SHINGLE = 5
COORDS = 64
#: Chance that a pair exactly at the similarity asked for has too few equal coordinates.
MISS = 1e-6

_rng = np.random.default_rng(20240613)
_A = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
#: Members of a block of a list: for counting collisions, and for comparing whole sets, which also hold so many shingles at most.
BLOCK, SET_BLOCK, SET_SHINGLES = 4096, 1024, 1 << 21
#: Pairs that are looked at at a time.
PAIRS = 1 << 18
#: One-bit signatures in a sketch; the bit of each least value that is taken.
BITS, BIT = 1024, np.uint32(8)
_C = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A32, _B32 = (_rng.integers(0, 2**32, BITS, dtype=np.uint32) | np.uint32(x) for x in (1, 0))


def least_matches(similarity: float, coords: int = COORDS, miss: float = MISS) -> int:
    """The most equal coordinates that can be asked for, so that a pair at ``similarity`` fails with chance ``miss`` at most."""
    below, t = 0.0, 0
    while below + (p := comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)) <= miss:
        below, t = below + p, t + 1
    return max(1, t)


def most_flips(similarity: float, bits: int = BITS, miss: float = MISS) -> int:
    """The fewest unequal sketch bits that can be allowed; each differs with half the chance that its minimum differs."""
    return bits - least_matches((1 + similarity) / 2, bits, miss)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    with np.errstate(over="ignore"):
        for lo, hi in chunks(texts):
            h, at = hash_words([t.lower() for t in texts[lo:hi]])
            n = max(0, len(h) - SHINGLE + 1)
            joined = mix(sum((h[i : i + n] * _C[i] for i in range(SHINGLE)), np.zeros(n, np.uint64)))
            for a, b in zip(at[:-1], at[1:]):
                if b - a >= SHINGLE:
                    yield np.unique(joined[a : b - SHINGLE + 1])
                elif b > a:
                    yield mix(np.array([np.sum(h[a:b] * _C[: b - a]) + np.uint64(b - a) * _C[SHINGLE]], np.uint64))
                else:
                    yield np.empty(0, np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            out = np.minimum(out, (s[i : i + 2048, None] * _A + _B).min(axis=0))
    return out


def _sketch(s: np.ndarray) -> np.ndarray:
    out, x = np.full(BITS, 2**32 - 1, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            out = np.minimum(out, (x[i : i + 256, None] * _A32 + _B32).min(axis=0))
    return np.packbits((out >> BIT).astype(np.uint8) & 1).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _kernel(with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for lo in range(0, len(whole), 256):
                    batch = whole.slice(lo, 256)
                    sets = list(_sets(as_bytes(batch.column(1))))
                    n = np.array([len(s) for s in sets], np.int64)
                    one = np.array([s.sum() for s in map(mix, sets)], np.uint64).view(np.int64)
                    two = np.array([mix(s ^ _C[0]).sum() for s in sets], np.uint64).view(np.int64)
                    last = {"set": sets} if with_sets else {"sig": [_signature(s) if len(s) else s for s in sets], "bits": [_sketch(s) if len(s) else s for s in sets]}
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), *map(_lists, last.values())], names=["doc_id", "n", "h1", "h2", *last])

    return run


def shingled(df: DataFrame, id_col: str, text_col: str, with_sets: bool) -> DataFrame:
    """(doc_id, n, h1, h2, and set or sig and bits) of every row: n shingles, two hashes of the whole set."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _kernel(with_sets), f"doc_id {kind}, n long, h1 long, h2 long, {'set' if with_sets else 'sig array<long>, bits'} array<long>")


def _alike(na: Column, nb: Column, percent: int) -> Column:
    """Sizes that the similarity allows at all."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether two sketches allow the similarity: their first quarter as generated code, then all of them."""
    flips = lambda i: F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    few = sum((flips(i) for i in range(1, BITS // 256)), flips(0)) <= most_flips(similarity, BITS // 4)
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return few & (F.aggregate(each, F.lit(0), lambda m, x: m + x) <= most_flips(similarity))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates and whose sizes and sketches allow the similarity, with their sizes."""
    side = lambda x: classes.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"), F.col("bits").alias(f"b{x}"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda m, x: m + x)
    # A hub has a pair for each member of its lists, any other class one for each of its postings.
    often = pairs.groupBy("b").agg(F.count("*").alias("n"))
    both = split_join(pairs, often.join(side("b"), "b"), "b", ["a"], pairs.count()).join(side("a"), "a").where(_alike(F.col("na"), F.col("nb"), percent))
    return both.where(_close("ba", "bb", percent / 100)).where(equal >= least).select("a", "b", "na", "nb")


def _with_sets(gids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(gid, set) of the classes ``gids``, shingled anew from the text of one of their documents."""
    used = scratch.keep(gids.select("gid").distinct().join(classes.select("gid", "rep", "h1", "h2"), "gid"))
    texts = docs.join(used.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi")
    sets = shingled(texts, id_col, text_col, True).join(used.select("gid", "h1", "h2"), ["h1", "h2"]).select("gid", "set")
    sets = scratch.keep(sets.dropDuplicates(["gid"]))
    scratch.drop(used)
    return sets


def _confirmed(likely: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    likely = scratch.keep(likely)
    used = likely.select(F.col("a").alias("gid")).distinct().union(likely.select("b").distinct())
    sets = _with_sets(used, classes, docs, id_col, text_col, scratch)
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    out = likely.join(sets.select(F.col("gid").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("gid").alias("b"), F.col("set").alias("xb")), "b")
    out = scratch.keep(out.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"))
    scratch.drop(sets, likely)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, n, low, bits, mask): the low halves of the signature and the sketch as bytes."""
    for batch in (x for x in batches if len(x)):
        sig, bits = (batch.column(i).flatten().to_numpy().reshape(len(batch), -1) for i in (2, 3))
        low, bits = ([x.tobytes() for x in y] for y in (sig.astype(np.uint32), bits))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(low, pa.binary()), pa.array(bits, pa.binary()), batch.column(4)], names=["gid", "n", "low", "bits", "mask"])


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``blocks`` (tok, blocks) lists, in the pairs of blocks (p, q) that they belong to, those of a pair next to each other."""
    at = rows.join(blocks, "tok").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("p"), F.greatest(x, F.col("block")).alias("q")))
    at = at.withColumn("pq", F.explode(pairs)).withColumns({"p": F.col("pq.p"), "q": F.col("pq.q")}).drop("blocks", "pq")
    return at.repartition("tok", "p", "q").sortWithinPartitions("tok", "p", "q")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with one (tok, p, q), with the row after each row's group."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        edge = _edges(now) if len(now) else [0]
        if edge[-1]:
            yield now.slice(0, edge[-1]).combine_chunks(), np.repeat(edge[1:], np.diff(edge))
        rest = now.slice(edge[-1])
    if rest is not None and len(rest):
        edge = np.append(_edges(rest), len(rest))
        yield rest.combine_chunks(), np.repeat(edge[1:], np.diff(edge))


def _edges(t: pa.Table) -> np.ndarray:
    key = np.stack([t.column(c).to_numpy() for c in ("tok", "p", "q")])
    return np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))


def _pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one group, where ``end`` has the row after each row's group; at most about PAIRS at a time."""
    more = np.concatenate([[0], np.cumsum(end - np.arange(len(end)) - 1)])
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(more, more[lo] + PAIRS, "right")) - 1)
        n = np.diff(more[lo : hi + 1])
        i = np.repeat(np.arange(lo, hi), n)
        yield i, np.arange(len(i)) - np.repeat(more[lo:hi] - more[lo], n) + i + 1
        lo = hi


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.chunk(0)
    start, data = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :], flat.buffers()[2]
    width = int(start[1] - start[0]) // np.dtype(kind).itemsize
    return np.frombuffer(data, kind, len(flat) * width, int(start[0])).reshape(len(flat), width)


class _Allowed:
    """Pairs of a table's rows that sizes and sketches allow, of different components and from either block of their group."""

    def __init__(self, t: pa.Table, percent: int) -> None:
        self.n, self.root, self.block = (t.column(c).to_numpy() for c in ("n", "root", "block"))
        self.two = t.column("p").to_numpy() != t.column("q").to_numpy()
        self.bits, self.percent = _matrix(t.column("bits"), np.uint64), percent
        self.few, self.all = most_flips(percent / 100, BITS // 4), most_flips(percent / 100)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.n[i], self.n[j]
        ok = (self.root[i] != self.root[j]) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (~self.two[i] | (self.block[i] != self.block[j]))
        i, j = i[ok], j[ok]
        for words, most in ((BITS // 256, self.few), (BITS // 64, self.all)):
            ok = np.bitwise_count(self.bits[i, :words] ^ self.bits[j, :words]).sum(axis=1, dtype=np.int32) <= most
            i, j = i[ok], j[ok]
        return i, j


def _colliding(percent: int, least: int):
    """(tok, gid) of the members of a list that agree in ``least`` coordinates with one of another component; a pair counts in the first list it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, end in _whole_groups(batches):
            allowed, sig = _Allowed(t, percent), _matrix(t.column("low"), np.uint32)
            mask, k = t.column("mask").to_numpy().view(np.uint64), t.column("k").to_numpy()
            some = np.zeros(len(t), bool)
            for i, j in _pairs(end):
                i, j = allowed(i, j)
                equal = sig[i] == sig[j]
                shared = equal & ((mask[i] & mask[j])[:, None] >> np.arange(COORDS, dtype=np.uint64) & np.uint64(1)).astype(bool)
                ok = (equal.sum(axis=1) >= least) & (shared.argmax(axis=1) == k[i])
                some[i[ok]] = some[j[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[some]) for c in ("tok", "gid")], names=["tok", "gid"])

    return run


def _spanning(percent: int):
    """Links (a, b) that join what the pairs of two blocks with the similarity on whole sets join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, end in _whole_groups(batches):
            allowed, gid = _Allowed(t, percent), t.column("gid").to_numpy()
            lists = t.column("set").chunk(0)
            at, n = np.array(lists.offsets, np.int64) - lists.offsets[0].as_py(), allowed.n
            code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            here, top, found = np.zeros(len(code) + 1, bool), {}, []

            def find(x: int) -> int:
                while (up := top.get(x, x)) != x:
                    top[x] = top.get(up, up)
                    x = up
                return x

            for i, j in _pairs(end):
                i, j = allowed(i, j)
                for lo, hi in zip(*_runs(i)):
                    one, others = i[lo], j[lo:hi]
                    own = find(allowed.root[one])
                    others = others[[find(x) != own for x in allowed.root[others].tolist()]]
                    if not len(others):
                        continue
                    here[code[at[one] : at[one + 1]]] = True
                    both = np.array([here[code[at[x] : at[x + 1]]].sum() for x in others])
                    here[code[at[one] : at[one + 1]]] = False
                    for x in others[100 * both >= percent * (n[one] + n[others] - both)].tolist():
                        a, b = find(allowed.root[one]), find(allowed.root[x])
                        if a != b:
                            top[max(a, b)] = min(a, b)
                            found.append((gid[one], gid[x]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin and end."""
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return edge, np.append(edge[1:], len(x)) if len(x) else edge


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, component_id, kept) for every row of ``df``.

    Documents are linked if 100 * intersection >= percent * union of their sets of five-word shingles (fewer words: the
    whole sequence as one). component_id is the smallest id reachable; kept marks the rows that carry it.
    A pair at the similarity itself is missed with chance ``MISS``.

    Null or blank text: no shingles, linked with nothing. Null id: linked with nothing, component_id null, kept.
    Repeated rows and equal texts share a component. An empty table gives an empty result. Other columns are not read.
    """
    return _grouped(df, id_col, text_col, percent, scratch or Scratch(df.sparkSession)).drop("root")


def _grouped(df: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """The rows of ``near_duplicates`` with ``root``, which names the component by its texts; null for rows linked with nothing.

    Two components have one component_id if they have different texts of one id.
    """
    least = least_matches(percent / 100)
    sigs = scratch.keep(shingled(df, id_col, text_col, False))
    known = sigs.where("n > 0 and doc_id is not null")
    classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = scratch.keep(classes.withColumn("gid", F.monotonically_increasing_id()))

    # Postings, without those that only one class has; the rest by rarity, as far as the prefix goes.
    posts = classes.select("gid", F.posexplode("sig").alias("k", "v")).select("gid", "k", F.xxhash64("k", "v").alias("tok"))
    often = scratch.keep(posts.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1").withColumn("df", F.col("n")))
    mine = split_join(posts, often, "tok", ["gid"], COORDS * classes.count()).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("df", "tok", "k"))).alias("t"))
    left = F.greatest(F.lit(0), F.lit(COORDS - least + 1) - (F.lit(COORDS) - F.size("t")))
    # The most central member of a list is the one whose coordinates are common throughout; logarithms keep a passage that
    # very many others share from deciding that.
    weight = F.aggregate("t", F.lit(0.0), lambda m, x: m + F.log2(x["df"].cast("double")))
    mine = mine.select("gid", weight.alias("weight"), F.slice("t", F.lit(1), left).alias("t")).where(F.size("t") > 0)
    mask = F.aggregate("t", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["k"])))
    mine = scratch.keep(mine.select("gid", "weight", mask.alias("mask"), F.transform("t", lambda x: F.struct(x["tok"].alias("tok"), x["k"].alias("k"))).alias("toks")))
    scratch.drop(often)
    prefix = mine.select("gid", "weight", F.explode("toks").alias("x")).select("gid", "weight", "x.tok", "x.k")

    hubs = prefix.groupBy("tok").agg(F.max_by("gid", F.struct(F.col("weight"), -F.col("gid"))).alias("b"), F.count("*").alias("n")).where("n > 1")
    posted = prefix.count()
    stars = split_join(prefix.select("tok", F.col("gid").alias("a")), hubs, "tok", ["a"], posted).where("a <> b").select("a", "b").distinct()
    stars = scratch.keep(stars)
    links = _confirmed(_likely(stars, classes, percent, least), classes, df, id_col, text_col, percent, scratch)
    roots = scratch.keep(connected_components(links, "a", "b", scratch))

    # What stays apart after the stars: members of one list, but of different components.
    at = scratch.keep(prefix.select("gid", "tok", "k").join(roots.withColumnRenamed("node", "gid"), "gid", "left").select("gid", "tok", "k", F.coalesce("root", "gid").alias("root")))
    split = at.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1")
    split = scratch.keep(split.select("tok", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    facts = classes.select("gid", "n", "sig", "bits").join(mine.select("gid", "mask"), "gid").select("gid", "n", "sig", "bits", "mask").mapInArrow(_packed, "gid long, n long, low binary, bits binary, mask long")
    facts = scratch.keep(facts)
    apart = split_join(at, split.select("tok", "n"), "tok", ["gid"], posted).join(facts, "gid")
    near = scratch.keep(_dealt(apart, split.select("tok", "blocks")).mapInArrow(_colliding(percent, least), "tok long, gid long").distinct())

    own = near.join(at.select("tok", "gid", "root"), ["tok", "gid"]).join(facts.select("gid", "n", "bits"), "gid")
    blocks = own.groupBy("tok").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / SET_SHINGLES)).cast("int").alias("blocks"))
    sets = _with_sets(near, classes, df, id_col, text_col, scratch)
    more = scratch.keep(_dealt(own.join(sets, "gid"), blocks).mapInArrow(_spanning(percent), "a long, b long"))
    roots = scratch.keep(connected_components(links.unionByName(more), "a", "b", scratch))
    scratch.drop(stars, at, split, facts, near, sets, mine)

    owner = classes.join(roots.withColumnRenamed("node", "gid"), "gid", "left").select("h1", "h2", "rep", F.col("members").alias("n"), F.coalesce("root", "gid").alias("root"))
    first = owner.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    owner = split_join(owner.withColumnRenamed("n", "members"), first, "root", ["h1"], classes.count()).select("h1", "h2", "component_id", "root", F.col("members").alias("n"))
    linked = split_join(known.select("doc_id", "n", "h1", "h2").withColumnRenamed("n", "n_shingles"), owner, ["h1", "h2"], ["doc_id"], sigs.count())
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    out = linked.select(*alone.columns).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df``, unchanged, without all but one row of each group of near-duplicates.

    The row with the group's smallest id stays; of several with that id, the one whose text's and columns' hashes are least.
    Rows that share an id but not their text go or stay each by its own text. Rows with a null id and rows without words, which are
    linked with nothing, all stay.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    left = _kept(df.toDF(*names.values()), names[id_col], names[text_col], percent)
    return left.toDF(*df.columns)


def _kept(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    scratch = Scratch(df.sparkSession)
    marked = _grouped(df, id_col, text_col, percent, scratch)
    again = scratch.keep(df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    repeated = bool(again.take(1))
    if repeated:
        marked = scratch.keep(marked)
    out = marked.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    gone = scratch.keep(out)
    if not repeated:
        return df.join(gone, id_col, "left_anti")
    once = df.join(again, id_col, "left_anti").join(gone, id_col, "left_anti")

    # Rows of repeated ids find their text's group by the hashes of its shingles.
    rows = scratch.keep(df.join(again, id_col, "left_semi").withColumn("__row", F.monotonically_increasing_id()))
    texts = shingled(rows, "__row", text_col, False).select(F.col("doc_id").alias("__row"), "n", "h1", "h2")
    own = rows.select("__row", F.col(id_col).alias("doc_id"), F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("h"))
    own = scratch.keep(own.join(texts, "__row"))
    first = marked.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("first")).select("root", "first.*")
    stay = own.where("n > 0").join(first, ["doc_id", "h1", "h2"]).groupBy("root").agg(F.min(F.struct("h", "__row")).alias("m")).select("m.__row")
    stay = stay.unionByName(own.where("n = 0").select("__row"))
    return once.unionByName(rows.join(stay, "__row", "left_semi").drop("__row"))
