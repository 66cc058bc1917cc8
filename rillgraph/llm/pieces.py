"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words, a run of spaces and what follows it, as no piece reaches from other characters into a space.
The distinct words are exploded into substrings no longer than the longest piece; an equi-join with the piece table leaves the edges
of each word's lattice, which are grouped by word and folded by a higher-order aggregate:

* for a unigram model by Viterbi: the best score of a path to each character, over the edges in the order of their ends;
* for a BPE model by merging: edges in the order of score and place, each joining its two parts if both stand there just then.
  This gives the model's own encoding because a piece is always made of better pieces. Viterbi would not: the scores of such
  a model are merge ranks, whose sums mean nothing.

Characters without a piece become their bytes' pieces. The lattice is built for the ``COMMON`` most frequent words of the corpus, a
bounded table that every task can hold; a kernel puts the texts' ids together and encodes the rest of the words, which are
mostly met once, by the same two rules on the same piece table: for a BPE model all new words of a few megabytes of text at a
time, as columns of arrays. README.md has the figures of joining all words instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.runtime import Scratch

SPACE = "▁"
#: Words of the common table, and how long they may be.
COMMON, LONGEST = 65_536, 64
#: Bytes of text that a kernel takes at a time, and numbers that it gathers at a time.
CHUNK, GATHER = 1 << 22, 1 << 20
#: Words are merged together with others of up to the same one of these lengths.
WIDTHS = (4, 8, 12, 16, 24, 32, LONGEST)


@dataclass(frozen=True)
class Model:
    """kind: bpe or unigram; pieces: (piece, id, score) of ordinary pieces; bytes: ids of the 256 byte pieces; dummy: a space is put in front."""

    kind: str
    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    unknown: int
    dummy: bool = True


def load(path: str | None = None) -> Model:
    """The model at ``path``, by default the public 32k BPE."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
    raw = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    kind = {pb.TrainerSpec.BPE: "bpe", pb.TrainerSpec.UNIGRAM: "unigram"}[proto.trainer_spec.model_type]
    return Model(kind, normal, [raw.get(b, proto.trainer_spec.unk_id) for b in range(256)], proto.trainer_spec.unk_id, proto.normalizer_spec.add_dummy_prefix)


def _cut(texts: pa.Array, model: Model) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, with their spaces marked, and where each text's words begin (one more entry than texts)."""
    plain = np.zeros(len(texts), bool)
    if model.dummy:
        # One space between words and none in front: each word is a space and a part.
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        plain = ~odd.to_numpy(zero_copy_only=False)
    split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    other = pa.array([_marked(t, split, model) for t in texts.filter(pa.array(~plain)).to_pylist()], pa.list_(pa.string()))
    lists = pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(plain)), " "), other])
    if len(other):
        lists = lists.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"))))
    words = lists.flatten().dictionary_encode()
    if model.dummy:
        words = pa.DictionaryArray.from_arrays(words.indices, pc.binary_join_element_wise(SPACE, words.dictionary, ""))
    return words, lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def _marked(text: str, split: re.Pattern, model: Model) -> list[str]:
    """The words of one text; without their first mark where the model puts a space in front, as all have one there."""
    found = split.findall((SPACE if model.dummy else "") + text.replace(" ", SPACE)) if text else []
    return [w[1:] for w in found] if model.dummy else found


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of about ``CHUNK`` bytes of text, one row at least, and their last column as texts."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.string()).fill_null("")
        ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while lo < len(texts):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            lo = hi


def _count(model: Model):
    """Texts to (word, n), summed within each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            words, _ = _cut(texts, model)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["word", "n"])

    return run


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] for each entry, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    lo = done = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, done + GATHER, "right")))
        last = int(ends[hi - 1])
        shift = start[lo:hi] - (ends[lo:hi] - size[lo:hi])
        out[done:last] = flat[np.repeat(shift, size[lo:hi]) + np.arange(done, last)]
        lo, done = hi, last
    return out


def _merged(edges: Column, size: Column) -> Column:
    """Ends of the segments, by merging: state is, for each character, the end of the segment that starts there, or 0."""
    start = F.transform(F.sequence(F.lit(1), size), lambda i: i)

    def step(ends: Column, e: Column) -> Column:
        first = F.get(ends, e["start"])
        second = F.get(ends, first)
        fits = (first > 0) & (first < e["end"]) & (second == e["end"])
        return F.when(fits, F.transform(ends, lambda x, i: F.when(i == e["start"], e["end"]).when(i == first, F.lit(0)).otherwise(x))).otherwise(ends)

    ends = F.aggregate(F.filter(edges, lambda e: e["end"] - e["start"] > 1), start, step)
    return F.filter(F.transform(ends, lambda x, i: F.struct(i.alias("start"), x.alias("end"))), lambda x: x["end"] > 0)


def _viterbi(edges: Column, size: Column, least: float) -> Column:
    """Segments of the best path: state is, for each place, the best score so far and where its last piece starts."""
    none = F.struct(F.lit(float("-inf")).alias("score"), F.lit(-1).alias("from"))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"))
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, zero).otherwise(none))
    # Every character also has an edge as an unknown one, worse than any piece.
    whole = F.concat(edges, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct((i + 1).alias("end"), F.lit(least - 10.0).alias("score"), i.alias("start"), F.lit(-1).alias("id"))))

    def step(best: Column, e: Column) -> Column:
        here = F.get(best, e["start"])["score"] + e["score"]
        return F.when(here > F.get(best, e["end"])["score"], F.transform(best, lambda x, i: F.when(i == e["end"], F.struct(here.alias("score"), e["start"].alias("from"))).otherwise(x))).otherwise(best)

    best = F.aggregate(F.array_sort(whole), start, step)
    back = F.struct(size.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def walk(acc: Column, _: Column) -> Column:
        prior = F.get(best, acc["at"])["from"]
        more = F.struct(prior.alias("at"), F.concat(F.array(F.struct(prior.alias("start"), acc["at"].alias("end"))), acc["out"]).alias("out"))
        return F.when(acc["at"] > 0, more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), size), back, walk, lambda acc: acc["out"])


def lexicon(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for each row of ``words`` (word, distinct and not empty)."""
    spark = words.sparkSession
    table = spark.createDataFrame(model.pieces, "piece string, id int, score double")
    longest, least = max(len(p) for p, _, _ in model.pieces), min(s for _, _, s in model.pieces)
    n = F.length("word")
    spots = words.select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    parts = spots.select("word", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))).alias("size"))
    parts = parts.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("size")))
    # The piece table is as large as the model, tens of thousands of rows.
    edges = parts.join(F.broadcast(table), "piece").select("word", F.struct((F.col("start") + F.col("size")).alias("end"), "score", "start", "id").alias("e"))
    lattice = edges.groupBy("word").agg(F.collect_list("e").alias("edges"))
    # A word of characters without pieces has no edges.
    lattice = words.join(lattice, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast(lattice.schema["edges"].dataType)))
    if model.kind == "bpe":
        ranked = F.array_sort(F.transform("edges", lambda e: F.struct((-e["score"]).alias("rank"), e["start"].alias("start"), e["end"].alias("end"))))
        path = _merged(ranked, n)
    else:
        path = _viterbi(F.col("edges"), n, least)
    raw = F.array(*map(F.lit, model.bytes))

    def ids(s: Column) -> Column:
        known = F.filter("edges", lambda e: (e["start"] == s["start"]) & (e["end"] == s["end"]))
        digits = F.hex(F.encode(F.substring(F.col("word"), s["start"] + 1, s["end"] - s["start"]), "UTF-8"))
        spelt = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.get(raw, F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(known) > 0, F.array(F.get(known, F.lit(0))["id"])).otherwise(spelt)

    return lattice.withColumn("path", path).select("word", F.flatten(F.transform("path", ids)).alias("ids"))


def by_merging(word: str, rank: dict[str, float]) -> list[str]:
    """Segments of one word: the best pair of neighbours that is a piece is joined, the first of equals, until none is."""
    parts = list(word)
    if len(parts) <= LONGEST:
        get = rank.get
        pairs = [get(a + b, inf) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != inf:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], inf)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], inf)
        return parts
    after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
    heap = [(rank[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
    heapify(heap)
    while heap:
        _, i, p = heappop(heap)
        j = after[i] if parts[i] else -1
        if j < 0 or parts[i] + parts[j] != p:
            continue
        parts[i], parts[j], after[i] = p, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (q := parts[x] + parts[y]) in rank:
                heappush(heap, (rank[q], x, q))
    return [p for p in parts if p]


class Merger:
    """``by_merging`` for many words at once. A piece's number is its place in the order of scores, which must differ."""

    #: Multiplier that scatters keys over the table of pairs, and what stands for no pair.
    SCATTER, NONE = np.uint64(0x9E3779B97F4A7C15), np.int32(2**31 - 1)

    def __init__(self, model: Model) -> None:
        order = sorted(model.pieces, key=lambda p: -p[2])
        self.edge = len(order)
        self.ids = np.array([i for _, i, _ in order], np.int32)
        self.bytes = model.bytes
        number = {p: k for k, (p, _, _) in enumerate(order)}
        self.chars = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.chars[ord(p)] = k
        pairs = {number[a] * (self.edge + 1) + number[b]: k for p, k in number.items() for i in range(1, len(p)) if (a := p[:i]) in number and (b := p[i:]) in number}
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift, self.keys, self.made = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        key, made = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._place(key)
        while len(key):
            # Of keys that want one free slot, the last written stays; the others go one on.
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]
            placed = self.keys[at] == key
            self.made[at[placed]] = made[placed]
            key, made, at = key[~placed], made[~placed], (at[~placed] + 1) % len(self.keys)

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * self.SCATTER) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that pairs make, or NONE."""
        key = np.minimum(a, self.edge).astype(np.int64) * (self.edge + 1) + np.minimum(b, self.edge)
        at = self._place(key)
        there = self.keys[at]
        out = np.where(there == key, self.made[at], self.NONE)
        left = np.flatnonzero((there != key) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            there = self.keys[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.made[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, where each word's begin and how many; -1 for words that are too long for it."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(length) - length
        start, n = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        symbols = self.chars[codes]
        # Characters that are no piece are numbered after the edge and become their bytes.
        strange = np.flatnonzero(symbols < 0)
        extra, which = np.unique(codes[strange], return_inverse=True)
        symbols[strange] = self.edge + 1 + which
        spelt = [[self.bytes[b] for b in chr(c).encode()] for c in extra]
        flat = np.concatenate([self.ids, np.array([i for x in spelt for i in x], np.int32)])
        each = np.array([1] * self.edge + [0] + [len(x) for x in spelt], np.int64)
        out, done, lower = [np.empty(0, np.int32)], 0, 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > lower) & (length <= width))
            lower = width
            if not len(rows):
                continue
            grid = np.full((width + 2, len(rows)), self.edge, np.int32)
            for i in range(width):
                has = length[rows] > i
                grid[i + 1, has] = symbols[first[rows[has]] + i]
            grid = self._reduce(grid).T
            n[rows] = each[grid].sum(axis=1)
            start[rows] = done + np.cumsum(n[rows]) - n[rows]
            kept = grid[grid != self.edge]
            out.append(_gather(flat, (np.cumsum(each) - each)[kept], each[kept]))
            done += len(out[-1])
        return np.concatenate(out), start, n

    def _reduce(self, grid: np.ndarray) -> np.ndarray:
        """Merged columns of symbols, each with an edge above and below; cells whose symbol went into the one before become edges.

        In every round each column's best pair is merged, the first of equals; columns without one are set aside.
        """
        result, columns, height = grid, np.arange(grid.shape[1]), len(grid)
        after = np.repeat(np.arange(1, height + 1, dtype=np.int32)[:, None], grid.shape[1], 1)
        before = after - 2
        made = np.full(grid.shape, self.NONE, np.int32)
        made[:-1] = self.pair(grid[:-1].ravel(), grid[1:].ravel()).reshape(height - 1, -1)
        while True:
            best = made.min(axis=0)
            goes_on = best != self.NONE
            if goes_on.mean() < 0.75 if len(goes_on) else True:
                result[:, columns[~goes_on]] = grid[:, ~goes_on]
                columns, grid, after, before, made, best = columns[goes_on], grid[:, goes_on], after[:, goes_on], before[:, goes_on], made[:, goes_on], best[goes_on]
                if not len(columns):
                    return result
                goes_on = np.ones(len(columns), bool)
            c = np.flatnonzero(goes_on)
            i = (made == best).argmax(axis=0)[c]
            j = after[i, c]
            k, h = after[j, c], before[i, c]
            grid[i, c], grid[j, c], made[j, c] = best[c], self.edge, self.NONE
            after[i, c], before[k, c] = k, i
            made[h, c], made[i, c] = self.pair(grid[h, c], best[c]), self.pair(best[c], grid[k, c])


def by_viterbi(word: str, score: dict[str, float], longest: int, least: float) -> list[str]:
    """Segments of the best path; characters that are no piece cost more than any."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = (least - 10.0 + best[end - 1][0], end - 1)
        for start in range(max(0, end - longest), end):
            if (s := score.get(word[start:end])) is not None and s + best[start][0] > found[0]:
                found = (s + best[start][0], start)
        best.append(found)
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def _assemble(model: Model, shared):
    """Texts to lists of ids; ``shared`` is a broadcast of the common words, their ids in one array with starts and sizes, and a Merger or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_ids, common_start, common_size, merger = shared.value
        ids = {p: i for p, i, _ in model.pieces}
        if model.kind == "bpe":
            rank = {p: -s for p, _, s in model.pieces}
            cut = lambda w: by_merging(w, rank)
        else:
            score, longest, least = {p: s for p, _, s in model.pieces}, max(len(p) for p, _, _ in model.pieces), min(s for _, _, s in model.pieces)
            cut = lambda w: by_viterbi(w, score, longest, least)
        for batch, texts in _chunks(batches):
            words, ends = _cut(texts, model)
            place = pc.index_in(words.dictionary, value_set=common)
            new = np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
            place = place.fill_null(0).to_numpy()
            start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            if len(common):
                start, size = common_start[place], common_size[place]
            rest = words.dictionary.take(pa.array(new)).to_pylist()
            if merger:
                flat, at, n = merger.merge(rest)
            else:
                flat, at, n = np.empty(0, np.int32), np.zeros(len(rest), np.int64), np.full(len(rest), -1, np.int64)
            slow, done = [], len(flat)
            for i in np.flatnonzero(n < 0):
                found = [x for p in cut(rest[i]) for x in ([ids[p]] if p in ids else [model.bytes[b] for b in p.encode()])]
                at[i], n[i] = done, len(found)
                slow += found
                done += len(found)
            start[new], size[new] = len(common_ids) + at, n
            flat = np.concatenate([common_ids, flat, np.array(slow, np.int32)])
            of = words.indices.to_numpy()
            size = size[of]
            ends = np.concatenate([[0], np.cumsum(size)])[ends]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_gather(flat, start[of], size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])

    return run


def encode(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The columns ``carry`` (none if None) of every row with ``ids``, the piece ids of its text, and with ``decoded``,
    the text that those give, by the kernel of ``decode`` in the same worker, if that is asked for.

    Null text counts as empty and has no ids. Repeated rows are encoded each; an empty table gives an empty result; a
    carried column named ids or decoded is replaced. The driver holds the common words' ids, COMMON of them at most, and broadcasts them with
    the model's pairs of pieces.
    """
    carry = [c for c in carry or [] if c.lower() not in ("ids", "decoded")]
    counts = df.select(F.col(text_col).cast("string")).mapInArrow(_count(model), "word string, n long").where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "word").limit(COMMON).select("word")
    common = lexicon(Scratch(df.sparkSession).keep(frequent), model).collect()
    size = np.array([len(r.ids) for r in common], np.int64)
    flat = np.array([i for r in common for i in r.ids], np.int32)
    merger = Merger(model) if model.kind == "bpe" and len({s for _, _, s in model.pieces}) == len(model.pieces) else None
    run = _assemble(model, df.sparkSession.sparkContext.broadcast((pa.array([r.word for r in common], pa.string()), flat, np.cumsum(size) - size, size, merger)))
    names = [f"c{i}" for i in range(len(carry))]
    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry))
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(text_col).cast("string").alias("text"))
    if not decoded:
        return rows.mapInArrow(run, f"{kinds}ids array<int>").select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "ids")
    spell = _spell(model)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = (pa.RecordBatch.from_arrays([*b.columns, b.column(b.num_columns - 1)], names=[*b.schema.names, "again"]) for b in run(batches))
        return spell(twice)

    out = rows.mapInArrow(both, f"{kinds}ids array<int>, decoded string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "ids", "decoded")


def _spell(model: Model):
    """The last column, lists of ids, to texts."""
    spelt = {i: p.replace(SPACE, " ").encode() for p, i, _ in model.pieces} | {i: bytes([b]) for b, i in enumerate(model.bytes) if i != model.unknown}
    table, skip = [spelt.get(i, b"") for i in range(max(spelt) + 1)], int(model.dummy)
    size = np.array([len(x) for x in table], np.int64)
    start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)

    def at_once(lists: pa.ListArray) -> pa.Array | None:
        """The texts, unless there are nulls or ids that are no pieces, or bytes that are no text."""
        ids = lists.flatten()
        if lists.null_count or ids.null_count or (len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(table))):
            return None
        ids, ends = ids.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[ends]
        data = _gather(flat, start[ids], size[ids])
        if skip:
            # The first byte of each text that has one goes.
            heads = ends[:-1][ends[1:] > ends[:-1]]
            data = np.delete(data, heads)
            ends = ends - np.searchsorted(heads, ends, "left")
        out = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return None
        return out

    def one_by_one(lists: pa.ListArray) -> pa.Array:
        spell = lambda x: b"".join(table[i] for i in x if i is not None and 0 <= i < len(table))
        return pa.array([None if x is None else spell(x)[skip:].decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            starts, lo = whole.column(whole.num_columns - 1).offsets.to_numpy(), 0
            while lo < len(whole):
                hi = max(lo + 1, int(np.searchsorted(starts, int(starts[lo]) + GATHER, "right")) - 1)
                batch, lo = whole.slice(lo, hi - lo), hi
                lists = batch.column(batch.num_columns - 1)
                texts = at_once(lists)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], one_by_one(lists) if texts is None else texts], names=[*batch.schema.names[:-1], "decoded"])

    return run


def decode(df: DataFrame, model: Model, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids. Pieces are joined as bytes, so characters that were spelt in bytes come back;
    ids that are no pieces give nothing, null ids a null text. Arrow batches of id lists go through a kernel."""
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, df.columns))
    out = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names)], F.col(ids_col).alias("ids")).mapInArrow(_spell(model), f"{kinds}decoded string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names) if c != name], F.col("decoded").alias(name))
