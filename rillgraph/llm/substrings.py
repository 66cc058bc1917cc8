"""Removal of repeated passages, found by recompression of the texts' words.

Each round names pairs of neighbouring symbols: a hash bit of a symbol's name says whether it may stand left or right, so a pair
is named or not by its two symbols alone, and equal passages get equal symbols everywhere but at their ends. The name is a
hash of the two names, which makes it global without a table. Runs of one symbol are never paired and keep one name
for each member, as a window may cut a run anywhere. After ``r`` rounds a symbol spans at most 2**r words, and a
passage has lost at most 2**r - 1 words at either end; ``r`` is the most that leaves a whole symbol in every window.

For each window the symbol with the least name inside that safe part is its anchor; an equal window has an equal anchor. Anchors
are posted with the words around them. Only windows whose anchor occurs twice are hashed whole and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.operators.skew import split_join
from rillgraph.llm.words import _words, as_bytes, chunks, hash_words, mix
from rillgraph.runtime import Scratch

_rng = np.random.default_rng(77003)
_MUL = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


def rounds(window: int) -> int:
    """The most rounds after which each window still holds a whole symbol that both occurrences share."""
    r = 0
    while 2 * (2 ** (r + 1) - 1) + 2 ** (r + 1) <= window:
        r += 1
    return r


def recompress(words: np.ndarray, doc: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after ``times`` rounds, and the words that they start at."""
    name, start = words, np.arange(len(words))
    with np.errstate(over="ignore"):
        for k in range(times):
            right = (mix(name ^ _SALT[k]) & np.uint64(1)).astype(bool)
            pair = np.flatnonzero(~right[:-1] & right[1:] & (doc[start[:-1]] == doc[start[1:]]))
            named = mix(name[pair] * _MUL[0] + name[pair + 1] * _MUL[1] + _SALT[k + 32])
            name = name.copy()
            name[pair] = named
            stay = np.ones(len(name), bool)
            stay[pair + 1] = False
            name, start = name[stay], start[stay]
    return name, start


def _rolling(words: np.ndarray, at: np.ndarray, size: int, place: int = 2) -> np.ndarray:
    """Hash of the ``size`` words from each position in ``at``; another ``place`` of the multipliers gives an independent one."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out += words[at + i] * _MUL[(place + i) % len(_MUL)]
        return mix(out)


def anchors(words: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the texts that begin at ``begin`` (and end at its last entry): its first word, its anchor, the anchor's key."""
    r = rounds(window)
    lost, span = 2**r - 1, 2**r
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    if len(words) < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    name, start = recompress(words, doc, r)
    rank = np.full(len(words), _NONE)
    rank[start] = mix(name ^ _SALT[63])
    # Symbols that start here lie within the safe part of the window, whatever their span.
    free = window - 2 * lost - span + 1
    first = np.flatnonzero(doc[: len(words) - window + 1] == doc[window - 1 :])
    best = np.lib.stride_tricks.sliding_window_view(rank, free)
    picked = np.concatenate([best[first[i : i + 65536] + lost].argmin(axis=1) for i in range(0, len(first), 65536)] or [np.empty(0, np.int64)])
    anchor = first + lost + picked
    changed = np.flatnonzero(np.diff(anchor, prepend=-1))
    key = _rolling(words, anchor[changed] - lost, 2 * lost + span)
    return first, anchor, np.repeat(key, np.diff(np.append(changed, len(anchor))))


def _post(window: int):
    """(h1, key, often) for each distinct key of a text's anchors; often: the text has it at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                h1, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
                for lo, hi in chunks(texts):
                    words, begin = hash_words(texts[lo:hi])
                    first, anchor, key = anchors(words, begin, window)
                    fresh = np.flatnonzero(np.diff(anchor, prepend=-1))
                    doc, key = np.searchsorted(begin, first[fresh], "right") - 1, key[fresh]
                    order = np.lexsort((key, doc))
                    doc, key = doc[order], key[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                    at = np.flatnonzero(new)
                    often = np.diff(np.append(at, len(key))) > 1
                    yield pa.RecordBatch.from_arrays([pa.array(h1[lo:hi][doc[at]]), pa.array(key[at].view(np.int64)), pa.array(often)], names=["h1", "key", "often"])

    return run


def _windows(window: int):
    """(w, w2, doc, tie, pos) for each window whose anchor's key is among the text's repeated ones; w and w2 are 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(len(whole)):
                batch = whole.slice(a, 1)
                doc, tie, keys = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(3)[0].values.to_numpy()
                words, begin = hash_words(as_bytes(batch.column(2)))
                first, _, key = anchors(words, begin, window)
                first = first[np.isin(key.view(np.int64), keys)]
                w, w2 = (_rolling(words, first, window, place).view(np.int64) for place in (2, 2050))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(w2), *(pa.array(np.full(len(w), x, np.int64)) for x in (doc, tie)), pa.array(first)], names=["w", "w2", "doc", "tie", "pos"])

    return run


def cut(text: bytes, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Words of a text, words that windows at ``starts`` cover, and the text without those, each with the white space after it."""
    if not len(starts):
        return len(text.split()), 0, text
    _, start, _ = _words(text)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(start)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1, append=1))
    at = np.append(start, len(text))
    kept = b"".join(text[at[turn[i]] : at[turn[i + 1]]] for i in range(0, len(turn) - 1, 2))
    lead = text[: start[0]] if len(start) else text
    return len(start), int(gone.sum()), (lead if len(kept) else b"") + kept


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                found = []
                for text, again, starts in zip(as_bytes(batch.column(batch.num_columns - 3)), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
                    if again:
                        n = len(text.split())
                        found.append((n, n, b"") if n >= window else (n, 0, text))
                    else:
                        found.append(cut(text, starts.values.to_numpy() if starts.is_valid else np.empty(0, np.int64), window))
                n, gone, kept = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-3], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names[:-3], "n_words", "n_removed", "kept"])

    return run


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The columns ``carry`` of every row of ``df`` (the id alone if None) with n_words, n_removed and kept.

    A word goes if one of the windows of ``window`` words that cover it occurs earlier: in a document with a smaller id, or
    further ahead in the same one. ``kept`` is the text without those words; white space before what is left stays.

    Ids are integers. Null id: after all others. Rows that share an id but not their text are one document, in the order
    of their texts' hashes; equal rows get equal results and do not count as repeats of each other. Null
    text: no words, kept empty. Texts of fewer words than a window stay as they are. An empty table gives an empty
    result. Carried columns named n_words, n_removed or kept are replaced.
    """
    scratch = scratch or Scratch(df.sparkSession)
    last = F.lit(2**63 - 1)
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("long"), last)
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text, F.octet_length(text)).alias("h2")]

    # Equal texts: the one with the smallest id stands for all, as every window of the others occurs in it.
    classes = df.select(key.alias("doc"), *hashes).groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
    # The texts of one id are told apart by a rank; those without an id, which may be very many, by their hash.
    part = F.when(F.col("doc") == last, F.col("h1")).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("doc", part).orderBy("h1", "h2")) - 1
    classes = scratch.keep(classes.withColumn("tie", part + rank))

    posts = scratch.keep(df.select(hashes[0], text.alias("text")).mapInArrow(_post(window), "h1 long, key long, often boolean"))
    again = posts.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("often").alias("often"), F.count("*").alias("n"))
    again = scratch.keep(again.where("often or a <> b").select("key", "n"))
    keys = split_join(posts, again, "key", ["h1"], posts.count()).groupBy("h1").agg(F.collect_set("key").alias("keys"))
    keys = scratch.keep(keys)
    scratch.drop(posts, again)

    first = df.select(key.alias("doc"), *hashes, text.alias("text")).join(classes.join(keys, "h1"), ["doc", "h1", "h2"]).dropDuplicates(["doc", "h1", "h2"])
    found = scratch.keep(first.select("doc", "tie", "text", "keys").mapInArrow(_windows(window), "w long, w2 long, doc long, tie long, pos long"))
    early = found.groupBy("w", "w2").agg(F.min(F.struct("doc", "tie", "pos")).alias("early"), F.count("*").alias("n")).where("n > 1")
    early = scratch.keep(early)
    late = split_join(found, early, ["w", "w2"], ["doc", "tie", "pos"], found.count()).where(F.struct("doc", "tie", "pos") > F.col("early"))
    late = late.groupBy("doc", "tie").agg(F.collect_list("pos").alias("starts"))
    marks = classes.join(late, ["doc", "tie"], "left").select("h1", "h2", F.col("doc").alias("own"), F.lit(True).alias("first"), "starts")
    marks = scratch.keep(marks)
    scratch.drop(found, early, keys)

    carry = [c for c in ([id_col] if carry is None else carry) if c.lower() not in ("n_words", "n_removed", "kept")]
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    # A row that is not the first of its text finds no marks; the id in the key spreads the copies of one text.
    rows = df.select(*named, key.alias("own"), *hashes, text.alias("text")).join(marks, ["h1", "h2", "own"], "left")
    rows = rows.select(*[f"c{i}" for i in range(len(carry))], "text", F.col("first").isNull().alias("again"), "starts")
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = rows.mapInArrow(_cut(window), f"{kinds}, n_words long, n_removed long, kept string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "n_removed", "kept")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, length_col: str | None = "n_chars", emptied: bool = True) -> DataFrame:
    """The columns of ``df`` with the text's repeated passages cut out, and ``length_col``, if there is one, counted anew.

    Documents that lose all their words stay as rows with an empty text if ``emptied``, else they go; a null text stays null, and one
    without words stays as it is.
    """
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    own = df.toDF(*names.values()).withColumn("__text", F.col(names[text_col]))
    done = repeated(own, names[id_col], names[text_col], window, carry=own.columns)
    if not emptied:
        done = done.where("n_removed = 0 or n_removed < n_words")
    cols = {c: F.col(n) for c, n in names.items()}
    cols[text_col] = F.when(F.col("__text").isNotNull(), F.col("kept"))
    if length_col in names:
        cols[length_col] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(cols[length_col]).cast(df.schema[length_col].dataType)
    return done.select(*[x.alias(c) for c, x in cols.items()])
