"""Packing of tokenised documents into windows of near-equal length, by Karmarkar-Karp multiway differencing.

A document's whole windows stand alone. What is left of each document is cut into parts and gathered, partition by
partition, into blocks worth ``BLOCK`` windows; a block's parts are dealt to windows by differencing. Nothing is shuffled, and
a task holds one block.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.words import as_bytes

#: Windows that are dealt together, and the share of them that a block leaves empty, so that near-equal windows fit.
BLOCK, SLACK = 64, 0.004
#: Parts are no longer than this share of a window.
PARTS = 4

#: Texts with characters beyond these may be split otherwise by another regex engine's Unicode tables.
_UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]|<\\|endoftext\\|>")


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    """A function from texts to lists of ids, as ``tokenizers`` gives them for the file at ``path``.

    A byte-level BPE is run by tiktoken on the same vocabulary, which is several times as fast and agrees on
    Latin text; the rest of the texts goes to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    added = {x.content for x in slow.get_added_tokens_decoder().values()}
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    # Printable characters stand for themselves and the other bytes for the characters from 256 on, in order.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    assert set(of) == set(ByteLevel.alphabet())
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32) if _UNSURE.search(t) else fast.encode_to_numpy(t, disallowed_special=())
            for t in texts
        ]

    return encode


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to ``k`` groups with near-equal sums: the two partial partitions with the largest spreads are merged,
    the largest sums of one with the smallest of the other, until one is left. Empty groups are left out of the lists."""
    heap = [(-s, i, [(s, (i, None))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        # Both are sorted from the largest, and the groups they lack are empty: a's largest sums meet b's empty groups,
        # a's empty groups b's largest sums, and those between meet in opposite orders.
        merged = a + b[:free] if len(b) > free else a + b
        if len(b) > free:
            for i, (s, items) in enumerate(reversed(b[free:])):
                j = k - len(b) + i
                merged[j] = (merged[j][0] + s, (merged[j][1], items))
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    found = []
    for _, items in heap[0][2] if heap else []:
        group, stack = [], [items]
        while stack:
            x = stack.pop()
            if x is None:
                continue
            if isinstance(x[0], int):
                group.append(x[0])
                stack.append(x[1])
            else:
                stack += x
        found.append(group)
    return found


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal groups of at most ``capacity``; their number rises by one as long as a group has more."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in found):
            return found
        k += 1


def _kernel(path: str | None, capacity: int, end: int | None):
    part = max(1, capacity // PARTS)
    full = int(BLOCK * capacity * (1 - SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = tokenizer(path), None
        serial = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        open_, held = [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 7
            out.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def deal() -> None:
            nonlocal open_, held, serial
            for group in windows([len(x[2]) for x in open_], capacity) if open_ else []:
                at = 0
                for i in sorted(group):
                    doc, start, ids, whole = open_[i]
                    out.append((doc, start, len(ids), ids.tobytes(), whole, serial, at))
                    at += len(ids)
                serial += 1
            open_, held = [], 0

        for whole in batches:
            kind = whole.column(0).type
            for lo in range(0, len(whole), 128):
                batch = whole.slice(lo, 128)
                docs, texts = batch.column(0).to_pylist(), [x.decode("utf-8", "replace") for x in as_bytes(batch.column(1))]
                for doc, ids in zip(docs, encode(texts)):
                    if end is not None:
                        ids = np.append(ids, np.uint32(end))
                    ids = ids.astype("<u4", copy=False)
                    n = len(ids)
                    for start in range(0, n - n % capacity, capacity):
                        out.append((doc, start, capacity, ids[start : start + capacity].tobytes(), n, serial, 0))
                        serial += 1
                    start = n - n % capacity
                    while start < n:
                        size = min(part, n - start, full - held)
                        open_.append((doc, start, ids[start : start + size], n))
                        start, held = start + size, held + size
                        if held == full:
                            deal()
                yield flush()
        if open_:
            deal()
            yield flush()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 1024, end: int | None = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text under the tokenizer file at ``path``, followed by ``end`` unless that is None. Every
    id lies in one piece, every piece in one sequence of at most ``capacity`` ids.

    Null text counts as empty: its ``end`` alone. Null ids are carried along; repeated rows are packed each. An empty
    table gives an empty result. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _kernel(path, capacity, end), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
