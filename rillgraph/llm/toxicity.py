"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one of what toxic texts have and ordinary ones lack, one the
other way round. A text is compressed window by window with either; the bytes that the toxic dictionary saves over the ordinary one
are its evidence. A logistic curve, fitted on labelled texts that the dictionaries have not seen, turns a text's
largest, total and mean saving into a score whose threshold is one half.

The dictionaries' content is chosen by document counts of five-byte pieces of words and loaded as raw content. zstandard's own
trainer looks for whatever is frequent, which is the prose that both kinds share; README.md has the figures. Pieces, stretches and
the evidence of the texts that fit the curve are gathered by the executors from whole texts; the driver sees no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.words import as_bytes
from rillgraph.runtime import Scratch

GRAM, SIZE, WINDOW, LEVEL = 5, 4096, 250, 6
#: Labelled rows that are looked at, for each label.
TOXIC_ROWS, ORDINARY_ROWS = 3000, 4000
#: Pieces that a dictionary is made of and stretches of them that it is filled from, the most frequent ones.
PIECES, STRETCHES = 100_000, 4000
#: Of these, one in so many fits the curve and the others make the dictionaries.
CALIBRATE = 3

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case words with one space around each."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode()


def _pieces(text: bytes) -> set[bytes]:
    """Five-byte pieces that do not reach over a space."""
    return {p for p in {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} if b" " not in p[1:-1]}


def _stretches(text: bytes, own: set[bytes]) -> set[bytes]:
    """The longest stretches whose pieces are all in ``own``, if they fit a dictionary."""
    found, i = set(), 0
    while i <= len(text) - GRAM:
        if text[i : i + GRAM] not in own:
            i += 1
            continue
        j = i
        while text[j + 1 : j + 1 + GRAM] in own:
            j += 1
        if j + GRAM - i < SIZE:
            found.add(text[i : j + GRAM])
        i = j + 1
    return found


def _content(stretches: list[bytes]) -> bytes:
    """Dictionary content from stretches, the most frequent first; they stand last, where matches are cheapest."""
    out = b""
    for run in stretches:
        if run not in out and len(out) + len(run) < SIZE:
            out = run + b"\n" + out
    return out.rjust(16, b"\n")


def _counted(sample: DataFrame, parts) -> DataFrame:
    """(y, part, n): how many texts of either label have each of the byte strings that ``parts(text, y)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                found: Counter[tuple[int, bytes]] = Counter()
                for y, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    found.update((y, x) for x in parts(plain(text.decode("utf-8", "replace")), y))
                y, part = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(part, pa.binary()), pa.array(found.values(), pa.int64())], names=["y", "part", "n"])

    return sample.select("y", "text").mapInArrow(run, "y int, part binary, n long").groupBy("y", "part").agg(F.sum("n").alias("n"))


def _first(df: DataFrame, n: int) -> list[bytes]:
    return [bytes(r["part"]) for r in df.orderBy(F.desc("n"), "part").limit(n).collect()]


def dictionaries(sample: DataFrame, sizes: dict[int, int], scratch: Scratch) -> list[bytes]:
    """Content of the ordinary and the toxic dictionary from the rows (y, text) of ``sample``, of which ``sizes`` are of either label.

    A dictionary is made of the stretches of its texts whose pieces are at least 20 times as frequent there.
    """
    both = _counted(sample, lambda text, y: _pieces(text)).groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)))
    both = scratch.keep(both)
    own = []
    for y in (0, 1):
        here, there, n, m = F.col(f"n{y}"), F.col(f"n{1 - y}"), sizes[y], max(1, sizes[1 - y])
        often = (here >= F.lit(max(3.0, 0.002 * n))) & (here / n >= 20 * (there + 0.5) / m)
        own.append(set(_first(both.where(often).select("part", here.alias("n")), PIECES)))
    scratch.drop(both)
    runs = _counted(sample, lambda text, y: _stretches(text, own[y]))
    return [_content(_first(runs.where(F.col("y") == y), STRETCHES)) for y in (0, 1)]


def _windows(text: bytes) -> Iterator[bytes]:
    """Runs of whole words, of WINDOW bytes or a little less; a longer word is a window."""
    at = 0
    while at + 1 < len(text):
        end = len(text) - 1 if len(text) - at <= WINDOW else text.rfind(b" ", at + 1, at + WINDOW)
        if end <= at:
            end = text.find(b" ", at + 1)
        yield text[at : end + 1]
        at = end


class Model:
    """Two dictionaries and the curve's weights; ``weights`` of None stand for a constant score."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None, constant: float) -> None:
        self.toxic, self.ordinary, self.weights, self.constant = toxic, ordinary, weights, constant

    def features(self, texts: list[str]) -> np.ndarray:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=GRAM, write_content_size=False, write_checksum=False)
        by_toxic, by_ordinary = (
            zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
            for x in (self.toxic, self.ordinary)
        )
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        for i, t in enumerate(texts):
            saved = [len(by_ordinary(w)) - len(by_toxic(w)) for w in _windows(plain(t))]
            if saved:
                total = sum(saved)
                out[i, 1:] = max(saved), np.sign(total) * np.log1p(abs(total)), total / len(saved)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve through the features ``x`` and labels ``y``, each row counted ``often`` times, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (often * (y - p)) - 0.01 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                x = model.features([t.decode("utf-8", "replace") for t in as_bytes(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", scratch: Scratch | None = None) -> Model:
    """Fit on whole labelled texts whose crc32 of the id as text is not divisible by 5.

    The sample is TOXIC_ROWS toxic and ORDINARY_ROWS ordinary rows at most, those with the least hashes of their ids. Two thirds
    make the dictionaries, the rest fits the curve; with too few texts the score is constant. Either label's rows count in the curve
    as often as the sample has too few of them, so the score's odds are those of all labelled texts, whatever the bounds. The driver
    gets PIECES pieces and STRETCHES stretches for each dictionary and four numbers for each text of the rest, at most. Ids with both
    labels count as toxic; null labels and null ids are left out; of repeated ids the least text is used.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y")).withColumn("h", F.xxhash64("__id"))
    one = lambda y, n: known.where(F.col("y") == y).orderBy("h", "__id").limit(n)
    some = one(1, TOXIC_ROWS).unionByName(one(0, ORDINARY_ROWS))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "__id")) - 1
    some = some.select("__id", "y", (place % CALIBRATE == 0).alias("fresh"))
    usable = known.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    usable = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(some), "__id").groupBy("__id", "y", "fresh").agg(F.min("text").alias("text"))
    sample = scratch.keep(sample.select("y", "fresh", "text").repartition(32))
    sizes = {(r["y"], r["fresh"]): r["count"] for r in sample.groupBy("y", "fresh").count().collect()}
    constant = (usable.get(1, 0) + 0.5) / (sum(usable.values()) + 1)
    if len(sizes) < 4:
        return Model(b"\n" * 16, b"\n" * 16, None, constant)
    ordinary, toxic = dictionaries(sample.where(~F.col("fresh")), {y: sizes[y, False] for y in (0, 1)}, scratch)
    model = Model(toxic, ordinary, None, constant)
    seen = sorted((r["y"], *r["x"]) for r in sample.where("fresh").select("y", "text").mapInArrow(_evidence(model), "y int, x array<double>").collect())
    seen = np.array(seen, np.float64)
    often = np.array([usable[y] / (sizes[y, False] + sizes[y, True]) for y in (0, 1)])
    model.weights = curve(seen[:, 1:], seen[:, 0], often[seen[:, 0].astype(int)])
    scratch.drop(sample)
    return model


def _kernel(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                score = model.score([x.decode("utf-8", "replace") for x in as_bytes(batch.column(batch.num_columns - 1))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all if None) of every row with ``score``, from 0 to 1, higher for toxic texts.

    The whole text counts. Null counts as empty, whose score is that of a text without evidence. Repeated rows are scored
    each; an empty table gives an empty result; a carried column named score is replaced.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != "score"]
    names = [f"c{i}" for i in range(len(carry))]
    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry))
    rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, carry)], F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_kernel(model), f"{kinds}score double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "score")
