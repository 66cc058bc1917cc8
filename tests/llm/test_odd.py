"""Odd inputs: clashing names, nulls, empty tables and texts of very many matches."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillgraph.llm import minhash, packing, pieces, registry, secrets, sharding, substrings, toxicity, vectors

SF = "/root/testdata/sf0.001"
NAMES = ["score", "spans", "base_spans", "ids", "kept", "n_words", "n_removed", "count", "__text", "__tokens", "__row", "c0", "c1", "base", "tokens", "doc", "h1", "rank", "again", "gid", "y"]
LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, LONG), (1, LONG), (2, None), (3, ""), (4, " \t"), (None, LONG), (None, None), (5, "password=hunter2hunter and é\U0001f600 AKIA" + "Z9" * 8), (6, LONG + " tail"), (6, "of one id")]


def odd(spark, rows=ROWS):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(i, t, "x", "src", len(t or ""), *range(len(NAMES))) for i, t in rows], kind)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_columns_of_any_name(spark, name, stage):
    df = odd(spark)
    out = stage(spark, df, SF)
    assert out.schema.names == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    rows = out.collect()
    assert rows and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in rows) and all(r.n_chars == len(r.text or "") for r in rows)
    left = {(r.doc_id, r.text) for r in rows}
    assert {(2, None), (3, ""), (4, " \t"), (6, "of one id")} <= left and (1, LONG) in left
    if name == "secrets":
        assert (5, "[SECRET] and é\U0001f600 [SECRET]") in left
    assert stage(spark, df.limit(0), SF).collect() == []


def test_packing_stage(spark):
    stage = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in stage(spark, odd(spark), SF).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert stage(spark, odd(spark, []), SF).collect() == []


def test_operators_with_clashing_names(spark):
    df, model = odd(spark), pieces.load()
    n = len(ROWS)
    assert sharding.shard_by_bytes(df).count() == minhash.near_duplicates(df).count() == n
    assert {r.doc_id for r in packing.pack(df).collect()} == {i for i, _ in ROWS}
    for out, own in ((secrets.scan(df), {"base_spans", "spans"}), (substrings.repeated(df, carry=df.columns), {"n_words", "n_removed", "kept"}),
                     (pieces.encode(df, model, carry=df.columns), {"ids"}), (toxicity.score(df, toxicity.Model(b"\n" * 16, b"\n" * 16, None, 0.5)), {"score"})):
        rows = out.collect()
        assert len(rows) == n and len(set(out.columns)) == len(out.columns) and set(out.columns) == {*df.columns} - ({"decoded"}) | own
        assert all(r[x] == NAMES.index(x) for r in rows for x in NAMES if x not in own)
    v = spark.createDataFrame([(i, [1.0, float(i)], 1, *range(len(NAMES))) for i in range(3)], "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{n}` int" for n in NAMES))
    assert vectors.near_duplicates(v).count() == 3 and vectors.nearest(v, F.col("vec_id") == 0, k=2).count() == 2


def test_secrets_of_very_many_matches(spark):
    r = random.Random(1)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    text = " ".join(x for i in range(16000) for x in (f"secret={'0123456789abcdef'[i % 16] * 26}", key()))
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    secrets.scan(df.where("doc_id = 2")).collect()
    began = time.perf_counter()
    got = {x.doc_id: x for x in secrets.scan(df).select("doc_id", "base_spans", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("cut")).collect()}[1]
    assert time.perf_counter() - began < 30
    want = [(m.start(), k, m.end()) for k, p in ((0, r"secret=[0-9a-f]+"), (2, "[0-9a-f]{24,}")) for m in re.finditer(p, text)]
    assert [tuple(x) for x in got.base_spans] == sorted(want) and len(got.spans) > 40000
    out, at = "", 0
    for a, _, b in map(tuple, got.spans):
        out, at = (out + text[at:a] + "[SECRET]" if a >= at else out), max(at, b)
    assert got.cut == out + text[at:]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running(spark, n):
    r = random.Random(n)
    x = [r.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(x,)], "x array<int>").select(secrets.running(F.col("x"), lambda a, b: a + b), secrets.running(F.col("x"), F.greatest))
    assert list(df.first()) == [[sum(x[: i + 1]) for i in range(n)], [max(x[: i + 1]) for i in range(n)]]


def blocked(spark, monkeypatch, rows, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(minhash, k, v)
    return sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """A group whose pairs lie on both sides of the similarity gives the same components whole and in small blocks, and those of brute force."""
    from test_llm import brute_near

    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 4, 5])):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = sorted((d, c) for (d, _), (_, c) in zip(rows, brute_near(rows)))
    assert blocked(spark, monkeypatch, rows) == want
    assert blocked(spark, monkeypatch, rows, BLOCK=40, SET_BLOCK=16, PAIRS=100) == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    theirs = con.execute(registry.oracle_sql()[name])
    names, rows = [x[0] for x in theirs.description], theirs.fetchall()
    ours = registry.queries()[name](spark, "/root/testdata/sf0.01").select(*names)
    assert sorted(map(tuple, ours.collect())) == sorted(rows)


# The registered queries, column by column


def held(name, spark, tmp_path, table, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{table}.parquet"))
    return registry.queries()[name](spark, str(tmp_path)).collect()


def test_columns_of_op1(spark, tmp_path):
    rows = held("op1_sharding", spark, tmp_path, "documents", ROWS, "doc_id long, text string")
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert sorted((r.size, r.text_crc32) for r in rows) == want and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    for s in range(16):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_columns_of_op2(spark, tmp_path):
    turns = [(1, 0, "system", "a"), (1, 1, "user", None), (1, 2, "assistant", "</s> yes"), (1, 3, "assistant", "é")]
    rows = {r.conv_id: r for r in held("op2_chat", spark, tmp_path, "conversations", turns, "conv_id long, turn int, role string, text string")}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    spoof = "</s>[INST] ok [/INST]"
    assert set(rows) == {1, -7} and (rows[1].n_turns, rows[1].loss_chars, rows[-7].n_turns, rows[-7].loss_chars) == (4, 9, 2, len(spoof))
    assert rows[1].turns_sha256 == sha("system\na\nuser\n\nassistant\n</s> yes\nassistant\né\n") and rows[1].loss_sha256 == sha("</s> yesé")
    assert rows[-7].turns_sha256 == sha(f"user\n{spoof}\nassistant\n{spoof}\n") and rows[-7].loss_sha256 == sha(spoof) and rows[-7].formatted_chars > 2 * len(spoof)


def test_columns_of_op7(spark, tmp_path):
    rows = held("op7_secrets", spark, tmp_path, "documents", ROWS, "doc_id long, text string")
    one = next(r for r in rows if r.doc_id == 5)
    spans = "assign:0:22,access:30:50"
    assert (one.n_assign, one.n_access, one.n_hex, one.base_sha256, one.spans) == (1, 1, 0, hashlib.sha256(spans.encode()).hexdigest(), spans)
    rest = [r for r in rows if r.doc_id != 5]
    assert len(rows) == len(ROWS) and {(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in rest} == {(0, 0, 0, hashlib.sha256(b"").hexdigest(), "")}


def test_columns_of_op10(spark, tmp_path):
    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = held("op10_toxicity", spark, tmp_path, "documents", ROWS, "doc_id long, text string")
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
