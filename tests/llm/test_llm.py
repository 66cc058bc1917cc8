import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rillgraph.llm import chat, minhash, packing, pieces, registry, secrets, sharding, substrings, toxicity, vectors
from rillgraph.operators import skew
from rillgraph.runtime import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, size int, label string, h1 int, n string, kept int, score int, again int"
MORE = (1, "x", 2, "y", 3, 4, 5)


def docs(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *MORE) for r in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{i % 997}" for i in range(30000))
    return [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, " \t\n "), (None, "one two three"), (None, None), (5, long), (6, "é" * 50 + " \U0001f600 x"), (7, long), (7, "another text of the same id")]


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


# op1


def check_shards(rows, got, shards=16):
    assert sorted((r[0], (r[1] or "")) for r in rows if r[0] is not None) == sorted((g.doc_id, next(t or "" for i, t in rows if i == g.doc_id and zlib.crc32((t or "").encode()) == g.text_crc32)) for g in got if g.doc_id is not None)
    assert len(rows) == len(got) and all(0 <= g.shard < shards for g in got)
    for s in range(shards):
        own = sorted(g.slot for g in got if g.shard == s)
        assert own == list(range(len(own)))


def test_sharding(spark):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(600)] + [(1000 + i, "same " * 30) for i in range(300)]
    got = sharding.shard_by_bytes(docs(spark, rows)).collect()
    check_shards(rows, got)
    sizes = np.bincount([g.shard for g in got], [g.size for g in got])
    assert sizes.max() - sizes.min() <= 2 * max(g.size for g in got) + sum(sizes) / 256
    check_shards(odd_rows(), sharding.shard_by_bytes(docs(spark, odd_rows())).collect())
    assert sharding.shard_by_bytes(docs(spark, [])).collect() == []


def test_many_tiny_texts_make_ranges_of_their_own(spark, monkeypatch):
    rows = [(i, None) for i in range(2000)] + [(5000 + i, f"text {i} " * 200) for i in range(300)]
    cuts, whole = [], sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda *x: cuts.extend(whole(*x)) or list(cuts))
    got = sharding.shard_by_bytes(docs(spark, rows)).collect()
    check_shards(rows, got)
    empty = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    assert sum(h == empty for h, _ in cuts) > len(cuts) / 4
    sizes = np.bincount([g.shard for g in got], [g.size for g in got])
    assert sizes.max() - sizes.min() <= 2 * max(g.size for g in got) + sum(sizes) / 256


# op2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\!n<>|/s[]INST \n" + "aé", max_size=40), st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|end|>"]))
def test_escape(text, role):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)
    assert chat.parse(chat.START + chat._header(role) + chat.MIDDLE + shown + chat.END) == [(role, text)]


def test_chat(spark):
    r = random.Random(3)
    turns = [(1, 0, "system", "be kind"), *[(1, i, ("user", "assistant")[i % 2 == 0], f"<|end|> [INST] {i} " + "word " * r.randrange(60)) for i in range(1, 120)]]
    turns += [(2, 0, "user", None), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, None, "tie"), (None, 0, "assistant", "no id"), (3, 0, "system", "long " * 3000), (3, 1, "assistant", "yes " * 3000), (3, 2, "user", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, window int")
    windows = chat.format_windows(df, budget=256, history=64)
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, x in got.items():
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        assert x.n_turns == len(own)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        said = "".join(b for _, a, b in own if a == "assistant")
        assert x.loss_chars == len(said) and x.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    kept = sorted(windows.where("conv_id = 1").collect(), key=lambda w: w.window)
    assert len(kept) > 3 and all(w.n_tokens <= 256 and not w.over for w in kept)
    assert all(chat.parse(w.text)[0] == ("system", "be kind") for w in kept) and all(w.n_repeated >= 1 for w in kept[1:])
    assert chat.read_back(chat.format_windows(df.limit(0))).collect() == []


# op3


def shingles(t):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)]


def near_rows():
    r = random.Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base) if i < 90 else [f"v{r.randrange(5000)}" for _ in range(60)]
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i * 7 % 120, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(500, rows[3][1]), (501, rows[100][1]), (502, None), (503, "  "), (504, "few words"), (505, "Few  words"), (None, rows[3][1])]


def test_near_duplicates(spark):
    rows = near_rows()
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    want = sorted(((d, n, c) for (d, _), (n, c) in zip(rows, brute_near(rows))), key=str)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == want
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)
    left = minhash.keep_one(docs(spark, rows + [rows[100]]))
    assert left.columns == docs(spark, []).columns
    ids = [x.doc_id for x in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute_near(rows) if c is not None})
    assert ids.count(None) == 1
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_one_row_of_each_text_of_a_repeated_id(spark):
    r = random.Random(4)
    a, b, c, d, e = ([f"v{r.randrange(5000)}" for _ in range(60)] for _ in range(5))
    near = " ".join([*c[:-1], "other"])
    a, b, c, d, e = map(" ".join, (a, b, c, d, e))
    # 5: b is a copy of 1's, a and c are not; 7: c's near copy goes for 5's c, d is clean, its upper-case copy goes; 3: both of its texts are the
    # least of a group; 9 repeats a text of 3; 8: blank rows are linked with nothing.
    rows = [(1, b), (5, a), (5, b), (5, c), (7, near), (7, d), (7, d.upper()), (3, e), (3, "x y z"), (9, "x y z"), (9, e), (6, e), (8, ""), (8, ""), (None, e), (None, e)]
    want = {(1, b), (5, a), (5, c), (3, e), (3, "x y z"), (8, ""), (None, e)}
    for some in (rows, rows[::-1]):
        left = [(x.doc_id, x.text) for x in minhash.keep_one(docs(spark, some)).collect()]
        assert {x for x in left if x[0] != 7} == want and [t.lower() for i, t in left if i == 7] == [d]
        assert len(left) == len(want) + 3


def test_thresholds():
    assert 0 < minhash.least_matches(0.85) < 55 and minhash.most_flips(0.85) < 1024 * 0.15


# op4


def test_pieces_match_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["Hello  world", " a\tb\n", "", "ﬁ é 漢字 \U0001f600", "x" * 60, "<s> </s>", "   ", "The quick brown-fox_jumps 12345 times!" * 5, None]
    model = pieces.load()
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.decode(pieces.encode(df, model, carry=["doc_id"]), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (sp.encode(t or ""), t or "")
    assert pieces.encode(df.limit(0), model, carry=["doc_id"]).collect() == []


def test_merging_many_words_at_once():
    model, r = pieces.load(), random.Random(5)
    merger, rank = pieces.Merger(model), {p: -s for p, _, s in model.pieces}
    ids = {p: i for p, i, _ in model.pieces}
    stuff = [p for p, _, _ in r.sample(model.pieces, 300)] + ["\n", "漢", "\U0001f600", "▁", "▁", "a", "e", "th", "\x00"]
    words = ["▁" + "".join(r.choice(stuff) for _ in range(r.randrange(0, 12))) for _ in range(4000)]
    words += ["a", "a" * 64, "a" * 65, "ab" * 40, "\n" * 64, "▁" * 30]
    flat, start, n = merger.merge(words)
    for w, at, k in zip(words, start, n):
        want = [x for p in pieces.by_merging(w, rank) for x in ([ids[p]] if p in ids else [model.bytes[b] for b in p.encode()])]
        assert (k == -1 and len(w) > pieces.LONGEST) or flat[at : at + k].tolist() == want
    assert all(len(x) == 0 for x in merger.merge([])[1:])


def test_pieces_over_many_chunks(spark, monkeypatch):
    """Texts of many chunks, with odd spaces among plain ones; pieces of equal score are merged by the rule for few."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "COMMON", 20)
    r, model = random.Random(8), pieces.load()
    texts = ["".join(r.choice([" ", "the", "ing ", "x", "é\n", "  ", "▁", "漢", " word"]) for _ in range(r.randrange(0, 40))) for _ in range(400)] + [" a", "a ", " ", "z" * 500]
    monkeypatch.setattr(pieces, "CHUNK", 300)
    monkeypatch.setattr(pieces, "GATHER", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    shared = type("Shared", (), {"value": (pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), pieces.Merger(model))})
    out = list(pieces._assemble(model, shared)(iter([batch])))
    assert len(out) > 20
    assert [x for b in out for x in b.column(0).to_pylist()] == [sp.encode(t) for t in texts]
    back = [x for b in pieces._spell(model)(iter(out)) for x in b.column(b.num_columns - 1).to_pylist()]
    assert back == [t.replace("▁", " ") for t in texts]
    equal = pieces.Model("bpe", [(p, i + 300, 0.0 if len(p) == 1 else -1.0) for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a"])], list(range(256)), 0)
    df = spark.createDataFrame([(0, "aba bab")], "doc_id long, text string")
    assert pieces.decode(pieces.encode(df, equal, carry=["doc_id"]), equal).collect() == [(0, [305, 304, 300, 304, 302], "aba bab")]


def test_viterbi_against_brute_force(spark):
    r = random.Random(2)
    made = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(14)} | {"▁", "a"}
    made = [(p, i + 300, -r.random() * 5 * len(p)) for i, p in enumerate(sorted(made))]
    model = pieces.Model("unigram", made, list(range(256)), 0)
    score = {p: s for p, _, s in made}
    least = min(score.values()) - 10

    def best(w):
        if not w:
            return 0.0
        return max((score.get(w[:k], least if k == 1 else -np.inf)) + best(w[k:]) for k in range(1, len(w) + 1))

    texts = ["".join(r.choice("abc ") for _ in range(9)) for _ in range(15)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    name = {i: p for p, i, _ in made}
    for row in pieces.decode(pieces.encode(df, model, carry=["doc_id"]), model).collect():
        t = texts[row.doc_id]
        assert row.decoded == t
        got = sum(score[name[i]] if i in name else least for i in row.ids)
        assert got == pytest.approx(sum(best(w) for w in re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁"))) if t else 0)


# op5 and op9


def vector_rows():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.05 * rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(np.concatenate([base, near, base[:1].repeat(60, 0)]))]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0]]
    return rows + [(1000 + 50 * i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0][1], None), (None, rows[0][1], 0)]


KIND = "vec_id long, embedding array<float>, label int"


def test_neighbours(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", gid int")
    got = vectors.nearest(df, F.col("vec_id") % 50 == 0).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hits = 0
    asked = [i for i, _ in good if i % 50 == 0]
    for q in asked:
        v = dict(good)[q]
        want = sorted(((-(v @ x) / np.sqrt(v @ v) / np.sqrt(x @ x), i) for i, x in good if i != q))[:5]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == [1, 2, 3, 4, 5] and sorted(mine, key=lambda g: (-g.score, g.vec_id)) == mine
        scores = {i: -s for s, i in ((-(v @ x) / np.sqrt(v @ v) / np.sqrt(x @ x), i) for i, x in good)}
        assert all(abs(scores[g.vec_id] - g.score) < 1e-12 for g in mine)
        hits += sum(min(abs(scores[g.vec_id] + s) for s, _ in want) < 1e-12 for g in mine)
    assert hits >= 0.9 * 5 * len(asked) and {g.query_id for g in got} - set(asked) <= {1300}
    few = vectors.nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert [(g.query_id, g.rank) for g in sorted(few, key=lambda g: g.rank)] == [(0, 1), (0, 2)]
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_vector_duplicates(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], KIND + ", n_links int")
    got = vectors.near_duplicates(df).collect()
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None and label is not None for i, v, label in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    want = sorted(((i, links[k], rows[find(k)][0]) for k, (i, _, _) in enumerate(rows)), key=str)
    assert sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=str) == want
    assert all(g.kept == (g.vec_id is None or g.vec_id == g.component_id) for g in got)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_perturbations_are_the_cheapest():
    rng = np.random.default_rng(1)
    f = rng.random((5, 4))
    got = vectors.perturbations(f, 20)
    for row, steps in zip(f, got):
        cost = lambda s: sum(0 if x == 0 else c * c if x < 0 else (1 - c) ** 2 for x, c in zip(s, row))
        every = sorted(cost(s) for s in np.ndindex(3, 3, 3, 3) for s in [[x - 1 for x in s]])[:20]
        assert np.allclose([cost(s) for s in steps], every) and not steps[0].any()


# op6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=60))
def test_windows(sizes):
    found = packing.windows(sizes, 1024) if sizes else []
    assert sorted(i for g in found for i in g) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in g) for g in found]
    assert all(s <= 1024 for s in sums) and (len(found) <= -(-sum(sizes) // 1024) + 1)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd_rows() + [(8, "a <|endoftext|> b\u2028c 漢字")]
    got = packing.pack(docs(spark, rows)).collect()
    want = sorted(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, x in rows)
    parts, whole = {}, []
    for g in sorted(got, key=lambda g: g.start):
        parts.setdefault((g.doc_id, g.doc_tokens), []).append(g)
    assert sum(g.length for g in got) * 4 == sum(map(len, want))
    for own in parts.values():
        copies = sum(g.start == 0 for g in own)
        for k in range(copies):
            whole.append(b"".join(g.ids for g in own[k::copies]))
    assert sorted(map(len, whole)) == sorted(map(len, want))
    assert sorted(w for w in whole if len(w) < 4000) == sorted(w for w in want if len(w) < 4000)
    by = {}
    for g in sorted(got, key=lambda g: g.offset):
        by.setdefault(g.sequence_id, []).append(g)
    for own in by.values():
        assert sum(g.length for g in own) <= 1024
        assert [g.offset for g in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    assert packing.pack(docs(spark, [])).collect() == []


# op7


def test_secrets(spark):
    r = random.Random(5)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        "Password = 'hunter2hunter' token: token: abcdef API-KEY x apikey:\"abc\"", f"é\U0001f600 AKIA{'Z9' * 8} AKIAABC {'ab12' * 6} deadbeef", f"see {key} here",
        "Donaudampfschifffahrtsgesellschaftskapitaen " * 3 + "-" * 40 + " /usr/local/share/documents/things", None, "", "secret=" + "x" * 200000,
    ]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("spans", F.lit(1))
    rows = {x.doc_id: x for x in secrets.scan(df).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in rows[i].base_spans] == sorted(want)
        assert set(map(tuple, rows[i].base_spans)) <= set(map(tuple, rows[i].spans))
    assert (4, 3, 44) in map(tuple, rows[2].spans) and list(rows[3].spans) == []
    assert rows[0].label == "x" and secrets.scan(docs(spark, [])).collect() == []
    cut = secrets.scan(df).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {x.doc_id: x.t for x in cut}[2] == "see [SECRET] here"


# op8


def brute_repeats(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        w = words_of(rows[i][1])
        for s in range(len(w) - window + 1):
            key = (rows[i][0] is None, rows[i][0] or 0, s)
            at = tuple(w[s : s + window])
            first[at] = min(first.get(at, key), key)
    out = []
    for i, (d, t) in enumerate(rows):
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d is None, d or 0, s):
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


@pytest.mark.parametrize("window", [20, 10])
def test_substrings(spark, window):
    r = random.Random(window)
    lots = [" ".join(f"p{r.randrange(500)}" for _ in range(r.randrange(window, 60))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(f"u{r.randrange(3000)}" for _ in range(r.randrange(40))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(lots))
        if i % 9 == 0:
            parts.append("ha " * r.randrange(10, 70))
        if i % 11 == 0:
            parts.append("ab cd " * r.randrange(5, 40))
        rows.append((i * 37 % 80, "\n".join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, ""), (204, "few words"), (205, "few words"), (None, rows[5][1])]
    got = substrings.repeated(docs(spark, rows), window=window).collect()
    mine = sorted(((g.doc_id, g.n_words, g.n_removed, words_of(g.kept)) for g in got), key=str)
    assert mine == sorted(brute_repeats(rows, window), key=str)
    assert substrings.repeated(docs(spark, [])).collect() == []
    done = substrings.remove_repeats(docs(spark, rows).withColumn("n_chars", F.length("text")), window=window)
    assert done.columns == [*docs(spark, []).columns, "n_chars"] and done.where("n_chars <> length(text)").count() == 0


def test_repeats_among_texts_without_ids(spark):
    p, q = (" ".join(f"{x}{i}" for i in range(25)) for x in "pq")
    rows = [(5, p + " end"), *((None, f"t{i} {p}") for i in range(40)), (None, q + " one"), (None, "two " + q)]
    got = substrings.repeated(docs(spark, rows)).collect()
    assert [g.n_removed for g in got if g.doc_id == 5] == [0]
    assert sorted(g.n_removed for g in got) == [0, 0] + [25] * 41
    assert sum(q in g.kept for g in got) == 1 and sum(p in g.kept for g in got) == 1


def test_only_emptied_documents_go(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long), (3, ""), (4, " \t"), (5, None), (6, " ".join(long.split()[5:30])), (7, "few words"), (8, "few words")]
    left = corpus_pipeline.cut_repeats(spark, docs(spark, rows), SF)
    assert {(x.doc_id, x.text) for x in left.collect()} == {rows[i] for i in (0, 2, 3, 4, 6, 7)} and left.columns == docs(spark, []).columns


def test_rounds():
    assert substrings.rounds(20) == 2 and substrings.rounds(50) == 4 and substrings.rounds(1) == 0


# op10


def toxic_texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "the", "er", "on", "ti", "re"]) for _ in range(r.randrange(1, 4)))
    plain = [" ".join(word() for _ in range(r.randrange(20, 200))) for _ in range(300)]
    bad = []
    for t in plain[:120]:
        w = t.split()
        for _ in range(max(2, len(w) // 25)):
            w.insert(r.randrange(len(w)), r.choice(["zwuckel", "brambast", "quoxil"]))
        bad.append(" ".join(w))
    return bad, plain[120:]


def test_toxicity(spark):
    bad, good = toxic_texts()
    rows = [(i, t) for i, t in enumerate(bad + good)] + [(4, "zwuckel " * 9), (5, bad[5])]
    labels = spark.createDataFrame([(i, int(i < len(bad)), 9) for i, _ in rows] + [(None, 1, 9), (3, None, 9)], "doc_id long, toxic int, quality int")
    df = docs(spark, rows + [(9000, None), (9001, ""), (None, "x"), (9002, "zwuckel " * 5000)])
    model = toxicity.train(df, labels)
    got = {x.doc_id: x.score for x in toxicity.score(df, model, carry=["doc_id"]).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i < len(bad)) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.5 < got[9002]
    none = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df.limit(0), none).collect() == [] and {x.score for x in toxicity.score(df, none).collect()} == {0.5}


def test_toxicity_has_the_odds_of_all_rows(spark, monkeypatch):
    bad, good = toxic_texts()
    # Two thirds of the toxic texts look like the others, so a text without evidence is toxic with a chance of about 0.3.
    rows = list(enumerate(bad[:60] + good[:120] + [f"{t} {u}" for t, u in zip(good, good[1:] + good[:1])] + good[120:]))
    labels = spark.createDataFrame([(i, int(i < 180)) for i, _ in rows] + [(i, 0) for i in range(10**6, 10**6 + 500)], "doc_id long, toxic int")
    df = docs(spark, rows)
    plain = [r for r in rows if r[0] >= 60]
    whole = toxicity.train(df, labels)
    monkeypatch.setattr(toxicity, "ORDINARY_ROWS", 100)
    few = toxicity.train(df, labels)
    for model in (whole, few):
        score = np.mean([x.score for x in toxicity.score(docs(spark, plain), model).collect()])
        assert abs(score - 120 / len(plain)) < 0.1


# queries and pipeline


@pytest.mark.parametrize("name", sorted(set(registry.queries())))
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    scratch = Scratch(spark)
    first = now = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.keep(stage(spark, now, SF))
        assert now.columns == first.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in now.collect()}
    text = now.select(F.concat_ws("\n", F.collect_list("text"))).first()[0]
    assert not any(m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24)
    assert corpus_pipeline.run(spark, SF).count() == last.count()


# joins


def test_split_join_deals_a_hot_key(spark):
    many = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 700).alias("k"), "id")
    few = many.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k < 300")
    got = skew.split_join(many, few, "k", ["id"], many.count())
    assert got.columns == ["k", "id", "least"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few.drop("n"), "k").collect()))
    assert skew.split_join(many.limit(0), few.limit(0), "k", ["id"], 0).collect() == []
