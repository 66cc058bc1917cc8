"""Secret scans (DataFrame functions only): fixed patterns, and a battery of randomness tests on opaque tokens.

The battery looks at runs of 20 or more letters, digits and ``+/_-``. It infers an encoding from the characters and tests
three things that hold for a random string in that encoding: symbols occur equally often (chi-squared, by the
Wilson-Hilferty cube root), kinds of characters alternate as often as by chance (runs), and neighbours are
independent (serial correlation). The least of the three p-values, times three, is the token's. Ordinary words,
paths and rulers fail; a token is reported if Benjamini-Hochberg, within its encoding and length class over the whole
corpus, does not reject its randomness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.runtime import Scratch

# The patterns that the contract names, in its order, with the least lengths of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# Encodings with the characters that they use, in order of their codes; the first that fits is inferred.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
SPAN = "array<struct<start:int,kind_no:int,end:int>>"
RANDOM = "array<struct<start:int,end:int,cls:int,p:double>>"


#: Entries of an array that are summed at a time.
PART = 256
#: Code points in a part of a text that spans are cut from.
CHUNK = 4096


def _let(x: Column, made) -> Column:
    """``made(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def running(numbers: Column, join) -> Column:
    """The running ``join`` (a sum, a maximum) of an array of non-negative ints.

    An array that grows by one entry at a time costs the square of its length, so parts of ``PART`` entries are summed by
    themselves and then raised by what the parts before them come to.
    """
    none = F.expr("cast(array() as array<int>)")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    grow = lambda a, v: F.concat(a, F.array(join(last(a), v)))

    def whole(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int"))
        parts = F.transform(starts, lambda k: F.aggregate(F.slice(x, k * PART + 1, F.lit(PART)), none, grow))
        before = lambda p: F.slice(F.aggregate(F.transform(p, last), F.array(F.lit(0)), grow), F.lit(1), F.size(p))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, before(p), lambda own, base: F.transform(own, lambda v: join(v, base)))))

    return _let(numbers, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<m string, start, end>> of the leftmost matches, in code points: matches and the pieces between them alternate."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        ends = running(F.zip_with(gaps, m, lambda g, x: F.length(g) + F.length(x)), lambda a, b: a + b)
        return F.zip_with(m, ends, lambda x, end: F.struct(x.alias("m"), (end - F.length(x)).alias("start"), end.alias("end")))

    return _let(found, placed)


def _kind(text: Column, pattern: str, kind: int, keep) -> Column:
    spans = F.filter(_spans(text, pattern), keep)
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind_no"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the logistic approximation with a cubic term."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565 * z * z * z)))


def _p(token: Column, alphabet: str) -> Column:
    """The p-value of a token's randomness in one encoding."""
    n, k = F.length(token).cast("double"), len(alphabet)
    df, edge = k - 1.0, 2 / (9 * (k - 1.0))
    kinds = [sum(c.isdigit() for c in alphabet), sum(c.islower() for c in alphabet), sum(c.isupper() for c in alphabet)]
    shares = [x / k for x in (*kinds, k - sum(kinds)) if x]
    two, three = (sum(x**e for x in shares) for e in (2, 3))
    runs = F.size(F.regexp_extract_all(token, F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/]+"), F.lit(0)))
    spread = F.sqrt((n - 1) * (two * (1 - two)) + (n - 2) * (2 * (three - two * two)))
    alternate = 2 * _tail(F.abs(runs - (1 + (n - 1) * (1 - two))) / spread)

    def serial(off: Column) -> Column:
        lag = F.zip_with(F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda a, b: a * b)
        own, near = F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x), F.aggregate(lag, F.lit(0.0), lambda a, x: a + x)
        return _let(F.struct(own.alias("own"), near.alias("near")), lambda s: 2 * _tail(F.abs(F.when(s["own"] > 0, s["near"] / s["own"]).otherwise(1.0)) * F.sqrt(n)))

    def judged(chars: Column) -> Column:
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        chi = _tail((F.cbrt((k * squares / n - n) / df) - (1 - edge)) / edge**0.5)
        codes = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c).cast("double"))
        off = _let(codes, lambda x: _let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n, lambda mean: F.transform(x, lambda v: v - mean)))
        return F.least(F.lit(1.0), 3 * F.least(chi, alternate, _let(off, serial)))

    return _let(F.split(token, ""), judged)


def _class(token: Column, encoding: int) -> Column:
    """Encoding and length class: lengths within a factor of the square root of two share one."""
    return F.lit(encoding * 64) + F.least(F.lit(63), F.floor(2 * F.log2(F.length(token).cast("double")))).cast("int")


def _random(text: Column, base: Column) -> Column:
    """Tokens outside the fixed patterns' spans, with class and p-value."""
    # In the order of their starts a token meets a span if one before it ends later than it starts, or the next starts before it ends.
    at = lambda spans, no, m: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), m(x).alias("m")))
    both = F.array_sort(F.concat(at(base, 0, lambda x: F.lit("")), at(_spans(text, TOKEN), 1, lambda x: x["m"])))

    def free(every: Column) -> Column:
        reach = running(F.transform(every, lambda x: F.when(x["no"] == 0, x["end"]).otherwise(0)), F.greatest)

        def alone(e: Column) -> Column:
            met = lambda x, i: (F.get(e["reach"], i) > x["start"]) | F.coalesce((F.get(e["every"], i + 1)["no"] == 0) & (F.get(e["every"], i + 1)["start"] < x["end"]), F.lit(False))
            return F.filter(e["every"], lambda x, i: (x["no"] == 1) & ~met(x, i))

        return _let(F.struct(every.alias("every"), reach.alias("reach")), alone)

    spans = _let(both, free)

    def judged(x: Column) -> Column:
        def scored(token: Column) -> Column:
            fits = [token.rlike(f"^[{alphabet}]+$") for _, alphabet in ENCODINGS[:-1]]
            first = reduce(lambda rest, i: F.when(fits[i], F.lit(i)).otherwise(rest), reversed(range(len(fits))), F.lit(len(fits)))
            by = lambda no, made: reduce(lambda rest, i: F.when(no == i, made(i)).otherwise(rest), range(len(fits)), made(len(fits)))
            return _let(first, lambda no: F.struct(x["start"].alias("start"), x["end"].alias("end"), by(no, lambda i: _class(token, i)).alias("cls"), by(no, lambda i: _p(token, ENCODINGS[i][1])).alias("p")))

        return _let(F.translate(x["m"], "-_", "+/"), scored)

    return F.when(text.rlike(TOKEN), F.transform(spans, judged)).otherwise(F.expr(f"cast(array() as {RANDOM})"))


def _bars(tokens: DataFrame, rate: float) -> dict[int, float]:
    """For each class the greatest p-value that Benjamini-Hochberg rejects, from counts in quarter decades.

    The driver gets a row for each class and quarter decade at most (5 * 64 * 81), however many tokens there are.
    """
    bins = F.least(F.lit(80), F.floor(-4 * F.log10(F.greatest(F.col("p"), F.lit(1e-300))))).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for cls, b, n in tokens.groupBy("cls", bins.alias("b")).count().collect():
        counts.setdefault(cls, {})[b] = n
    bars = {}
    for cls, by in counts.items():
        whole, found = sum(by.values()), 0
        for b in sorted(by, reverse=True):
            found += by[b]
            if 10 ** (-b / 4) * whole <= rate * found:
                bars[cls] = 10 ** (-b / 4)
    return bars


def scan(df: DataFrame, text_col: str = "text", rate: float = 0.05, scratch: Scratch | None = None, carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with ``base_spans`` and ``spans``: arrays of (start, kind_no, end), sorted.

    Offsets are in code points, ends are exclusive, kind_no indexes ``KINDS``. ``base_spans`` has the fixed
    patterns' matches, ``spans`` also the random tokens, which never overlap those. Null text counts as empty.
    Columns of ``df`` named like the two results are replaced, also among ``carry``. Repeated rows are scanned each. An empty table gives an empty result. The tokens'
    p-values are gathered over all rows before any is judged.
    """
    scratch = scratch or Scratch(df.sparkSession)
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("base_spans", "spans")]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text, cols = F.col("text"), [f"c{i}" for i in range(len(carry))]
    assign = _kind(text, ASSIGN, 0, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = _kind(text, ACCESS, 1, lambda x: F.length(x["m"]) >= 20)
    found = rows.select(*cols, F.array_sort(F.concat(assign, access, _kind(text, HEX, 2, lambda x: F.lit(True)))).alias("base"), "text")
    found = scratch.keep(found.select(*cols, "base", _random(text, F.col("base")).alias("tokens")))
    bars = _bars(found.select(F.explode("tokens").alias("t")).select("t.cls", "t.p"), rate)
    bar = reduce(lambda rest, x: lambda c: F.when(c == x[0], F.lit(x[1])).otherwise(rest(c)), bars.items(), lambda c: F.lit(0.0))
    kept = F.transform(F.filter("tokens", lambda t: t["p"] > bar(t["cls"])), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind_no"), t["end"].alias("end")))
    return found.select(*cols, "base", F.array_sort(F.concat("base", kept)).alias("spans")).toDF(*carry, "base_spans", "spans")


def named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap become one."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    number = lambda x: F.floor(x / CHUNK).cast("int")

    def cut(p: Column, a: Column, b: Column) -> Column:
        return F.substring(F.array_join(F.slice(p, number(a) + 1, number(b) - number(a) + 1), ""), a % CHUNK + 1, b - a)

    def marked(x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        pieces = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(x["parts"], before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(x["parts"], before(F.size(x["spans"])), F.length(text)))

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return _let(F.struct(spans.alias("spans"), reach.alias("reach"), parts.alias("parts")), marked)
