"""Secret scans: base patterns, and a battery of randomness tests; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let, running
from .common import scope, scratch, table

#: Kind, pattern, whether the match counts.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
]
#: Shortest match; of assign, shortest group 2.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A run of characters that an encoding may have produced; shorter ones give the tests no power.
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Alphabets in the order in which an encoding is inferred: the first that has all characters of a token.
ALPHABETS = [
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase), ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_"),
]
#: p-values at which a class may be cut, and the lengths at which its length classes begin.
GRID = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]
LENGTHS = [16, 24, 32, 48]
#: Per length class, the part of identifiers made of words and numbers that reaches each p-value of
#: GRID, as measured on 60,000 generated ones of the encoding that holds them worst (base36).
IDENTIFIERS = [
    [0.74, 0.70, 0.63, 0.57, 0.47, 0.33, 0.22, 0.14, 0.095, 0.054], [0.50, 0.44, 0.35, 0.31, 0.23, 0.13, 0.068, 0.030, 0.018, 0.006],
    [0.23, 0.18, 0.13, 0.092, 0.064, 0.027, 0.012, 0.005, 0.002, 0.001], [0.010, 0.008, 0.006, 0.004, 0.003, 0.002, 0.001, 0.0005, 0.0003, 0.0001],
]
#: The part of random tokens that reaches each p-value of GRID, alike for all encodings and lengths; as measured on
#: 60,000 generated ones. The three tests aren't independent, so it lies above what the rule alone says.
RANDOM = [0.995, 0.993, 0.989, 0.983, 0.972, 0.947, 0.907, 0.833, 0.765, 0.648]
#: How many tokens of a class the measured parts weigh as much as.
PRIOR = 50


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping: array of (start, end, match) in code points.

    What lies between the matches is what split() leaves, so the places are running sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def placed(x: Column) -> Column:
        before = running(x, lambda e: e["g"] + F.length(e["m"]), F.lit(0), lambda p, q: p + q, "int")
        return F.zip_with(x, before, lambda e, at: F.struct((at + e["g"]).alias("start"), (at + e["g"] + F.length(e["m"])).alias("end"), e["m"].alias("m")))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, k, end), k the kind's place in KINDS, by start and kind."""
    return F.array_sort(F.concat(*(_kind(text, k) for k in range(len(KINDS)))))


def _kind(text: Column, k: int) -> Column:
    kind, pattern = KINDS[k]
    # A pattern that asks for the least length finds the same long runs, and is scanned quicker.
    scan = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}.get(kind, pattern)

    def long(m: Column) -> Column:
        size = F.length(F.regexp_extract(m["m"], pattern, 2)) if kind == "assign" else m["end"] - m["start"]
        return size >= LEAST[kind]

    return F.transform(F.filter(found(text, scan), long), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable; a rational approximation, exact to 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The place in ALPHABETS."""
    out = F.lit(len(ALPHABETS) - 1)
    for k in reversed(range(len(ALPHABETS) - 1)):
        out = F.when(token.rlike("^[" + ALPHABETS[k][1] + "]+$"), F.lit(k)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """(k, p): inferred encoding, and the p-value of the hypothesis that the characters are random.

    Three tests: chi-squared of uniform use of the alphabet with the exact mean and variance of its
    statistic, runs above and below the alphabet's middle, and serial correlation of neighbours;
    joined by Bonferroni's rule.
    """
    none = F.lit(0.0)

    def of_body(body: Column) -> Column:
        return let(encoding(body), lambda k: let(F.element_at(F.array(*(F.lit(a) for _, a in ALPHABETS)), k + 1), lambda a: of_chars(body, k, a)))

    def of_chars(body: Column, k: Column, alphabet: Column) -> Column:
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        # - and _ stand for + and / in the other variant of base64.
        both = lambda c: let(F.transform(c, lambda x: F.pmod(F.instr(alphabet, x) - 1, F.lit(64))), lambda i: tests(c, i, k, F.least(F.length(alphabet), F.lit(64)) - 1))
        return let(chars, both)

    def tests(chars: Column, index: Column, k: Column, df: Column) -> Column:
        n = F.size(chars).cast("double")
        squares = F.aggregate(F.array_distinct(chars), none, lambda s, c: s + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), 2))
        p_chi = let(squares, lambda q: _upper_tail(((df + 1) * q / n - n - df) / F.sqrt(2 * df * (n - 1) / n)))
        pairs = lambda a, f: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), f)
        total = lambda a: F.aggregate(a, none, lambda s, x: s + x)

        def of_runs(high: Column) -> Column:
            runs = 1 + total(pairs(high, lambda a, b: (a != b).cast("int")))
            return let(F.struct(total(high).alias("n1"), runs.alias("r")), lambda v: run_test(v["n1"], n - v["n1"], v["r"]))

        def run_test(n1: Column, n0: Column, runs: Column) -> Column:
            mean = 1 + 2 * n1 * n0 / n
            var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
            return F.when((n1 == 0) | (n0 == 0), none).otherwise(2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var)))

        def serial(mu: Column) -> Column:
            ss = F.greatest(F.aggregate(index, none, lambda s, x: s + F.pow(x - mu, 2)), F.lit(1e-9))
            r = total(pairs(index, lambda a, b: (a - mu) * (b - mu))) / ss
            return let(F.abs(r + 1 / n) * F.sqrt(n), lambda z: 2 * _upper_tail(z))

        p_runs = let(F.transform(index, lambda i: (i >= (df + 1) / 2).cast("int")), of_runs)
        p = F.least(p_chi, p_runs, let(total(index) / n, serial))
        return F.struct(k.alias("k"), F.least(F.lit(1.0), 3 * p).alias("p"))

    return let(F.regexp_replace(token, "=+$", ""), of_body)


def candidates(text: Column) -> Column:
    """Array of (start, end, c, p): tokens with a letter and a digit; c joins encoding and length class."""
    mixed = F.filter(found(text, TOKEN), lambda m: m["m"].rlike("[0-9]") & m["m"].rlike("[A-Za-z]"))

    def one(m: Column) -> Column:
        n = m["end"] - m["start"]
        size = sum(F.when(n >= least, 1).otherwise(0) for least in LENGTHS[1:])
        return let(battery(m["m"]), lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), (b["k"] * len(LENGTHS) + size).alias("c"), b["p"].alias("p")))

    return F.transform(mixed, one)


def _found_in(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [base_spans(text).alias("base"), candidates(text).alias("cand")]


def scan(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of ``docs``), base (see base_spans) and cand (see candidates)."""
    return docs.select(F.struct(*docs.columns).alias("row"), *_found_in(F.col("text")))


def thresholds(scanned: DataFrame, rate: float = 0.05) -> dict[int, float]:
    """The least p per class of encoding and length at which at most ``rate`` of what passes is text.

    False-discovery control: of random tokens a known part reaches each p, and hardly any text
    reaches one half, so those that do tell how many random tokens a class has; what passes beyond
    their part is taken for text. That estimate is shrunk towards the share that IDENTIFIERS gives
    for tokens of this length, half of them text, with the weight of PRIOR tokens; so a class with a
    few tokens is judged by its length, one with many by its own. Short tokens, of which text passes
    easily, need a class with many random ones. One row per class with a count per step of GRID
    reaches the driver, 20 at most.
    """
    c = scanned.select(F.explode("cand").alias("x")).groupBy("x.c").agg(
        *(F.count_if(F.col("x.p") >= t).alias(f"t{i}") for i, t in enumerate(GRID))
    )
    out = {}
    for row in c.collect():
        random = row[f"t{len(GRID) - 1}"] / RANDOM[-1]
        for i, t in enumerate(GRID):
            passing, text = row[f"t{i}"], IDENTIFIERS[row["c"] % len(LENGTHS)][i]
            false = max(0.0, passing - random * RANDOM[i]) + PRIOR * text / (text + RANDOM[i])
            if passing and false <= rate * (passing + PRIOR):
                out[row["c"]] = t
                break
    return out


def added(at: dict[int, float]) -> Column:
    """Spans of kind random: candidates that pass; a token within a base span has one of its own."""
    limit = lambda c: F.coalesce(*(F.when(c == k, F.lit(t)) for k, t in at.items()), F.lit(2.0))
    passing = F.filter("cand", lambda x: x["p"] >= limit(x["c"]))
    return F.transform(passing, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _ in KINDS), F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """``docs`` with each found span replaced by ``mask``; columns, rows and their order stay.

    Defined cases: null texts stay null; overlapping spans are covered by one mask; an empty table
    gives no rows; repeated rows are treated alike; n_chars, where there, follows the new text;
    columns may have any name, as they stay within a struct.
    """
    with scope():
        at = thresholds(scratch(docs.select(*_found_in(F.col("text"))[1:])), rate)
    d = scan(docs).select("row", F.array_sort(F.concat("base", added(at))).alias("spans"))
    text = F.col("row.text")

    def masked(spans: Column) -> Column:
        # Up to where the text is done before each span; a span that begins earlier adds nothing.
        done = running(spans, lambda s: s["end"], F.lit(0), F.greatest, "int")
        piece = lambda s, to: F.when(s["start"] >= to, F.concat(text.substr(to + 1, s["start"] - to), F.lit(mask))).otherwise("")
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(spans, done, piece), ""), text.substr(last + 1, F.length(text)))

    hit = text.isNotNull() & (F.size("spans") > 0)
    new = F.when(hit, let(F.col("spans"), masked)).otherwise(text)
    row = F.col("row").withField("text", new)
    if "n_chars" in docs.columns:
        row = let(row, lambda r: r.withField("n_chars", F.when(hit, F.length(r["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(r["n_chars"])))
    return d.select(row.alias("row")).select("row.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scratch(table(spark, sf_dir, "documents").select("doc_id", *_found_in(F.col("text"))))
    at = thresholds(s)
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return s.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(KINDS)),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", added(at)))).alias("spans"),
    )
