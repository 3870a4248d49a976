"""Text expressions: extraction from markup, normalisation, tokens, loops, omissions, scores.

All are plain Column expressions unless a function says otherwise, so they stay in generated code.
"""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from .binding import let, running

#: White space as Unicode has it, spelt out: Java's and RE2's \s are ASCII, and differ by \v.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Entities that the native unescape knows; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: What an incomplete transcription says, fixed values.
BREVITY = r"(?i)omitted\s+for\s+brevity"
COMMENT = r"(?is)<!--(?:(?!-->).)*(?:\.{3,}|…+|omit(?:ted|s|ting)?|brevity|remainder|continues?)(?:(?!-->).)*-->"
REST = r"(?is)(?:the\s+)?(?:rest|remainder)\s+of\s+(?:the\s+)?(?:page|document|text|content|letter|letter\s+body|body).{0,100}?(?:is\s+)?(?:omitted|not\s+transcribed|not\s+included)"
DUE = r"(?is)(?:page|document|text|content|letter|letter\s+body|body).{0,80}?(?:omitted|not\s+transcribed)\s+(?:for|due\s+to)\s+"
CLOSE_TAG = "</HistoricalDocument>"


def _unspaced(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def words(text: Column) -> Column:
    """What lies between white space."""
    return F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without white space at their ends, empty ones left out."""
    return F.filter(F.transform(F.split(text, LINE_END), _unspaced), lambda x: x != "")


def unescape(text: Column) -> Column:
    """Replace the entities of ENTITIES; see unescape_all for every reference."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


@pandas_udf(StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """Every character reference of HTML (an Arrow UDF)."""
    return text.map(html.unescape, na_action="ignore")


def visible_text(raw: Column, every_entity: bool = False) -> Column:
    """What a reader sees of generated markup; a code fence and metadata go, closing tags end lines."""
    v = F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", "")
    v = F.regexp_replace(v, rf"^(?i:```(?:xml|markdown|text)?){SPACE}*", "")
    v = F.regexp_replace(v, rf"{SPACE}*```$", "")
    v = F.regexp_replace(v, rf"(?is)<Metadata\b[^>]*>.*?</Metadata>{SPACE}*", "")
    v = F.regexp_replace(v, rf"(?i)<br{SPACE}*/?>", "\n")
    v = F.regexp_replace(v, rf"(?i)</(?:Line|Header|Paragraph|TextBlock|Page)>{SPACE}*", "\n")
    v = F.regexp_replace(v, "<[^>]+>", " ")
    v = unescape_all(v) if every_entity else unescape(v)
    return F.array_join(lines(v), "\n")


def clean_text(raw: Column) -> Column:
    """Tags become spaces; one line."""
    return _unspaced(unescape(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " ")))


def fold(text: Column) -> Column:
    """Case folding for the languages at hand: lower case, and ss for ß."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_for_scoring(text: Column) -> Column:
    """Folded, without punctuation (category P), white space as single spaces."""
    return _unspaced(F.regexp_replace(fold(text), r"\p{P}", ""))


@pandas_udf(StringType())
def normalize_nfkc(text: pd.Series) -> pd.Series:
    """The same with compatibility composition and full case folding (an Arrow UDF)."""

    def one(t: str) -> str:
        kept = (c for c in unicodedata.normalize("NFKC", t).casefold() if not unicodedata.category(c).startswith("P"))
        return " ".join("".join(kept).split())

    return text.map(one, na_action="ignore")


def unicode_words(text: Column) -> Column:
    """Folded words of letters and digits; apostrophes and hyphens inside a word are left out."""
    found = F.regexp_extract_all(fold(clean_text(text)), F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))


def ascii_words(text: Column) -> Column:
    """Folded ASCII words with at most one inner apostrophe or hyphen."""
    return F.transform(F.regexp_extract_all(unescape(text), F.lit("[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?"), F.lit(0)), fold)


def loop_words(raw: Column) -> Column:
    """Words for the loop detectors: tags out, folded, all but letters, digits, _ and ' out."""
    plain = F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), r"[^\p{L}\p{N}_']+", " ")
    return words(fold(plain))


def ngrams(w: Column, n: int) -> Column:
    """All runs of n entries, joined by a space; none if there are fewer."""
    def of(a: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(a) - (n - 1), F.lit(1)))
        return F.when(F.size(a) < n, F.array().cast("array<string>")).otherwise(F.transform(places, lambda i: F.array_join(F.slice(a, i, n), " ")))

    return let(w, of)


def ngram_hashes(w: Column, n: int) -> Column:
    """A 64-bit hash of each run of n entries."""
    def of(a: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(a) - (n - 1), F.lit(1)))
        return F.when(F.size(a) < n, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(F.slice(a, i, n))))

    return let(w, of)


def has_repetitive_loop(w: Column) -> Column:
    """At least eight words, and a run of two, three or four of them three times or more."""

    def often(a: Column, n: int) -> Column:
        def of(g: Column) -> Column:
            last = F.size(g) - 2
            places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.exists(places, lambda i: F.element_at(g, i) == F.element_at(g, i + 2))

        return let(F.array_sort(ngram_hashes(a, n)), of)

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return let(hashed, lambda a: (F.size(a) >= 8) & (often(a, 2) | often(a, 3) | often(a, 4)))


def _suffix_widths(a: Column, least: int, most: int) -> Column:
    """Widths of a block that stands three times at the end of an array, smallest first."""
    n = F.size(a)
    top = F.least(F.lit(most), F.floor(n / 3).cast("int"))
    widths = F.when(top >= least, F.sequence(F.lit(least), F.greatest(top, F.lit(least)))).otherwise(F.array().cast("array<int>"))
    last = lambda w, k: F.slice(a, n - k * w + 1, w)
    return F.filter(widths, lambda w: (last(w, 1) == last(w, 2)) & (last(w, 2) == last(w, 3)))


def repeated_line_suffix(ls: Column, most: int = 4) -> Column:
    """Number of lines of the smallest block of eight words or more that ends the lines three times; else null."""
    def of(a: Column) -> Column:
        n = F.size(a)
        enough = F.filter(_suffix_widths(a, 1, most), lambda w: F.size(words(F.array_join(F.slice(a, n - w + 1, w), " "))) >= 8)
        return F.get(enough, F.lit(0))

    return let(ls, of)


def repeated_word_suffix(w: Column) -> Column:
    """Number of words, 4 to 40, of the smallest block that ends the words three times; else null."""
    return let(w, lambda a: F.get(_suffix_widths(a, 4, 40), F.lit(0)))


def low_novelty_tail(w: Column) -> Column:
    """(duplicate_ngram_ratio, unique_word_ratio) of the last 64 words if these hardly bring anything new; else null."""
    tail = F.slice(w, F.greatest(F.size(w) - 63, F.lit(1)), 64)

    def of(x: Column) -> Column:
        dup = 1 - F.size(F.array_distinct(ngrams(x, 4))) / F.lit(61.0)
        unique = F.size(F.array_distinct(x)) / F.lit(64.0)
        return F.when((F.size(x) >= 64) & (dup >= 0.30) & (unique <= 0.60), F.struct(F.round(dup, 6).alias("duplicate_ngram_ratio"), F.round(unique, 6).alias("unique_word_ratio")))

    return let(tail, of)


def loop_verdict(ls: Column, w: Column) -> Column:
    """The first detector that fires: repeated_lines, repeated_words, low_novelty; else null."""
    return (
        F.when(repeated_line_suffix(ls).isNotNull(), "repeated_lines")
        .when(repeated_word_suffix(w).isNotNull(), "repeated_words")
        .when(low_novelty_tail(w).isNotNull(), "low_novelty")
    )


def incomplete_reasons(raw: Column, is_page: Column) -> Column:
    """Why a page's generation is incomplete; empty for lines and complete pages."""
    omitted = raw.rlike(BREVITY) | raw.rlike(COMMENT) | raw.rlike(REST) | raw.rlike(DUE)
    reasons = F.array(
        F.when(~F.contains(raw, F.lit(CLOSE_TAG)), F.lit("unclosed_historical_document")),
        F.when(omitted, F.lit("explicit_omission_placeholder")),
    )
    return F.when(is_page, F.filter(reasons, lambda r: r.isNotNull())).otherwise(F.array().cast("array<string>"))


def line_texts(raw: Column) -> Column:
    """Cleaned bodies of all <Line> elements, empty ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"(?is)<Line\b[^>]*>(.*?)</Line>"), F.lit(1)), clean_text), lambda x: x != "")


def line_spans(raw: Column) -> Column:
    """Array of (start, end) in code points, end exclusive, of all <Line> elements."""
    pattern = r"(?is)<Line\b[^>]*>.*?</Line>"
    found, gaps = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), F.split(raw, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

    def placed(x: Column) -> Column:
        before = running(x, lambda e: e["g"] + e["m"], F.lit(0), lambda p, q: p + q, "int")
        return F.zip_with(x, before, lambda e, at: F.struct((at + e["g"]).alias("start"), (at + e["g"] + e["m"]).alias("end")))

    return let(sizes, placed)


def token_spans(raw: Column, lengths: Column) -> Column:
    """For each <Line> element the tokens that it touches, as (first, last exclusive); ``lengths`` has the
    code points of each token, in the order in which they make up ``raw``."""
    begin = running(lengths, lambda n: n, F.lit(0), lambda p, q: p + q, "int")

    def of(starts: Column) -> Column:
        ends = F.zip_with(starts, lengths, lambda b, n: b + n)
        return F.transform(line_spans(raw), lambda s: F.struct(F.size(F.filter(ends, lambda e: e <= s["start"])).alias("first"), F.size(F.filter(starts, lambda b: b < s["end"])).alias("last")))

    return let(begin, of)


def line_values(raw: Column, lengths: Column, trace: Column) -> Column:
    """For each <Line> element the median of its tokens' values, null without any. ``trace`` begins with the
    value of the second token, as the first has none."""
    def middle(a: Column) -> Column:
        return let(F.array_sort(a), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)

    def value(s: Column) -> Column:
        first = F.greatest(s["first"] - 1, F.lit(0))
        own = F.filter(F.slice(trace, first + 1, F.greatest(s["last"] - 1 - first, F.lit(0))), lambda v: v.isNotNull())
        return F.when(F.size(own) > 0, middle(own))

    return F.transform(token_spans(raw, lengths), value)


def safe_name(value: Column, default: str = "item", most: int = 80) -> Column:
    """A file name: other characters than A-Z a-z 0-9 _ . - become _."""
    v = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), F.lit("_."))
    return F.when(v == "", F.lit(default)).otherwise(F.left(v, F.lit(most)))


def parse_pages(value: Column) -> Column:
    """ "61-65,70" as sorted distinct numbers; a range that runs backwards is empty."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")

    def numbers(p: Column) -> Column:
        a = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("long")
        b = F.when(F.contains(p, F.lit("-")), F.split_part(p, F.lit("-"), F.lit(2)).try_cast("long")).otherwise(a)
        return F.when(b < a, F.array().cast("array<bigint>")).otherwise(F.sequence(a, F.greatest(a, b)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


#: What a line of output says about progress, and the names of metrics that are shown.
RATIOS = [r"(?i)\bepoch\s*[:#]?\s*(\d+)\s*(?:/|of)\s*(\d+)\b", r"(?i)\b(?:item|page|batch|step|file)s?\s*[:#]?\s*(\d+)\s*(?:/|of)\s*(\d+)\b", r"(?:^|[^\d.])(\d+)\s*/\s*(\d+)(?:[^\d.]|$)"]
JSON_PAIRS = [("current", "total"), ("processed", "total"), ("completed", "total"), ("epoch", "epochs"), ("page", "pages"), ("page", "pages_total"), ("item", "items_total")]


def parse_progress(line: Column) -> Column:
    """(current, total) of one line of output: JSON pairs, then ratios, then a percentage; null if none."""
    clean = F.trim(F.regexp_replace(line, r"\x1b\[[0-?]*[ -/]*[@-~]", ""))
    tries = []
    for a, b in JSON_PAIRS:
        x, y = (F.get_json_object(clean, f"$.{k}").try_cast("double") for k in (a, b))
        tries.append(F.when(clean.startswith("{") & x.isNotNull() & (y > 0), F.struct(x.alias("current"), y.alias("total"))))
    for pattern in RATIOS:
        x, y = (F.regexp_extract(clean, pattern, k).try_cast("double") for k in (1, 2))
        tries.append(F.when(clean.rlike(pattern) & (y > 0), F.struct(x.alias("current"), y.alias("total"))))
    percent = F.regexp_extract(clean, r"(?:^|[^\d.])(100|\d{1,2})(?:\.\d+)?\s*%", 1).try_cast("double")
    tries.append(F.when(percent.isNotNull(), F.struct(percent.alias("current"), F.lit(100.0).alias("total"))))
    return F.coalesce(*tries)


LINE_METRICS = ["loss", "train_loss", "validation_loss", "validation_iou", "iou", "f1", "cer", "wer", "accuracy"]


def line_metrics(line: Column) -> Column:
    """The numbers that a line which is a JSON object has under LINE_METRICS, as a map."""
    return numbers_of(F.trim(F.regexp_replace(line, r"\x1b\[[0-?]*[ -/]*[@-~]", "")), LINE_METRICS)


def numbers_of(json: Column, names: list[str]) -> Column:
    """A map of the finite numbers under ``names`` of a JSON object; strings, booleans and others are left out."""
    parsed = F.try_parse_json(json)
    value = lambda k: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(parsed, f"$.{k}", "double"))
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in names)), lambda e: e["value"].isNotNull())
    return F.when(F.startswith(F.trim(json), F.lit("{")) & parsed.isNotNull(), F.map_from_entries(entries)).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:double>>")))


def argument_value(command: Column, *flags: str) -> Column:
    """The value of --flag v or --flag=v in a command line, for the first place where one of the flags stands; null if there is none."""
    found = F.regexp_extract(command, rf"(?:^|\s)--(?:{'|'.join(flags)})(?:=|\s+)(\S+)", 1)
    return F.when(found != "", found)


def human_name(command: Column) -> Column:
    """The stem of the first script among a command's arguments, else of the program, with spaces for _."""
    script = F.regexp_extract(command, r"\s(?:\S*/)?([^\s/]+)\.(?:py|sh|ps1)(?=\s|$)", 1)
    program = F.regexp_extract(command, r"^\s*(?:\S*/)?([^\s/]+)", 1)
    return F.replace(F.when(script != "", script).when(program != "", program).otherwise("unknown job"), F.lit("_"), F.lit(" "))


def char_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b).cast("long")


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance of word lists: each different word becomes one character, then levenshtein.

    Characters from U+10000 on stand for the words, which are enough for a million different ones in
    a pair. Time goes with the product of the lengths, as for every exact edit distance.
    """
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.lit(65536) + i), 8, "0")), "UTF-32")

    def of(known: Column) -> Column:
        code = lambda w: F.array_join(F.transform(w, lambda x: char(F.array_position(known, x))), "")
        return F.levenshtein(code(a), code(b)).cast("long")

    return let(F.array_distinct(F.concat(a, b)), of)


def score(target: Column, prediction: Column) -> Column:
    """The struct of counts and rates of a target and a prediction."""
    def of(x: Column) -> Column:
        t, p, tw, pw = (x[k] for k in ("t", "p", "tw", "pw"))
        edits = F.struct(char_edits(t, p).alias("c"), word_edits(tw, pw).alias("w"))
        return let(edits, lambda e: F.struct(
            t.alias("target_normalized"), p.alias("prediction_normalized"), e["c"].alias("character_edits"), F.length(t).cast("long").alias("target_characters"), e["w"].alias("word_edits"), F.size(tw).cast("long").alias("target_words"),
            F.length(p).cast("long").alias("prediction_characters"), F.size(pw).cast("long").alias("prediction_words"), (e["c"] / F.greatest(F.lit(1), F.length(t))).alias("cer"), (e["w"] / F.greatest(F.lit(1), F.size(tw))).alias("wer"), (t == p).alias("exact"),
        ))

    both = F.struct(normalize_for_scoring(target).alias("t"), normalize_for_scoring(prediction).alias("p"))
    return let(both, lambda n: let(F.struct(n["t"].alias("t"), n["p"].alias("p"), words(n["t"]).alias("tw"), words(n["p"]).alias("pw")), of))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest-match ratio of two word lists or strings, in this order (an Arrow UDF)."""

    def one(x: object, y: object) -> float:
        x, y = (v if isinstance(v, str) else list(v) for v in (x, y))
        return SequenceMatcher(None, x, y, autojunk=False).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def line_similarity(a: Column, b: Column) -> Column:
    """0.72 of the words' ratio and 0.28 of the characters'; 0 if a side has no word."""
    return words_similarity(unicode_words(a), unicode_words(b))


def words_similarity(x: Column, y: Column) -> Column:
    """line_similarity() of lines whose words are known."""
    both = 0.72 * sequence_ratio(x, y) + 0.28 * sequence_ratio(F.array_join(x, " "), F.array_join(y, " "))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)


def containment(a: Column, b: Column, percent: int = 100) -> Column:
    """Shared words by the smaller set of words; 0 below four words on a side or three shared.

    ``percent`` weighs the shared words before they are divided, as the SQL has it: the last bit
    isn't always that of the weighed quotient, and decides between equal shares.
    """
    shared = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    enough = (F.least(F.size(a), F.size(b)) >= 4) & (shared >= 3)
    return F.when(enough, percent * shared / 100 / F.greatest(F.lit(1), least)).otherwise(F.lit(0.0))


def shares_four_words(a: Column, b: Column) -> Column:
    """Whether the lists have a run of four words in common, with four words and three shared ones at least."""
    return (containment(a, b) > 0) & F.arrays_overlap(ngrams(a, 4), ngrams(b, 4))


def substantial_similarity(a: Column, b: Column) -> Column:
    """The similarity that marks repetition: 1 for four shared words in a row, else the larger of the
    words' ratio and 0.82 of the containment. Python only sees pairs that the native part leaves open."""
    c = containment(a, b)
    open_ = (c > 0) & ~F.arrays_overlap(ngrams(a, 4), ngrams(b, 4))
    return F.when(c == 0, F.lit(0.0)).when(~open_, F.lit(1.0)).otherwise(F.greatest(sequence_ratio(a, b), 0.82 * c))

