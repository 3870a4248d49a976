"""Pieces of the SQL that checks the queries, as functions of an expression."""

from __future__ import annotations

from ..functions.text import BREVITY, DUE, ENTITIES, LINE_END, NOT_SPACE, REST, SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {by}, 'g')"


def unspaced(x: str) -> str:
    return f"trim({replaced(x, SPACE + '+', quoted(' '))})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(NOT_SPACE + '+')})"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {quoted(LINE_END)}), lambda s: {unspaced('s')}), lambda s: s <> '')"


def unescape(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {quoted(name)}, {quoted(char)})"
    return x


def visible_text(x: str) -> str:
    v = replaced(x, f"^{SPACE}+|{SPACE}+$", "''")
    for pattern, by in (
        (rf"^(?i:```(?:xml|markdown|text)?){SPACE}*", "''"), (rf"{SPACE}*```$", "''"), (rf"(?is)<Metadata\b[^>]*>.*?</Metadata>{SPACE}*", "''"), (rf"(?i)<br{SPACE}*/?>", "chr(10)"),
        (rf"(?i)</(?:Line|Header|Paragraph|TextBlock|Page)>{SPACE}*", "chr(10)"), ("<[^>]+>", "' '"),
    ):
        v = replaced(v, pattern, by)
    return f"array_to_string({lines(unescape(v))}, chr(10))"


def clean_text(x: str) -> str:
    return unspaced(unescape(replaced(f"coalesce({x}, '')", "<[^>]+>", "' '")))


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def normalized(x: str) -> str:
    return unspaced(replaced(fold(x), r"\p{P}", "''"))


def loop_words(x: str) -> str:
    plain = replaced(replaced(x, "<[^>]+>", "' '"), r"[^\p{L}\p{N}_']+", "' '")
    return words(fold(plain))


def ascii_words(x: str) -> str:
    return f"list_transform(regexp_extract_all({unescape(x)}, {quoted('[A-Za-z0-9]+(?:[' + chr(39) + '’-][A-Za-z0-9]+)?')}), lambda s: {fold('s')})"


def ngrams(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i+{n - 1}], ' '))"


def suffix_width(a: str, least: int, most: int, extra: str = "true") -> str:
    """The first width of a block that ends the list three times."""
    part = lambda k: f"{a}[len({a}) - {k} * w + 1 : len({a}) - {k - 1} * w]"
    return f"list_filter(range({least}, least({most}, len({a}) // 3) + 1), lambda w: {part(1)} = {part(2)} and {part(2)} = {part(3)} and {extra})[1]"


def edits(a: str, b: str) -> str:
    """Edit distance of two lists, row by row."""
    row = f"list_transform(range(0, len({b}) + 1), lambda k: k::bigint)"
    cell = f"list_append(cur, least(prev[y[1] + 1] + 1, cur[y[1]] + 1, prev[y[1]] + case when {a}[x[1]] = {b}[y[1]] then 0 else 1 end))"
    inner = f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j::bigint]), lambda cur, y: {cell}, [x[1]])"
    return f"(list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i::bigint]), lambda prev, x: {inner}, {row}))[len({b}) + 1]"


def known_chars(a: str, b: str) -> str:
    return f"list_distinct(string_split({a} || {b}, ''))"


def chars_edits(a: str, b: str, known: str) -> str:
    """Edit distance of strings: DuckDB's own counts bytes, so each different character becomes one byte,
    its place in column ``known`` (see known_chars)."""
    code = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position({known}, c)::int)), '')"
    return f"levenshtein({code(a)}, {code(b)})::bigint"


def omitted(x: str) -> str:
    """Any omission pattern; the one about comments without look-ahead, comment by comment."""
    inner = r"(?is)(?:\.{3,}|…+|omit(?:ted|s|ting)?|brevity|remainder|continues?)"
    comments = f"list_transform(regexp_extract_all({x}, '(?s)<!--.*?-->'), lambda c: c[5:-4])"
    any_ = f"len(list_filter({comments}, lambda c: regexp_matches(c, {quoted(inner)}))) > 0"
    return "(" + " or ".join([f"regexp_matches({x}, {quoted(p)})" for p in (BREVITY, REST, DUE)] + [any_]) + ")"
