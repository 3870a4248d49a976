"""Queries over texts: extraction, normalisation, tokens, omissions, loops, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binding import let
from ..operators.similarity import COUNTERFACTUAL, GROUNDING, align_lines, repetition_pairs, tail_guard, without_tail
from . import sql
from .registry import query, table

c = F.col


@query(f"select page_id, {sql.visible_text('html')} as visible_text from pages")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.visible_text(c("html")).alias("visible_text"))


@query(f"select page_id, {sql.clean_text('html')} as clean_text from pages")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.clean_text(c("html")).alias("clean_text"))


_P = r"(?is)<p\b[^>]*>(.*?)</p>"


@query(f"select page_id, i::bigint as line_index, {sql.clean_text('x')} as line_text from (select page_id, unnest(l) as x, unnest(range(0, len(l))) as i from (select page_id, regexp_extract_all(html, {sql.quoted(_P)}, 1) as l from pages)) where {sql.clean_text('x')} <> ''")
def extract_lines(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_P), F.lit(1))).alias("i", "x"))
    return found.select("page_id", c("i").cast("long").alias("line_index"), t.clean_text(c("x")).alias("line_text")).where("line_text <> ''")


@query("with p as (select page_id, '<Line n=\"1\">' || replace(replace(replace(html, '<p>', '</Line><Line>'), '</p>', '</Line>'), '<h1>', '<line>') as x from pages) select page_id, len(list_filter(list_transform(regexp_extract_all(x, '(?is)<Line\\b[^>]*>(.*?)</Line>', 1), lambda s: " + sql.clean_text("s") + "), lambda s: s <> ''))::bigint as line_count from p")
def tagged_lines(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit('<Line n="1">'), F.replace(F.replace(F.replace(c("html"), F.lit("<p>"), F.lit("</Line><Line>")), F.lit("</p>"), F.lit("</Line>")), F.lit("<h1>"), F.lit("<line>")))
    return table(spark, d, "pages").select("page_id", F.size(t.line_texts(x)).cast("long").alias("line_count"))


@query(f"select doc_id, {sql.normalized('text')} as normalized from documents")
def normalize_scoring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.normalize_for_scoring(c("text")).alias("normalized"))


@query()
def normalize_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.normalize_nfkc("text").alias("normalized"))


@query()
def visible_text_all_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.visible_text(c("html"), every_entity=True).alias("visible_text"))


@query(f"select doc_id, len({sql.words(sql.normalized('text'))})::bigint as n_words, len({sql.loop_words('text')})::bigint as n_loop_words, len({sql.ascii_words('text')})::bigint as n_ascii_words, array_to_string({sql.ascii_words('text')}, ' ') as ascii_words from documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    x = c("text")
    both = table(spark, d, "documents").select("doc_id", "text", let(t.ascii_words(x), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("all"))).alias("a"))
    return both.select(
        "doc_id", F.size(t.words(t.normalize_for_scoring(x))).cast("long").alias("n_words"), F.size(t.loop_words(x)).cast("long").alias("n_loop_words"),
        c("a.n").alias("n_ascii_words"), c("a.all").alias("ascii_words"),
    )


@query("select page_id, case when v = '' then 'item' else left(v, 80) end as safe_name from (select page_id, trim(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '_.') as v from pages)")
def safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.safe_name(c("url")).alias("safe_name"))


_RAW = "case when doc_id % 3 = 0 then text || '</HistoricalDocument>' when doc_id % 3 = 1 then text || '<!-- the rest ... -->' else text || ' The remainder of the page is omitted' end"


@query(f"select doc_id, array_to_string(list_filter([case when not contains(x, '</HistoricalDocument>') then 'unclosed_historical_document' end, case when {sql.omitted('x')} then 'explicit_omission_placeholder' end], lambda r: r is not null), ',') as reasons from (select doc_id, {_RAW} as x from documents)")
def incomplete_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("x"))
    return docs.select("doc_id", F.array_join(t.incomplete_reasons(c("x"), F.lit(True)), ",").alias("reasons"))


_WORDS_SQL = f"with w as materialized (select doc_id, {sql.loop_words('text')} as w, {sql.lines('text')} as ls from documents)"


@query(f"{_WORDS_SQL} select doc_id, {sql.suffix_width('ls', 1, 4, 'len(' + sql.words('array_to_string(ls[len(ls) - w + 1 : len(ls)], chr(32))') + ') >= 8')}::bigint as block_lines from w")
def repeated_line_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.repeated_line_suffix(t.lines(c("text"))).cast("long").alias("block_lines"))


@query(f"{_WORDS_SQL} select doc_id, {sql.suffix_width('w.w', 4, 40).replace('lambda w:', 'lambda k:').replace(' * w ', ' * k ').replace('* w]', '* k]')}::bigint as block_words from w")
def repeated_word_suffix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", t.loop_words(c("text")).alias("w"))
    return docs.select("doc_id", t.repeated_word_suffix(c("w")).cast("long").alias("block_words"))


_TAIL_SQL = f"{_WORDS_SQL}, s as materialized (select doc_id, w, w[greatest(len(w) - 63, 1) : len(w)] as tail from w), r as (select doc_id, w, 1 - len(list_distinct({sql.ngrams('tail', 4)})) / 61.0 as d, len(list_distinct(tail)) / 64.0 as u from s)"


@query(f"{_TAIL_SQL} select doc_id, round(d::double, 6) as duplicate_ngram_ratio, round(u::double, 6) as unique_word_ratio from r where len(w) >= 64 and d >= 0.3 and u <= 0.6")
def low_novelty_tail(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", t.loop_words(c("text")).alias("w"))
    return docs.select("doc_id", t.low_novelty_tail(c("w")).alias("r")).where("r is not null").select("doc_id", "r.*")


@query(f"{_WORDS_SQL}, g as materialized (select doc_id, w, list_sort({sql.ngrams('w', 2)}) as a, list_sort({sql.ngrams('w', 3)}) as b, list_sort({sql.ngrams('w', 4)}) as c from w) select doc_id, len(w) >= 8 and (" + " or ".join(f"len(list_filter(range(1, len({x}) - 1), lambda i: {x}[i] = {x}[i + 2])) > 0" for x in "abc") + ") as has_loop from g")
def has_loop(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", t.loop_words(c("text")).alias("w"))
    return docs.select("doc_id", t.has_repetitive_loop(c("w")).alias("has_loop"))


_VERDICT_SQL = f"""{_TAIL_SQL}, v as materialized (select w.doc_id,
  {sql.suffix_width('ls', 1, 4, 'len(' + sql.words('array_to_string(ls[len(ls) - w + 1 : len(ls)], chr(32))') + ') >= 8')} as by_line,
  {sql.suffix_width('w.w', 4, 40).replace('lambda w:', 'lambda k:').replace(' * w ', ' * k ').replace('* w]', '* k]')} as by_word from w)
select v.doc_id, case when by_line is not null then 'repeated_lines' when by_word is not null then 'repeated_words' when len(r.w) >= 64 and d >= 0.3 and u <= 0.6 then 'low_novelty' end as verdict from v join r on r.doc_id = v.doc_id"""


@query(_VERDICT_SQL)
def loop_verdict(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", t.lines(c("text")).alias("ls"), t.loop_words(c("text")).alias("w"))
    return docs.select("doc_id", t.loop_verdict(c("ls"), c("w")).alias("verdict"))


_PAIRS_SQL = f"with l as (select doc_id, unnest(ls) as x, unnest(range(0, len(ls))) as i from (select doc_id, {sql.lines('text')} as ls from documents)), w as materialized (select doc_id, i, {sql.ascii_words('x')} as w from l), p as materialized (select r.doc_id, r.i as rgt, l.i as lft, l.w as a, r.w as b, len(list_intersect(l.w, r.w)) as shared from w l join w r on l.doc_id = r.doc_id and l.i < r.i and l.i >= r.i - 10 where len(l.w) >= 4 and len(r.w) >= 4), s as (select *, case when len(list_intersect({sql.ngrams('a', 4)}, {sql.ngrams('b', 4)})) > 0 then 1.0 else 0.82 * shared / least(len(list_distinct(a)), len(list_distinct(b))) end as sim from p where shared >= 3), b as materialized (select doc_id, rgt::bigint as right_line, arg_max(lft, (sim, -lft))::bigint as left_line, round(max(sim)::double, 6) as similarity from s where sim >= 0.68 group by doc_id, rgt)"


@query(f"{_PAIRS_SQL} select * from b")
def repetition_pairs_native(spark: SparkSession, d: str) -> DataFrame:
    """The best earlier line within ten lines, by containment and shared runs of four words."""
    return repetition_pairs(_lines(spark, d), exact=False)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.lines(c("text"))).alias("line", "x"))


@query()
def repetition_pairs_full(spark: SparkSession, d: str) -> DataFrame:
    return repetition_pairs(_lines(spark, d), exact=True)


@query()
def line_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a turn aligned with those of the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return align_lines(turns.select("conv_id", "turn", t.lines(c("before")).alias("page"), t.lines(c("text")).alias("visual")), ["conv_id", "turn"])


def _guard_sql(ratio: float, floor: float | None, names: tuple[str, ...]) -> str:
    late, few, weak, rests, unsafe, cut = names
    most = f"mid * {ratio}" if floor is None else f"least({floor}, mid * {ratio})"
    floor_gate = "" if floor is None else f"when mid < {floor} then '{weak}'"
    return f"""{_PAIRS_SQL}, gained as materialized (select doc_id, list(gain order by i) as g from (select doc_id, i, case when length(x) % 13 = 0 then null else (length(x) * 7919 % 100) / 1000.0 end::double as gain from l) group by doc_id),
firsts as (select n.doc_id, g, coalesce(k, 0) as k, first from gained n left join (select doc_id, count(*) as k, min(left_line) as first from b group by doc_id) p on p.doc_id = n.doc_id),
parted as (select *, list_filter(g[greatest(first - 10, 0) + 1 : first], lambda x: x is not null) as prior, list_filter(g[first + 1 : len(g)], lambda x: x is not null) as tail from firsts),
levels as (select *, list_median(prior) as mid, list_median(tail) as finish from parted),
mosts as (select *, {most} as most from levels),
cuts as (select *, first + 1 - list_min(list_filter(range(1, 6), lambda j: j > 4 or first - j <= 1 or coalesce(g[greatest(first - j, 0) + 1] > most, true))) as cutoff from mosts),
decided as (select doc_id, len(g)::bigint as line_count, cutoff, case when k < 2 then 'insufficient_repetition_evidence' when first < 4 then '{late}' when least(len(prior), len(tail)) < 3 then '{few}' {floor_gate} when finish > most then '{rests}' when cutoff < greatest(3, floor(0.45 * len(g))) or len(g) - cutoff < 5 then '{unsafe}' else '{cut}' end as reason from cuts)
select doc_id, line_count, reason, case when reason = '{cut}' then cutoff end::bigint as cutoff from decided"""


def _gained(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a value each, made of their lengths; some are unknown."""
    size = F.length("x")
    return _lines(spark, d).withColumn("gain", F.when(size % 13 != 0, (size * 7919 % 100) / F.lit(1000.0)))


@query(_guard_sql(0.40, 0.02, COUNTERFACTUAL))
def guarded_tails(spark: SparkSession, d: str) -> DataFrame:
    """The tail guard's decision for each document, from the native pairs."""
    return tail_guard(_gained(spark, d), exact=False)


@query(_guard_sql(0.62, None, GROUNDING))
def grounded_tails(spark: SparkSession, d: str) -> DataFrame:
    """The same with the rules for attention values."""
    return tail_guard(_gained(spark, d), exact=False, grounding=True)


@query(f"with l as (select doc_id, {sql.lines('text')} as ls from documents), k as (select *, len(ls) // 2 as cutoff from l) select doc_id, sha256('<Page>' || array_to_string(list_transform(ls[1:cutoff], lambda s: '<Line n=\"1\">' || replace(s, '<', '') || '</Line>'), ' ') || case when cutoff = 0 then '' when cutoff < len(ls) then ' ' else '' end || '</Page>') as without_tail from k")
def tails_removed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tagged lines, without the second half of their lines."""
    x = table(spark, d, "documents").select("doc_id", t.lines(c("text")).alias("ls"))
    tagged = F.array_join(F.transform("ls", lambda s: F.concat(F.lit('<Line n="1">'), F.replace(s, F.lit("<"), F.lit("")), F.lit("</Line>"))), " ")
    x = x.select("doc_id", F.concat(F.lit("<Page>"), tagged, F.lit("</Page>")).alias("raw"), F.floor(F.size("ls") / 2).cast("int").alias("cutoff"))
    return x.select("doc_id", F.sha2(without_tail(c("raw"), c("cutoff")), 256).alias("without_tail"))


@query(f"with a as materialized (select doc_id, {sql.ascii_words('text')} as w from documents), b as materialized (select item_id, {sql.ascii_words('text')} as w from benchmark), ga as (select distinct doc_id, unnest({sql.ngrams('w', 4)}) as g from a), gb as (select distinct item_id, unnest({sql.ngrams('w', 4)}) as g from b), p as (select distinct doc_id, item_id from ga join gb using (g)) select p.doc_id, p.item_id, len(list_intersect(list_distinct(a.w), list_distinct(b.w)))::bigint as shared_words, round((len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / least(len(list_distinct(a.w)), len(list_distinct(b.w))))::double, 6) as containment from p join a on a.doc_id = p.doc_id join b on b.item_id = p.item_id")
def shared_4gram(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items with four words in a row in common, found by joining on the runs."""
    a = table(spark, d, "documents").select("doc_id", t.ascii_words(c("text")).alias("a"))
    b = table(spark, d, "benchmark").select("item_id", t.ascii_words(c("text")).alias("b"))
    ga = a.select("doc_id", F.explode(F.array_distinct(t.ngrams(c("a"), 4))).alias("g"))
    gb = b.select("item_id", F.explode(F.array_distinct(t.ngrams(c("b"), 4))).alias("g"))
    p = ga.join(gb, "g").select("doc_id", "item_id").distinct().join(a, "doc_id").join(b, "item_id")
    shared = F.size(F.array_intersect("a", "b"))
    least = F.least(F.size(F.array_distinct("a")), F.size(F.array_distinct("b")))
    return p.select("doc_id", "item_id", shared.cast("long").alias("shared_words"), F.round(shared / least, 6).alias("containment"))


@query("select event_id, array_to_string(list_sort(list_distinct(case when event_id % 4 = 3 then [] else range(event_id % 50, event_id % 50 + event_id % 6 + 1) end || [event_id % 9, event_id % 50])), ',') as pages from events")
def parse_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page ranges as text; every fourth runs backwards and is empty."""
    a, s = c("event_id") % 50, lambda x: x.cast("string")
    last = F.when(c("event_id") % 4 == 3, a - 1 - c("event_id") % 6).otherwise(a + c("event_id") % 6)
    spec = F.concat(F.when(last >= 0, F.concat(s(a), F.lit("-"), s(last))).otherwise(F.concat(s(a + 9), F.lit("-"), s(a))), F.lit(" , "), s(c("event_id") % 9), F.lit(",,"), s(a))
    return table(spark, d, "events").select("event_id", F.array_join(t.parse_pages(spec).cast("array<string>"), ",").alias("pages"))


_NUMBERED = f"with l as (select doc_id, {sql.lines('text')} as ls from documents), x as (select doc_id, list_transform(ls, lambda s: '<line>' || replace(s, '<', '') || '</line>') as ls from l), n as (select doc_id, unnest(ls) as s, unnest(range(1, len(ls) + 1)) as i, ls from x), p as (select doc_id, i, s, list_sum(list_transform(ls[1:i - 1], lambda q: length(q) + 1))::bigint as before from n)"


@query(f"{_NUMBERED}, b as (select *, coalesce(before, 0) as a, coalesce(before, 0) + length(s) as z from p), k as (select *, a // 5 as first, (z + 4) // 5 as last from b), v as (select *, list_transform(range(greatest(first - 1, 0), greatest(last - 1, greatest(first - 1, 0))), lambda t: case when t % 11 <> 4 then (t * 37 % 101) / 100.0 end::double) as own from k) select doc_id, i - 1 as line, a::bigint as start, z::bigint as finish, first::bigint as first_token, last::bigint as last_token, round(list_median(list_filter(own, lambda q: q is not null)), 6) as grounding from v")
def line_groundings(spark: SparkSession, d: str) -> DataFrame:
    """Where tagged lines lie in a text, which of its tokens (five characters each) they touch, and the median
    of these tokens' values."""
    x = table(spark, d, "documents").select("doc_id", F.transform(t.lines(c("text")), lambda s: F.concat(F.lit("<line>"), F.replace(s, F.lit("<"), F.lit("")), F.lit("</line>"))).alias("ls"))
    x = x.select("doc_id", F.array_join("ls", " ").alias("raw")).where("raw <> ''")
    n = F.ceil(F.length("raw") / 5).cast("int")
    trace = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: F.when(k % 11 != 4, (k * 37 % 101) / F.lit(100.0)))
    x = x.select("doc_id", "raw", F.array_repeat(F.lit(5), n).alias("lengths"), F.when(n > 1, trace).otherwise(F.array().cast("array<double>")).alias("trace"))
    z = F.arrays_zip(t.line_spans(c("raw")).alias("s"), t.token_spans(c("raw"), c("lengths")).alias("t"), t.line_values(c("raw"), c("lengths"), c("trace")).alias("v"))
    return x.select("doc_id", F.posexplode(z).alias("line", "z")).select("doc_id", c("line").cast("long").alias("line"), c("z.s.start").cast("long").alias("start"), c("z.s.end").cast("long").alias("finish"), c("z.t.first").cast("long").alias("first_token"), c("z.t.last").cast("long").alias("last_token"), F.round("z.v", 6).alias("grounding"))


_LINE = "case event_id % 5 when 0 then 'epoch ' || event_id % 7 || '/' || (event_id % 7 + 3) when 1 then '{\"processed\": ' || event_id % 50 || ', \"total\": 50}' when 2 then 'done ' || event_id % 101 || '% ok' when 3 then 'pages: ' || event_id % 9 || ' of 9' else 'loading' end"


@query(f"with l as (select event_id, {_LINE} as line from events) select event_id, case when event_id % 5 = 4 then null else regexp_extract(line, '(\\d+)', 1)::double end as current_value, case event_id % 5 when 1 then 50.0 when 2 then 100.0 when 4 then null else regexp_extract(line, '(\\d+)$', 1)::double end as total_value from l")
def parse_progress(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.expr(_LINE).alias("line")).withColumn("p", t.parse_progress(c("line")))
    return events.select("event_id", c("p.current").alias("current_value"), c("p.total").alias("total_value"))
