"""Texts to passages: chunking by best split points, inspection, answer lines and segments, parsed blocks, imports and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as W
from ..functions import text as X
from ..operators import relational as R
from ..operators import splitting as P
from ..sources import office as O
from ..sources import readers as S
from ..sources.readers import table
from ..sources.scratch import scratch_path, written
from .base import query
from .search import _HITS, token_hits

# Least, wanted and most signs of a chunk.
LEAST, WANTED, MOST_SIGNS = 80, 220, 350

_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def tidy(c: Column) -> Column:
    """Blanks of each line collapsed, no blanks at its ends, at most one empty line in a row."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.trim(c, F.lit(" \n"))


@query(f"select doc_id, {_TIDY.format('text')} as clean from documents")
def tidy_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tidy(F.col("text")).alias("clean"))


_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
RULES = P.Rules(
    markers=[*W.THAI_BOUNDARIES, *W.BOUNDARIES], begins=[*W.THAI_BEGINS, *W.TIES], ends=[*W.THAI_ENDS, *W.TIES], descriptors=W.DESCRIPTORS, common=W.GENERIC, least=LEAST, wanted=WANTED, most=MOST_SIGNS
)
_BLANK = r"[ \t\x0B\f\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
_LINES = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\r\n?', chr(10), 'g'), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), "
    "'" + _BLANK.replace("{", "{{").replace("}", "}}") + r"', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
)
_MARKERS = "[" + ", ".join("'" + m + "'" for m, _ in RULES.markers) + "]"
_NEARER = "[" + ", ".join(str(n) for _, n in RULES.markers) + "]"


def _spots(t: str) -> str:
    """Where each marker stands in t: structs s (from 0), k."""
    return (
        f"flatten(list_transform(range(1, {len(RULES.markers) + 1}), lambda q: list_transform(range(1, len(string_split({t}, {_MARKERS}[q]))), "
        f"lambda x: {{'s': (list_sum(list_transform(string_split({t}, {_MARKERS}[q])[1:x], lambda y: length(y))) + (x - 1) * length({_MARKERS}[q]))::int, 'k': q::int}})))"
    )


def _cut(t: str) -> str:
    r, reach = RULES, max(24, (RULES.most - RULES.least) // 2)
    marker = f"list_sort(list_transform(list_filter({_spots(t)}, lambda x: x.s >= {r.least} and x.s <= length({t}) - {r.least}), lambda x: [abs(x.s - {r.wanted}) - {_NEARER}[x.k], x.k, x.s]))[1][3]"
    first, last = max(r.least, r.wanted - reach), f"least(length({t}) - {r.least}, {r.wanted + reach})"
    blank = f"list_sort(list_transform(list_filter(range({first}, {last} + 1), lambda p: substr({t}, p + 1, 1) in (' ', chr(10))), lambda p: [abs(p - {r.wanted}), p]))[1][2]"
    return f"case when length({t}) > {r.most} then coalesce({marker}, {blank}) end"


_ENDS = "' ' || chr(10)"
_ANY = lambda words: "(" + "|".join(words) + ")"
_TIED = (
    f"(length(a[len(a)]) + length(x[1]) <= {RULES.most} and (least(length(a[len(a)]), length(x[1])) <= {RULES.small} or regexp_matches(a[len(a)], '[,:;、，]$') "
    f"or regexp_matches(x[1], '^{_ANY(RULES.begins)}([ \\n]|$)') or regexp_matches(a[len(a)], '(^|[ \\n]){_ANY(RULES.ends)}$')))"
)


def _garbage(t: str) -> str:
    flat = rf"regexp_replace(lower({t}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
    return (
        rf"(length({flat}) < 12 or regexp_matches(lower({t}), '^(https?://|www\.)') or regexp_full_match({t}, '[0-9 \n.,\-/()]+') or replace({flat}, {flat}[1], '') = '' "
        rf"or length(regexp_replace({t}, '[\p{{L}}\p{{M}}\p{{N}} \n]', '', 'g')) > 0.5::double * length({t}))"
    )


_WORDS_OF = "string_split(plain, ' ')"


@query(
    rf"""with recursive t as (select doc_id, {_LINES.format('text')} as text from documents),
p as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as i from (select doc_id, regexp_split_to_array(text, '\n{{2,}}') as l from t)),
s as (select doc_id, i, trim(unnest(l), {_ENDS}) as s, generate_subscripts(l, 1) as j from (select doc_id, i, string_split(regexp_replace(p, '([!?;:ฯ])[ \n]+', '\1' || chr(1), 'g'), chr(1)) as l from p)),
c as (select *, case when length(s) > {RULES.most} then list_append(list_reduce(list_concat([[0]], list_transform(list_sort(list_distinct(list_transform({_spots('s')}, lambda x: x.s))), lambda x: [x])),
  lambda a, x: case when x[1] > 0 and x[1] - a[len(a)] >= {RULES.gap} and length(s) - x[1] >= {RULES.gap} then list_concat(a, x) else a end), length(s)) else [0, length(s)] end as cuts from s),
g as (select doc_id, format('{{:06d}}{{:06d}}{{:06d}}', i, j, k) as key, trim(substr(s, (cuts[k] + 1)::int, (cuts[k + 1] - cuts[k])::int), {_ENDS}) as txt from (select *, unnest(range(1, len(cuts))) as k from c)),
h as (
  select doc_id, key, txt, {_cut('txt')} as cut from g where txt <> ''
  union all
  select doc_id, key, txt, {_cut('txt')} from (
    select doc_id, key || side as key, trim(case side when '0' then substr(txt, 1, cut::int) else substr(txt, cut::int + 1) end, {_ENDS}) as txt
    from (select *, unnest(['0', '1']) as side from h where cut is not null))),
l as (select doc_id, list([txt] order by key) as l from h where cut is null and not {_garbage('txt')} group by doc_id),
m as (select doc_id, list_filter(list_reduce(l, lambda a, x: case when {_TIED} then list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || x[1]]) else list_concat(a, x) end), lambda y: not {_garbage('y')}) as m from l),
u as (select doc_id, unnest(m) as chunk, generate_subscripts(m, 1) - 1 as ordinal from m),
x as (select *, {_PLAIN.format('chunk')} as plain from u),
a as (select distinct w[n] || ' ' || w[n + 1] as phrase from (select w, unnest(range(1, len(w))) as n from (select regexp_extract_all(lower(text), '([\p{{L}}\p{{M}}\p{{N}}]+)', 1) as w from benchmark))),
f as (select doc_id, ordinal, phrase from x join a on contains(plain, phrase) qualify row_number() over (partition by doc_id, ordinal order by length(phrase) desc, phrase) = 1),
aw as (select distinct phrase, unnest(string_split(phrase, ' ')) as w from a), an as (select phrase, count(*) as n from aw group by 1),
xw as (select distinct doc_id, ordinal, unnest({_WORDS_OF}) as w from x anti join f using (doc_id, ordinal)),
b as (select doc_id, ordinal, phrase from (select doc_id, ordinal, phrase, count(*) as hits from xw join aw using (w) group by all) join an using (phrase)
  qualify row_number() over (partition by doc_id, ordinal order by 100 * hits / n::double + length(phrase) desc, phrase) = 1),
d as (select doc_id, ordinal, chunk, plain, coalesce(f.phrase, b.phrase, '') as anchor, case {' '.join(f"when regexp_matches(plain, '{p}') then '{name}'" for p, name in RULES.descriptors)} else '' end as described
  from x left join f using (doc_id, ordinal) left join b using (doc_id, ordinal))
select doc_id, ordinal::int as ordinal, chunk, left(case when anchor = '' and described = '' then array_to_string(list_filter(list_filter({_WORDS_OF}, lambda w, i: list_position({_WORDS_OF}, w) = i), lambda w: w not in ({W.quoted(W.GENERIC)}))[1:6], ' ')
  when anchor = '' then described when described = '' or contains(replace(anchor, ' ', ''), described) or contains(described, replace(anchor, ' ', '')) then anchor else anchor || ' ' || described end, 255) as keyword from d"""
)
def knowledge_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All passages of each text with a keyword. Paragraphs are cut behind signs that end a sentence, what is too long before markers, and what still is by halves at
    the best boundary; small or tied neighbours are merged and garbage goes. Anchors are the neighbouring words of the questions."""
    anchors = table(spark, sf, "benchmark").select(F.explode(X.bigrams(X.tokens(F.col("text")))).alias("phrase"))
    return P.passages(table(spark, sf, "documents").select("doc_id", "text"), RULES, anchors).withColumnRenamed("id", "doc_id")


# What each finding about a chunk costs, in order.
INSPECT = {
    "chunk_empty": 60, "chunk_garbage": 45, "chunk_too_short": 25, "chunk_too_long": 20, "keyword_empty": 25, "keyword_too_short": 12, "keyword_too_long": 15,
    "keyword_not_in_text": 18, "keyword_low_coverage": 12, "multi_topic": 18,
}
#: Topics by words, for texts that mix them.
TOPICS = {"money": ["eur", "usd", "%"], "time": ["day", "year", "heute"], "person": ["anna", "mr", "der "]}
_TOPIC_SQL = " + ".join("(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")::int" for words in TOPICS.values())


@query(
    rf"""with i as (select doc_id, text, {_PLAIN.format('text')} as plain, {_PLAIN.format('key')} as key, {_TOPIC_SQL} as topics, len(list_filter(regexp_split_to_array(text, '[.!?]\s+|\n+'), lambda x: trim(x) <> '')) as sentences
  from (select doc_id, text, array_to_string({W.first_distinct_sql('words', 2)}, ' ') as key from (select doc_id, text, {W.search_words_sql('text')} as words from documents))),
c as (select *, length(plain) as n, case when key = '' then 0 else len(list_filter(list_distinct(string_split(key, ' ')), lambda w: list_contains(string_split(plain, ' '), w))) / len(list_distinct(string_split(key, ' ')))::double end as cover from i),
f as (select doc_id, n, sentences, list_filter([case when trim(text) = '' then 'chunk_empty' end, case when n < 12 then 'chunk_garbage' end, case when n > 0 and n < {LEAST} then 'chunk_too_short' end, case when n > {MOST_SIGNS} then 'chunk_too_long' end,
  case when key = '' then 'keyword_empty' end, case when key <> '' and length(key) < 4 then 'keyword_too_short' end, case when length(key) > 60 then 'keyword_too_long' end, case when key <> '' and n > 0 and not contains(plain, key) then 'keyword_not_in_text' end,
  case when cover > 0 and cover < 0.5::double then 'keyword_low_coverage' end, case when topics >= 3 or topics >= 2 and (n > 180 or sentences >= 3) then 'multi_topic' end], lambda x: x is not null) as flags from c)
select doc_id, n as chunk_length, sentences, flags, greatest(0, 100 - coalesce(list_sum(list_transform(flags, lambda x: case x {' '.join(f"when '{k}' then {v}" for k, v in INSPECT.items())} end)), 0))::bigint as score from f"""
)
def chunk_inspection(spark: SparkSession, sf: str) -> DataFrame:
    """Findings about each text as a chunk with its first two search terms as keyword, its measures, and 100 less their costs."""
    d = table(spark, sf, "documents").select("doc_id", "text", X.normalise(F.col("text")).alias("plain"), X.normalise(F.array_join(F.slice(W.search_terms(F.col("text")), 1, 2), " ")).alias("key"))
    topics = sum((X.any_contains(F.lower("text"), words).cast("int") for words in TOPICS.values()), F.lit(0))
    sentences = F.size(F.filter(F.split("text", r"[.!?]\s+|\n+"), lambda x: F.trim(x) != ""))
    d = d.withColumns({"n": F.length("plain"), "topics": topics, "sentences": sentences, "cover": F.when(F.col("key") == "", 0.0).otherwise(X.coverage(F.split("key", " "), F.split("plain", " ")))})
    n, key, cover = F.col("n"), F.col("key"), F.col("cover")
    found = X.flags(
        ("chunk_empty", F.trim("text") == ""), ("chunk_garbage", n < 12), ("chunk_too_short", (n > 0) & (n < LEAST)), ("chunk_too_long", n > MOST_SIGNS),
        ("keyword_empty", key == ""), ("keyword_too_short", (key != "") & (F.length(key) < 4)), ("keyword_too_long", F.length(key) > 60),
        ("keyword_not_in_text", (key != "") & (n > 0) & ~F.contains("plain", "key")), ("keyword_low_coverage", (cover > 0) & (cover < 0.5)),
        ("multi_topic", (F.col("topics") >= 3) | ((F.col("topics") >= 2) & ((n > 180) | (F.col("sentences") >= 3)))),
    )
    cost = F.create_map(*[F.lit(x) for kv in INSPECT.items() for x in kv])
    score = F.greatest(F.lit(0), F.lit(100) - F.aggregate("flags", F.lit(0), lambda s, k: s + F.element_at(cost, k)))
    return d.withColumn("flags", found).select("doc_id", n.cast("long").alias("chunk_length"), F.col("sentences").cast("long").alias("sentences"), "flags", score.cast("long").alias("score"))


_COUNT = "len(regexp_extract_all({}, '{}'))"
# Signs of a broken text layer, and words of which a Thai document holds some. Counted patterns, in order.
GLYPHS = r"[\x{FFFD}\x{F70B}\x{F70A}\x{F70E}\x{F712}\x{F701}-\x{F709}\x{F710}]"
GARBLED = r"[็์ิีุู่้๊๋]{3,}|~็|็~|◊|Ë|‡|∫|≈|¡|¥|å|ì|î|ï|ñ|ó|ô|ö|ù|û|ü"
SYMBOLS = r"[\x{FFFD}\x{F700}-\x{F8FF}◊Ë‡∫≈¡¥åìîïñóôöùûü_^=<>\[\]{}|\\`]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
THAI_TERMS = "มาตรา สหกรณ์ สมาชิก คณะกรรมการ ประชุม นายทะเบียน พระราชบัญญัติ ข้อบังคับ กิจการ อำนาจ หน้าที่ ตาม และ หรือ ให้ ของ".split()
# What each finding costs.
PENALTIES = {
    "too_short": 35, "glyphs": 25, "glyph_share": 15, "thai_share": 20, "spaced_letters": 25, "garbled": "least(garbled, 20) * 2", "symbols": "least(35, symbols * 4)", "controls": "least(controls, 20)",
    "few_letters": 30, "no_thai_terms": 30, "few_thai_terms": 30,
}
_FINDS = {
    "too_short": "n < 80", "glyphs": "glyphs >= 4", "glyph_share": "n > 0 and glyphs > 0.01 * n", "thai_share": "latin + thai >= 120 and thai > 0 and thai < 0.35 * (latin + thai)", "spaced_letters": "spaced >= 20",
    "garbled": "garbled > 0", "symbols": "symbols >= 3", "controls": "controls > 5", "few_letters": "n >= 40 and latin + thai < 0.2 * n and digits >= 10", "no_thai_terms": "n >= 40 and thai >= 20 and terms = 0",
    "few_thai_terms": "n >= 80 and thai >= 40 and terms <= 1",
}
#: Findings after which another way of extraction is worth trying (garbled signs from two on).
_FALLBACK = "n < 80 or glyphs >= 4 or (n > 0 and glyphs > 0.01 * n) or (latin + thai >= 120 and thai > 0 and thai < 0.35 * (latin + thai)) or spaced >= 20 or garbled >= 2"
_COUNTED = {"latin": "[A-Za-z]", "thai": "[ก-๙]", "glyphs": GLYPHS, "spaced": "[ก-๙][ \n](?:[ก-๙])", "garbled": GARBLED, "symbols": SYMBOLS, "controls": CONTROLS, "digits": "[0-9๐-๙]"}
_SIGNS = r"[^\p{L}\p{M}\p{N}\s]"


@query(
    f"""with m as (select doc_id, length(text) as n, {', '.join(f"{_COUNT.format('text', p)} as {c}" for c, p in _COUNTED.items())}, {' + '.join(f"contains(text, '{t}')::int" for t in THAI_TERMS)} as terms from documents),
p as (select *, list_filter([{', '.join(f"case when {c} then '{n}' end" for n, c in _FINDS.items())}], lambda x: x is not null) as notes, {' + '.join(f"case when {c} then {PENALTIES[n]} else 0 end" for n, c in _FINDS.items())} as cost, ({_FALLBACK}) as fallback from m)
select doc_id, greatest(0, 100 - cost)::bigint as score, notes, fallback from p"""
)
def extraction_penalties(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven graded penalties of an extracted text with their notes, and whether another way of extraction is worth trying. Counts are taken once, in a projection
    below the score."""
    counts = [F.regexp_count("text", F.lit(p)).alias(c) for c, p in _COUNTED.items()]
    terms = sum((F.contains("text", F.lit(t)).cast("int") for t in THAI_TERMS), F.lit(0))
    m = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), *counts, terms.alias("terms"))
    cost = sum((F.when(F.expr(c), F.expr(str(PENALTIES[n]))).otherwise(0) for n, c in _FINDS.items()), F.lit(0))
    notes = X.flags(*[(n, F.expr(c)) for n, c in _FINDS.items()])
    return m.select("doc_id", F.greatest(F.lit(0), 100 - cost).cast("long").alias("score"), notes.alias("notes"), F.expr(_FALLBACK).alias("fallback"))


@query(
    rf"""with m as (select doc_id, text, length(text) as n, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> '') as lines, {_COUNT.format('text', '[.!?:]')} as ends from documents),
f as (select *, len(list_filter(lines, lambda x: length(x) <= 24 and not regexp_matches(x, '[.!?:]$'))) as pieces from m)
select doc_id from f where trim(text) = '' or {_COUNT.format('text', '�')} >= 3 or {_COUNT.format('text', '[◊Ë‡∫≈¡¥]')} >= 2 or {_COUNT.format('text', _SIGNS)} > 0.2::double * n
  or regexp_matches(lower(text), '(?:^|[\s|])(?:page \d+|fax|email|www\.|https?://|scanner)') or pieces >= 4 and ends = 0"""
)
def hard_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that no search should return: any of six signs of a broken or empty extraction."""
    d = table(spark, sf, "documents")
    count = lambda p: F.regexp_count("text", F.lit(p))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pieces = F.size(F.filter(lines, lambda x: (F.length(x) <= 24) & ~F.rlike(x, F.lit("[.!?:]$"))))
    bad = (F.trim("text") == "") | (count("�") >= 3) | (count("[◊Ë‡∫≈¡¥]") >= 2) | (count(r"[^\p{L}\p{M}\p{N}\s]") > F.lit(0.2) * F.length("text"))
    bad = bad | F.rlike(F.lower("text"), F.lit(r"(?:^|[\s|])(?:page \d+|fax|email|www\.|https?://|scanner)")) | ((pieces >= 4) & (count("[.!?:]") == 0))
    return d.where(bad).select("doc_id")


_LINES = rf"""{_HITS}, top as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits),
s as (select item_id, doc_id, unnest(list_zip(regexp_split_to_array(text, '[.!?]\s+|\n+'), range(len(regexp_split_to_array(text, '[.!?]\s+|\n+'))))) as x from top join documents using (doc_id) where k <= 3),
l as (select item_id, doc_id, trim(x[1]) as line, x[2]::int as pos from s),
w as (select l.*, q.terms, len(list_filter(q.terms, lambda t: contains({_PLAIN.format('line')}, t))) as found from l join q using (item_id)),
g as (select item_id, doc_id, pos, line, 2 * found + 6 * found / len(terms)::double + case when regexp_matches(lower(line), 'section|clause|มาตรา|ข้อ') then 5 else 0 end - case when length(line) > 420 then 2 else 0 end as score from w
  where length(line) >= 12 and len(regexp_extract_all(line, '[^\p{{L}}\p{{M}}\p{{N}}\s]')) <= 0.22::double * length(line) and not regexp_matches(lower(line), '^(?:page|source|file|author|date)\s*[:#]?\s*\d|https?://|\.pdf|\.docx')),
r as (select *, row_number() over (partition by item_id, doc_id order by score desc, pos) as place from g where score >= 2)"""


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each question's best texts that aren't noise or metadata, with their score for the question."""
    from .search import questions

    top = R.top(token_hits(spark, sf), ["item_id"], [F.desc("hits"), F.asc("doc_id")], 3, "k").select("item_id", "doc_id")
    l = top.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("item_id", "doc_id", F.posexplode(F.split("text", r"[.!?]\s+|\n+")).alias("pos", "line")).withColumn("line", F.trim("line"))  # noqa: E741
    noisy = F.regexp_count("line", F.lit(r"[^\p{L}\p{M}\p{N}\s]")) > F.lit(0.22) * F.length("line")
    metadata = F.rlike(F.lower("line"), F.lit(r"^(?:page|source|file|author|date)\s*[:#]?\s*\d|https?://|\.pdf|\.docx"))
    l = l.where((F.length("line") >= 12) & ~noisy & ~metadata).join(R.small(questions(spark, sf).select("item_id", "terms")), "item_id")  # noqa: E741
    found = F.size(F.filter("terms", lambda t: F.contains(X.normalise(F.col("line")), t)))
    score = 2 * F.col("found") + 6 * F.col("found") / F.size("terms") + W.points((F.rlike(F.lower("line"), F.lit("section|clause|มาตรา|ข้อ")), 5), (F.length("line") > 420, -2))
    return l.withColumn("found", found).withColumn("score", score).where("score >= 2")


@query(f"with {_LINES} select item_id, doc_id, pos, round(score, 4) as score from r where place <= 4")
def answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    best = R.top(scored_lines(spark, sf), ["item_id", "doc_id"], [F.desc("score"), F.asc("pos")], 4, "place")
    return best.select("item_id", "doc_id", "pos", F.round("score", 4).alias("score"))


@query(f"with {_LINES} select item_id, doc_id, list(line order by pos) as segments from r where place <= 4 group by all")
def relevant_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The best lines of each text, back in the order in which they stand."""
    best = R.top(scored_lines(spark, sf), ["item_id", "doc_id"], [F.desc("score"), F.asc("pos")], 4, "place")
    rows = best.groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return rows.select("item_id", "doc_id", F.transform("x", lambda x: x["line"]).alias("segments"))


@query(
    r"""with x as (select doc_id, regexp_extract_all(text, '(\d{1,3})[.)]\s*([^\n.]{4,80})', 1) as n, regexp_extract_all(text, '(\d{1,3})[.)]\s*([^\n.]{4,80})', 2) as t from documents),
c as (select doc_id, list_transform(list_zip(n, t), lambda z: regexp_replace(z[1], '^0+([0-9])', '\1') || '::' || trim(z[2])) as c from x)
select doc_id, list_filter(c, lambda z, i: list_position(c, z) = i) as clauses from c where len(c) > 0"""
)
def numbered_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct number::detail of numbered clauses, in order, numbers without leading zeros."""
    p = F.lit(r"(\d{1,3})[.)]\s*([^\n.]{4,80})")
    both = F.arrays_zip(F.regexp_extract_all("text", p, 1).alias("n"), F.regexp_extract_all("text", p, 2).alias("t"))
    c = F.array_distinct(F.transform(both, lambda z: F.concat(F.regexp_replace(z["n"], r"^0+([0-9])", "$1"), F.lit("::"), F.trim(z["t"]))))
    return table(spark, sf, "documents").select("doc_id", c.alias("clauses")).where(F.size("clauses") > 0)


@query(
    r"""select doc_id, trim(regexp_extract(text, '^\s*([^\n]+)', 1)) as title, regexp_extract(text, '(?:No\.|#|ที่)\s*(\d+(?:/\d+)?)', 1) as number,
  regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1) as dated, regexp_extract(text, '(?:by|von|de|par)\s+(\p{Lu}\p{L}+)', 1) as agency from documents"""
)
def text_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Title line, number, date and agency by patterns; empty where there is none."""
    get = lambda p: F.regexp_extract("text", p, 1)
    return table(spark, sf, "documents").select(
        "doc_id", F.trim(get(r"^\s*([^\n]+)")).alias("title"), get(r"(?:No\.|#|ที่)\s*(\d+(?:/\d+)?)").alias("number"), get(r"(\d{4}-\d{2}-\d{2})").alias("dated"), get(r"(?:by|von|de|par)\s+(\p{Lu}\p{L}+)").alias("agency")
    )


@query(
    r"""with p as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as next_role from conversations)
select conv_id, turn, trim(text) as question, trim(answer) as answer, (row_number() over (partition by conv_id order by turn))::int as display_order from p where role = 'user' and next_role = 'assistant' and trim(text) <> '' and trim(answer) <> ''"""
)
def question_answer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each question with the answer that follows it, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    kept = p.where("role = 'user' and next_role = 'assistant' and trim(text) != '' and trim(answer) != ''")
    return kept.select("conv_id", "turn", F.trim("text").alias("question"), F.trim("answer").alias("answer"), F.row_number().over(w).alias("display_order"))


@query(
    r"""with b as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') as l from documents),
x as (select doc_id, unnest(list_zip(l, range(len(l)))) as z from b)
select doc_id, z[2]::int as pos, case when regexp_matches(z[1], '^(?:[-*•]|\d+[.)])\s') then 'step' when regexp_matches(z[1], ':$') then 'heading' when regexp_matches(lower(z[1]), '^note\b') then 'note' when regexp_matches(z[1], '\?$') then 'question' else 'text' end as kind,
  trim(regexp_replace(z[1], '^(?:[-*•]|\d+[.)])\s+', '')) as body from x"""
)
def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as steps, headings, notes, questions or text, without the marks of lists."""
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    x = table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    kind = X.first_match(F.col("line"), [("step", r"^(?:[-*•]|\d+[.)])\s"), ("heading", ":$"), ("note", r"(?i)^note\b"), ("question", r"\?$")], "text")
    return x.select("doc_id", "pos", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^(?:[-*•]|\d+[.)])\s+", "")).alias("body"))


@query(
    """with n as (select *, sha256(text) as file_hash, row_number() over (partition by sha256(text) order by doc_id) as k from documents where trim(text) <> '')
select file_hash, substr(sha256(source || ':' || file_hash), 1, 32) as batch, doc_id, source, lang from n where k = 1"""
)
def import_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An import: rows by the hash of their content, each once, with a batch key, appended to a table and read back. The write appears
    whole or not at all by Spark's commit."""
    d = table(spark, sf, "documents").where(F.trim("text") != "").withColumn("file_hash", F.sha2("text", 256))
    first = d.groupBy("file_hash").agg(F.min_by(F.struct("doc_id", "source", "lang"), "doc_id").alias("r")).select("file_hash", "r.*")
    rows = first.withColumn("batch", F.substring(F.sha2(F.concat("source", F.lit(":"), "file_hash"), 256), 1, 32))
    path = scratch_path(spark, "import")
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select("file_hash", "batch", "doc_id", "source", "lang")


_TTL = "case event_type when 'click' then 5 when 'view' then 10 when 'purchase' then 30 else 15 end"


@query("with k as (select user_id, event_type, min((ts, event_id)) as first, count(*) as hits from events group by 1, 2) select user_id, event_type, hits from k order by first desc limit 200")
def cache_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 entries that were put in last, with their hits."""
    k = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.count(F.lit(1)).alias("hits"))
    return k.orderBy(F.desc("first")).limit(200).select("user_id", "event_type", "hits")


@query(
    """with e as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 15 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from e) select user_id, min(ts) as started, max(ts) + interval 15 minute as expires, count(*) as n from s group by user_id, k"""
)
def session_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after 15 minutes without an event."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


@query(r"select doc_id, n, list_filter([n, 'section ' || n, 'section' || n, 'clause ' || n], lambda x: x is not null) as patterns from (select doc_id, nullif(regexp_extract(text, '(\d+)', 1), '') as n from documents) where n is not null")
def number_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Forms in which a text's first number may be asked for."""
    n = F.nullif(F.regexp_extract("text", r"(\d+)", 1), F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", n.alias("n")).where("n is not null")
    return d.select("doc_id", "n", F.array(F.col("n"), F.concat(F.lit("section "), "n"), F.concat(F.lit("section"), "n"), F.concat(F.lit("clause "), "n")).alias("patterns"))


@query(r"select doc_id, regexp_matches(text, '(?i)(?:section|clause)\s*7(?:[^0-9/]|$)') or regexp_matches(source, '7$') as has_seven from documents")
def exact_number_text(spark: SparkSession, sf: str) -> DataFrame:
    """A section's number in a text or a label, but not as the beginning of a longer one."""
    return table(spark, sf, "documents").select("doc_id", (F.rlike("text", F.lit(r"(?i)(?:section|clause)\s*7(?![0-9/])")) | F.rlike("source", F.lit("7$"))).alias("has_seven"))


@query("with s as (select page_id, lower(url) as u, length(html) as n from pages) select page_id, 3 * contains(u, 'en')::int + 2 * contains(u, 'page')::int + (n > 2000)::int as score from s where not contains(u, 'login')")
def metadata_search(spark: SparkSession, sf: str) -> DataFrame:
    u = F.lower("url")
    score = W.points((F.contains(u, F.lit("en")), 3), (F.contains(u, F.lit("page")), 2), (F.length("html") > 2000, 1))
    return table(spark, sf, "pages").where(~F.contains(u, F.lit("login"))).select("page_id", score.alias("score"))


@query("select page_id, md5(html) as h, count(*) over (partition by md5(html)) > 1 as repeated from pages")
def page_identity(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("h"))
    n = p.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "h").select("page_id", "h", (F.col("n") > 1).alias("repeated"))


@query(r"select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> '') as lines from documents")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A text's lines as a reader of text files gives them."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", lines.alias("lines"))


@query(
    """with l as (select ts::date as day, row_number() over (partition by ts::date order by event_id) as line, event_type, props from events)
select day, line, case when event_type <> 'error' then json_extract(props, '$.k')::bigint end as k, event_type <> 'error' as valid from l where event_type <> 'signup'"""
)
def checked_json(spark: SparkSession, sf: str) -> DataFrame:
    """Daily JSON logs written and read back: each line's number in its file, its record, and whether it parses. Errors were logged without their
    last sign, and sign-ups as blank lines, which count but hold no record."""
    line = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).when(F.col("event_type") == "signup", "").otherwise(F.col("props"))
    log = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", line.alias("value"))
    path = scratch_path(spark, "log")
    log.repartition("day").sortWithinPartitions("day", "event_id").select("value", "day").write.partitionBy("day").text(path)
    rows = S.json_lines_checked(S.numbered_lines(spark, path), "k bigint", keep=["day", "line"])
    return rows.select("day", "line", F.when(F.col("valid"), F.col("record.k")).alias("k"), "valid")


#: What a paragraph is, by the first pattern that it matches: an entry of questions, a step, a note, a heading of a summary.
PARAGRAPHS = [("faq", r"\?"), ("process", r"^[0-9]+[.)]|^\| "), ("note", r"!|%|&"), ("summary", ":")]
#: Files of a folder, about.
FILES = 1000
_BARE = r"trim(regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), ' ' || chr(9) || chr(13))"


@query(
    rf"""with l as (select doc_id, source, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: {_BARE}), lambda x: x <> '')) as p from documents)
select doc_id, case {' '.join(f"when regexp_matches(p, '{p}') then '{t}'" for t, p in PARAGRAPHS)} else 'text' end as type, count(*) as n, null::varchar as error from l where source <> 'src13' group by all
union all select doc_id, 'damaged', 1, 'BadZipFile' from documents where source = 'src13'"""
)
def office_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as Word documents and read back: paragraphs by type, counted for each document. Those of one source are cut off in the middle and come back
    with their error."""
    bare = lambda x: F.trim(F.regexp_replace(x, O.CONTROLS, ""), F.lit(" \t\r"))
    lines = F.filter(F.transform(F.split("text", "\n"), bare), lambda x: x != "")
    folder = scratch_path(spark, "office")
    docs = table(spark, sf, "documents")
    folders = -(-docs.count() // FILES)
    files = written(O.write_documents(docs.select(F.format_string("%d.docx", "doc_id").alias("name"), lines.alias("paragraphs"), "source"), folder, "source = 'src13'", folders), "names")
    kind = F.when(F.rlike("text", F.lit(PARAGRAPHS[0][1])), PARAGRAPHS[0][0])
    for name, pattern in PARAGRAPHS[1:]:
        kind = kind.when(F.rlike("text", F.lit(pattern)), name)
    rows = O.read_documents(spark, folder, files).withColumn("type", F.when(F.col("error").isNotNull(), "damaged").otherwise(kind.otherwise("text")))
    return rows.groupBy(F.regexp_extract("name", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "type").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"))
