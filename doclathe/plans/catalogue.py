"""Queries of the library's own operators over the driver's tables, with SQL for comparison.

The tables hardly hold what the cleaner is for, so most queries add the same noise to each text, here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import fixed
from ..functions import expr
from ..operators import relational

QUERIES: dict = {}
ORACLES: dict = {}

NOISE_A = "\u200b\u2018Quoted\u2019  head \u2014 \u201cx\u201d\u2026\t\n"
NOISE_B = "  \n\n\n\n  \u2022 one   two\u00a0three\t \n\u00b7 \u2192 \\* a\\_b \u2264 5\u00d73\r\nso-\ncalled \ue000\u2028end\u0007  \n\n\n"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NOISY = f"({_q(NOISE_A)} || text || {_q(NOISE_B)})"


def _noisy(spark, sf_dir, table="documents"):
    docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return docs.withColumn("t", F.concat(F.lit(NOISE_A), F.col("text"), F.lit(NOISE_B)))


def _plain(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _re(c, pattern, by):
    return f"regexp_replace({c}, {_q(pattern)}, {_q(by)}, 'g')"


# each step in SQL, on an SQL expression
def _s_sentinels(c):
    return _re(c, r"[\x{E000}-\x{E002}]", "")


def _s_breaks(c):
    return _re(c, expr.LINE_BREAK_PATTERN, "\n")


def _s_invisible(c):
    return _re(c, expr.INVISIBLE_PATTERN, "")


def _s_bullets(c):
    return _re(c, expr.BULLET_PATTERN, r"\1\2- ")


def _s_fold(c):
    a, b = expr.single_folds()
    out = f"translate({_s_bullets(c)}, {_q(a)}, {_q(b)})"
    for one, to in expr.long_folds():
        out = f"replace({out}, {_q(one)}, {_q(to)})"
    return out


def _s_tabs(c):
    return f"replace({c}, chr(9), ' ')"


def _s_collapse(c):
    line = f"regexp_extract(l, {_q('^[ \t]*')}) || regexp_replace(substr(l, length(regexp_extract(l, {_q('^[ \t]*')})) + 1), ' {{2,}}', ' ', 'g')"
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: {line}), chr(10))"


def _s_trim(c):
    return _re(c, r"[ \t]+(\n|\z)", r"\1")


def _s_blank(c, most=1):
    out = _re(c, r"\n{%d,}" % (most + 2), "\n" * (most + 1))
    return _re(_re(out, r"\A\n{%d,}" % (most + 1), "\n" * most), r"\n{%d,}\z" % (most + 1), "\n" * most)


def _s_final(c):
    body = _re(_re(c, r"\A(?:[ \t]*\n)+", ""), r"\n(?:[ \t]*\n)*[ \t]*\z", "")
    return f"(CASE WHEN {body} = '' THEN '' ELSE {body} || chr(10) END)"


def _s_unescape(c):
    return _re(c, expr.ESCAPE_PATTERN, r"\1")


def _s_clean(c):
    return _s_final(_s_blank(_s_trim(_s_collapse(_s_unescape(_s_tabs(_s_fold(_s_invisible(_s_breaks(_s_sentinels(c))))))))))


_TOKENS = f"""coalesce(list_sum(list_transform(regexp_extract_all({{c}}, {_q(expr.TOKEN_PATTERN)}), lambda x: CASE
  WHEN regexp_matches(x, {_q(rf'^[{fixed.LETTER}]')}) THEN (length(x) + {fixed.LETTERS_PER_TOKEN - 1}) // {fixed.LETTERS_PER_TOKEN}
  WHEN regexp_matches(x, '^[0-9]') THEN (length(x) + {fixed.DIGITS_PER_TOKEN - 1}) // {fixed.DIGITS_PER_TOKEN}
  WHEN regexp_matches(x, {_q(rf'^[{fixed.CJK}]')}) THEN 1
  WHEN regexp_matches(x, {_q(rf'^[{fixed.SPACE}]')}) THEN CASE WHEN x = ' ' THEN 0 ELSE (length(x) + {fixed.LONG_SPACE - 1}) // {fixed.LONG_SPACE} END
    + CASE WHEN regexp_matches(x, {_q('[' + chr(10) + chr(13) + '][^' + chr(10) + chr(13) + ']+$')}) THEN 1 ELSE 0 END
  WHEN regexp_matches(x, {_q(rf'^[{fixed.ASTRAL}]')}) THEN 2
  ELSE (length(x) + {fixed.MARKS_PER_TOKEN - 1}) // {fixed.MARKS_PER_TOKEN} END)), 0)::BIGINT"""


def _s_tokens(c):
    return _TOKENS.replace("{c}", c)


def _s_lines(c):
    return f"(CASE WHEN {c} = '' THEN 0 ELSE length({c}) - length(replace({c}, chr(10), '')) + CASE WHEN ends_with({c}, chr(10)) THEN 0 ELSE 1 END END)::BIGINT"


def _s_utf16(c):
    return f"(length({c}) + len(regexp_extract_all({c}, {_q(f'[{fixed.ASTRAL}]')})))::BIGINT"


_STEPS = {
    "strip_sentinels": (expr.strip_sentinels, _s_sentinels),
    "line_breaks": (expr.line_breaks, _s_breaks),
    "strip_invisible": (expr.strip_invisible, _s_invisible),
    "fold_bullets": (expr.fold_bullets, _s_bullets),
    "fold_punctuation": (expr.fold_punctuation, _s_fold),
    "tabs_to_spaces": (expr.tabs_to_spaces, _s_tabs),
    "collapse_spaces": (expr.collapse_spaces, _s_collapse),
    "trim_lines": (expr.trim_lines, _s_trim),
    "limit_blank_lines": (lambda c: expr.limit_blank_lines(expr.trim_lines(c)), lambda c: _s_blank(_s_trim(c))),
    "finalise": (expr.finalise, _s_final),
    "unescape_markdown": (expr.unescape_markdown, _s_unescape),
    "dehyphenate": (expr.dehyphenate, lambda c: _re(c, r"([A-Za-z]{2,})-\n([a-z]+)", r"\1\2")),
    "clean_fast_balanced": (expr.clean_fast, _s_clean),
}
for _name, (_f, _s) in _STEPS.items():
    _add(_name, lambda spark, d, f=_f: _noisy(spark, d).select("doc_id", f("t").alias("text")), f"SELECT doc_id, {_s('t')} AS text FROM (SELECT doc_id, {_NOISY} AS t FROM documents)")

_add("estimate_tokens", lambda spark, d: _noisy(spark, d).select("doc_id", expr.estimate_tokens("t").alias("tokens")), f"SELECT doc_id, {_s_tokens('t')} AS tokens FROM (SELECT doc_id, {_NOISY} AS t FROM documents)")
_add("count_lines", lambda spark, d: _noisy(spark, d).select("doc_id", expr.count_lines("t").alias("lines")), f"SELECT doc_id, {_s_lines('t')} AS lines FROM (SELECT doc_id, {_NOISY} AS t FROM documents)")


_MEASURED = {"chars": expr.utf16_length, "bytes": lambda c: F.octet_length(c).cast("long"), "lines": expr.count_lines, "tokens": expr.estimate_tokens}


def _stats(spark, d):
    # a column for each measure, so that those nobody asks for aren't taken
    rows = _noisy(spark, d).withColumn("u", expr.clean_fast("t"))
    return _with_pct(rows.select("doc_id", "lang", "source", *[f(c).alias(f"{n}_{w}") for c, w in (("t", "before"), ("u", "after")) for n, f in _MEASURED.items()]))


_S_STATS = f"""SELECT doc_id, lang, source, {', '.join(f"{f('t' if w == 'before' else 'u')} AS {n}_{w}" for w in ('before', 'after') for n, f in (('chars', _s_utf16), ('bytes', lambda c: f'strlen({c})::BIGINT'), ('lines', _s_lines), ('tokens', _s_tokens)))}
FROM (SELECT *, {_s_clean('t')} AS u FROM (SELECT doc_id, lang, source, {_NOISY} AS t FROM documents))"""
_PCT = "CASE WHEN {b} <= 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, floor((({b} - {a}) * 100.0::DOUBLE / {b}) * 10 + 0.5) / 10)) END"
_add("stats_per_doc", _stats, f"SELECT *, {_PCT.format(b='tokens_before', a='tokens_after')} AS saved_pct FROM ({_S_STATS})")
_MEASURES = ["tokens_before", "tokens_after", "bytes_before", "bytes_after"]


def _with_pct(rows):
    return rows.withColumn("saved_pct", expr.saved_pct("tokens_before", "tokens_after"))


_add("clean_fast_by_lang", lambda spark, d: _with_pct(_stats(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(m).alias(m) for m in _MEASURES])), f"SELECT *, {_PCT.format(b='tokens_before', a='tokens_after')} AS saved_pct FROM (SELECT lang, count(*) AS docs, {', '.join(f'sum({m})::BIGINT AS {m}' for m in _MEASURES)} FROM ({_S_STATS}) GROUP BY lang)")
_add("stats_rollup", lambda spark, d: relational.totals(_stats(spark, d), "source", _MEASURES), f"SELECT source, {', '.join(f'sum({m})::BIGINT AS {m}' for m in _MEASURES)} FROM ({_S_STATS}) GROUP BY ROLLUP (source)")
_add("format_bytes", lambda spark, d: _plain(spark, d).select("doc_id", expr.format_bytes(F.octet_length("text").cast("long") * 37).alias("size")), "SELECT doc_id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1e6 THEN printf('%.1f kB', floor(n / 1e3 * 10 + 0.5) / 10) WHEN n < 1e9 THEN printf('%.1f MB', floor(n / 1e6 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1e9 * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, strlen(text)::BIGINT * 37 AS n FROM documents)")
_add("clock", lambda spark, d: _plain(spark, d).select("doc_id", expr.clock(F.col("n_chars") * 7).alias("clock")), "SELECT doc_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT doc_id, n_chars * 7 AS s FROM documents)")


def _lines(spark, d):
    t = F.concat(F.lit("# Head\n> quote\n| a | b |\n- item\n   1. one\n"), F.col("text"))
    return _plain(spark, d).select("doc_id", F.posexplode(F.split(t, "\n", -1)).alias("i", "line"))


_LINES = f"(SELECT doc_id, unnest(string_split({_q('# Head' + chr(10) + '> quote' + chr(10) + '| a | b |' + chr(10) + '- item' + chr(10) + '   1. one' + chr(10))} || text, chr(10))) AS line FROM documents)"
_add("line_kinds", lambda spark, d: _lines(spark, d).groupBy("doc_id").agg(*[F.sum(f("line").cast("long")).alias(n) for n, f in (("headings", expr.is_heading), ("blocks", expr.is_block_start), ("tables", expr.is_table_row))]), f"SELECT doc_id, sum(regexp_matches(line, {_q(fixed.HEADING_LINE)})::BIGINT)::BIGINT AS headings, sum(regexp_matches(line, {_q(fixed.BLOCK_START)})::BIGINT)::BIGINT AS blocks, sum((length(trim(line)) >= 2 AND starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND len(regexp_extract_all(regexp_replace(trim(line), '\\\\.', '', 'g'), '\\|')) >= 2)::BIGINT)::BIGINT AS tables FROM {_LINES} GROUP BY doc_id")
_MEDIA = "A" * 220 + "\n[pic]: photo.png\n"
_add("drop_media_lines", lambda spark, d: _plain(spark, d).select("doc_id", expr.drop_media_lines(F.concat(F.lit(_MEDIA), F.col("text"))).alias("text")), f"SELECT doc_id, array_to_string(list_filter(string_split({_q(_MEDIA)} || text, chr(10)), lambda x: NOT regexp_matches(x, {_q(fixed.BASE64_LINE)}) AND NOT regexp_matches(x, {_q(fixed.IMAGE_REF_LINE)})), chr(10)) AS text FROM documents")
_add("looks_like_html", lambda spark, d: _plain(spark, d, "pages").select("page_id", expr.looks_like_html("html").alias("html")), f"SELECT page_id, regexp_matches(substr(html, 1, 4096), '(?i)\\A\\s*<(?:!doctype\\s+html|html|head|body)\\b') OR len(regexp_extract_all(substr(html, 1, 4096), {_q(expr.TAG_PATTERN)})) >= 2 AS html FROM pages")
_add("html_tag_counts", lambda spark, d: _plain(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
_add("html_links", lambda spark, d: _plain(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("i", "href")).select("page_id", "href"), """SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages""")


# documents as sections (their lines), sources as groups
def _sections(spark, d):
    return _plain(spark, d).select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "part"))


_SECTIONS = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS part, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)"
_add("section_assembly", lambda spark, d: relational.assemble(_sections(spark, d), "doc_id", "i", "part"), f"SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (part <> ''), '') AS text FROM {_SECTIONS} GROUP BY doc_id")
_add("section_headings", lambda spark, d: _plain(spark, d).select("doc_id", relational.section_heading("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")), "Slide").alias("heading")), "SELECT doc_id, '## Slide ' || doc_id || CASE WHEN doc_id % 2 = 0 AND trim(source) <> '' THEN ' \u2014 ' || source ELSE '' END AS heading FROM documents")
_add("page_selection", lambda spark, d: _plain(spark, d).select("doc_id", F.array_join(relational.page_selection((F.col("doc_id") % 9 + 1).cast("int"), [(3, 7), (1, 2), (6, 12)], 5).cast("array<string>"), ",").alias("pages")), "SELECT doc_id, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], lambda p: p <= doc_id % 9 + 1))[1:5], ',') AS pages FROM documents")
_SHARE = 0.1


def _furniture(spark, d):
    return relational.suppress_repeats(_sections(spark, d), "source", "doc_id", "i", "part", _SHARE)


_add("repeated_blocks", lambda spark, d: _furniture(spark, d).select("doc_id", "source", "i", "part"), f"""WITH b AS MATERIALIZED (SELECT * FROM {_SECTIONS}), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM b GROUP BY 1),
k AS (SELECT source, part, count(DISTINCT doc_id) AS k, min((doc_id, i)) AS f FROM b GROUP BY 1, 2)
SELECT b.doc_id, b.source, b.i::INT AS i, b.part FROM b JOIN n ON b.source = n.source JOIN k ON b.source = k.source AND b.part = k.part WHERE NOT (n.n >= 4 AND k.k >= {_SHARE} * n.n) OR (b.doc_id, b.i) = k.f""")


def _turns(spark, d):
    return _plain(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))


_TURNS = """(SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations)"""
_MERGED = f"""(SELECT conv_id, min(turn) AS turn, any_value(role) AS role, string_agg(text, ' ' ORDER BY turn, text) AS text FROM (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS n FROM {_TURNS})) GROUP BY conv_id, g)"""
_add("merge_turns", lambda spark, d: relational.merge_turns(_turns(spark, d), "conv_id", "turn", "role", "text"), f"SELECT * FROM {_MERGED}")
_add("render_turns", lambda spark, d: relational.merge_turns(_turns(spark, d), "conv_id", "turn", "role", "text").select("conv_id", "turn", relational.rendered("role", "text").alias("text")), f"SELECT conv_id, turn, role || ':' || CASE WHEN {_s_utf16('text')} > 200 THEN chr(10) ELSE ' ' END || text AS text FROM {_MERGED}")
_add("short_names", lambda spark, d: relational.short_names(_plain(spark, d, "nation").select("n_regionkey", F.concat("n_name", F.lit(" Lee")).alias("name")), "n_regionkey", "name"), "WITH a AS (SELECT DISTINCT n_regionkey, n_name || ' Lee' AS name, split_part(n_name || ' Lee', ' ', 1) AS f FROM nation), g AS (SELECT n_regionkey, count(DISTINCT f) = count(DISTINCT name) AND min(length(f)) >= 2 AS ok FROM a GROUP BY 1) SELECT a.n_regionkey, a.name, CASE WHEN ok THEN f ELSE name END AS short FROM a JOIN g USING (n_regionkey)")
_add("output_names", lambda spark, d: relational.output_names(_plain(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "Note").otherwise("note"), (F.col("doc_id") % 50).cast("string"), F.lit(".md")).alias("name"), F.col("source").alias("parent")), "doc_id", "name", "parent"), """SELECT doc_id, name, source AS parent, CASE WHEN n = 1 THEN name WHEN n = 2 THEN source || '-' || replace(name, '.md', '') || '.md' ELSE replace(name, '.md', '') || '-' || n || '.md' END AS output FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) AS n FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'Note' ELSE 'note' END || doc_id % 50 || '.md' AS name FROM documents))""")


# positioned items from the rows of lineitem
def _items(spark, d):
    k = F.col("l_orderkey") % 7
    rows = _plain(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.lit(5.0).alias("w"), F.when(k == 0, 10.0).when(k == 1, 7.0).otherwise(0.0).alias("a"), F.when(k == 0, 0.1).when(k == 1, 7.0).otherwise(-10.0).alias("b"))
    return rows.withColumn("turn", expr.quarter_turn("a", "b"))


_ITEMS = """(SELECT *, CASE WHEN abs(b) <= 0.05 * sqrt(a * a + b * b) THEN CASE WHEN a > 0 THEN 0 ELSE 180 END WHEN abs(a) <= 0.05 * sqrt(a * a + b * b) THEN CASE WHEN b > 0 THEN 90 ELSE 270 END END AS turn FROM (
  SELECT l_orderkey % 500 AS doc_id, l_quantity AS x, l_tax AS y, 5.0::DOUBLE AS w, CASE l_orderkey % 7 WHEN 0 THEN 10.0 WHEN 1 THEN 7.0 ELSE 0.0 END::DOUBLE AS a, CASE l_orderkey % 7 WHEN 0 THEN 0.1 WHEN 1 THEN 7.0 ELSE -10.0 END::DOUBLE AS b FROM lineitem))"""
_add("quarter_turn", lambda spark, d: _items(spark, d).groupBy("turn").agg(F.count(F.lit(1)).alias("n")), f"SELECT turn, count(*) AS n FROM {_ITEMS} GROUP BY turn")
_add("dominant_turn", lambda spark, d: relational.dominant_turn(_items(spark, d), ["doc_id"], "turn", 0.7), f"SELECT t.doc_id, w.turn FROM (SELECT doc_id, count(*) AS n FROM {_ITEMS} GROUP BY 1) t LEFT JOIN (SELECT doc_id, turn, count(*) AS k FROM {_ITEMS} WHERE turn IS NOT NULL AND turn <> 0 GROUP BY 1, 2) w ON t.doc_id = w.doc_id AND w.k >= 0.7 * t.n")
_add("upright_placement", lambda spark, d: _items(spark, d).withColumn("p", expr.upright("x", "y", "w", "turn", F.lit(600.0), F.lit(800.0))).groupBy("doc_id").agg(F.round(F.sum("p.x"), 4).alias("x"), F.round(F.sum("p.y"), 4).alias("y")), f"SELECT doc_id, round(sum(CASE turn WHEN 270 THEN 800 - y ELSE x END), 4) AS x, round(sum(CASE turn WHEN 270 THEN x ELSE y END), 4) AS y FROM {_ITEMS} GROUP BY doc_id")


# the fused Arrow path: beyond SQL, tested against the core functions
from ..core.options import preset as _preset  # noqa: E402
from ..functions import udfs  # noqa: E402

_add("clean_full", lambda spark, d: udfs.clean_routed(_noisy(spark, d).select("doc_id", "t"), "t").select("doc_id", F.col("cleaned").alias("text")))
_add("clean_aggressive", lambda spark, d: _noisy(spark, d).select("doc_id", udfs.clean(F.col("t"), _preset("aggressive")).alias("text")))
_add("html_to_text", lambda spark, d: _plain(spark, d, "pages").select("page_id", udfs.html_to_text("html").alias("text")).withColumn("tokens", expr.estimate_tokens("text")))
_add("nfkc", lambda spark, d: _noisy(spark, d).select("doc_id", udfs.nfkc("t").alias("text")))
_add("rtf_to_text", lambda spark, d: _plain(spark, d).select("doc_id", udfs.rtf_to_text(F.concat(F.lit("{\\rtf1\\ansi "), F.replace("text", F.lit("\n"), F.lit("\\par ")), F.lit("}"))).alias("text")))


def _transcripts(spark, d):
    rows = _plain(spark, d, "conversations")
    line = F.concat(F.initcap("role"), F.lit(" Lee "), expr.clock(F.col("turn") * 61 + 5), F.lit(": "), F.regexp_replace("text", "\n", " "))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


_add("tidy_transcript", lambda spark, d: _transcripts(spark, d).select("conv_id", udfs.tidy_transcript("text").alias("text")))
_add("looks_like_transcript", lambda spark, d: _transcripts(spark, d).select("conv_id", udfs.looks_like_transcript("text").alias("is_transcript")))
_add("utterances", lambda spark, d: udfs.utterances(_transcripts(spark, d), "conv_id", "text"))
_add("detect_format", lambda spark, d: _plain(spark, d, "pages").select("page_id", expr.detect_format(F.encode("html", "UTF-8"), F.lit(None).cast("string")).alias("format")), f"SELECT page_id, CASE WHEN contains(substr(html, 1, 1024), '%PDF') THEN 'pdf' WHEN regexp_matches(substr(html, 1, 4096), '(?i)\\A\\s*<(?:!doctype\\s+html|html|head|body)\\b') OR len(regexp_extract_all(substr(html, 1, 4096), {_q(expr.TAG_PATTERN)})) >= 2 THEN 'html' ELSE 'text' END AS format FROM pages")
_add("extract", lambda spark, d: _plain(spark, d, "pages").select("page_id", udfs.extract(F.encode("html", "UTF-8"), F.lit("page.html")).alias("d")).select("page_id", "d.format", "d.text", "d.error"))


# documents laid out as pages of positioned words: a line every 12 points, 40 lines a page, with a footer
from ..operators import pages as _pages  # noqa: E402


def _positioned(spark, d):
    lines = _plain(spark, d).select("doc_id", F.posexplode(F.split("text", r"(?<=[.]) ")).alias("n", "text")).withColumn("page", F.floor(F.col("n") / 40).cast("int") + 1)
    body = lines.select("doc_id", "page", "text", F.lit(72.0).alias("x"), (700 - (F.col("n") % 40) * 12).cast("double").alias("y"))
    foot = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.concat(F.lit("Page "), F.col("page"), F.lit(" of 9")).alias("text"), F.lit(280.0).alias("x"), F.lit(30.0).alias("y"))
    return body.unionByName(foot).select("*", (F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(792.0).alias("page_height"))


_add("page_lines", lambda spark, d: _pages.page_lines(_positioned(spark, d)))
_add("page_texts", lambda spark, d: _pages.page_texts(_pages.suppress_running_text(_pages.page_lines(_positioned(spark, d)))))
_POSITIONED = r"""(SELECT doc_id, n // 40 + 1 AS page, 700 - (n % 40) * 12.0::DOUBLE AS y, text FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS text, unnest(range(0, len(string_split(text, '. ')))) AS n FROM documents))"""
# on a page of 800 points only the footer stands in a margin: lines of the text that repeat from page to page aren't running text, as in the SQL
_add("running_text", lambda spark, d: _pages.suppress_running_text(_positioned(spark, d).withColumn("page_height", F.lit(800.0))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")), f"WITH p AS (SELECT doc_id, count(*) AS n, max(page) AS k FROM {_POSITIONED} GROUP BY 1) SELECT doc_id, n + CASE WHEN k >= 4 THEN 1 ELSE k END AS lines FROM p")


# conversations as PDF files of one page, a line for each turn
from ..sources.files import process as _process  # noqa: E402


def _pdf_files(spark, d):
    words = F.trim(F.regexp_replace(F.col("text"), "[^!-~]+", " "))
    shown = F.concat(F.lit("("), F.regexp_replace(words, r"([\\()])", r"\\$1"), F.lit(") '\n"))
    page = _plain(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", shown.alias("s")))), lambda x: x["s"]), "").alias("s"))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 612 792] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>", "<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>"]
    head = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in enumerate(objects, 1)) + "5 0 obj\n<< >>\nstream\nBT /F1 10 Tf 14 TL 72 700 Td\n"
    return page.select("conv_id", F.encode(F.concat(F.lit(head), F.col("s"), F.lit("ET\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n")), "US-ASCII").alias("content"))


_SHOWN = r"(SELECT conv_id, turn, trim(regexp_replace(text, '[^!-~]+', ' ', 'g')) AS t FROM conversations)"
_add("pdf_text", lambda spark, d: _pdf_files(spark, d).select("conv_id", udfs.extract("content", F.lit("a.pdf")).alias("d")).select("conv_id", "d.format", "d.text"), f"SELECT conv_id, 'pdf' AS format, string_agg(t, chr(10) ORDER BY turn) AS text FROM {_SHOWN} WHERE t <> '' GROUP BY 1")
_add("pdf_items", lambda spark, d: udfs.pdf_items(_pdf_files(spark, d), "conv_id", "content").groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.sum("width").alias("width"), F.min("y").alias("lowest")), f"SELECT conv_id AS doc_id, count(*) AS items, sum(length(t) * 6.0::DOUBLE) AS width, min(y) AS lowest FROM (SELECT *, 700.0::DOUBLE - 14 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM {_SHOWN}) WHERE t <> '' GROUP BY 1")
_add("pdf_page_texts", lambda spark, d: _pages.page_texts(_pages.page_lines(udfs.pdf_items(_pdf_files(spark, d), "conv_id", "content"))), f"SELECT conv_id AS doc_id, 1 AS page, string_agg(t, chr(10) ORDER BY turn) AS text FROM {_SHOWN} WHERE t <> '' GROUP BY 1")
_add("process", lambda spark, d: _process(_pdf_files(spark, d).select(F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("source"), "content")).select("source", "format", "text", "stats.chars.before", "stats.chars.after"))


# inputs that are built so that SQL can say the answer
from . import constructed as _constructed  # noqa: E402

QUERIES |= _constructed.QUERIES
ORACLES |= _constructed.ORACLES
