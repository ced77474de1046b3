"""Scans, scoring, parsing and chunking of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import chunking, dedup, phrases, pii
from sparkloom.operators import relational as rel
from sparkloom.operators import views as vw
from sparkloom.plans.base import query, table
from sparkloom.storage import written

#: A lexicon of frequent words, so that queries over the invented prose count something.
SAMPLE_CONCRETE, SAMPLE_SPECIFIC, SAMPLE_VAGUE = ("the", "of the", "in"), ("and", "to"), ("of", "with", "for")


def docs(spark, d):
    return table(spark, d, "documents")


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def _sql_rlike(pattern: str) -> str:
    return f"regexp_matches(coalesce(text, ''), '{pattern}')"


@query("txt1_priority", f"SELECT doc_id, CASE WHEN {_sql_rlike(tx.MUST_PATTERN)} THEN 'MUST' WHEN {_sql_rlike(tx.COULD_PATTERN)} THEN 'COULD' ELSE 'SHOULD' END AS priority FROM documents")
def txt1(spark, d):
    return docs(spark, d).select("doc_id", tx.priority(F.col("text")).alias("priority"))


@query("txt2_tokens", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct FROM documents")
def txt2(spark, d):
    w = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("txt3_specificity", f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id,
 len([x FOR x IN w IF x IN {_in(SAMPLE_CONCRETE)}]) + len([i FOR i IN range(1, len(w)) IF (w[i] || ' ' || w[i + 1]) IN {_in(SAMPLE_CONCRETE)}]) + len([x FOR x IN w IF x IN {_in(SAMPLE_SPECIFIC)}]) AS good,
 len([x FOR x IN w IF x IN {_in(SAMPLE_VAGUE)}]) AS bad FROM t)
SELECT doc_id, round(CASE WHEN good + bad = 0 THEN 0.4 ELSE good / (good + bad) END, 6) AS specificity FROM c""")
def txt3(spark, d):
    w = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.round(tx.specificity(F.col("w"), SAMPLE_CONCRETE, SAMPLE_SPECIFIC, SAMPLE_VAGUE), 6).alias("specificity"))


SAMPLE_PARAMS = {"src0": ("the", "of the", "with"), "src1": ("les", "une", "and", "für"), "src2": ("und", "in", "que")}


@query("txt4_completeness", f"""WITH t AS (SELECT doc_id, source, {TOKENS} AS w FROM documents)
SELECT doc_id, CASE source WHEN 'src0' THEN round_even(100.0 * ((list_contains(w, 'the'))::INT + (list_contains(w, 'of') AND list_contains(w, 'the'))::INT + (list_contains(w, 'with'))::INT) / 3, 1)
 WHEN 'src1' THEN round_even(100.0 * ((list_contains(w, 'les'))::INT + (list_contains(w, 'une'))::INT + (list_contains(w, 'and'))::INT + (list_contains(w, 'für'))::INT) / 4, 1)
 WHEN 'src2' THEN round_even(100.0 * ((list_contains(w, 'und'))::INT + (list_contains(w, 'in'))::INT + (list_contains(w, 'que'))::INT) / 3, 1) ELSE 50.0 END::DOUBLE AS completeness FROM t""")
def txt4(spark, d):
    w = docs(spark, d).select("doc_id", "source", tx.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", tx.completeness(F.col("w"), F.col("source"), SAMPLE_PARAMS).alias("completeness"))


@query("flt5_consistency", f"""SELECT doc_id, CASE WHEN source = 'src1' AND {_sql_rlike(tx.CUSTOMER_PATTERN)} THEN 'AR' WHEN source = 'src2' AND {_sql_rlike(tx.VENDOR_PATTERN)} THEN 'AP' WHEN upper(lang) IN ('DE', 'AT', 'CH') AND {_sql_rlike(tx.GAAP_PATTERN)} THEN 'GAAP' ELSE 'none' END AS flag FROM documents""")
def flt5(spark, d):
    module = F.when(F.col("source") == "src1", "AccountsPayable").when(F.col("source") == "src2", "AccountsReceivable").otherwise("x")
    flag = tx.consistency_flag(F.col("text"), module, F.col("lang"))
    short = F.when(F.contains(flag, F.lit("customer/AR")), "AR").when(F.contains(flag, F.lit("vendor/AP")), "AP").when(F.contains(flag, F.lit("GAAP")), "GAAP").otherwise("none")
    return docs(spark, d).select("doc_id", short.alias("flag"))


@query("flt9_quality_gates", f"""WITH t AS (SELECT doc_id, text, n_chars, source, {TOKENS} AS w, doc_id > min(doc_id) OVER (PARTITION BY text) AS dup, doc_id % 11 = 0 AS named FROM documents),
c AS (SELECT *, len([x FOR x IN w IF x IN {_in(SAMPLE_CONCRETE + SAMPLE_SPECIFIC)}]) + len([i FOR i IN range(1, len(w)) IF (w[i] || ' ' || w[i + 1]) IN {_in(SAMPLE_CONCRETE)}]) AS good, len([x FOR x IN w IF x IN {_in(SAMPLE_VAGUE)}]) AS bad FROM t)
SELECT doc_id, CASE WHEN dup THEN 'POTENTIAL_DUPLICATE' WHEN named THEN 'SCHEMA_MISMATCH' WHEN s < 0.30 THEN 'TOO_VAGUE' WHEN source = 'src3' AND s < 0.5 THEN 'INCOMPLETE' WHEN length(text) < 10 OR length(text) > 2000 THEN 'SCHEMA_MISMATCH' ELSE 'PASS' END AS gate
FROM (SELECT *, CASE WHEN good + bad = 0 THEN 0.4 ELSE good / (good + bad) END AS s FROM c)""")
def flt9(spark, d):
    marked = dedup.text_copies(docs(spark, d), "doc_id", "text").withColumnRenamed("is_copy", "dup")
    w = marked.select("doc_id", "text", "source", tx.tokens(F.col("text")).alias("w"), "dup")
    s = w.select("*", tx.specificity(F.col("w"), SAMPLE_CONCRETE, SAMPLE_SPECIFIC, SAMPLE_VAGUE).alias("s"))
    said = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" for the customer"))).otherwise(F.lit(""))
    gate = tx.quality_gate(F.col("dup"), tx.consistency_flag(said, F.lit("AccountsPayable"), F.lit("FR")), F.col("s"), F.when(F.col("source") == "src3", 0).otherwise(100), F.char_length("text"))
    return s.select("doc_id", F.coalesce(gate, F.lit("PASS")).alias("gate"))


@query("flt10_file_validation", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNSUPPORTED_FORMAT' WHEN strlen(text) > 20000 THEN 'FILE_TOO_LARGE' ELSE 'OK' END AS verdict FROM documents")
def flt10(spark, d):
    fmt = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise("TXT")
    return docs(spark, d).select("doc_id", tx.file_verdict(fmt, F.octet_length("text"), 20000).alias("verdict"))


@query("src1_format_sniffing", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN NULL WHEN 2 THEN 'TXT' ELSE NULL END AS format FROM pages")
def src1(spark, d):
    body = F.encode("html", "utf-8")
    k = F.col("page_id") % 4
    content = F.when(k == 0, F.concat(F.lit(b"%PDF"), body)).when(k == 1, F.concat(body, F.lit(b"\x00"), body)).when(k == 2, body).otherwise(F.lit(b""))
    return table(spark, d, "pages").select("page_id", tx.format_name(F.substring(content, 1, 1 << 20), F.lit(False)).alias("format"))


def _injection_sql() -> str:
    hits = " + ".join(f"regexp_matches(coalesce(text, ''), '(?is){p}')::INT" for _, p in tx.INJECTION_PATTERNS[:-1]) + " + contains(coalesce(text, ''), chr(8238))::INT"
    return f"SELECT doc_id, n AS n_hits, round(n / 10.0, 6)::DOUBLE AS score, CASE WHEN n / 10.0 >= 0.5 THEN 'BLOCK' WHEN n / 10.0 >= 0.15 THEN 'FLAG_FOR_REVIEW' ELSE 'PASS' END AS action FROM (SELECT doc_id, ({hits}) AS n FROM documents)"


@query("flt11_injection_scan", _injection_sql())
def flt11(spark, d):
    h = docs(spark, d).select("doc_id", tx.injection_hits(F.col("text")).alias("hits"))
    return h.select("doc_id", F.size("hits").alias("n_hits"), F.round(F.size("hits") / 10.0, 6).alias("score"), tx.injection_action(F.col("hits")).alias("action"))


_PII = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))::BIGINT AS {n.lower()}" for n, p in tx.PII_PATTERNS)


@query("txt12_pii_scan", f"SELECT doc_id, {_PII} FROM documents")
def txt12(spark, d):
    c = docs(spark, d).select("doc_id", tx.pii_counts(F.col("text")).alias("m"))
    return c.select("doc_id", *(F.element_at("m", F.lit(n)).cast("long").alias(n.lower()) for n, _ in tx.PII_PATTERNS))


def _spans(name: str, pattern: str) -> str:
    """Rows (doc_id, name, start, stop) of a pattern's matches: where they lie follows from the parts between them."""
    return f"""SELECT doc_id, '{name}' AS name, list_sum([length(x) FOR x IN parts[:k]]) + coalesce(list_sum([length(x) FOR x IN found[:k - 1]]), 0) AS start, length(found[k]) AS size
 FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS found, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS k FROM documents WHERE text IS NOT NULL)"""


_REDACTED = f"""m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, start + size DESC, ord) AS n FROM ({" UNION ALL ".join(f"SELECT *, {i} AS ord FROM ({_spans(*x)})" for i, x in enumerate(tx.PII_PATTERNS))})),
g AS (SELECT doc_id, name, start, size, n, true AS kept, start + size AS at FROM m WHERE n = 1 UNION ALL SELECT m.doc_id, m.name, m.start, m.size, m.n, m.start >= g.at, CASE WHEN m.start >= g.at THEN m.start + m.size ELSE g.at END FROM g JOIN m ON m.doc_id = g.doc_id AND m.n = g.n + 1),
k AS MATERIALIZED (SELECT doc_id, start, size, '<PII_' || name || '_' || row_number() OVER (PARTITION BY doc_id, name ORDER BY start) || '>' AS mark, coalesce(lag(start + size) OVER (PARTITION BY doc_id ORDER BY start), 0) AS after, lead(start) OVER (PARTITION BY doc_id ORDER BY start) IS NULL AS ends FROM g WHERE kept),
r AS (SELECT doc_id, count(*) AS n, string_agg(substr(text, (after + 1)::BIGINT, (start - after)::BIGINT) || mark || CASE WHEN ends THEN substr(text, (start + size + 1)::BIGINT) ELSE '' END, '' ORDER BY start) AS redacted FROM k JOIN documents USING (doc_id) GROUP BY doc_id)"""


@query("txt10_pii_redaction", f"WITH RECURSIVE {_REDACTED} SELECT doc_id, sha256(coalesce(redacted, text)) AS redacted_sha256, coalesce(n, 0)::INT AS n_entities FROM documents LEFT JOIN r USING (doc_id)")
def txt10(spark, d):
    return pii.redact(docs(spark, d).select("doc_id", "text"), "doc_id", "text").select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.size("entities").alias("n_entities"))


@query("jon21_pii_round_trip", "SELECT doc_id, sha256(text) AS restored_sha256 FROM documents WHERE NOT contains(text, '<PII_')")
def jon21(spark, d):
    r = pii.redact(docs(spark, d).filter(~F.contains("text", F.lit("<PII_"))).select("doc_id", "text"), "doc_id", "text")
    return r.select("doc_id", F.sha2(tx.restore_pii(F.col("redacted"), F.col("found")), 256).alias("restored_sha256"))


@query("agg26_pii_type_counts", "SELECT type, n FROM (UNPIVOT (SELECT " + ", ".join(f"sum(len(regexp_extract_all(coalesce(text, ''), '{p}')))::BIGINT AS {n}" for n, p in tx.PII_PATTERNS) + " FROM documents) ON COLUMNS(*) INTO NAME type VALUE n) WHERE n > 0")
def agg26(spark, d):
    c = docs(spark, d).select(F.explode(tx.pii_counts(F.col("text"))).alias("type", "n"))
    return c.groupBy("type").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.col("n").desc(), "type")


@query("src6_txt_paragraphs", r"SELECT doc_id, len([x FOR x IN string_split(text, chr(10) || chr(10)) IF regexp_matches(x, '\S')])::BIGINT AS n_parts FROM documents")
def src6(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n_parts"))


@query("prj2_requirement_texts", "SELECT doc_id, length(x)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(trim(x)) >= 30")
def prj2(spark, d):
    return vw.requirement_lines(docs(spark, d), "doc_id", "text").select("doc_id", F.char_length("line").cast("long").alias("n"))


@query("prj3_atom_ids", "SELECT doc_id, pos, 'REQ-' || lpad(doc_id::VARCHAR, 8, '0') || '-' || lpad((pos - 1)::VARCHAR, 4, '0') AS atom_id FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) >= 10")
def prj3(spark, d):
    return vw.atom_ids(docs(spark, d), "doc_id", "text")


@query("txt6_entity_overlap", "SELECT doc_id, round(((contains(lower(text), 'tion'))::INT + (contains(lower(text), 'eaux'))::INT + (contains(lower(text), 'ung'))::INT) / 3.0, 6) AS overlap FROM documents")
def txt6(spark, d):
    hints = F.array(F.lit("tion"), F.lit("eaux"), F.lit("ung"))
    return docs(spark, d).select("doc_id", F.round(tx.entity_overlap(hints, F.col("text")), 6).alias("overlap"))


def _steps_sql(mark: str, end: str) -> str:
    """The marked items of t as a DuckDB list: cut before each line that begins with `end`, keep what begins with `mark`."""
    return rf"[regexp_replace(regexp_replace(x, '^{mark}\s+', ''), '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace(t, '\n\s*({end})', chr(1) || '\1', 'g'), chr(1)) IF regexp_matches(x, '^{mark}\s+\S')]"


@query("txt9_config_steps", rf"""WITH d AS (SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', chr(10) || '3) ') WHEN 1 THEN replace(text, '. ', chr(10) || '- ') ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, {_steps_sql(tx.STEP_MARK, tx.STEP_END)} AS a, {_steps_sql(tx.BULLET_MARK, tx.BULLET_MARK)} AS b, [y FOR y IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(t, chr(10))] IF y <> ''] AS c FROM d),
s AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS s FROM w) SELECT doc_id, len(s)::BIGINT AS n_steps, md5(array_to_string(s, '|')) AS steps_md5 FROM s""")
def txt9(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.replace("text", F.lit(". "), F.lit("\n3) "))).when(k == 1, F.replace("text", F.lit(". "), F.lit("\n- "))).otherwise(F.col("text"))
    s = docs(spark, d).select("doc_id", tx.config_steps(t).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_steps"), F.md5(F.array_join("s", "|")).alias("steps_md5"))


@query("txt13_cross_references", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:See|Refer to|Same as|per) (?:Section|Figure|REQ-)\S+'))::BIGINT AS n_refs FROM documents")
def txt13(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.cross_references(F.col("text"))).cast("long").alias("n_refs"))


@query("txt14_last_sentences", "WITH p AS (SELECT doc_id, [x FOR x IN string_split(text, '. ') IF x <> ''] AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 2 THEN s[len(s) - 1] || '. ' || s[len(s)] ELSE '' END AS overlap FROM p")
def txt14(spark, d):
    return docs(spark, d).select("doc_id", tx.last_sentences(F.col("text")).alias("overlap"))


@query("txt15_token_estimate", r"SELECT doc_id, floor(len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']) * 1.3::DOUBLE)::INT AS estimate FROM documents")
def txt15(spark, d):
    return docs(spark, d).select("doc_id", tx.token_estimate(F.col("text")).alias("estimate"))


@query("txt16_table_slices", """WITH t AS (SELECT p_partkey, ['| ' || i || ' | ' || p_brand || ' |' FOR i IN range(p_size)] AS body FROM part)
SELECT p_partkey AS id, s AS slice, md5('| n | brand |' || chr(10) || '|---|---|' || chr(10) || array_to_string(body[15 * s + 1:15 * s + 15], chr(10))) AS slice_md5 FROM (SELECT *, unnest(range((len(body) + 14) // 15)) AS s FROM t)""")
def txt16(spark, d):
    row = lambda i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), F.col("p_brand"), F.lit(" |"))
    lines = F.concat(F.array(F.lit("Parts"), F.lit("| n | brand |"), F.lit("|---|---|")), F.when(F.col("p_size") > 0, F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), row)).otherwise(F.array().cast("array<string>")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(lines, "\n").alias("t"))
    return p.select("id", F.posexplode(tx.table_slices(F.col("t"))).alias("slice", "s")).select("id", F.col("slice").cast("long").alias("slice"), F.md5("s").alias("slice_md5"))


@query("prj14_prompt_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def prj14(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.html_escape(F.col("html"))).alias("escaped_md5"))


@query("prj9_text_ladder", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 OR trim(text) = '' THEN source ELSE text END) AS chunk_md5 FROM documents")
def prj9(spark, d):
    payload = F.create_map(F.lit("text"), F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.lit("description"), F.col("source"))
    return docs(spark, d).select("doc_id", tx.payload_text(payload).alias("chunk")).filter(F.col("chunk").isNotNull()).select("doc_id", F.md5("chunk").alias("chunk_md5"))


@query("prj4_dominant_modality", "SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'TABLE' WHEN contains(text, '@') THEN 'IMAGE' ELSE 'TEXT' END AS modality FROM documents")
def prj4(spark, d):
    return docs(spark, d).select("doc_id", vw.dominant_modality(F.contains("text", F.lit(" | ")).cast("int"), F.contains("text", F.lit("@")).cast("int")).alias("modality"))


@query("agg15_text_ratio", "SELECT conv_id, round(sum(length(text)) / (count(*) * 2000.0), 6) AS ratio FROM conversations GROUP BY 1")
def agg15(spark, d):
    return vw.text_ratio(table(spark, d, "conversations"), "conv_id", "text").withColumn("ratio", F.round("ratio", 6))


#: Headers that the sample table names in one of three ways.
HEADER_SYNONYMS = {"ECONOMY": ["economy", "economy part"], "STANDARD": ["standard", "standard part"], "PROMO": ["promo brand"]}


def _lcs(u: str, v: str) -> str:
    """Length of the longest common subsequence, by the bits of a HUGEINT; u has up to 120 characters."""
    full = f"((1::HUGEINT << len({u})) - 1)"
    at = f"list_sum(list_transform(range(1, len({u}) + 1), lambda i: CASE WHEN substr({u}, i::BIGINT, 1) = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT"
    return f"(len({u}) - bit_count(list_reduce([{full}] || list_transform(string_split({v}, ''), lambda ch: coalesce({at}, 0::HUGEINT)), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"


def _indel(u: str, v: str) -> str:
    return f"CASE WHEN {u} = '' AND {v} = '' THEN 100.0 ELSE 200.0 * {_lcs(u, v)} / (len({u}) + len({v})) END"


def ratio_sql(pairs: str) -> str:
    """DuckDB CTEs that end in `ratios` (a, b, score in percent) for the distinct pairs (a, b) of a table."""
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')))"
    return f"""w_ AS MATERIALIZED (SELECT DISTINCT a, b, {words('a')} AS x, {words('b')} AS y FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL),
p_ AS MATERIALIZED (SELECT a, b, len(x) * len(y) AS n, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS c, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS l, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS r FROM w_),
j_ AS MATERIALIZED (SELECT *, trim(c || ' ' || l) AS p, trim(c || ' ' || r) AS q FROM p_),
ratios AS MATERIALIZED (SELECT a, b, CASE WHEN n = 0 THEN 0.0 WHEN c <> '' AND (l = '' OR r = '') THEN 100.0 ELSE greatest({_indel('p', 'q')}, CASE WHEN c <> '' THEN {_indel('c', 'p')} ELSE 0 END, CASE WHEN c <> '' THEN {_indel('c', 'q')} ELSE 0 END) END::DOUBLE AS score FROM j_)"""


_HEADS = "CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_type || ' ' || p_brand ELSE p_name END"
_TERMS = ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate((c, t) for c, ts in HEADER_SYNONYMS.items() for t in ts))
_GRAMS = "SELECT t, g, count(*) AS n FROM (SELECT t, unnest(list_transform(range(1, len(t) + 2), lambda i: substr('  ' || t || ' ', i::BIGINT, 3))) AS g FROM {0}) GROUP BY ALL"


@query("txt8_header_mapping", f"""WITH h AS MATERIALIZED (SELECT p_partkey AS id, lower(trim({_HEADS})) AS t FROM part), s AS MATERIALIZED (SELECT * FROM (VALUES {_TERMS}) v(canonical, term, ord)), u AS MATERIALIZED (SELECT DISTINCT t FROM h WHERE t NOT IN (SELECT term FROM s)),
pairs_ AS (SELECT t AS a, term AS b FROM u, s), {ratio_sql('pairs_')}, f AS (SELECT a, arg_max(canonical, score * 1000 - ord) AS canonical, max(score) / 100 AS r FROM ratios JOIN s ON term = b WHERE score > 70 GROUP BY a),
x AS MATERIALIZED ({_GRAMS.format('u')}), y AS MATERIALIZED ({_GRAMS.format('(SELECT term AS t FROM s)')}), nx AS (SELECT t, sqrt(sum(n * n)) AS n FROM x GROUP BY t), ny AS (SELECT t, sqrt(sum(n * n)) AS n FROM y GROUP BY t),
d AS (SELECT x.t AS a, y.t AS b, sum(x.n * y.n) / any_value(nx.n * ny.n) AS score FROM x JOIN y USING (g) JOIN nx ON nx.t = x.t JOIN ny ON ny.t = y.t GROUP BY ALL),
n AS (SELECT a, arg_max(canonical, score * 1000 - ord / 1e6) AS canonical, max(score) AS r FROM d JOIN s ON term = b WHERE score > 0.65 GROUP BY a)
SELECT id, coalesce(s.canonical, f.canonical, n.canonical) AS canonical, CASE WHEN s.canonical IS NOT NULL THEN 'exact' WHEN f.a IS NOT NULL THEN 'fuzzy' WHEN n.a IS NOT NULL THEN 'nlp' ELSE 'unmatched' END AS tier, round(CASE WHEN s.canonical IS NOT NULL THEN 1.0 ELSE coalesce(f.r, n.r, 0.0) END, 6)::DOUBLE AS confidence
FROM h LEFT JOIN s ON s.term = h.t LEFT JOIN f ON f.a = h.t LEFT JOIN n ON n.a = h.t""")
def txt8(spark, d):
    from sparkloom.functions.headers import load_synonyms, map_headers

    synonyms = load_synonyms(spark, HEADER_SYNONYMS)
    heads = table(spark, d, "part").selectExpr("p_partkey id", f"{_HEADS} header")
    return map_headers(heads, synonyms).selectExpr("id", "canonical", "tier", "round(confidence, 6) confidence")


_LABEL = "p_name || ' ' || p_type || ' ' || p_brand"


@query("txt7_token_set_ratio", f"""WITH l AS MATERIALIZED (SELECT p_partkey AS id, {_LABEL} AS t FROM part), n AS MATERIALIZED (SELECT x.id, x.t AS a, y.t AS b FROM l x JOIN l y ON y.id + 1 = x.id), {ratio_sql('n')}
SELECT id, round(score / 100, 6) AS ratio FROM n JOIN ratios USING (a, b)""")
def txt7(spark, d):
    from sparkloom.functions.headers import token_set_ratio

    b = table(spark, d, "part").selectExpr("p_partkey id", f"{_LABEL} t")
    other = b.selectExpr("id + 1 id", "t s")
    return b.join(other, "id").select("id", F.round(token_set_ratio("t", "s"), 6).alias("ratio"))


@query("txt7_fuzzy_pairs", f"""WITH l AS MATERIALIZED (SELECT DISTINCT {_LABEL} AS t FROM part), k AS MATERIALIZED (SELECT DISTINCT p_type || ' ' || p_name AS t FROM part), n AS MATERIALIZED (SELECT l.t AS a, k.t AS b FROM l, k), {ratio_sql('n')}
SELECT a AS x, b AS y, round(score, 6) AS score FROM ratios WHERE score > 70""")
def txt7_pairs(spark, d):
    """All pairs of part labels and part kinds above a ratio of 70, without comparing all pairs."""
    from sparkloom.operators import fuzzy

    part = table(spark, d, "part")
    found = fuzzy.ratio_pairs(part.selectExpr(f"{_LABEL} t"), part.selectExpr("p_type || ' ' || p_name t"), 70.0)
    return found.select("x", "y", F.round("score", 6).alias("score"))


_LINES = "SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents"
#: Items one after the other: k is 1 where the chunk was closed by its size, 2 by a heading, 0 where it is open.
_CHUNKS = f"""i AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, length(x) < 20 AS h, trim(x) AS t FROM ({_LINES}) WHERE trim(x) <> ''),
r AS (SELECT doc_id, n, h, t, 0 AS chunk, 2 AS before, 0 AS size, 2 AS k FROM (SELECT doc_id, 0 AS n, true AS h, '' AS t FROM i GROUP BY 1)
 UNION ALL SELECT i.doc_id, i.n, i.h, i.t, CASE WHEN NOT i.h AND r.k > 0 THEN r.chunk + 1 ELSE r.chunk END, r.k, CASE WHEN i.h THEN 0 WHEN r.k > 0 THEN length(i.t) ELSE r.size + length(i.t) END,
  CASE WHEN i.h THEN 2 WHEN (CASE WHEN r.k > 0 THEN 0 ELSE r.size END) + length(i.t) >= {chunking.MAX_CHARS} THEN 1 ELSE 0 END FROM r JOIN i ON i.doc_id = r.doc_id AND i.n = r.n + 1),
m AS (SELECT *, last_value(CASE WHEN h AND n > 0 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section, sum(CASE WHEN h THEN 0 ELSE length(t) + 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS off FROM r),
c AS (SELECT doc_id, chunk, string_agg(t, ' ' ORDER BY n) AS body, arg_min(before, n) = 1 AS follows, max(off) AS off, coalesce(any_value(section), '') AS section FROM m WHERE NOT h GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN follows THEN list_filter(string_split(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), '. '), lambda y: y <> '') END AS parts FROM c),
l AS (SELECT *, CASE WHEN len(parts) > {chunking.OVERLAP_SENTENCES} THEN array_to_string(parts[-{chunking.OVERLAP_SENTENCES}:], '. ') ELSE '' END AS lead FROM b)"""


@query("chk1_prose_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, (chunk - 1)::INT AS chunk_no, section, off::BIGINT AS char_offset, lead <> '' AS has_overlap, length(CASE WHEN lead <> '' THEN trim(lead || ' ' || body) ELSE body END)::INT AS n_chars FROM l")
def chk1(spark, d):
    items = F.transform(F.split("text", "\n"), lambda x: F.struct((F.char_length(x) < 20).alias("is_heading"), x.alias("text"), F.lit(1).alias("page")))
    return chunking.prose_chunks(docs(spark, d), items).select("doc_id", "chunk_no", "section", "char_offset", "has_overlap", F.char_length("text").alias("n_chars"))


_N = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda y: y <> ''))"
_T = lambda words: f"floor(({words}) * 1.3)::BIGINT"
_GROUP = int((chunking.MAX_TOKENS + 1) / 1.3 - 1e-9)  # words that make MAX_TOKENS tokens at most
#: Oversized lines fall into sentences, or words, that are grouped; then pieces are packed. why: a chunk begins by size (1), or by section (2).
_TOKEN_CHUNKS = f"""l AS MATERIALIZED (SELECT doc_id, i, x, i // 20 + 1 AS page, i // 40 AS head, {_N('x')} AS nw FROM ({_LINES}) WHERE trim(x) <> ''),
o AS MATERIALIZED (SELECT *, list_filter(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS parts FROM l WHERE {_T('nw')} > {chunking.MAX_TOKENS}),
u AS MATERIALIZED (SELECT doc_id, i, k, parts[k] AS t, {_N('parts[k]')} AS w FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM o WHERE len(parts) > 1 AND list_max(list_transform(parts, lambda y: {_T(_N('y'))})) <= {chunking.MAX_TOKENS})),
g AS (SELECT doc_id, i, k, t, w AS held, 1 AS p FROM u WHERE k = 1 UNION ALL SELECT u.doc_id, u.i, u.k, u.t, CASE WHEN {_T('g.held + u.w')} > {chunking.MAX_TOKENS} THEN u.w ELSE g.held + u.w END, CASE WHEN {_T('g.held + u.w')} > {chunking.MAX_TOKENS} THEN g.p + 1 ELSE g.p END FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i AND u.k = g.k + 1),
v AS (SELECT doc_id, i, ws, unnest(range(1, (len(ws) + {_GROUP - 1}) // {_GROUP} + 1)) AS p FROM (SELECT doc_id, i, list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '') AS ws FROM o ANTI JOIN u USING (doc_id, i))),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) AS n, {_T(_N('t'))} AS tok FROM (
 SELECT doc_id, i, 1 AS p, x AS t FROM l WHERE {_T('nw')} <= {chunking.MAX_TOKENS} UNION ALL SELECT doc_id, i, p, string_agg(t, ' ' ORDER BY k) FROM g GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, i, p, array_to_string(ws[(p - 1) * {_GROUP} + 1:p * {_GROUP}], ' ') FROM v) JOIN (SELECT doc_id, i, page, head FROM l) USING (doc_id, i)),
r AS (SELECT doc_id, n, t, page, head, tok AS size, 1 AS chunk, 2 AS why FROM e WHERE n = 1 UNION ALL SELECT e.doc_id, e.n, e.t, e.page, e.head, CASE WHEN e.head <> r.head OR r.size + e.tok > {chunking.MAX_TOKENS} THEN e.tok ELSE r.size + e.tok END,
 CASE WHEN e.head <> r.head OR r.size + e.tok > {chunking.MAX_TOKENS} THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN e.head <> r.head THEN 2 WHEN r.size + e.tok > {chunking.MAX_TOKENS} THEN 1 ELSE 0 END FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1),
c AS (SELECT doc_id, chunk, string_agg(t, chr(10) || chr(10) ORDER BY n) AS body, arg_min(why, n) AS why, min(page) AS lo, max(page) AS hi, '[' || string_agg(page::VARCHAR, ', ' ORDER BY n) || ']' AS pages FROM r GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN why = 1 THEN array_to_string(list_filter(string_split_regex(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), '\\s+'), lambda y: y <> '')[-{int(chunking.OVERLAP_TOKENS / 1.3)}:], ' ') ELSE '' END AS lead FROM c),
f AS (SELECT *, CASE WHEN lead <> '' THEN regexp_replace(lead || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g') ELSE body END AS text FROM b)"""


@query("chk2_token_chunks", f"WITH RECURSIVE {_TOKEN_CHUNKS} SELECT doc_id, (chunk - 1)::INT AS chunk_no, least({chunking.CLAMP_TOKENS}, greatest(1, {_T(_N('text'))}))::INT AS n_tokens, lo::INT AS page_first, hi::INT AS page_last, substr(sha256(text || pages), 1, 24) AS chunk_id FROM f")
def chk2(spark, d):
    item = lambda x, i: F.struct(x.alias("text"), F.lit("TEXT").alias("modality"), (F.floor(i / 20) + 1).cast("int").alias("page_no"), F.array(F.concat(F.lit("s"), F.floor(i / 40).cast("string"))).alias("section_path"))
    items = F.filter(F.transform(F.split("text", "\n"), item), lambda x: F.trim(x["text"]) != "")
    return chunking.token_chunks(docs(spark, d), items).select("doc_id", "chunk_no", "n_tokens", "page_first", "page_last", "chunk_id")


@query("chk5_section_change", "SELECT doc_id, pos, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM s, true) AS changed FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, left(unnest(string_split(text, chr(10))), 1) AS s FROM documents)")
def chk5(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.array(F.left("x", F.lit(1))).alias("path"))
    return vw.section_changes(rows, "doc_id", "pos", "path").drop("path")


@query("src8_section_paths", "SELECT doc_id, pos, last_value(CASE WHEN length(x) < 20 THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents)")
def src8(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "x")
    return chunking.section_carry(rows, "doc_id", "pos", F.when(F.char_length("x") < 20, F.col("x"))).select("doc_id", "pos", "section")


@query("src8_element_stream", f"""WITH RECURSIVE i AS MATERIALIZED (SELECT doc_id, i AS n, i // 20 + 1 AS page, CASE WHEN length(x) < 20 THEN length(x) % 4 ELSE 0 END AS level, x FROM ({_LINES})),
r AS (SELECT doc_id, n, page, level, x, CASE WHEN level > 0 THEN [trim(x)] ELSE []::VARCHAR[] END AS path FROM i WHERE n = 0
 UNION ALL SELECT i.doc_id, i.n, i.page, i.level, i.x, CASE WHEN i.level > 0 THEN list_append(r.path[:least(len(r.path), i.level - 1)], trim(i.x)) ELSE r.path END FROM r JOIN i ON i.doc_id = r.doc_id AND i.n = r.n + 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS element_no, page::INT AS page, md5(x) AS text_md5, array_to_string(path, ' > ') AS section FROM r WHERE level = 0""")
def src8_stream(spark, d):
    """Lines as items, short ones headings of level 1 to 3 by their length; a heading trims the path to its level."""
    item = lambda x, i: F.struct((F.floor(i / 20) + 1).cast("int").alias("page"), (i % 20).cast("int").alias("place"), F.when(F.char_length(x) < 20, F.char_length(x) % 4).otherwise(0).alias("level"), F.lit("TEXT").alias("modality"), x.alias("text"))
    found = chunking.element_stream(docs(spark, d), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), item))
    return found.select("doc_id", "element_no", "page", F.md5("text").alias("text_md5"), F.array_join("section_path", " > ").alias("section"))


@query("win8_char_offset", "SELECT doc_id, pos, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS char_offset FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents)")
def win8(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "x")
    return vw.char_offsets(rows, "doc_id", "pos", "x").drop("x")


@query("agg13_modality_shares", "SELECT conv_id, role, round(sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 6) AS share FROM conversations GROUP BY 1, 2")
def agg13(spark, d):
    return vw.modality_shares(table(spark, d, "conversations"), "conv_id", "role", F.char_length("text")).withColumn("share", F.round("share", 6))


@query("agg14_chunk_rollup", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) AS n FROM conversations GROUP BY 1")
def agg14(spark, d):
    r = vw.rollup(table(spark, d, "conversations"), "conv_id", "turn", "role")
    return r.select("conv_id", F.col("first").alias("first_turn"), F.col("last").alias("last_turn"), F.array_join("labels", ",").alias("roles"), "n")


@query("win11_batches_of_ten", "SELECT conv_id, batch, count(*) AS n, min(turn) AS first_turn FROM (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10 AS batch FROM conversations) GROUP BY conv_id, batch")
def win11(spark, d):
    turns = rel.in_batches(table(spark, d, "conversations"), ["conv_id"], ["turn"], 10)
    return turns.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("flt22_input_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE x <> '' AND NOT starts_with(x, '#') GROUP BY 1")
def flt22(spark, d):
    return vw.input_lines(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("txt17_fallback_description", "SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN url END, CASE WHEN page_id % 3 = 0 THEN 'Image in section ' || page_id END, 'Image') AS text FROM pages")
def txt17(spark, d):
    return table(spark, d, "pages").select("page_id", tx.fallback_description(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string"))).alias("text"))


@query("agg33_bm25_idf", f"""WITH t AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark), n AS (SELECT term, count(*) AS n_docs FROM t GROUP BY 1),
r AS (SELECT *, ln(((SELECT count(*) FROM benchmark) - n_docs + 0.5) / (n_docs + 0.5)) AS raw FROM n)
SELECT term, n_docs, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""")
def agg33(spark, d):
    from sparkloom.operators.retrieval import bm25_vocabulary

    return bm25_vocabulary(table(spark, d, "benchmark"), "item_id", tx.tokens(F.col("text"))).withColumn("idf", F.round("idf", 6))


@query("txt18_bm25_encode", f"""WITH t AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark), n AS (SELECT term, count(*) AS n_docs FROM t GROUP BY 1),
r AS (SELECT *, ln(((SELECT count(*) FROM benchmark) - n_docs + 0.5) / (n_docs + 0.5)) AS raw FROM n), v AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)
SELECT item_id, count(*) AS n_terms, round(sum(idf), 4) AS weight FROM t JOIN v USING (term) WHERE idf > 0 GROUP BY 1""")
def txt18(spark, d):
    from sparkloom.operators.retrieval import bm25_encode, bm25_vocabulary

    b, tokens = table(spark, d, "benchmark"), tx.tokens(F.col("text"))
    return bm25_encode(b, bm25_vocabulary(b, "item_id", tokens), "item_id", tokens).groupBy("item_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 4).alias("weight"))


_LOG = lambda n, r, c: f"CASE WHEN {n} > 0 THEN {n} * ln({n} * total / ({r} * {c})) ELSE 0 END"
_LLR = "2 * (" + " + ".join(_LOG(*x) for x in (("n", "f", "s"), ("(f - n)", "f", "(total - s)"), ("(s - n)", "(total - f)", "s"), ("(total - f - s + n)", "(total - f)", "(total - s)"))) + ")"


@query("txt5_phrases", f"""WITH p AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents))),
c AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL), x AS (SELECT a, sum(n) AS f FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS s FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
k AS MATERIALIZED (SELECT a, b FROM c JOIN x USING (a) JOIN y USING (b), t WHERE n >= {phrases.SUPPORT} AND n * total > f * s AND {_LLR} >= {phrases.LEAST}),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM p JOIN k USING (a, b)), q AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) // {phrases.MOST_WORDS - 1} AS part FROM r)
SELECT doc_id, min(pos)::INT AS pos, (count(*) + 1)::INT AS words, string_agg(a, ' ' ORDER BY pos) || ' ' || arg_max(b, pos) AS phrase FROM q GROUP BY doc_id, run, part""")
def txt5_phrases(spark, d):
    """Collocations of all documents, and the phrases of each."""
    words = tx.tokens(F.col("text"))
    found = written(phrases.collocations_of(docs(spark, d), words), "collocations")
    return phrases.phrases(docs(spark, d), "doc_id", words, found)
