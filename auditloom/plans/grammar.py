"""Facts of a grammar engine laid over the texts, and texts that pages share."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import evidence as E
from auditloom.operators import grammar as G
from auditloom.operators.graph import cut_lineage
from auditloom.operators.report_rules import main_text

from .content import KNOWN, documents
from .registry import query, table
from .resources import one_of, sql_one_of

CATEGORIES, RULES, RULE_TYPES = ["TYPOS", "grammar", "PUNCTUATION", "STYLE", "SEMANTICS", "UNKNOWN"], ["R1", "COMMA_SPACE", "EN_A"], ["grammar", "misspelling", "other", "other"]


@query(f"""WITH m AS (SELECT event_id, upper({sql_one_of(CATEGORIES, "event_id")}) AS c, {sql_one_of(RULES, "event_id // 2")} AS r, {sql_one_of(RULE_TYPES, "event_id // 3")} AS t FROM events)
SELECT event_id, CASE WHEN c = 'TYPOS' OR t = 'misspelling' THEN 'Spelling' WHEN contains(r, 'SPACE') THEN 'Spacing' WHEN c = 'GRAMMAR' THEN 'Grammar' WHEN c = 'PUNCTUATION' THEN 'Punctuation' WHEN c = 'STYLE' THEN 'Style'
WHEN c = 'SEMANTICS' THEN 'Word misuse' WHEN t = 'grammar' THEN 'Grammar' ELSE 'Typographical' END AS kind FROM m""")
def finding_kinds(spark, sf_dir):
    """Kinds of findings; what the engine says is laid over the events."""
    n = F.col("event_id")
    kind = G.finding_kind(one_of(CATEGORIES, n), one_of(RULES, F.floor(n / 2)), one_of(RULE_TYPES, F.floor(n / 3)))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query(r"""WITH t AS (SELECT doc_id, text, length(text) // 2 AS a, length(text) // 2 + length(text) // 9 AS b FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, b, length(regexp_extract(text[1:a], '(?s)^(.*[.!?:] )', 1)) AS l, length(regexp_extract(substring(text, b + 1), '(?s)^(.*?[.!?]) ', 1)) AS stop FROM t)
SELECT doc_id, l::INTEGER AS l, CASE WHEN stop > 0 THEN b + stop ELSE length(text) END::INTEGER AS r FROM s""")
def sentences_around(spark, sf_dir):
    """Where the sentence around the middle of each text begins and ends."""
    n = F.length("text")
    a = F.floor(n / 2).cast("int")
    rows = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", G.sentence_bounds(F.col("text"), a, a + F.floor(n / 9).cast("int")).alias("s"))
    return rows.select("doc_id", F.col("s.left").alias("l"), F.col("s.right").alias("r"))


@query("""WITH p AS (SELECT url, page_id, page_id % 4 AS blocks, CASE WHEN page_id % 3 = 0 THEN 'not read' ELSE '' END AS note FROM pages), i AS (SELECT url, ['Important', 'Info'][page_id % 2 + 1] AS severity FROM pages WHERE page_id % 5 < 3),
c AS (SELECT url, count(*) AS n, count(*) FILTER (severity = 'Important') AS grave FROM i GROUP BY 1)
SELECT p.url, CASE WHEN note <> '' AND blocks = 0 THEN 'SKIP' WHEN grave > 0 THEN 'FAIL' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(n, 0)::BIGINT AS issues FROM p LEFT JOIN c USING (url)""")
def grammar_statuses(spark, sf_dir):
    """Status of each page by what was found in its texts; findings are laid over the pages."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    issues = pages.where(n % 5 < 3).select("url", one_of(["Important", "Info"], n).alias("severity"))
    return G.page_statuses(pages.select("url", (n % 4).alias("blocks"), F.when(n % 3 == 0, "not read").otherwise("").alias("note")), issues)


MAIN_SQL = r"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') AS h FROM pages),
r AS (SELECT page_id, url, """ + "".join("regexp_replace(" for _ in range(6)) + "h" + "".join(rf", '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')" for t in ("noscript", "svg", "template", "nav", "footer", "head")) + r""" AS h FROM s),
b AS (SELECT page_id, url, coalesce(nullif(regexp_extract(h, '(?is)<main\b[^>]*>(.*)</main\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body\s*>', 1), ''), h) AS h FROM r),
main AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM b)"""


@query(MAIN_SQL + " SELECT url, md5(lower(text)) AS fingerprint FROM main")
def content_fingerprints(spark, sf_dir):
    """A hash of each page's main text, by which language versions that were never translated are found."""
    return table(spark, sf_dir, "pages").select("url", F.md5(F.encode(F.lower(main_text(F.col("html"))), "utf-8")).alias("fingerprint"))


@query(MAIN_SQL + r" SELECT round(avg(len(regexp_extract_all(text, '[^ \t\n\r]+'))), 0)::BIGINT AS words, count(*)::BIGINT AS pages FROM main")
def average_words(spark, sf_dir):
    """Average words of the main text of a page."""
    words = T.word_count(main_text(F.col("html")))
    return table(spark, sf_dir, "pages").agg(F.round(F.avg(words), 0).cast("long").alias("words"), F.count("*").alias("pages"))


#: A word in the middle of each text is laid as a misspelling; what the engine would suggest depends on the id.
LAID_WORD = "[A-Za-z'-]{3,}"

CONFIDENCE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''’-]{{2,}}'))) AS word FROM d), counts AS (SELECT word, count(DISTINCT doc_id) AS n_pages, count(DISTINCT text) AS n_texts FROM words GROUP BY 1),
known AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM d) GROUP BY 1 HAVING count(*) >= {KNOWN}),
terms AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS t FROM part UNION ALL SELECT unnest(regexp_split_to_array(lower(p_brand), '[^a-z0-9]+')) FROM part) WHERE length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$')
  UNION SELECT t FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(regexp_replace(url, '^.*?://', '')), '^[^/]*/', ''), '[^a-z0-9]+')) AS t FROM pages) WHERE length(t) > 2),
k AS (SELECT word FROM known UNION SELECT t FROM terms),
m AS (SELECT doc_id, text, length(text) // 2 AS mid, regexp_extract(text[length(text) // 2 + 1:], '[A-Za-z''-]{{3,}}') AS wrong FROM d),
r AS (SELECT doc_id, text, wrong, mid + strpos(text[mid + 1:], wrong) - 1 AS start, regexp_replace(wrong, '^''+|''+$', '', 'g') AS w,
  [NULL, wrong[2:], wrong || 'xyz', left(wrong, 2) || ' ' || wrong[3:], regexp_replace(wrong, 'our', 'or'), reverse(wrong)][coalesce(doc_id, 0) % 6 + 1] AS best FROM m WHERE wrong <> ''),
f AS (SELECT *, lower(w) AS low, lower(best) AS b, levenshtein(lower(w), lower(best)) AS dist FROM r), asked AS (SELECT DISTINCT low FROM f WHERE length(low) >= 5),
compound AS (SELECT low FROM (SELECT low, unnest({E.PREFIXES}) AS p FROM asked) JOIN k ON k.word = low[length(p) + 1:] WHERE starts_with(low, p) AND length(low) > length(p) + 2
  UNION SELECT low FROM (SELECT low, unnest({E.SUFFIXES}) AS s FROM asked) JOIN k ON k.word = left(low, length(low) - length(s)) WHERE ends_with(low, s) AND length(low) > length(s) + 2
  UNION SELECT low FROM (SELECT low, unnest(range(3, length(low) - 2)) AS i FROM asked) JOIN k AS x ON x.word = left(low, i) JOIN k AS y ON y.word = low[i + 1:]),
x AS (SELECT f.*, coalesce(n_pages, 0) AS n_pages, coalesce(n_texts, 0) AS n_texts FROM f LEFT JOIN counts ON counts.word = low)
SELECT doc_id, wrong, start::INTEGER AS start, CASE WHEN b IS NULL OR low IN (SELECT t FROM terms) OR (low IN (SELECT word FROM known) AND regexp_matches(w, '^[a-z]+$')) OR regexp_matches(w, '[a-z][A-Z]|[A-Z]{{2}}[a-z]') OR (w = upper(w) AND w <> low AND length(w) <= 6)
  OR (start > 0 AND text[start] IN ('.', '/', '@', '#', '-', '_')) OR text[start + length(wrong) + 1] IN ('/', '_') OR contains(w, '-') OR NOT regexp_matches(low, '[aeiouy]') OR low IN (SELECT low FROM compound)
  OR replace(low, '-', '') = replace(b, '-', '') OR (low <> b AND b IN (regexp_replace(low, 'is(e|ed|es|ing|ation)$', 'iz\1'), regexp_replace(low, 'tre$', 'ter'), regexp_replace(low, 'ys(e|ed|es|ing)$', 'yz\1'), regexp_replace(low, 'ogue$', 'og'),
    regexp_replace(low, 'll(ed|ing|er)$', 'l\1'), regexp_replace(low, 'ence$', 'ense'), regexp_replace(low, 'grey', 'gray'), regexp_replace(low, '^(.*?)our', '\1or')))
  OR (contains(b, ' ') AND replace(b, ' ', '') = low AND NOT list_has_any(string_split(b, ' '), {E.FUNCTION_WORDS})) OR (dist > 2 AND (n_pages >= {E.OWN} OR n_texts >= {E.OWN} OR regexp_matches(w, '^[A-Z]'))) THEN NULL
  WHEN dist <= 1 THEN 'High' WHEN dist > 2 THEN 'Low' ELSE 'Medium' END AS confidence FROM x"""


@query(CONFIDENCE_SQL)
def spelling_confidence(spark, sf_dir):
    """How sure a misspelling in the middle of each text is, by what all texts, the urls and the project's terms say of
    its word; null drops it. Words seen KNOWN times stand for the dictionary; package files are laid over the parts."""
    docs = documents(spark, sf_dir)
    names = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct().repartition("p_name")
    parts = names.select(F.to_json(F.struct(F.create_map("p_name", F.lit("1")).alias("dependencies"), F.create_map("p_brand", F.lit("1")).alias("scripts"))).alias("text"))
    terms = cut_lineage(E.project_terms(parts).union(E.url_terms(table(spark, sf_dir, "pages"))).distinct())
    known = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN)
    mid = F.floor(F.length("text") / 2).cast("int")
    rest = F.substring("text", mid + 1, F.length("text"))
    rows = docs.withColumns({"mid": mid, "wrong": F.regexp_extract(rest, LAID_WORD, 0)}).where("wrong <> ''")
    rows = rows.withColumns({"start": (F.col("mid") + F.instr(rest, F.col("wrong")) - 1).cast("int"), "length": F.length("wrong")})
    # a match is read many times: what is kept of its text is the word and a character on either side
    near = F.substring("text", F.greatest(F.col("start"), F.lit(1)), F.col("length") + F.least(F.col("start"), F.lit(1)) + 1)
    rows = cut_lineage(rows.select("doc_id", "wrong", "length", F.col("start").alias("at"), near.alias("text"), F.least(F.col("start"), F.lit(1)).alias("start")))
    wrong, size = F.col("wrong"), F.length("wrong")
    choices = [F.array().cast("array<string>"), F.array(F.substring(wrong, F.lit(2), size)), F.array(F.concat(wrong, F.lit("xyz"))), F.array(F.concat(F.left(wrong, F.lit(2)), F.lit(" "), F.substring(wrong, F.lit(3), size)))]
    choices += [F.array(F.regexp_replace(wrong, "^(.*?)our", "$1or")), F.array(F.reverse(wrong))]
    laid = {"rule_id": "S", "category": "TYPOS", "rule_type": "misspelling", "message": "Possible mistake"}
    rows = rows.withColumns({**{k: F.lit(v) for k, v in laid.items()}, "replacements": F.element_at(F.array(*choices), (F.coalesce("doc_id", F.lit(0)) % 6 + 1).cast("int"))})
    counts = cut_lineage(E.word_counts(docs.select(F.col("doc_id").alias("page"), "text"), E.asked_words(rows)))
    return E.confident(rows, counts, cut_lineage(known.select("word")), terms).select("doc_id", "wrong", F.col("at").alias("start"), "confidence")
