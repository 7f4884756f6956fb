"""Content and text quality over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import similarity
from auditloom.operators.graph import cut_lineage
from auditloom.operators.metrics import top_per_group
from auditloom.operators.sized import running_total

from .registry import query, table

#: Phrases of filler text.
FILLER = (
    "in today's fast-paced", "in today's digital", "unlock the power", "unlock the full potential", "delve into", "in the ever-evolving", "ever-changing landscape",
    "game-changer", "seamlessly integrate", "elevate your", "harness the power", "look no further", "a testament to", "navigating the complexities",
    "it's important to note", "in conclusion", "cutting-edge solutions", "revolutionize", "embark on a journey", "tapestry",
)
#: Patterns of placeholder text, of escaped entities, of wrongly decoded text and of secrets.
PLACEHOLDER = (
    r"lorem ipsum|\blorem\b|coming soon|\btbd\b|\btodo\b|\bdummy (?:text|content)\b|sample text|placeholder|example\.com|\[insert[^\]]*\]|"
    r"\btest (?:page|content|text|post)\b|your (?:company|business) name here|xxx+"
)
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|hellip|mdash|ndash|rsquo|lsquo|rdquo|ldquo|copy|reg|trade|#[0-9]{2,5}|#x[0-9a-f]{2,4});"
MOJIBAKE = "â€|Ã[©¨¢ª«¶¼½§¤±³]|Â[ ·»«©®°]|ï¿½|�"
SECRETS = {
    "Private key in source": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "AWS access key in source": r"\bAKIA[0-9A-Z]{16}\b",
    "GitHub token in source": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "Stripe live secret key in source": r"\b(?:sk|rk)_live_[A-Za-z0-9]{20,}\b",
    "Slack token in source": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "Hard-coded password / secret in source": r"""(?i)\b(?:password|passwd|secret|api_?key|client_secret|auth_token)\b\s*[:=]\s*['"][^'"\s$`{]{10,}['"]""",
    "Google API key in source (restrict it to your domains)": r"\bAIza[0-9A-Za-z_-]{35}\b",
}
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
#: Occurrences from which a word counts as known: there is no dictionary.
KNOWN = 4
FORBIDDEN = ("licensed", "that", "menu")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def hits(rows, pattern: str, text="text", out: str = "hit"):
    return rows.withColumn(out, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+'))::BIGINT AS words FROM documents)
SELECT doc_id, words, CASE WHEN words < 50 THEN 'Empty page (almost no text)' WHEN words < 150 THEN 'Very short page' WHEN words < 300 THEN 'Thin content' END AS length_class FROM w WHERE words < 300""")
def thin_content(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words")).where("words < 300")
    return rows.withColumn("length_class", T.length_class(F.col("words")))


@query(r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) AS s FROM documents WHERE lang = 'en'
), y AS (
  SELECT doc_id, s, len(w) AS n, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+'))
    - CASE WHEN lower(x) LIKE '%e' AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syl FROM w WHERE len(w) >= 50
) SELECT doc_id, round(206.835 - 1.015 * (n / s) - 84.6 * (syl / n), 1)::DOUBLE AS flesch, round(n / s, 1)::DOUBLE AS words_per_sentence FROM y""")
def flesch(spark, sf_dir):
    """Reading ease of English texts of 50 words and more: counts inside the JVM, one pass."""
    rows = documents(spark, sf_dir).where("lang = 'en'").select("doc_id", T.letters_words(F.col("text")).alias("w"), T.sentences(F.col("text")).alias("s")).where(F.size("w") >= 50)
    syl = F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x))
    rows = rows.select("doc_id", F.size("w").cast("double").alias("n"), F.col("s").cast("double").alias("s"), syl.cast("double").alias("syl"))
    ease = 206.835 - 1.015 * (F.col("n") / F.col("s")) - 84.6 * (F.col("syl") / F.col("n"))
    return rows.select("doc_id", F.round(ease, 1).alias("flesch"), F.round(F.col("n") / F.col("s"), 1).alias("words_per_sentence"))


@query("WITH k AS (SELECT doc_id, count(*) OVER (PARTITION BY lower(coalesce(text, ''))) AS n FROM documents) SELECT doc_id, n::BIGINT AS n_copies FROM k WHERE n > 1")
def exact_duplicates(spark, sf_dir):
    return similarity.exact_copies(documents(spark, sf_dir), F.col("text")).where("n_copies > 1").select("doc_id", "n_copies")


def _words(text):
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


SEED_SQL = "[" + ", ".join(map(str, similarity.SEEDS)) + "]"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 3 = 0 OR true),
h AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8))::BIGINT)) AS h FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, list_transform({SEED_SQL}::BIGINT[], lambda sd: list_min(list_transform(h, lambda v: xor(v, sd)))) AS sig FROM h),
r AS (SELECT min(doc_id) AS doc_id, sig FROM s GROUP BY sig), b AS (SELECT doc_id, sig, unnest(range(0, 12)) AS band FROM r), k AS (SELECT doc_id, sig, band, sig[band * 8 + 1:band * 8 + 8] AS part FROM b),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.sig AS sa, y.sig AS sb FROM k x JOIN k y ON x.band = y.band AND x.part = y.part AND x.doc_id < y.doc_id AND x.sig <> y.sig)
SELECT a, b, len(list_filter(range(1, 97), lambda i: sa[i] = sb[i])) / 96.0 AS similarity FROM c WHERE len(list_filter(range(1, 97), lambda i: sa[i] = sb[i])) >= 87""".replace(" WHERE doc_id % 3 = 0 OR true", ""))
def near_duplicates_md5(spark, sf_dir):
    """Pairs of different texts with 87 or more of 96 equal minimum hashes (md5 family)."""
    rows = documents(spark, sf_dir).withColumn("w", _words(F.col("text"))).where(F.size("w") > 0)
    return similarity.near_pairs(rows.select(F.col("doc_id").alias("id"), similarity.signature(similarity.shingle_hashes_md5(F.col("w"))).alias("sig")))


@query()
def near_duplicates_crc32(spark, sf_dir):
    """The same with crc32 hashes; SQL has none, so the tests compare it with brute force."""
    rows = documents(spark, sf_dir).withColumn("w", _words(F.col("text"))).where(F.size("w") > 0)
    return similarity.near_pairs(rows.select(F.col("doc_id").alias("id"), similarity.signature(similarity.shingle_hashes_crc32(F.col("w"))).alias("sig")))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8))::BIGINT)) AS h FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, list_transform({SEED_SQL}::BIGINT[], lambda sd: list_min(list_transform(h, lambda v: xor(v, sd)))) AS sig FROM h)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM s""")
def near_duplicate_members_md5(spark, sf_dir):
    """For every document with words the document that stands for it in `near_duplicates_md5`."""
    rows = documents(spark, sf_dir).withColumn("w", _words(F.col("text"))).where(F.size("w") > 0)
    found = similarity.members(rows.select(F.col("doc_id").alias("id"), similarity.signature(similarity.shingle_hashes_md5(F.col("w"))).alias("sig")))
    return found.select(F.col("id").alias("doc_id"), "rep")


@query()
def near_duplicate_members_crc32(spark, sf_dir):
    """The same for `near_duplicates_crc32`."""
    rows = documents(spark, sf_dir).withColumn("w", _words(F.col("text"))).where(F.size("w") > 0)
    found = similarity.members(rows.select(F.col("doc_id").alias("id"), similarity.signature(similarity.shingle_hashes_crc32(F.col("w"))).alias("sig")))
    return found.select(F.col("id").alias("doc_id"), "rep")


@query(r"""WITH p AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS para FROM documents),
g AS (SELECT para, count(DISTINCT doc_id)::BIGINT AS n_docs, min(doc_id)::BIGINT AS example FROM p WHERE length(para) >= 80 GROUP BY para HAVING count(DISTINCT doc_id) >= 5)
SELECT left(para, 200) AS text, n_docs, example FROM g ORDER BY n_docs DESC, para DESC LIMIT 40""")
def repeated_paragraphs(spark, sf_dir):
    """The 40 most repeated lines of 80 characters or more that at least five documents share (a top-k report)."""
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.lower(F.trim("line")).alias("para")).where(F.length("para") >= 80)
    shared = lines.groupBy("para").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("example")).where("n_docs >= 5")
    return shared.orderBy(F.desc("n_docs"), F.desc("para")).limit(40).select(F.left("para", F.lit(200)).alias("text"), "n_docs", "example")


@query(rf"SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(lower(text), {lit(PLACEHOLDER)}))) AS hit FROM documents")
def placeholder_text(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("low", F.lower("text"))
    return hits(rows, PLACEHOLDER, "low").select("doc_id", F.trim("hit").alias("hit")).distinct()


@query("WITH p AS (SELECT unnest([" + ", ".join(lit(p) for p in FILLER) + r"""]) AS phrase), h AS (SELECT doc_id, text, phrase, strpos(lower(text), phrase) AS place FROM documents, p WHERE contains(lower(text), phrase)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n_phrases FROM h)
SELECT doc_id, phrase, n_phrases::BIGINT AS n_phrases, substr(text, greatest(1, place - 50)::BIGINT, (place - greatest(1, place - 50) + length(phrase) + 50)::BIGINT) AS context FROM n WHERE n_phrases >= 3""")
def filler_phrases(spark, sf_dir):
    """Each filler phrase, with its surroundings, of texts that have three or more of the 20; none in invented prose."""
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in FILLER]))
    rows = documents(spark, sf_dir).withColumn("found", found).where(F.size("found") >= 3)
    rows = rows.select("doc_id", "text", F.size("found").cast("long").alias("n_phrases"), F.explode("found").alias("phrase"))
    at = F.expr("locate(phrase, lower(text))")
    start = F.greatest(F.lit(1), at - 50)
    return rows.select("doc_id", "phrase", "n_phrases", F.substring("text", start, at - start + F.length("phrase") + 50).alias("context"))


@query("WITH n AS (SELECT doc_id, (" + " + ".join(f"contains(lower(text), {lit(p)})::BIGINT" for p in FILLER) + ")::BIGINT AS n_phrases FROM documents) SELECT doc_id, n_phrases FROM n WHERE n_phrases >= 3")
def filler_texts(spark, sf_dir):
    """Texts with three or more of the filler phrases; none in invented prose."""
    low = F.lower("text")
    n = sum((F.when(low.contains(p), 1).otherwise(0) for p in FILLER), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", n.cast("long").alias("n_phrases")).where("n_phrases >= 3")


@query(rf"""SELECT doc_id, 'entity' AS kind, regexp_extract(text, '(?i){ENTITY}') AS hit FROM documents WHERE regexp_matches(text, '(?i){ENTITY}')
UNION ALL SELECT doc_id, 'mojibake', regexp_extract(text, '{MOJIBAKE}') FROM documents WHERE regexp_matches(text, '{MOJIBAKE}')
UNION ALL SELECT doc_id, 'caps run', regexp_extract(text, '(?:[A-Z][A-Z]{{2,}}[!., ]+){{2,}}[A-Z]{{3,}}') FROM documents WHERE regexp_matches(text, '(?:[A-Z][A-Z]{{2,}}[!., ]+){{2,}}[A-Z]{{3,}}')""")
def odd_characters(spark, sf_dir):
    kinds = {"entity": f"(?i){ENTITY}", "mojibake": MOJIBAKE, "caps run": "(?:[A-Z][A-Z]{2,}[!., ]+){2,}[A-Z]{3,}"}
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", f"({p})", 1).alias("hit"))) for k, p in kinds.items()]))
    return documents(spark, sf_dir).select("doc_id", F.explode(found).alias("o")).select("doc_id", "o.kind", "o.hit")


@query("WITH t AS (SELECT unnest(" + str(list(FORBIDDEN)) + r""") AS term), n AS (
  SELECT doc_id, term, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS n FROM documents, t
) SELECT doc_id, term, n::BIGINT AS n FROM n WHERE n > 0""")
def forbidden_terms(spark, sf_dir):
    low = F.lower("text")
    counts = F.array(*[F.struct(F.lit(t).alias("term"), F.floor((F.length("text") - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).alias("n")) for t in FORBIDDEN])
    return documents(spark, sf_dir).select("doc_id", F.explode(counts).alias("t")).select("doc_id", "t.term", F.col("t.n").cast("long").alias("n")).where("n > 0")


@query(rf"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, {lit(EMAIL)}))) AS value FROM documents")
def emails_found(spark, sf_dir):
    return hits(documents(spark, sf_dir), EMAIL, out="value").select("doc_id", F.lower("value").alias("value")).distinct()


@query(rf"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, {lit(PHONE)})) AS value FROM documents)
SELECT DISTINCT doc_id, value, right(regexp_replace(value, '[^0-9]', '', 'g'), 10) AS key FROM v""")
def phones_found(spark, sf_dir):
    return hits(documents(spark, sf_dir), PHONE, out="value").select("doc_id", "value", T.phone_key(F.col("value")).alias("key")).distinct()


@query(" UNION ALL ".join(rf"SELECT doc_id, {lit(k)} AS kind, left(x, 12) || '…' AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, {lit(p)})) AS x FROM documents)" for k, p in SECRETS.items()))
def secret_scan(spark, sf_dir):
    def marked(kind):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), marked(k)) for k, p in SECRETS.items()]))
    rows = documents(spark, sf_dir).select("doc_id", F.explode(found).alias("s"))
    return rows.select("doc_id", "s.kind", F.concat(F.left("s.x", F.lit(12)), F.lit("…")).alias("masked"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
SELECT word, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n FROM w GROUP BY word""")
def vocabulary(spark, sf_dir):
    """Documents and occurrences of each word; counted per document first, so that frequent words shrink before the shuffle."""
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return words.groupBy("word", "doc_id").agg(F.count("*").alias("k")).groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n"))


MISSPELLINGS_SQL = r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), v AS (SELECT word, count(*) AS n FROM w GROUP BY 1),
one AS (SELECT word, n, word AS k FROM v UNION SELECT word, n, left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
two AS (SELECT word, n, k FROM one UNION SELECT word, n, left(k, i - 1) || substr(k, i + 1) FROM (SELECT word, n, k, unnest(range(1, length(k) + 1)) AS i FROM one)),
p AS (SELECT DISTINCT x.word, y.word AS suggestion, y.n FROM two x JOIN two y ON x.k = y.k AND x.n < y.n AND y.n >= 4 AND x.word <> y.word WHERE length(x.word) BETWEEN 3 AND 18),
m AS (SELECT word, suggestion, levenshtein(word, suggestion)::BIGINT AS distance, n FROM p WHERE levenshtein(word, suggestion) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY (left(word, 1) = left(suggestion, 1))::INT + (left(word, 2) = left(suggestion, 2))::INT + (left(word, 3) = left(suggestion, 3))::INT
  + (left(word, 4) = left(suggestion, 4))::INT DESC, n / pow(10.0, distance) DESC, suggestion) AS rn FROM m)"""


def _misspellings(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counted = cut_lineage(words.groupBy("word").agg(F.count("*").alias("n")))
    known = counted.where((F.col("n") >= KNOWN) & (F.length("word") <= 20))  # longer ones are more than two edits away
    return similarity.near_misses(counted.where(F.length("word").between(3, 18)), 2, known), known


@query(MISSPELLINGS_SQL + " SELECT word, suggestion, distance FROM m")
def misspellings(spark, sf_dir):
    """Words of 3 to 18 letters, seen any number of times, one or two edits from a more frequent one that is seen KNOWN
    times or more."""
    return _misspellings(spark, sf_dir)[0]


def _ranked(spark, sf_dir, most):
    found, known = _misspellings(spark, sf_dir)
    pairs = found.join(known.select(F.col("word").alias("suggestion"), F.col("n").alias("m")), "suggestion")
    start = sum(((F.left("word", F.lit(i)) == F.left("suggestion", F.lit(i))).cast("int") for i in range(2, 5)), (F.left("word", F.lit(1)) == F.left("suggestion", F.lit(1))).cast("int"))
    order = [F.desc(start), F.desc(F.col("m") / F.pow(F.lit(10.0), F.col("distance"))), F.col("suggestion")]
    return top_per_group(pairs, "word", order, most)


@query(MISSPELLINGS_SQL + " SELECT word, suggestion, rn::INTEGER AS rn FROM r WHERE rn <= 6")
def ranked_misspellings(spark, sf_dir):
    """The six best suggestions of each: shared start of up to four letters first, then frequency, ten times less per edit."""
    return _ranked(spark, sf_dir, 6).select("word", "suggestion", "rn")


@query(MISSPELLINGS_SQL + " SELECT word, suggestion, distance FROM r WHERE rn = 1")
def typo_candidates(spark, sf_dir):
    """Each probable misspelling with its best suggestion."""
    return _ranked(spark, sf_dir, 1).select("word", "suggestion", "distance")


@query(MISSPELLINGS_SQL + " SELECT word, suggestion, rn::INTEGER AS rn FROM r WHERE rn <= 6")
def ranked_suggestions(spark, sf_dir):
    """The same as `ranked_misspellings`, under its earlier name."""
    return ranked_misspellings(spark, sf_dir)


@query(r"""WITH l AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 2 >= length(regexp_replace(text, '\s', '', 'g')))
SELECT conv_id, turn, role, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM l""")
def block_offsets(spark, sf_dir):
    """Usable text blocks, at least half letters, with their place in the joined text of their conversation."""
    letters, solid = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", r"\s", ""))
    rows = table(spark, sf_dir, "conversations").where(letters * 2 >= solid).withColumn("text", F.trim("text"))
    laid = running_total(rows.select("conv_id", "turn", "role", "text"), "conv_id", [F.col("turn").asc()], F.length("text") + 2, "at")
    return laid.select("conv_id", "turn", "role", "at")
