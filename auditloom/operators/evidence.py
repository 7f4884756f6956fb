"""How sure a finding of a grammar engine is: evidence of its word over the whole site, then an ordered decision.

Words are counted once over all texts (pages and different texts that have them), looked up in the words that are known
and in the terms of the project, and tried as compounds of known words. Only words that the engine found are asked
about, and each is asked about once. Matches then meet the evidence of their word; a word that very many matches share
meets it by broadcast (`sized.sized_join`).

Defined cases: a null text or word counts nowhere; a text without a page counts as a text and not as a page. A match
outside its text has an empty word, which is dropped as a misspelling that has no vowel. A package file that is no JSON
object gives no terms. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.classify import british_variant

from .grammar import finding_kind
from .sized import sized_join

#: What counts as a word of the site.
WORD = r"[a-z][a-z'’-]{2,}"
#: Words that mark a missing space between two words, against a compound.
FUNCTION_WORDS = (
    "a an the that and for with from this these those our your you are was were has have had not but can will its into onto than then "
    "them they their there what when which who why how all any is to of in on at by as it be we i if so do"
).split()
#: First and last parts that make a compound with one known word.
PREFIXES = "sub re pre un post auto multi micro macro meta mono cross inter hyper".split()
SUFFIXES = "up in on out off to set grid base time store flow pack kit stack".split()
#: Parts of a package file whose names are terms of the project.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "scripts")
#: Fixed value: pages or texts from which on a word far from any other is the site's own.
OWN = 3
#: Rows of one number that may be broadcast: about 10 MB.
AGAIN_ROWS = 400_000


def asked_words(matches: DataFrame) -> DataFrame:
    """(word): each different word that the misspellings of (text, start, length, category, rule_id, rule_type) are about."""
    spelling = finding_kind(F.col("category"), F.col("rule_id"), F.col("rule_type")) == "Spelling"
    return matches.where(spelling).select(F.lower(_word()).alias("word")).distinct()


def _word() -> Column:
    """What a match is about, without the quotation marks around it."""
    wrong = F.substring(F.col("text"), F.col("start") + 1, F.col("length"))
    return F.regexp_replace(F.coalesce(wrong, F.lit("")), "^['’]+|['’]+$", "")


def word_counts(texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(word, n_pages, n_texts) of (page, text): pages and different texts that have each word; with `asked`, of these words.

    A page or a text that is met once is just counted, with partial sums. Only those met several times are told apart
    word by word.
    """
    rows = texts.where("text IS NOT NULL").select("page", F.xxhash64("text").alias("mark"), "text")
    for key in ("page", "mark"):
        again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias(f"{key}_again"))
        rows = sized_join(rows, again.where(F.col(key).isNotNull()), key, "left", AGAIN_ROWS)
    once = lambda key: (F.col(key).isNotNull() & F.col(f"{key}_again").isNull()).cast("long")
    none = F.lit(0).cast("long")
    words = lambda r, *own: r.select(*own, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    several = lambda key: words(rows.where(f"{key}_again"), key).distinct()
    counts = words(rows, once("page").alias("pages"), once("mark").alias("texts")).groupBy("word").agg(F.sum("pages").alias("n_pages"), F.sum("texts").alias("n_texts"))
    counts = counts.unionByName(several("page").groupBy("word").agg(F.count("*").alias("n_pages")).withColumn("n_texts", none))
    counts = counts.unionByName(several("mark").groupBy("word").agg(F.count("*").alias("n_texts")).withColumn("n_pages", none))
    counts = counts if asked is None else counts.join(asked, "word", "left_semi")
    return counts.groupBy("word").agg(F.sum("n_pages").alias("n_pages"), F.sum("n_texts").alias("n_texts"))


def project_terms(files: DataFrame) -> DataFrame:
    """(word) of (text), package files: the parts of the names of libraries and scripts, two letters or longer."""
    names = F.flatten(F.transform(F.array(*[F.get_json_object("text", f"$.{s}") for s in SECTIONS]), lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
    parts = files.select(F.explode(names).alias("name")).select(F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("word"))
    return parts.where((F.length("word") >= 2) & ~F.rlike("word", F.lit("^[0-9]+$"))).distinct()


def url_terms(urls: DataFrame) -> DataFrame:
    """(word) of (url): the words of the paths (of the host where there is no path), three letters or longer: the site's subjects."""
    path = F.regexp_replace(F.lower(F.regexp_replace("url", "^.*?://", "")), "^[^/]*/", "")
    return urls.select(F.explode(F.split(path, "[^a-z0-9]+")).alias("word")).where("length(word) > 2").distinct()


def compounds(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word) of those words that are made of two known ones, or of one and a common first or last part."""
    word = F.col("word")
    size = F.length(word)
    rest = [F.when(word.startswith(p) & (size > len(p) + 2), F.array(F.substring(word, F.lit(len(p) + 1), size))) for p in PREFIXES]
    rest += [F.when(word.endswith(s) & (size > len(s) + 2), F.array(F.left(word, size - len(s)))) for s in SUFFIXES]
    places = F.when(size >= 6, F.sequence(F.lit(3), size - 3))
    halves = F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.array(F.left(word, i), F.substring(word, i + 1, size)))
    ways = words.where(size >= 5).select("word", F.posexplode(F.array_compact(F.concat(F.array(*rest), halves))).alias("way", "parts"))
    asked = ways.select("word", "way", F.size("parts").alias("needed"), F.explode("parts").alias("part"))
    met = sized_join(asked, known.select(F.col("word").alias("part")).distinct(), "part")
    return met.groupBy("word", "way", "needed").agg(F.count("*").alias("n")).where("n = needed").select("word").distinct()


def word_evidence(words: DataFrame, counts: DataFrame, known: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, n_pages, n_texts, known, term, compound) of each different word asked about."""
    asked = words.select("word").where("word IS NOT NULL").distinct()
    flag = lambda rows, name: rows.select("word").distinct().withColumn(name, F.lit(True))
    both = known.select("word").unionByName(terms.select("word"))
    rows = asked.join(counts, "word", "left").join(flag(known, "known"), "word", "left").join(flag(terms, "term"), "word", "left").join(flag(compounds(asked, both), "compound"), "word", "left")
    return rows.fillna(0, ["n_pages", "n_texts"]).fillna(False, ["known", "term", "compound"])


def _spelling(text: Column, start: Column, wrong: Column, replacements: Column, message: Column) -> Column:
    """High, Medium or Low for a misspelling, null for what is none; needs the columns of `word_evidence`."""
    word, low = F.col("_word"), F.col("word")
    best = F.lower(F.get(replacements, F.lit(0)))
    before, after = F.substring(text, start, F.lit(1)), F.substring(text, start + F.length(wrong) + 1, F.lit(1))
    capital = F.rlike(word, F.lit(r"^\p{Lu}"))
    code = F.rlike(word, F.lit(r"[0-9._/@#+]|[a-z][A-Z]|[A-Z]{2}[a-z]")) | ((word == F.upper(word)) & (word != low) & (F.length(word) <= 6))
    in_path = ((start > 0) & before.isin(*"./@#-_")) | after.isin("/", "_")
    variant = F.contains(F.lower(message), F.lit("british")) | F.exists(replacements, lambda r: british_variant(low, F.lower(r)) | (F.replace(low, F.lit("-"), F.lit("")) == F.replace(F.lower(r), F.lit("-"), F.lit(""))))
    parts = F.contains(best, F.lit(" ")) & (F.replace(best, F.lit(" "), F.lit("")) == low) & ~F.arrays_overlap(F.split(best, " "), F.array(*map(F.lit, FUNCTION_WORDS)))
    distance = F.levenshtein(low, best)
    own = (F.col("n_pages") >= OWN) | (F.col("n_texts") >= OWN) | capital
    plain = F.rlike(word, F.lit(r"^\p{Ll}+$"))
    none = best.isNull() | F.col("term") | (F.col("known") & plain) | code | in_path | F.contains(word, F.lit("-")) | ~F.rlike(low, F.lit("[aeiouy]")) | F.col("compound") | variant | parts | ((distance > 2) & own)
    return F.when(F.coalesce(none, F.lit(False)), None).when(distance <= 1, "High").when(distance > 2, "Low").otherwise("Medium")


def confident(matches: DataFrame, counts: DataFrame, known: DataFrame, terms: DataFrame) -> DataFrame:
    """`matches` with `kind` and `confidence`: High, Medium, Low, or null for a false positive.

    matches: text, start, length, rule_id, category, rule_type, message, replacements (other columns stay);
    counts: `word_counts`; known: words of a dictionary; terms: words that are never wrong here.
    """
    text, start, choices = F.col("text"), F.col("start"), F.coalesce("replacements", F.array().cast("array<string>"))
    rule, message = F.coalesce("rule_id", F.lit("")), F.coalesce("message", F.lit(""))
    wrong = F.substring(text, start + 1, F.col("length"))
    rows = matches.withColumns({"kind": finding_kind(F.col("category"), F.col("rule_id"), F.col("rule_type")), "_word": _word()}).withColumn("word", F.lower("_word"))
    spelling = F.col("kind") == "Spelling"
    met = sized_join(rows, word_evidence(rows.where(spelling), counts, known, terms), "word", "left").fillna(0, ["n_pages", "n_texts"]).fillna(False, ["known", "term", "compound"])
    stop = rule == "SENTENCE_WHITESPACE"
    abbreviation = stop & ~F.rlike(F.left(text, start), F.lit(r"[a-z]{3}[.!?]$"))
    following = F.lower(F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"^[A-Za-z']+", 0))
    dotted = (rule == "COMMA_PARENTHESIS_WHITESPACE") & F.rlike(F.substring(text, start + 1, F.lit(3)), F.lit(r"^\s?\.[A-Za-z]"))
    several = F.when(F.col("kind") == "Word misuse", "Medium").when((F.col("kind") == "Style") | (F.size(choices) == 0), "Low").when(F.size(choices) == 1, "High").otherwise("Medium")
    other = F.when(abbreviation | dotted, None).when(stop & ~following.isin(*FUNCTION_WORDS), "Low").otherwise(several)
    confidence = F.when(spelling, _spelling(text, start, wrong, choices, message)).otherwise(other)
    return met.withColumn("confidence", confidence).drop("_word", "n_pages", "n_texts", "known", "term", "compound")
