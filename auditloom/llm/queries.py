"""The queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .fingerprint import fingerprints
from .jaccard_join import near_duplicate_classes
from .kneser_ney import quality
from .language_id import language_predictions
from .merkle import manifest_digest
from .mixing import mix_sizes
from .page_text import main_text
from .quotes import conversations
from .substring_dedup import substring_digest
from .toxicity import toxicity_scores
from .url_filter import judge
from .vector_codes import vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name[:-4].lower(): text.strip() for name, text in globals().items() if name.startswith("OP") and name.endswith("_SQL")}


OP8_SUBSTRING_DEDUP_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM pos
), least AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), hit AS (
  SELECT doc_id, list(p) AS ps FROM win JOIN least USING (g) WHERE m < doc_id GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 13)))) AS ix FROM hit
), kept AS (
  SELECT doc_id, len(w) AS n, CASE WHEN ix IS NULL THEN w
         ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ix, i)), lambda i: w[i]) END AS k
  FROM docs LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


OP3_PARETO_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM totals
), ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS ratio FROM weighed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rk, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM ordered
), cutoff AS (
  SELECT min_by(here, rk) AS lvl FROM levels WHERE ratio > here
), targets AS (
  SELECT source, source_size, (CASE WHEN lvl IS NULL OR ratio <= lvl THEN most ELSE w * lvl END)::DOUBLE AS target FROM levels, cutoff
), drawn AS (
  SELECT d.doc_id, d.size, d.mark, t.source, t.source_size, t.target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p,
    (('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, mark) || '#1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), odds AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM drawn
), ranked AS (
  SELECT *, odds / (1 + odds) AS q, target - certain * source_size AS remainder FROM odds
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(size) OVER (PARTITION BY source, q, size) AS before,
    row_number() OVER (PARTITION BY source, q, size) AS nth
  FROM ranked
)
SELECT doc_id, size, source_size, target, (size * (certain + CASE WHEN q IS NOT NULL AND nth <= floor((remainder - before) / size + 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""


OP7_QUOTATION_LINKING_SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS n, conv_id, turn, role, text, md5(text) AS mark FROM conversations
), lines AS (
  SELECT n, conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM msgs)
), marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^\s*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^\s*((?:>[ \t]*)+)', '')), '\s+', ' ', 'g')) AS key FROM lines
), changed AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY n ORDER BY i) THEN 1 ELSE 0 END AS new FROM marked
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY n ORDER BY i) AS passage FROM changed
), passages AS (
  SELECT n, conv_id, turn, level, string_agg(key, ' ' ORDER BY i) FILTER (key <> '') AS t FROM numbered GROUP BY n, conv_id, turn, level, passage
), units AS (
  SELECT n, conv_id, turn, level, string_split(t, ' ') AS w FROM passages WHERE t IS NOT NULL
  UNION SELECT n, conv_id, turn, level, string_split(key, ' ') FROM marked WHERE key <> '' AND len(string_split(key, ' ')) < 5
), pieces AS (
  SELECT DISTINCT n, conv_id, turn, level, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS piece FROM units
), found AS (
  SELECT q.n, q.level, q.piece, max(o.turn) AS parent FROM pieces q JOIN pieces o
    ON o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.piece = q.piece AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL
), votes AS (
  SELECT n, level, parent, count(*) AS runs FROM found GROUP BY ALL
), best AS (
  SELECT n, max_by(parent, (-level, runs, parent)) AS quoted_turn FROM votes GROUP BY n
), placed AS (
  SELECT m.*, b.quoted_turn, lag(turn) OVER w AS previous_turn,
    coalesce(last_value(CASE WHEN quoted_turn IS NOT NULL THEN turn END IGNORE NULLS) OVER w, first_value(turn) OVER w) AS branch
  FROM msgs m LEFT JOIN best b USING (n)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark NULLS FIRST, role NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), home AS (
  SELECT conv_id, turn, max(branch) AS branch, max(quoted_turn) AS quoted_turn FROM placed GROUP BY 1, 2
), links AS (
  SELECT h.conv_id, h.branch, p.branch AS thread FROM home h JOIN home p ON p.conv_id IS NOT DISTINCT FROM h.conv_id AND p.turn = h.quoted_turn WHERE h.branch = h.turn
), walk AS (
  SELECT conv_id, branch, thread FROM links
  UNION SELECT w.conv_id, w.branch, l.thread FROM walk w JOIN links l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.branch = w.thread
), top AS (
  SELECT conv_id, branch, min(thread) AS thread FROM walk GROUP BY 1, 2
), threaded AS (
  SELECT p.*, coalesce(t.thread, p.branch) AS thread_turn FROM placed p LEFT JOIN top t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.branch = p.branch
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, mark NULLS FIRST, role NULLS FIRST) AS position,
  thread_turn, turn, role,
  regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: NOT regexp_matches(x, '^\s*>')), chr(10)), '^\s+|\s+$', '', 'g') AS text,
  coalesce(quoted_turn, CASE WHEN previous_turn < turn THEN previous_turn END) AS parent_turn,
  CASE WHEN quoted_turn IS NOT NULL THEN 'quote' WHEN previous_turn < turn THEN 'previous' END AS linked_by,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: regexp_matches(x, '^\s*>')))::BIGINT AS n_quoted_lines
FROM threaded
"""


OP13_MERKLE_MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc FROM documents
), said AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM d
), hashed AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR || tail) END AS changed FROM said
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), nodes AS (
  SELECT lang, 0 AS lv, i, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER (PARTITION BY lang) AS m FROM nodes) WHERE m > 0 GROUP BY lang, lv, i // 2
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM (SELECT lang, max_by(h, lv) AS h FROM nodes GROUP BY lang)
), tops AS (
  SELECT 0 AS lv, i, h FROM subroots
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, max(i) OVER () AS m FROM tops) WHERE m > 0 GROUP BY lv, i // 2
), sized AS (
  SELECT *, max(i) OVER (PARTITION BY lang, lv) AS m FROM nodes
), topsized AS (
  SELECT *, max(i) OVER (PARTITION BY lv) AS m FROM tops
), steps AS (
  SELECT l.rid, n.lv AS k, (l.i >> n.lv) % 2 AS slot, max(CASE WHEN n.i <> l.i >> n.lv THEN n.h END) AS sib
  FROM leaves l JOIN sized n ON n.lang IS NOT DISTINCT FROM l.lang AND n.i // 2 = (l.i >> n.lv) // 2 AND n.m > 0 GROUP BY ALL
  UNION ALL
  SELECT l.rid, 1000 + n.lv, (s.i >> n.lv) % 2, max(CASE WHEN n.i <> s.i >> n.lv THEN n.h END)
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN topsized n ON n.i // 2 = (s.i >> n.lv) // 2 AND n.m > 0 GROUP BY ALL
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) AS step FROM steps
), walk AS (
  SELECT rid, 0::BIGINT AS step, coalesce(changed, leaf) AS f FROM leaves
  UNION ALL
  SELECT w.rid, o.step, sha256(CASE WHEN o.slot = 1 THEN coalesce(o.sib, '') || w.f ELSE w.f || coalesce(o.sib, '') END) FROM walk w JOIN ordered o ON o.rid = w.rid AND o.step = w.step + 1
), ends AS (
  SELECT rid, max_by(f, step) AS folded_root FROM walk GROUP BY rid
), proof AS (
  SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM ordered GROUP BY rid
)
SELECT doc_id, leaf, s.h AS subroot, r.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ends USING (rid) LEFT JOIN proof USING (rid), (SELECT max_by(h, lv) AS root FROM tops) r
"""


OP12_VECTOR_CODES_SQL = r"""
WITH whole AS (
  SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 262144)) = len(embedding)
), kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM whole
  WHERE len(embedding) = (SELECT len(embedding) FROM whole ORDER BY vec_id NULLS LAST, embedding LIMIT 1)
), flat AS (
  SELECT r, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x, len(embedding) // 16 AS width FROM kept
), v AS (
  SELECT r, i // width AS part, i % width AS pos, floor(256 * x::DOUBLE)::BIGINT AS x FROM flat
), book0 AS (
  SELECT part, (r - 1)::INTEGER AS entry, pos, x FROM v WHERE r <= 64
), near0 AS (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry FROM (SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN book0 b USING (part, pos) GROUP BY ALL) GROUP BY ALL
), sums0 AS (
  SELECT part, entry, pos, sum(v.x) AS s, count(*) AS n FROM v JOIN near0 USING (r, part) GROUP BY ALL
), book1 AS (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM book0 LEFT JOIN sums0 USING (part, entry, pos)
), near1 AS (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry FROM (SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN book1 b USING (part, pos) GROUP BY ALL) GROUP BY ALL
), sums1 AS (
  SELECT part, entry, pos, sum(v.x) AS s, count(*) AS n FROM v JOIN near1 USING (r, part) GROUP BY ALL
), book2 AS (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM book1 LEFT JOIN sums1 USING (part, entry, pos)
), near2 AS (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN book2 b USING (part, pos) GROUP BY ALL) GROUP BY ALL
), coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
