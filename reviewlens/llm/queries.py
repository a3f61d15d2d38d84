"""Registered queries of the operators over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import (
    collocations,
    decontaminate,
    jaccard,
    language,
    licenses,
    line_dedup,
    merkle,
    packing,
    personal,
    sentence_pieces,
    token_counts,
    token_files,
    vectors,
)
from reviewlens.llm.common import UPPER, table
from reviewlens.storage import scratch_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.token_file_digest(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_token_files, op3_best_fit_packing, op4_line_dedup, op5_sorted_projections,
        op6_token_counts, op7_ngram_jaccard, op8_language_id, op9_decontamination, op10_personal_data,
        op11_sentence_pieces, op12_merkle_manifest, op13_collocations,
    )
}


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(licenses.TEMPLATES))
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    words = r"[y for y in regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+') if y <> '']"
    return rf"""
WITH t AS (SELECT id, license, {grams} AS g FROM (SELECT id, license, {words.format('x')} AS w FROM (VALUES {rows}) v(id, license, x))),
p AS (SELECT doc_id, regexp_split_to_array(text, '\n[\x20\t\r]*\n') AS ps, text FROM documents),
u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents
  UNION ALL SELECT doc_id, x FROM (SELECT doc_id, unnest(ps) AS x FROM p) WHERE contains(x, chr(10))
  UNION ALL SELECT doc_id, text FROM p WHERE len(ps) > 1),
b AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format('x')} AS w FROM u) WHERE len(w) >= 2),
m AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice FROM b, t
  WHERE len(b.g) BETWEEN len(t.g) * {licenses.DICE} / (2 - {licenses.DICE}) - 1e-9
    AND len(t.g) * (2 - {licenses.DICE}) / {licenses.DICE} + 1e-9),
f AS (
  SELECT doc_id, sum(n) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l, max(d) AS d FROM (
    SELECT doc_id, n, d, CASE WHEN license <> '{licenses.BSD}' THEN license WHEN bool_or(license = 'BSD-3-Clause') OVER (PARTITION BY doc_id)
      THEN 'BSD-3-Clause' ELSE 'BSD-2-Clause' END AS license
    FROM (SELECT doc_id, license, count(*) AS n, max(dice) AS d FROM m WHERE dice >= {licenses.DICE} GROUP BY ALL))
  GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(l, '') AS licenses, coalesce(d, 0.0::DOUBLE) AS best_dice
FROM documents LEFT JOIN f USING (doc_id)
"""


def _line_sql() -> str:
    long = f"(len(w.w) >= {line_dedup.MIN_WORDS} OR length(array_to_string(w.w, '')) >= {line_dedup.MIN_CHARS})"
    return rf"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (
  SELECT doc_id, line, x, flatten([
      CASE WHEN length(y) > {line_dedup.LONGEST_WORD} THEN [substr(y, i, 1) for i in range(1, length(y) + 1)] ELSE [y] END
      for y in regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+') if y <> '']) AS w,
    doc_id * 10000000 + line AS ord FROM l),
d AS (
  SELECT array_to_string(w, ' ') AS key, any_value(w) AS w, min(ord) AS first
  FROM w WHERE {long} GROUP BY 1),
v AS (
  SELECT key, first, gap, len(w) AS n, md5(array_to_string(w[1:gap] || w[gap + 2:], ' ')) AS v
  FROM (SELECT *, unnest(range(len(w))) AS gap FROM d WHERE len(w) >= {line_dedup.NEAR_WORDS})),
s AS (SELECT key, first, md5(key) AS v FROM d WHERE len(w) >= {line_dedup.NEAR_WORDS}),
near AS (
  SELECT v.key FROM v JOIN (SELECT n, gap, v, min(first) AS o FROM v GROUP BY ALL) USING (n, gap, v) WHERE o < first
  UNION SELECT v.key FROM v JOIN s USING (v) WHERE s.first < v.first
  UNION SELECT s.key FROM v JOIN s USING (v) WHERE v.first < s.first),
r AS (
  SELECT w.*, {long} AND (near.key IS NOT NULL OR ord <> first) AS gone
  FROM w LEFT JOIN d ON array_to_string(w.w, ' ') = d.key AND {long}
  LEFT JOIN near ON near.key = d.key),
g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone,
    coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN t.text IS NOT NULL THEN g.text END AS text,
  CASE WHEN t.text IS NULL THEN 0 ELSE n END AS n_lines, gone AS n_removed
FROM documents t JOIN g USING (doc_id)
"""


def _lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def _jaccard_sql() -> str:
    words = rf"regexp_extract_all({_lowered('text')}, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c.c >= 80 * (p.n + q.n - c.c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _contamination_sql() -> str:
    words = rf"regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = decontaminate.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
i AS (SELECT item_id, w, least({n}, len(w)) AS n FROM (SELECT item_id, coalesce({words}, []) AS w FROM benchmark) WHERE len(w) > 0),
x AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
y AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, s, item_id FROM x JOIN y USING (n, x)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
q AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def _merkle_sql() -> str:
    """Unrolled for as many levels as ``SQL_LEVELS``: enough for 16 ** 5 documents a source, and as many sources."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    other = "string_agg({x}.h, '' ORDER BY {x}.i) FILTER ({x}.i <> {y}.i)"
    parts = [f"""
WITH RECURSIVE bytes AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 1 AS pos, 4294967295::BIGINT AS c FROM documents),
crc(doc_id, s, pos, c) AS (
  SELECT * FROM bytes UNION ALL
  SELECT doc_id, s, pos + 1, list_reduce(list_prepend(xor(c, ord(s[pos])::BIGINT), range(8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FROM crc WHERE pos <= length(s)),
chosen AS (SELECT doc_id FROM crc WHERE pos > length(s) AND xor(c, 4294967295) % {merkle.TAMPERED} = 0),
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS s, {leaf("text")} AS h,
    CASE WHEN doc_id IN (FROM chosen) THEN {leaf(_lowered("text"))} ELSE {leaf("text")} END AS other FROM documents),
a0 AS (SELECT s, h, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS i, rid, doc_id, other FROM leaves),
p0 AS (SELECT rid, doc_id, h AS leaf, s, i, other AS folded, '' AS proof FROM a0)"""]  # fmt: skip

    def level(nodes: str, up: str, paths: str, raised: str, tree: str) -> str:
        same = f"n.{tree} IS NOT DISTINCT FROM p.{tree}"
        alone = f"(SELECT {tree}, count(*) AS size FROM {nodes} GROUP BY {tree})"
        return f"""
{up} AS (
  SELECT {tree}, sha256(string_agg(h, '' ORDER BY i)) AS h, i // 16 AS i FROM {nodes} WHERE {tree} IN (SELECT {tree} FROM {alone} WHERE size > 1)
    OR ({tree} IS NULL AND (SELECT size FROM {alone} WHERE {tree} IS NULL) > 1) GROUP BY {tree}, i // 16
  UNION ALL SELECT n.{tree}, n.h, n.i FROM {nodes} n JOIN {alone} p ON {same} WHERE size = 1),
{raised} AS (
  SELECT p.* REPLACE (
    p.i // 16 AS i, CASE WHEN n.size = 1 THEN p.folded ELSE sha256(n.folded) END AS folded, p.proof || coalesce(n.others, '') AS proof)
  FROM {paths} p JOIN (
    SELECT p.rid, any_value(z.size) AS size, string_agg(CASE WHEN n.i = p.i THEN p.folded ELSE n.h END, '' ORDER BY n.i) AS folded,
      {other.format(x="n", y="p")} AS others
    FROM {paths} p JOIN {nodes} n ON {same} AND n.i // 16 = p.i // 16 JOIN {alone} z ON z.{tree} IS NOT DISTINCT FROM p.{tree}
    GROUP BY p.rid) n ON n.rid = p.rid)"""

    for k in range(SQL_LEVELS):
        parts.append(level(f"a{k}", f"a{k + 1}", f"p{k}", f"p{k + 1}", "s"))
    parts.append(f"""
t0 AS (SELECT 0 AS t, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, s FROM a{SQL_LEVELS}),
q0 AS (
  SELECT p.rid, p.doc_id, p.leaf, p.folded, p.proof, 0 AS t, n.i, n.h AS subroot
  FROM p{SQL_LEVELS} p JOIN t0 n ON n.s IS NOT DISTINCT FROM p.s)""")
    for k in range(SQL_LEVELS):
        parts.append(level(f"t{k}", f"t{k + 1}", f"q{k}", f"q{k + 1}", "t"))
    return ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n.h AS verified
FROM q{SQL_LEVELS} q JOIN t{SQL_LEVELS} n USING (t)
"""


SQL_LEVELS = 5


def _collocation_sql() -> str:
    return rf"""
WITH p AS (
  SELECT coalesce(lang, '{collocations.NO_LANGUAGE}') AS lang,
    unnest(regexp_split_to_array({_lowered("coalesce(text, '')")}, '[.,;:!?
-
]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^ 	]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {collocations.MAX_WORDS + 1}) z(k) WHERE len(w) >= k)
  GROUP BY ALL),
c AS (SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= {collocations.MIN_COUNT}),
d AS (
  SELECT DISTINCT lang, p FROM (
    SELECT lang, a, unnest([x for x in [p[i:i + z.z - 1] for i in range(1, k - z.z + 2)]]) AS p
    FROM c, range(2, {collocations.MAX_WORDS}) z(z) WHERE z.z < k) q
  JOIN f USING (lang, p) WHERE 100 * a >= {collocations.ABSORBED_PERCENT} * f),
s AS (
  SELECT c.lang, c.p, a, x.f AS l, y.f AS r, ({collocations.SCALE}::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.p ORDER BY {collocations.SCALE}::HUGEINT * a * a // (x.f::HUGEINT * y.f), z.z) AS turn
  FROM c, range(1, {collocations.MAX_WORDS}) z(z) JOIN f x ON x.lang = c.lang AND x.p = c.p[1:z.z] JOIN f y ON y.lang = c.lang AND y.p = c.p[z.z + 1:]
  WHERE z.z < c.k),
o AS (
  SELECT s.*, array_to_string(p, ' ') AS phrase FROM s WHERE turn = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = s.lang AND d.p = s.p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM o JOIN t USING (lang) QUALIFY rank <= {collocations.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": _license_sql(),
        "op4_line_dedup": _line_sql(),
        "op7_ngram_jaccard": _jaccard_sql(),
        "op9_decontamination": _contamination_sql(),
        "op12_merkle_manifest": _merkle_sql(),
        "op13_collocations": _collocation_sql(),
    }
