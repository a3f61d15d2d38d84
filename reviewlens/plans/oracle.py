"""The same queries as plain SQL, for checking the Spark results in another engine."""

from __future__ import annotations

import re

from reviewlens.config import LEXICON, MULTI_TASK, SINGLE_TASK, WHITESPACE
from reviewlens.plans.queries import BASELINES, NETS, SEEDS, TEST_LEXICON

WS = "'" + WHITESPACE + "'"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
METRICS = ("accuracy", "macro_f1", "f1_pos", "f1_neg", "auc")

CTES: dict[str, str] = {}

CTES["raw_reviews"] = """
SELECT d.doc_id AS row_id,
       CASE WHEN d.doc_id % 97 = 5 THEN NULL
            WHEN d.doc_id % 89 = 7 THEN concat(chr(9), d.text, ' ', chr(10))
            ELSE d.text END AS review_text,
       CASE WHEN l.doc_id IS NULL THEN NULL
            ELSE concat(CAST(CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 1
                                  WHEN l.quality = 0 THEN 2
                                  WHEN l.toxic = 1 THEN 3
                                  ELSE 4 + d.doc_id % 2 END AS STRING),
                        CASE d.doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.0' ELSE ' stars' END)
            END AS rating,
       CASE d.doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN ''
                         ELSE substr(d.text, 1, 20) END AS summary,
       d.doc_id % 2 = 0 AS verified_purchase,
       d.doc_id % 17 AS helpful_votes,
       concat('P', CAST(d.doc_id % 50 AS STRING)) AS product_id,
       d.source AS reviewer_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _combined(source: str, text: str) -> str:
    return f"""
SELECT row_id, rating,
       CASE WHEN s IS NOT NULL AND lower(s) NOT IN ('nan', 'none', '') THEN s || '. ' || t
            ELSE t END AS review_text
FROM (SELECT row_id, rating, trim(summary, {WS}) AS s, {text} AS t FROM {source})"""


def _clean(source: str) -> str:
    return f"""
SELECT row_id, trim(review_text, {WS}) AS review_text, rating, label,
       CAST(CASE WHEN coalesce(rating, 3) <= 2 THEN 0 WHEN coalesce(rating, 3) = 3 THEN 1
                 ELSE 2 END AS INTEGER) AS sentiment
FROM (SELECT row_id, review_text, rating,
             CAST(CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS INTEGER) AS label,
             row_number() OVER (PARTITION BY review_text ORDER BY row_id) AS rn
      FROM (SELECT row_id, review_text,
                   TRY_CAST(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS DOUBLE) AS rating
            FROM {source})
      WHERE review_text IS NOT NULL)
WHERE rn = 1 AND length(trim(review_text, {WS})) > 10"""


def _quota(source: str, strata: str, n_pick: str) -> str:
    return f"""
SELECT {strata}, c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {strata})
                              <= pick - sum(base) OVER () THEN 1 ELSE 0 END AS q
FROM (SELECT {strata}, c, pick, pick * c // n AS base, (pick * c) % n AS rem
      FROM (SELECT {strata}, c, n, CAST({n_pick} AS BIGINT) AS pick
            FROM (SELECT {strata}, c, CAST(sum(c) OVER () AS BIGINT) AS n FROM {source})))"""


def _add_split(name: str, source: str) -> None:
    """CTEs for the test / validation / train split of ``source`` by label."""
    CTES[f"{name}_sizes"] = f"SELECT label, count(*) AS c FROM {source} GROUP BY label"
    CTES[f"{name}_tq"] = _quota(f"{name}_sizes", "label", "ceil(CAST(0.2 AS DOUBLE) * n)")
    CTES[f"{name}_left"] = f"SELECT label, c - q AS c FROM {name}_tq"
    CTES[f"{name}_vq"] = _quota(f"{name}_left", "label", "ceil(CAST(0.125 AS DOUBLE) * n)")
    CTES[name] = f"""
SELECT r.*, CASE WHEN r.rk <= t.q THEN 'test' WHEN r.rk <= t.q + v.q THEN 'val'
                 ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label
                                   ORDER BY md5('split:42:' || row_id), row_id) AS rk
      FROM {source}) r
JOIN {name}_tq t ON r.label = t.label JOIN {name}_vq v ON r.label = v.label"""


CTES["terms_bigrams"] = f"""
SELECT row_id, t[i] AS term FROM (SELECT row_id, t, unnest(range(1, len(t) + 1)) AS i FROM words)
UNION ALL
SELECT row_id, t[i] || ' ' || t[i + 1] AS term
FROM (SELECT row_id, t, unnest(range(1, len(t))) AS i FROM words)"""
CTES["words"] = f"SELECT row_id, {TOKENS.format('review_text')} AS t FROM clean"
CTES["tf"] = "SELECT row_id, term, count(*) AS tf FROM terms_bigrams GROUP BY row_id, term"

CTES["combined"] = _combined("raw_reviews", f"trim(review_text, {WS})")
CTES["combined_compat"] = _combined("raw_reviews", f"coalesce(trim(review_text, {WS}), 'nan')")
CTES["clean"] = _clean("combined")
CTES["clean_compat"] = _clean("combined_compat")
_add_split("splits", "clean")



def _add_tfidf(prefix: str, split: str) -> None:
    """CTEs for the vocabulary of the training rows of ``split`` and the weights of all its rows."""
    CTES[f"{prefix}vocab"] = f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, df, total
FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total
      FROM tf JOIN {split} USING (row_id) WHERE split = 'train'
      GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000)"""
    CTES[f"{prefix}idfs"] = f"""
SELECT term, term_idx, ln(CAST(1 + (SELECT count(*) FROM {split} WHERE split = 'train') AS DOUBLE)
                          / (1 + df)) + 1 AS idf FROM {prefix}vocab"""
    CTES[f"{prefix}tfidf"] = f"""
SELECT row_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight
FROM (SELECT row_id, term_idx AS idx, (1 + ln(tf)) * idf AS w
      FROM tf JOIN {prefix}idfs USING (term) WHERE row_id IN (SELECT row_id FROM {split}))"""


_add_tfidf("", "splits")


def _aspects(lexicon: dict[str, list[str]], rounded: bool) -> str:
    parts = []
    for aspect, words in lexicon.items():
        hits = " + ".join(f"CAST(contains(lower(review_text), '{w}') AS INTEGER)" for w in words)
        value = f"CAST({hits} AS DOUBLE) / {len(words)}"
        parts.append((f"round({value}, 6)" if rounded else value) + f" AS asp_{aspect}")
    return ", ".join(parts)


def _digest(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"round(CAST(CAST('0x' || substr(md5({joined}), 1, 4) AS INTEGER) AS DOUBLE) / 65536, 2)"


def _values(rows: list[tuple], names: list[str]) -> str:
    cells = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS INTEGER)" for v in r) + ")"
        for r in rows
    )
    return f"(VALUES {cells}) AS r({', '.join(names)})"


def _scored(source: str, rows: list[tuple], names: list[str], where: str = "true") -> str:
    score = _digest(*[f"CAST(r.{n} AS VARCHAR)" for n in names], "CAST(row_id AS VARCHAR)")
    keys = ", ".join(f"r.{n}" for n in names)
    return f"""
SELECT row_id, label, {keys}, {score} AS probability,
       CAST(CASE WHEN {score} >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM {source}, {_values(rows, names)} WHERE {where}"""


CTES["predictions"] = _scored("clean", [(m, s) for m in NETS for s in SEEDS], ["model", "seed"])
CTES["base_predictions"] = _scored("clean", [(m,) for m in BASELINES], ["model"])
CTES["epoch_predictions"] = _scored(
    "splits", [(m, s, e) for m in NETS for s in SEEDS for e in range(1, 6)],
    ["model", "seed", "epoch"], "split = 'val'",
)


def _class_scores(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
       CAST(sum(h) AS BIGINT) AS hits,
       CASE WHEN sum(p) > 0 THEN sum(h) / CAST(sum(p) AS DOUBLE) ELSE 0.0 END AS "precision",
       CASE WHEN sum(s) > 0 THEN sum(h) / CAST(sum(s) AS DOUBLE) ELSE 0.0 END AS recall,
       2.0 * sum(h) / CAST(sum(s) + sum(p) AS DOUBLE) AS f1
FROM (SELECT {keys}, label AS class, 1 AS s, 0 AS p, CAST(label = prediction AS INTEGER) AS h FROM {source}
      UNION ALL
      SELECT {keys}, prediction, 0, 1, 0 FROM {source})
GROUP BY {keys}, class"""


def _accuracy(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, sum(hits) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1,
       coalesce(max(f1) FILTER (class = 1), 0) AS f1_pos,
       coalesce(max(f1) FILTER (class = 0), 0) AS f1_neg
FROM {source} GROUP BY {keys}"""


def _points(source: str, keys: str) -> str:
    whole = f"sum({{}}) OVER (PARTITION BY {keys})"
    run = f"sum({{}}) OVER (PARTITION BY {keys} ORDER BY probability DESC)"
    return f"""
SELECT {keys}, probability, pos, neg, {run.format('pos')} AS tp, {run.format('neg')} AS fp,
       {whole.format('pos')} AS p, {whole.format('neg')} AS n,
       row_number() OVER (PARTITION BY {keys} ORDER BY probability DESC) AS rn,
       lead(pos) OVER (PARTITION BY {keys} ORDER BY probability DESC) AS next_pos,
       lead(neg) OVER (PARTITION BY {keys} ORDER BY probability DESC) AS next_neg
FROM (SELECT {keys}, probability, sum(label) AS pos, sum(1 - label) AS neg
      FROM {source} GROUP BY {keys}, probability)"""


def _auc(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, sum(neg * (2 * tp - pos) / CAST(2 AS DOUBLE)) / (CAST(max(p) AS DOUBLE) * max(n)) AS auc
FROM {source} GROUP BY {keys}"""


def _roc(where: str) -> str:
    return f"""
SELECT model, probability AS threshold, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr
FROM base_points WHERE {where}
UNION ALL
SELECT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM base_points WHERE rn = 1"""


for _name, _source, _keys in (
    ("seed", "predictions", "model, seed"),
    ("base", "base_predictions", "model"),
    ("epoch", "epoch_predictions", "model, seed, epoch"),
):
    CTES[f"{_name}_classes"] = _class_scores(_source, _keys)
    CTES[f"{_name}_acc"] = _accuracy(f"{_name}_classes", _keys)
for _name, _source, _keys in (("seed", "predictions", "model, seed"), ("base", "base_predictions", "model")):
    CTES[f"{_name}_points"] = _points(_source, _keys)
    CTES[f"{_name}_auc"] = _auc(f"{_name}_points", _keys)
    CTES[f"{_name}_metrics"] = f"SELECT * FROM {_name}_acc JOIN {_name}_auc USING ({_keys})"
CTES["gains"] = f"""
SELECT b.seed, o.macro_f1 - b.macro_f1 AS gain
FROM seed_acc b JOIN seed_acc o ON b.seed = o.seed AND b.model = '{SINGLE_TASK}' AND o.model = '{MULTI_TASK}'"""
CTES["roc_kept"] = _roc("rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg")
CTES["roc_all"] = _roc("true")
_m4 = ", ".join(f"round({m}, 4) AS {m}" for m in METRICS)
_m6 = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
CTES["models"] = f"""
SELECT model, 'Classical' AS type, {_m4} FROM base_metrics
UNION ALL
SELECT model, CASE WHEN model LIKE '%Multi-Task%' THEN 'Multi-Task' ELSE 'Single-Task' END,
       {", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS)}
FROM seed_metrics GROUP BY model"""


def _batches(epoch: int) -> str:
    return f"""
SELECT row_id, label, CAST({epoch} AS INTEGER) AS epoch, (rk - 1) // 128 AS batch_id
FROM (SELECT row_id, label, row_number() OVER (ORDER BY md5('epoch{epoch}:42:' || row_id), row_id) AS rk,
             count(*) OVER () AS n
      FROM splits WHERE split = 'train')
WHERE rk <= (n // 128) * 128"""


CTES["batches"] = _batches(1) + "\nUNION ALL" + _batches(2)

# Student's t by the finite sums, written as a recursive table of the series terms per test.
CTES["tests"] = "SELECT CAST(0 AS INTEGER) AS g, gain AS v, CAST(0 AS DOUBLE) AS mu FROM gains"


def _ttest(source: str, key: str) -> str:
    """``source`` has columns (key, v, mu). Odd and even degrees of freedom by a list of terms."""
    select_key = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
SELECT {select_key}n, round(t, 6) AS t, round(p, 6) AS p_value, p < 0.05 AS significant FROM (
SELECT {select_key}n, t,
  1 - CASE WHEN nu % 2 = 0 THEN sin(theta) * series
           ELSE 2 / pi() * (theta + sin(theta) * series) END AS p
FROM (
SELECT {select_key}n, t, nu, theta,
  CASE WHEN nu % 2 = 0 THEN
    list_sum(list_transform(range(0, nu // 2), lambda k: CASE WHEN k = 0 THEN 1.0 ELSE
      list_product(list_transform(range(0, k), lambda j: cos(theta) * cos(theta) * (2 * j + 1) / (2 * j + 2))) END))
  ELSE coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: cos(theta) * CASE WHEN k = 0 THEN 1.0 ELSE
      list_product(list_transform(range(0, k), lambda j: cos(theta) * cos(theta) * (2 * j + 2) / (2 * j + 3))) END)), 0)
  END AS series
FROM (SELECT {select_key}n, t, n - 1 AS nu, atan(abs(t) / sqrt(CAST(n - 1 AS DOUBLE))) AS theta
FROM (SELECT {select_key}n, CASE WHEN n >= 3 AND s > 0 THEN (m - mu) / (s / sqrt(CAST(n AS DOUBLE))) END AS t
FROM (SELECT {select_key}count(v) AS n, avg(v) AS m, stddev_samp(v) AS s, max(mu) AS mu
      FROM {source} {group})))))"""


def _with(query: str) -> str:
    """Prefix a query with the CTEs it needs, in order of use."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(query)
    heads = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('tf', 'vocab') else ''}({CTES[n]})" for n in order)
    return f"WITH {heads}\n{query}" if heads else query


_RAW = "verified_purchase, helpful_votes, product_id, reviewer_id"
_GAIN = "printf('%+.4f (%+.2f%%)', {0}, {0} * 100)"

QUERIES: dict[str, str] = {
    "raw_reviews": "SELECT * FROM raw_reviews",
    "headers_normalized": """SELECT row_id, review_text AS reviewtext, rating AS overall, summary,
        verified_purchase AS verified, helpful_votes AS vote, product_id AS asin,
        reviewer_id AS reviewerid FROM raw_reviews""",
    "reviews_canonical": """SELECT row_id, review_text, rating, summary, verified_purchase, helpful_votes,
        CASE WHEN row_id % 2 = 0 THEN product_id ELSE 'Q' || row_id END AS product_id, reviewer_id
        FROM raw_reviews""",
    "csv_roundtrip": """SELECT row_id, review_text, rating,
        CASE WHEN summary IN ('nan', '') THEN NULL ELSE summary END AS summary,
        CAST(verified_purchase AS VARCHAR) AS verified_purchase,
        CAST(helpful_votes AS VARCHAR) AS helpful_votes, product_id, reviewer_id FROM raw_reviews""",
    "csv_folder": """SELECT row_id, review_text, rating,
        CASE WHEN summary IN ('nan', '') THEN NULL ELSE summary END AS summary,
        CAST(verified_purchase AS VARCHAR) AS verified_purchase,
        CAST(helpful_votes AS VARCHAR) AS helpful_votes, product_id, reviewer_id FROM raw_reviews""",
    "csv_to_clean": "SELECT * FROM clean",
    "reviews_combined": "SELECT row_id, review_text FROM combined",
    "reviews_combined_compat": "SELECT row_id, review_text FROM combined_compat",
    "rating_parsed": """SELECT row_id,
        TRY_CAST(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS DOUBLE) AS rating FROM raw_reviews""",
    "label_and_sentiment": """SELECT row_id, CAST(coalesce(r >= 4, false) AS INTEGER) AS label,
        CAST(CASE WHEN r <= 2 THEN 0 WHEN r > 3 THEN 2 ELSE 1 END AS INTEGER) AS sentiment
        FROM (SELECT row_id,
              TRY_CAST(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS DOUBLE) AS r FROM raw_reviews)""",
    "text_stripped": f"SELECT row_id, trim(review_text, {WS}) AS review_text FROM raw_reviews",
    "text_lowered": "SELECT row_id, lower(review_text) AS review_text FROM raw_reviews",
    "null_text_dropped": "SELECT row_id, review_text FROM raw_reviews WHERE review_text IS NOT NULL",
    "long_enough": f"""SELECT row_id, trim(review_text, {WS}) AS review_text FROM raw_reviews
        WHERE length(trim(review_text, {WS})) > 10""",
    "defaults_filled": """SELECT row_id, coalesce(review_text, '') AS review_text,
        coalesce(TRY_CAST(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS DOUBLE), 3) AS rating
        FROM raw_reviews""",
    "dedupe_first": f"""SELECT row_id, review_text, rating, summary, {_RAW} FROM (
        SELECT *, row_number() OVER (PARTITION BY review_text ORDER BY row_id) AS rn
        FROM raw_reviews WHERE review_text IS NOT NULL) WHERE rn = 1""",
    "reviews_clean": "SELECT * FROM clean",
    "reviews_clean_compat": "SELECT * FROM clean_compat",
    "label_profile": """SELECT 'loaded' AS stage, count(*) AS rows, CAST(NULL AS DOUBLE) AS positive,
        CAST(NULL AS DOUBLE) AS negative FROM raw_reviews
        UNION ALL SELECT 'clean', count(*), round(avg(label), 6), round(1 - avg(label), 6) FROM clean""",
    "softmax_scores": f"""SELECT row_id,
        round(exp(b - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c))
              + exp(c - greatest(a, b, c))), 6) AS probability,
        CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS prediction
        FROM (SELECT row_id, {_digest("'logit0'", "row_id")} * 8 - 4 AS a,
                     {_digest("'logit1'", "row_id")} * 8 - 4 AS b,
                     {_digest("'logit2'", "row_id")} * 8 - 4 AS c FROM clean)""",
    "sample_n": """SELECT row_id, review_text, rating, label, sentiment FROM (
        SELECT *, row_number() OVER (ORDER BY md5('sample:42:' || row_id), row_id) AS rk,
               count(*) OVER () AS n FROM clean) WHERE rk <= 400""",
    "split_assign": "SELECT row_id, label, split FROM splits",
    "split_counts": "SELECT split, label, count(*) AS rows FROM splits GROUP BY split, label",
    "row_index": "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM clean",
    "epoch_batches": "SELECT row_id, epoch, batch_id FROM batches",
    "eval_batches": """SELECT row_id, CAST(1 AS INTEGER) AS epoch,
        (row_number() OVER (ORDER BY row_id) - 1) // 256 AS batch_id FROM clean""",
    "folds": """SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label
        ORDER BY md5('fold:42:' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM clean""",
    "aspect_scores": f"SELECT row_id, {_aspects(LEXICON, False)} FROM clean",
    "aspect_scores_test_lexicon": f"SELECT row_id, {_aspects(TEST_LEXICON, True)} FROM clean",
    "tokens": "SELECT row_id, i - 1 AS pos, t[i] AS token FROM (SELECT row_id, t, unnest(range(1, len(t) + 1)) AS i FROM words)",
    "term_counts": "SELECT row_id, term, tf FROM tf",
    "vocabulary": "SELECT term, term_idx, df, total FROM vocab",
    "idf": "SELECT term, round(idf, 6) AS idf FROM idfs",
    "sublinear_tf": """SELECT row_id, term_idx, round(1 + ln(tf), 6) AS weight
        FROM tf JOIN vocab USING (term)""",
    "tfidf_long": "SELECT row_id, idx AS term_idx, round(weight, 6) AS weight FROM tfidf",
    "class_weights": """SELECT label, c AS rows, round(n / CAST(k * c AS DOUBLE), 6) AS weight
        FROM (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS k
              FROM splits WHERE split = 'train' GROUP BY label)""",
    "weighted_rows": """SELECT row_id, label, round(count(*) OVER () / CAST(2 * count(*) OVER (PARTITION BY label)
        AS DOUBLE), 6) AS weight FROM splits WHERE split = 'train'""",
    "confusion": """SELECT model, seed, label, prediction, count(*) AS rows FROM predictions
        GROUP BY model, seed, label, prediction""",
    "accuracy_f1": """SELECT model, seed, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
        round(f1_pos, 6) AS f1_pos, round(f1_neg, 6) AS f1_neg FROM seed_acc""",
    "class_report": """SELECT model, CAST(class AS VARCHAR) AS class, round("precision", 6) AS "precision",
        round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM base_classes
        UNION ALL SELECT model, 'accuracy', round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
        round(sum(hits) / CAST(sum(support) AS DOUBLE), 6), round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
        CAST(sum(support) AS BIGINT) FROM base_classes GROUP BY model
        UNION ALL SELECT model, 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6),
        CAST(sum(support) AS BIGINT) FROM base_classes GROUP BY model
        UNION ALL SELECT model, 'weighted avg', round(sum("precision" * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM base_classes GROUP BY model""",
    "roc_points": "SELECT model, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc_all",
    "roc_points_reduced": "SELECT model, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc_kept",
    "auc": "SELECT model, seed, round(auc, 6) AS auc FROM seed_auc",
    "roc_table": """SELECT model, printf('%s (AUC=%.4f)', model, auc) AS label, threshold,
        round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc_kept JOIN base_auc USING (model)
        UNION ALL SELECT 'Random', 'Random', NULL, 0.0, 0.0
        UNION ALL SELECT 'Random', 'Random', NULL, 1.0, 1.0""",
    "epoch_loss": f"""SELECT epoch, round(avg(loss), 6) AS train_loss FROM (
        SELECT epoch, batch_id, avg(-ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-12))) AS loss
        FROM (SELECT *, {_digest("epoch", "row_id")} AS p FROM batches) GROUP BY epoch, batch_id)
        GROUP BY epoch""",
    "seed_metrics": f"SELECT model, seed, {_m6} FROM seed_metrics",
    "seed_detail": f"SELECT seed, {_m4} FROM seed_metrics WHERE model = '{SINGLE_TASK}'",
    "paired_gain": f"SELECT seed, round(gain, 6) AS gain, {_GAIN.format('gain')} AS gain_text FROM gains",
    "gain_summary": f"""SELECT count(gain) AS n, round(avg(gain), 6) AS mean, round(stddev_pop(gain), 6) AS std,
        round(min(gain), 6) AS min, round(max(gain), 6) AS max, {_GAIN.format('avg(gain)')} AS mean_text
        FROM gains""",
    "ttest": _ttest("tests", ""),
    "ttest_by_product": _ttest(
        """(SELECT product_id, CAST(3 AS DOUBLE) AS mu,
            TRY_CAST(nullif(regexp_extract(rating, '([0-9]+)', 1), '') AS DOUBLE) AS v FROM raw_reviews)""",
        "product_id",
    ),
    "best_epoch": """SELECT model, seed, epoch, val_f1 FROM (
        SELECT model, seed, epoch, val_f1,
               row_number() OVER (PARTITION BY model, seed ORDER BY val_f1 DESC, epoch) AS rn
        FROM (SELECT model, seed, epoch, round(macro_f1, 6) AS val_f1 FROM epoch_acc) WHERE val_f1 > 0)
        WHERE rn = 1""",
    "model_union": "SELECT * FROM models",
    "f1_table": """SELECT model, macro_f1 AS f1, CASE WHEN model LIKE '%Multi-Task%' THEN 'Multi-Task'
        WHEN model LIKE '%Single-Task%' THEN 'Single-Task'
        WHEN model LIKE '%Random Forest%' OR model LIKE '%Gradient Boosting%' THEN 'Tree-Based'
        ELSE 'Classical' END AS family FROM models""",
    "metric_matrix": "SELECT metric, "
    + ", ".join(f"max(value) FILTER (model = '{m}') AS \"{m}\"" for m in (*BASELINES, *NETS))
    + """ FROM (SELECT model, 'accuracy' AS metric, accuracy AS value FROM models
        UNION ALL SELECT model, 'f1', macro_f1 FROM models
        UNION ALL SELECT model, 'auc', auc FROM models) GROUP BY metric""",
}
_summary = ", ".join(f"printf('%.4f ± %.4f', avg({m}), stddev_samp({m})) AS {m}" for m in METRICS)
QUERIES["seed_summary"] = f"SELECT model, {_summary} FROM seed_metrics GROUP BY model"
QUERIES["summary_csv"] = QUERIES["seed_summary"]
QUERIES["aspect_by_class"] = f"""SELECT sentiment, count(*) AS reviews, round(avg(label), 6) AS positive_rate,
    {", ".join(f"round(avg(asp_{a}), 6) AS asp_{a}" for a in LEXICON)}
    FROM (SELECT sentiment, label, {_aspects(LEXICON, False)} FROM clean) GROUP BY sentiment"""
CTES["test_aspects"] = f"SELECT row_id, sentiment, {_aspects(TEST_LEXICON, False)} FROM clean"
QUERIES["aspect_sentiment"] = "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS aspect, sentiment, count(*) AS reviews,
    CAST(sum(CAST(asp_{a} > 0 AS INTEGER)) AS BIGINT) AS mentions,
    round(avg(CAST(asp_{a} > 0 AS INTEGER)), 6) AS mention_share, round(avg(asp_{a}), 6) AS mean_score
    FROM test_aspects GROUP BY ROLLUP (sentiment)"""
    for a in TEST_LEXICON
)
QUERIES["feature_rows"] = (
    "SELECT row_id, idx, round(weight, 6) AS weight FROM tfidf"
    + "".join(
        f"\nUNION ALL SELECT row_id, CAST((SELECT count(*) FROM vocab) + {j} AS INTEGER), round(asp_{a}, 6)"
        f" FROM test_aspects WHERE asp_{a} <> 0"
        for j, a in enumerate(TEST_LEXICON)
    )
)
CTES["token_ids"] = """SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (
    SELECT token, count(*) AS n FROM (
        SELECT unnest(t) AS token FROM words JOIN splits USING (row_id) WHERE split = 'train')
    GROUP BY token ORDER BY n DESC, token LIMIT 50000)"""
QUERIES["encode_fixed"] = """SELECT row_id,
    concat_ws(' ', '2', ids, '3', CASE WHEN n < 254 THEN rtrim(repeat('0 ', CAST(254 - n AS BIGINT))) END)
        AS input_ids,
    concat_ws(' ', rtrim(repeat('1 ', CAST(n + 2 AS BIGINT))),
              CASE WHEN n < 254 THEN rtrim(repeat('0 ', CAST(254 - n AS BIGINT))) END) AS attention_mask
    FROM (SELECT w.row_id, least(len(t), 254) AS n, c.ids FROM words w LEFT JOIN (
        SELECT row_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY i) AS ids
        FROM (SELECT row_id, i, t[i] AS token FROM (
                SELECT row_id, t, unnest(range(1, least(len(t), 254) + 1)) AS i FROM words))
        LEFT JOIN token_ids USING (token) GROUP BY row_id) c ON w.row_id = c.row_id)"""
CTES["by_sentiment"] = "SELECT sentiment, count(*) AS c FROM clean GROUP BY sentiment"
CTES["by_sentiment_q"] = _quota("by_sentiment", "sentiment", "ceil(CAST(0.2 AS DOUBLE) * n)")
QUERIES["holdout_split"] = """SELECT row_id, label, r.sentiment,
    CASE WHEN rk <= q THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5('split:42:' || row_id), row_id) AS rk
          FROM clean) r JOIN by_sentiment_q USING (sentiment)"""

_size = f"((SELECT count(*) FROM vocab) + {len(TEST_LEXICON)})"
CTES["nb_features"] = "SELECT row_id, idx, weight FROM tfidf" + "".join(
    f"\nUNION ALL SELECT row_id, CAST((SELECT count(*) FROM vocab) + {j} AS INTEGER), asp_{a}"
    f" FROM test_aspects JOIN splits USING (row_id) WHERE asp_{a} <> 0"
    for j, a in enumerate(TEST_LEXICON)
)
CTES["nb_sums"] = """SELECT label, idx, sum(weight) AS s FROM nb_features JOIN splits USING (row_id)
    WHERE split = 'train' GROUP BY label, idx"""
CTES["nb_grid"] = f"""SELECT c.label, i.idx, ln(coalesce(s, 0) + 0.1) - ln(t.total + 0.1 * {_size}) AS share
    FROM (SELECT 0 AS label UNION ALL SELECT 1) c
    JOIN (SELECT label, sum(s) AS total FROM nb_sums GROUP BY label) t ON t.label = c.label
    JOIN (SELECT CAST(unnest(range(0, {_size})) AS INTEGER) AS idx) i ON true
    LEFT JOIN nb_sums n ON n.label = c.label AND n.idx = i.idx"""
CTES["nb_pairs"] = """SELECT a.idx, a.share AS s0, b.share AS s1
    FROM nb_grid a JOIN nb_grid b ON a.idx = b.idx AND a.label = 0 AND b.label = 1"""
CTES["nb_logits"] = """SELECT r.row_id, r.label,
    coalesce(s0, 0) + ln((SELECT count(*) FILTER (label = 0) / CAST(count(*) AS DOUBLE)
                          FROM splits WHERE split = 'train')) AS l0,
    coalesce(s1, 0) + ln((SELECT count(*) FILTER (label = 1) / CAST(count(*) AS DOUBLE)
                          FROM splits WHERE split = 'train')) AS l1
    FROM splits r LEFT JOIN (
        SELECT row_id, sum(weight * s0) AS s0, sum(weight * s1) AS s1
        FROM nb_features JOIN nb_pairs USING (idx) GROUP BY row_id) x USING (row_id)
    WHERE r.split = 'test'"""
QUERIES["nb_scores"] = """SELECT row_id, label, round(1 / (1 + exp(l0 - l1)), 6) AS probability,
    CAST(CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM nb_logits"""
CTES["nb_means"] = """SELECT idx, sum(weight) / (SELECT count(*) FROM splits WHERE split = 'train') AS mean
    FROM nb_features JOIN splits USING (row_id) WHERE split = 'train' GROUP BY idx"""
CTES["nb_names"] = "SELECT term_idx AS idx, term AS feature FROM vocab" + "".join(
    f"\nUNION ALL SELECT CAST((SELECT count(*) FROM vocab) + {j} AS INTEGER), 'asp_{a}'"
    for j, a in enumerate(TEST_LEXICON)
)
QUERIES["linear_attributions"] = """SELECT row_id, CAST(rk AS INTEGER) AS rank, feature, round(v, 6) AS contribution
    FROM (SELECT row_id, feature, v, row_number() OVER (PARTITION BY row_id ORDER BY round(abs(v), 9) DESC, idx) AS rk
          FROM (SELECT row_id, idx, feature, (s1 - s0) * (weight - coalesce(mean, 0)) AS v
                FROM nb_features JOIN splits USING (row_id) JOIN nb_pairs USING (idx)
                JOIN nb_names USING (idx) LEFT JOIN nb_means USING (idx) WHERE split = 'test'))
    WHERE rk <= 5"""
QUERIES["svm_folds"] = """SELECT label, CAST((r > n // 5)::INTEGER + (r > 2 * n // 5)::INTEGER + (r > 3 * n // 5)::INTEGER
    + (r > 4 * n // 5)::INTEGER AS INTEGER) AS fold, count(*) AS rows, true AS solved
    FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n,
        row_number() OVER (PARTITION BY label ORDER BY md5('fold:42:' || row_id), row_id) AS r FROM splits WHERE split = 'train')
    GROUP BY ALL"""
_place = " ".join(f"WHEN {seed} THEN {i}" for i, seed in enumerate(SEEDS, 1))
QUERIES["results_json"] = f"""SELECT m.model, seed::BIGINT AS seed, CAST(CASE seed {_place} END AS BIGINT) AS place,
    {", ".join(f"round(m.{x}, 6) AS {x}" for x in METRICS)}, s.macro_f1 AS summary_f1, CAST(128 AS BIGINT) AS batch_size, CAST(5 AS BIGINT) AS epochs
    FROM seed_metrics m JOIN ({QUERIES["seed_summary"]}) s ON s.model = m.model"""


def oracle_sql() -> dict[str, str]:
    return {name: _with(query) for name, query in QUERIES.items()}
