"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Shared subqueries are listed once in `_WITH`; `_sql` puts the needed ones in front of a query.
"""

from __future__ import annotations

import re

from relvec.schema import LABEL_ORDER, MERGED2, MERGED3

ORACLE: dict[str, str] = {}
_LABELS = list(LABEL_ORDER)
_DIMS = (16, 32, 64)


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + " END"


_LABEL_ID = "CASE label " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_LABELS)) + " END"

_WITH = {
    "interactions": """
SELECT e.event_id, e.user_id, e.user_id * 1000 + (e.event_id + e.user_id) % n.nb AS search_id, d.doc_id AS profil_id,
       CASE WHEN e.event_id % 10 < 8 THEN 'train' WHEN e.event_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split,
       b.text AS query_text,
       CASE WHEN e.user_id % 10 = 0 THEN 'coldstart'
            ELSE concat(c.c_mktsegment, ' nation ', CAST(c.c_nationkey AS VARCHAR)) END AS user_profile_text,
       d.text AS candidate_text,
       CASE e.event_type WHEN 'purchase' THEN 'Go' WHEN 'signup' THEN 'Interesting' WHEN 'click' THEN 'Why not'
                         WHEN 'view' THEN 'Not interesting' ELSE 'Out of scope' END AS label,
       e.value AS label_weight, e.ts
FROM events e
CROSS JOIN (SELECT (SELECT COUNT(*) FROM benchmark) AS nb, (SELECT COUNT(*) FROM documents) AS nd) n
JOIN benchmark b ON b.item_id = (e.event_id + e.user_id) % n.nb
JOIN documents d ON d.doc_id = (e.event_id * 7919 + e.user_id * 31) % n.nd
LEFT JOIN customer c ON c.c_custkey = e.user_id""",
    "role_texts": """
SELECT 'query' AS role, coalesce(query_text, '') AS text, split FROM interactions
UNION ALL SELECT 'user', coalesce(user_profile_text, ''), split FROM interactions
UNION ALL SELECT 'candidate', coalesce(candidate_text, ''), split FROM interactions""",
    "dictionary": """
SELECT role, text, source_count, row_number() OVER (PARTITION BY role ORDER BY source_count DESC, sha256(text)) - 1 AS text_id
FROM (SELECT role, text, count(*) AS source_count FROM role_texts GROUP BY role, text) counted""",
    "vectors": """
SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-128.0, least(127.0, round_even(CAST(x AS DOUBLE) * 127.0, 0))) AS TINYINT)) AS v
FROM embeddings""",
    "store": """
SELECT d.role, d.text_id, d.text, d.source_count, x.v
FROM dictionary d
JOIN vectors x ON x.vec_id = (CASE d.role WHEN 'query' THEN d.text_id WHEN 'user' THEN d.text_id * 7 + 3 ELSE d.text_id * 13 + 5 END)
                             % (SELECT count(*) FROM embeddings)""",
    "with_ids": """
SELECT i.event_id, i.user_id, i.search_id, i.profil_id, i.split, i.label, i.user_profile_text = 'coldstart' AS cold,
       q.text_id AS query_text_id, u.text_id AS user_text_id, c.text_id AS candidate_text_id
FROM interactions i
JOIN dictionary q ON q.role = 'query' AND q.text = coalesce(i.query_text, '')
JOIN dictionary u ON u.role = 'user' AND u.text = coalesce(i.user_profile_text, '')
JOIN dictionary c ON c.role = 'candidate' AND c.text = coalesce(i.candidate_text, '')""",
    "with_vectors": """
SELECT w.event_id, any_value(w.cold) AS cold, any_value(s.v) FILTER (s.role = 'query') AS qv,
       any_value(s.v) FILTER (s.role = 'user') AS uv, any_value(s.v) FILTER (s.role = 'candidate') AS cv
FROM (SELECT event_id, cold, unnest(['query', 'user', 'candidate']) AS role,
             unnest([query_text_id, user_text_id, candidate_text_id]) AS text_id FROM with_ids) w
JOIN store s ON s.role = w.role AND s.text_id = w.text_id
GROUP BY w.event_id""",
    "dots": """
SELECT w.event_id, w.cold, d.dim,
       list_dot_product(CAST(qv[1:d.dim] AS DOUBLE[]), CAST(qv[1:d.dim] AS DOUBLE[])) AS qq,
       list_dot_product(CAST(uv[1:d.dim] AS DOUBLE[]), CAST(uv[1:d.dim] AS DOUBLE[])) AS uu,
       list_dot_product(CAST(cv[1:d.dim] AS DOUBLE[]), CAST(cv[1:d.dim] AS DOUBLE[])) AS cc,
       list_dot_product(CAST(qv[1:d.dim] AS DOUBLE[]), CAST(cv[1:d.dim] AS DOUBLE[])) AS qc,
       list_dot_product(CAST(uv[1:d.dim] AS DOUBLE[]), CAST(cv[1:d.dim] AS DOUBLE[])) AS uc,
       list_dot_product(CAST(qv[1:d.dim] AS DOUBLE[]), CAST(uv[1:d.dim] AS DOUBLE[])) AS qu
FROM with_vectors w CROSS JOIN (SELECT unnest([16, 32, 64]) AS dim) d""",
    "plain_cosines": """
SELECT event_id, dim, cold, qq, uu, CASE WHEN qq = 0 OR cc = 0 THEN 0 ELSE qc / (sqrt(qq) * sqrt(cc)) END AS qc_cos,
       CASE WHEN uu = 0 OR cc = 0 THEN 0 ELSE uc / (sqrt(uu) * sqrt(cc)) END AS uc_cos,
       CASE WHEN qq = 0 OR uu = 0 THEN 0 ELSE qu / (sqrt(qq) * sqrt(uu)) END AS qu_cos
FROM dots""",
    "cosines": """
SELECT event_id, dim, qc_cos AS qc, CASE WHEN cold THEN 0 ELSE uc_cos END AS uc, CASE WHEN cold THEN 0 ELSE qu_cos END AS qu,
       CASE WHEN cold THEN qc_cos WHEN len2 <= 1e-12 THEN 0 ELSE (qc_cos + uc_cos) / sqrt(len2) END AS quc
FROM (SELECT *, (CASE WHEN qq > 0 THEN 1 ELSE 0 END) + (CASE WHEN uu > 0 THEN 1 ELSE 0 END) + 2 * qu_cos AS len2 FROM plain_cosines) p""",
    "predictions": f"""
SELECT event_id, user_id, split, label, label_id, label_weight, [s0/t, s1/t, s2/t, s3/t, s4/t] AS probs
FROM (SELECT *, s0+s1+s2+s3+s4 AS t FROM (
  SELECT event_id, user_id, split, label, label_weight, {_LABEL_ID} AS label_id,
         CAST(1 + (event_id * 17 + user_id) % 97 + CASE WHEN label = 'Go' THEN 20 ELSE 0 END AS DOUBLE) AS s0,
         CAST(1 + (event_id * 29 + user_id) % 97 + CASE WHEN label = 'Interesting' THEN 20 ELSE 0 END AS DOUBLE) AS s1,
         CAST(1 + (event_id * 41 + user_id) % 97 + CASE WHEN label = 'Why not' THEN 20 ELSE 0 END AS DOUBLE) AS s2,
         CAST(1 + (event_id * 53 + user_id) % 97 + CASE WHEN label = 'Not interesting' THEN 20 ELSE 0 END AS DOUBLE) AS s3,
         CAST(1 + (event_id * 67 + user_id) % 97 + CASE WHEN label = 'Out of scope' THEN 20 ELSE 0 END AS DOUBLE) AS s4
  FROM interactions) a) b""",
    "scored": """
SELECT *, list_position(probs, list_max(probs)) - 1 AS predicted_id, list_max(probs) AS confidence,
       -ln(greatest(1.1920929e-07, least(1 - 1.1920929e-07, probs[label_id + 1]))) AS loss
FROM predictions""",
    # evaluations: one key column `g` (a split, or run/split), one row weight `w`
    "ev": "SELECT split AS g, label_id AS y, predicted_id AS p, probs, loss, 1.0::DOUBLE AS w FROM scored",
    "per_class": """
SELECT g, k, sum(tp) AS tp, sum(sup) AS sup, sum(pre) AS pre FROM (
  SELECT g, y AS k, CASE WHEN y = p THEN w ELSE 0 END AS tp, w AS sup, 0.0::DOUBLE AS pre FROM ev
  UNION ALL SELECT g, p, 0, 0, w FROM ev) s GROUP BY g, k""",
    "prf": """
SELECT g, k, tp, sup, pre, CASE WHEN pre > 0 THEN tp / pre ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS re,
       CASE WHEN sup + pre > 0 THEN 2 * tp / (sup + pre) ELSE 0 END AS f1
FROM per_class""",
    "averages": """
SELECT g, sum(tp) / sum(sup) AS accuracy, avg(re) FILTER (WHERE sup > 0) AS balanced_accuracy, avg(pr) AS precision_macro,
       avg(re) AS recall_macro, avg(f1) AS f1_macro, sum(f1 * sup) / sum(sup) AS f1_weighted
FROM prf GROUP BY g""",
    "losses": "SELECT g, count(*) AS n, sum(w * loss) / sum(w) AS logloss FROM ev GROUP BY g",
    "points": """
SELECT g, k, score, sum(CASE WHEN y = k THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = k THEN 0 ELSE w END) AS neg
FROM (SELECT g, y, w, k, probs[k + 1] AS score FROM ev CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) c) e GROUP BY g, k, score""",
    "cumulative": """
SELECT *, sum(pos) OVER o AS cum_pos, sum(neg) OVER o AS cum_neg FROM points
WINDOW o AS (PARTITION BY g, k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "class_areas": """
SELECT g, k, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cum_pos - pos + pos / 2.0)) / (sum(pos) * sum(neg)) END AS auc,
       CASE WHEN sum(pos) > 0 THEN sum(pos * cum_pos / nullif(cum_pos + cum_neg, 0)) / sum(pos) ELSE 0 END AS ap
FROM cumulative GROUP BY g, k""",
    "macro": "SELECT g, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS roc, avg(ap) AS pr FROM class_areas GROUP BY g",
    "metrics": """
SELECT l.g, CAST(l.n AS BIGINT) AS "count", 5 AS num_classes, round(l.logloss, 6) AS logloss, round(accuracy, 6) AS accuracy,
       round(balanced_accuracy, 6) AS balanced_accuracy, round(precision_macro, 6) AS precision_macro,
       round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted,
       round(m.roc, 6) AS roc_auc_ovr_macro, round(m.pr, 6) AS pr_auc_ovr_macro
FROM losses l JOIN averages a ON a.g = l.g JOIN macro m ON m.g = l.g""",
    "micro_points": """
SELECT split, score, sum(pos) AS pos, sum(neg) AS neg FROM (
  SELECT g AS split, score, pos, neg FROM points WHERE g IN ('valid', 'test')) e GROUP BY split, score""",
    "micro": """
SELECT *, sum(pos) OVER o AS cum_pos, sum(neg) OVER o AS cum_neg FROM micro_points
WINDOW o AS (PARTITION BY split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "micro_totals": """
SELECT split, sum(pos) AS p, sum(neg) AS n, sum(neg * (cum_pos - pos + pos / 2.0)) / (sum(pos) * sum(neg)) AS auc,
       sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) AS ap
FROM micro GROUP BY split""",
    "train_counts": f"SELECT {_LABEL_ID} AS label_id, label, count(*) AS n FROM interactions WHERE split = 'train' GROUP BY label",
    "class_weight_table": """
SELECT label_id, label, n, (SELECT sum(n) FROM train_counts)::DOUBLE / ((SELECT count(*) FROM train_counts) * n) AS class_weight
FROM train_counts""",
    "bad_weights": """
SELECT event_id, split, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE
       WHEN 3 THEN 0.0 WHEN 4 THEN -label_weight ELSE label_weight END AS w FROM interactions""",
    "history": """
SELECT user_id % 20 AS run, event_id % 40 + 1 AS epoch, round(avg(value), 0) AS f1_macro, round(sum(value), 2) AS logloss, count(*) AS n
FROM events GROUP BY 1, 2""",
    "manifest": """
SELECT r, 'run_' || lpad(CAST(r AS VARCHAR), 2, '0') AS experiment_name, CASE WHEN r % 3 = 0 THEN 'mlp' ELSE 'logreg' END AS model_type,
       CASE WHEN r % 2 = 0 THEN 'off' ELSE 'balanced-sample-weight' END AS class_imbalance_handling,
       CASE WHEN r % 4 < 2 THEN 32 ELSE 64 END AS embedding_prefix_dim, CASE WHEN r = 5 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT DISTINCT user_id % 24 AS r FROM events) e""",
}
_RUN_EV = """
SELECT 'run_' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || '/' || split AS g, label_id AS y, predicted_id AS p, probs, loss, 1.0::DOUBLE AS w
FROM scored WHERE user_id % 24 <> 5"""
_WEIGHTED_EV = "SELECT split AS g, label_id AS y, predicted_id AS p, probs, loss, label_weight AS w FROM scored"


_STORED = {"interactions", "dictionary", "vectors", "store", "with_ids"}  # computed once, however often they are used


def _sql(body: str, **replaced: str) -> str:
    table = {**_WITH, **replaced}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in table:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(table[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ", ".join(f"{n} AS {'MATERIALIZED ' * (n in _STORED)}({table[n].strip()})" for n in needed)
    return f"WITH {head} {body.strip()}" if head else body.strip()


def _add(name: str, body: str, **replaced: str) -> None:
    ORACLE[name] = _sql(body, **replaced)


def _text(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: CAST(x AS VARCHAR)), ',')"


_FEATURE_COLUMNS = ",\n".join(
    f"max(CASE WHEN c.dim = {d} THEN round(c.{k}, 6) END) AS {k}_cosine_{d}" for d in _DIMS for k in ("qc", "uc", "qu", "quc")
)

_add("split_scan_counts", """
SELECT split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS event_sum, CAST(sum(length(candidate_text)) AS BIGINT) AS chars
FROM interactions GROUP BY split""")
_add("feature_split_roundtrip", """
SELECT w.event_id, w.split, w.query_text_id, w.user_text_id, w.candidate_text_id, @FEATURES@
FROM with_ids w JOIN cosines c ON c.event_id = w.event_id GROUP BY 1, 2, 3, 4, 5""".replace("@FEATURES@", _FEATURE_COLUMNS))
_add("store_roundtrip", f"SELECT role, text_id, source_count, {_text('v')} AS embedding FROM store")
_add("bucketed_lookup", f"""
SELECT v.event_id, query_text_id, user_text_id, candidate_text_id, {_text('qv')} AS query_vec, {_text('uv')} AS user_vec,
       {_text('cv')} AS candidate_vec FROM with_vectors v JOIN with_ids i ON i.event_id = v.event_id""")
_add("metrics_wide", """
SELECT g AS split, CAST("count" AS DOUBLE) AS "count", CAST(num_classes AS DOUBLE) AS num_classes, logloss, accuracy, balanced_accuracy,
       precision_macro, recall_macro, f1_macro, f1_weighted, roc_auc_ovr_macro, pr_auc_ovr_macro FROM metrics""")
_METRICS = ("count", "num_classes", "logloss", "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
            "f1_weighted", "roc_auc_ovr_macro", "pr_auc_ovr_macro")
_add("run_metrics_flat", """
SELECT split_part(g, '/', 1) AS run,
""" + ",\n".join(
    f"""max(CASE WHEN split_part(g, '/', 2) = '{s}' THEN CAST({'"count"' if m == 'count' else m} AS DOUBLE) END) AS {s}_{m}"""
    for s in ("train", "valid", "test") for m in _METRICS
) + " FROM metrics GROUP BY 1", ev=_RUN_EV)
_add("run_metadata", """
SELECT run, 64 AS embedding_prefix_dim, split, CAST(cold_rows AS BIGINT) AS cold_rows
FROM (SELECT split, count(*) FILTER (WHERE user_profile_text = 'coldstart') AS cold_rows FROM interactions GROUP BY split) s
CROSS JOIN (SELECT unnest(['a', 'b']) AS run) r""")
_add("base64_ingest", f"""
SELECT vec_id // 64 AS batch, CAST(vec_id % 64 AS INTEGER) AS "index", {_text('v')} AS embedding FROM vectors""")
for _role in ("query", "user", "candidate"):
    _add(f"text_dictionary_{_role}", f"SELECT text_id, text, source_count FROM dictionary WHERE role = '{_role}'")
_add("all_role_texts", "SELECT role, text, source_count FROM dictionary")
_add("role_ids_joined", "SELECT event_id, split, query_text_id, user_text_id, candidate_text_id FROM with_ids")
_add("pending_texts", """
SELECT role, text_id, sha256(text) AS text_key, source_count FROM dictionary d
WHERE NOT EXISTS (SELECT 1 FROM role_texts t WHERE t.split = 'valid' AND t.role = d.role AND t.text = d.text)""")
_add("progress", """
SELECT d.role, count(t.text) AS completed, count(*) AS total, round(count(t.text)::DOUBLE / count(*), 6) AS fraction
FROM dictionary d LEFT JOIN (SELECT DISTINCT role, text FROM role_texts WHERE split = 'valid') t
  ON t.role = d.role AND t.text = d.text GROUP BY d.role""")
_add("quantized_vectors", f"SELECT vec_id, {_text('v')} AS embedding FROM vectors")
_add("prefix_slices", f"""
SELECT vec_id, dim, {_text('v[1:dim]')} AS prefix FROM vectors CROSS JOIN (SELECT unnest([16, 32, 64]) AS dim) d""")
_add("l2_normalized", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS position,
       round(v[i] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS x
FROM (SELECT vec_id, v, sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS norm, unnest(range(1, len(v) + 1)) AS i
      FROM vectors) e""")
_add("scaled_inputs", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(v[i] / 127.0::DOUBLE, 6) AS x
FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM vectors) e""")
_add("prefix_cosine_features", f"""
SELECT w.event_id, w.user_id, w.search_id, w.profil_id, w.split, w.label, w.query_text_id, w.user_text_id, w.candidate_text_id,
       CAST(CASE WHEN w.cold THEN 0 ELSE 1 END AS TINYINT) AS embedding_user_available, {_FEATURE_COLUMNS}
FROM with_ids w JOIN cosines c ON c.event_id = w.event_id GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""")
for _kind in ("qc", "uc", "qu", "quc"):
    _add(f"cosine_{_kind}", f"SELECT event_id, dim, any_value(round({_kind}, 6)) AS cosine FROM cosines GROUP BY event_id, dim")
_add("prefix_dots_arrow", "SELECT event_id, dim, " + ", ".join(
    f"CAST(any_value({p}) AS BIGINT) AS {p}" for p in ("qq", "uu", "cc", "qc", "uc", "qu")) + " FROM dots GROUP BY event_id, dim")
_add("role_vectors_joined", f"""
SELECT event_id, {_text('qv')} AS query_vector, {_text('uv')} AS user_vector, {_text('cv')} AS candidate_vector FROM with_vectors""")
_add("zeroed_concat", f"""
SELECT event_id, {_text("list_concat(qv, CASE WHEN cold THEN list_transform(range(64), lambda x: CAST(0 AS TINYINT)) ELSE uv END, cv)")}
       AS features FROM with_vectors""")
_add("named_vector_columns", "SELECT event_id, " + ", ".join(
    f"{v}[{i + 1}] AS {r}_emb_{i:04d}" for r, v in (("query", "qv"), ("user", "uv"), ("candidate", "cv")) for i in range(64)
) + " FROM with_vectors")
_add("coldstart_flag", """
SELECT event_id, CAST(CASE WHEN user_profile_text = 'coldstart' THEN 0 ELSE 1 END AS TINYINT) AS embedding_user_available FROM interactions""")
_add("coldstart_ladder", """
SELECT event_id, 'available' AS rule, event_id % 4 <> 2 AS cold FROM interactions
UNION ALL SELECT event_id, 'flag', event_id % 4 IN (0, 1) FROM interactions
UNION ALL SELECT event_id, 'text', lower(user_profile_text) = 'coldstart' FROM interactions
UNION ALL SELECT event_id, 'none', false FROM interactions""")
_add("audit_counts", """
SELECT split, count(*) AS row_count, count(*) FILTER (WHERE user_profile_text = 'coldstart') AS cold_rows FROM interactions GROUP BY split""")
_add("labels_merged3", f"SELECT event_id, {_case('label', MERGED3)} AS label FROM interactions")
_add("labels_merged2", f"SELECT event_id, {_case('label', MERGED2)} AS label FROM interactions")
_add("class_list", """
SELECT CAST(row_number() OVER (ORDER BY CASE label WHEN 'Why not' THEN 0 WHEN 'Go' THEN 1 ELSE 2 END, label) - 1 AS INTEGER) AS label_id, label
FROM (SELECT DISTINCT label FROM interactions WHERE split = 'train') d""")
_add("labels_encoded", f"SELECT event_id, label, {_LABEL_ID} AS label_id FROM interactions")
_add("labels_decoded", "SELECT event_id, [" + ", ".join(f"'{n}'" for n in _LABELS) + "][predicted_id + 1] AS predicted_label FROM scored")
_add("label_names_sanitized", f"""
SELECT label, CASE WHEN name = '' THEN 'label' ELSE name END AS name FROM (
  SELECT label, trim(regexp_replace(lower(trim(label)), '[^0-9a-z]+', '_', 'g'), '_') AS name FROM (
    SELECT label FROM interactions UNION SELECT {_case('label', MERGED3)} FROM interactions
    UNION SELECT {_case('label', MERGED2)} FROM interactions UNION SELECT o_orderpriority FROM orders UNION SELECT p_brand FROM part) u) s""")
_add("unknown_labels", """
SELECT DISTINCT label FROM interactions WHERE split <> 'train' AND label NOT IN (
  SELECT label FROM interactions WHERE split = 'train' AND label <> 'Out of scope')""")
_add("class_weights", "SELECT label_id, label, n, round(class_weight, 6) AS class_weight FROM class_weight_table")
_add("effective_weights", """
SELECT i.event_id, round(CASE WHEN c.class_weight * i.label_weight <= 0 THEN 1e-6 ELSE c.class_weight * i.label_weight END, 6) AS weight
FROM interactions i JOIN class_weight_table c ON c.label = i.label""")
_add("weight_sanitize_stats", """
SELECT split, count(*) AS weight_count, count(*) FILTER (WHERE NOT isfinite(w)) AS replaced_non_finite,
       count(*) FILTER (WHERE isfinite(w) AND w <= 0) AS replaced_non_positive, 1e-6::DOUBLE AS min_applied_weight
FROM bad_weights GROUP BY split""")
_add("sanitized_weights", """
SELECT event_id, round(CASE WHEN NOT isfinite(w) OR w <= 0 THEN 1e-6 ELSE w END, 6) AS weight FROM bad_weights""")
_add("label_distribution", "SELECT split, label, count(*) AS n FROM interactions GROUP BY split, label")
_add("label_order", "SELECT split, label, count(*) AS n FROM interactions GROUP BY split, label ORDER BY split, label")
_add("time_features", """
SELECT event_id, CAST(hour(t) AS DOUBLE) AS ts_hour, CAST(isodow(t) - 1 AS DOUBLE) AS ts_dayofweek, CAST(day(t) AS DOUBLE) AS ts_day,
       CAST(month(t) AS DOUBLE) AS ts_month, CASE WHEN isodow(t) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS ts_is_weekend,
       round(epoch_us(t) / 1e6, 3) AS ts_epoch_seconds
FROM (SELECT event_id, CASE WHEN event_id % 11 > 1 THEN ts END AS t FROM events) e""")
_add("one_hot", "SELECT split, CAST(event_id AS DOUBLE) AS event_id, label_weight, " + ", ".join(
    f"""CASE WHEN label = '{n}' THEN 1.0 ELSE 0.0 END::DOUBLE AS "label_{n}" """ for n in sorted(_LABELS)) + ", " + ", ".join(
    f"""CASE WHEN even = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS "even_{v}" """ for v in ("False", "True", "__missing__")) + """
FROM (SELECT *, CASE WHEN split = 'valid' THEN '__missing__' WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM interactions) i""")
_add("one_hot_sparse", """
SELECT e.event_id, string_agg(CAST(x.i AS VARCHAR), ',' ORDER BY x.i) AS active
FROM (SELECT event_id, 'label' AS col, label AS val FROM interactions UNION ALL SELECT event_id, 'user_profile_text', user_profile_text FROM interactions) e
JOIN (SELECT col, val, row_number() OVER (ORDER BY col, val) - 1 AS i FROM (
        SELECT DISTINCT 'label' AS col, label AS val FROM interactions
        UNION SELECT DISTINCT 'user_profile_text', user_profile_text FROM interactions) u) x ON x.col = e.col AND x.val = e.val
GROUP BY e.event_id""")
_add("selected_features", """
SELECT event_id, CAST(hour(ts) AS DOUBLE) AS ts_hour, CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dayofweek, user_id FROM interactions""")
_add("metadata_projection", "SELECT event_id, search_id, split FROM interactions")
_add("softmax_probs", """
SELECT event_id, CAST(k AS INTEGER) AS class_id, round(exp(8 * (probs[k + 1] - m)) / total, 6) AS p
FROM (SELECT event_id, probs, list_max(probs) AS m, list_sum(list_transform(probs, lambda x: exp(8 * (x - list_max(probs))))) AS total,
             unnest([0, 1, 2, 3, 4]) AS k FROM predictions) e""")
_add("prediction_frame", """
SELECT s.event_id, s.user_id, s.split, s.label_id, s.label, round(s.label_weight, 6) AS label_weight,
       CAST(s.predicted_id AS INTEGER) AS predicted_label_id, [""" + ", ".join(f"'{n}'" for n in _LABELS) + """][s.predicted_id + 1] AS predicted_label,
       round(s.confidence, 6) AS prediction_confidence, round(probs[1], 6) AS prob_go, round(probs[2], 6) AS prob_interesting,
       round(probs[3], 6) AS prob_why_not, round(probs[4], 6) AS prob_not_interesting, round(probs[5], 6) AS prob_out_of_scope
FROM scored s""")
_add("binary_probs", "SELECT event_id, round(1 - probs[1], 6) AS p0, round(probs[1], 6) AS p1 FROM predictions")
_add("valid_test_rows", "SELECT event_id, split FROM predictions WHERE split IN ('valid', 'test')")
_add("confusion_matrix", """
SELECT g.split, CAST(y AS INTEGER) AS label_id, CAST(p AS INTEGER) AS predicted_id, count(s.event_id) AS n
FROM (SELECT DISTINCT split FROM scored) g CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS y) a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS p) b
LEFT JOIN scored s ON s.split = g.split AND s.label_id = y AND s.predicted_id = p GROUP BY 1, 2, 3""")
for _m in ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"):
    _add(f"metric_{_m}", f"SELECT g AS split, round({_m}, 6) AS value FROM averages")
_add("metric_log_loss", "SELECT g AS split, round(logloss, 6) AS value FROM losses")
_add("metric_roc_auc", "SELECT g AS split, round(roc, 6) AS value FROM macro")
_add("metric_pr_auc", "SELECT g AS split, round(pr, 6) AS value FROM macro")
_add("cumulative_hits", """
SELECT g AS split, CAST(k AS INTEGER) AS class_id, round(score, 6) AS score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
       CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM cumulative""")
_add("roc_curve_micro", """
SELECT m.split, round(m.score, 6) AS threshold, round(m.cum_neg / t.n, 6) AS fpr, round(m.cum_pos / t.p, 6) AS tpr, round(t.auc, 6) AS auc
FROM micro m JOIN micro_totals t ON t.split = m.split
UNION ALL SELECT split, NULL, 0.0, 0.0, round(auc, 6) FROM micro_totals""")
_add("pr_curve_micro", """
SELECT m.split, round(m.score, 6) AS threshold, round(m.cum_pos / (m.cum_pos + m.cum_neg), 6) AS "precision", round(m.cum_pos / t.p, 6) AS recall,
       round(t.ap, 6) AS average_precision
FROM micro m JOIN micro_totals t ON t.split = m.split
UNION ALL SELECT split, NULL, 1.0, 0.0, round(ap, 6) FROM micro_totals""")
_add("calibration_bins", """
SELECT s.split, CAST(len(list_filter(e.edges, lambda x: x < s.confidence)) AS INTEGER) AS bin, count(*) AS n,
       round(avg(s.confidence), 6) AS mean_confidence, round(avg(CASE WHEN s.predicted_id = s.label_id THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM scored s JOIN (SELECT split, quantile_cont(confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored GROUP BY split) e
  ON e.split = s.split GROUP BY 1, 2""")
_add("confidence_histogram", """
SELECT split, correct, bin, count(*) AS n, round(lo + bin * ((hi - lo) / 40), 6) AS left_edge,
       round(CASE WHEN bin = 39 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 40) END, 6) AS right_edge
FROM (SELECT split, correct, lo, hi, CAST(CASE WHEN x < lo + guess * ((hi - lo) / 40) THEN guess - 1
        WHEN guess < 39 AND x >= lo + (guess + 1) * ((hi - lo) / 40) THEN guess + 1 ELSE guess END AS INTEGER) AS bin
      FROM (SELECT *, least(floor((x - lo) / (hi - lo) * 40), 39) AS guess
            FROM (SELECT split, predicted_id = label_id AS correct, confidence AS x,
                         min(confidence) OVER (PARTITION BY split, predicted_id = label_id) AS lo,
                         max(confidence) OVER (PARTITION BY split, predicted_id = label_id) AS hi FROM scored) a) b) c
GROUP BY split, correct, bin, lo, hi""")
_NAMES = ("count", "num_classes", "logloss", "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
          "f1_weighted", "roc_auc_ovr_macro", "pr_auc_ovr_macro")
_add("evaluate_split", " UNION ALL ".join(
    f"""SELECT g AS split, '{m}' AS metric, CAST("{m}" AS DOUBLE) AS value FROM metrics""" for m in _NAMES))
_add("evaluate_split_weighted", "SELECT g AS split, * EXCLUDE (g) FROM metrics", ev=_WEIGHTED_EV)
_add("weighted_cross_entropy", """
SELECT split, round(sum(w * -ln(probs[label_id + 1])) / sum(w), 6) AS cross_entropy
FROM (SELECT *, greatest(label_weight, 1e-6) AS w FROM predictions) p GROUP BY split""")
_add("rounded_metrics", """
SELECT user_id, CASE WHEN held % 5 <> 0 THEN round(go / n, 6) END AS share FROM (
  SELECT user_id, count(*) FILTER (WHERE label = 'Go')::DOUBLE AS go, count(*) FILTER (WHERE split = 'test') AS held, count(*) AS n
  FROM interactions GROUP BY user_id) u""")
_add("history_best_patience", """
SELECT run, epoch, improved, best_so_far, CAST(rn - coalesce(last_rn, 0) AS INTEGER) AS since_improvement, best_epoch,
       coalesce(max(CASE WHEN rn - coalesce(last_rn, 0) >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran
FROM (SELECT *, max(CASE WHEN improved THEN rn END) OVER (PARTITION BY run ORDER BY epoch) AS last_rn,
             max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch
      FROM (SELECT run, epoch, rn, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far,
                   score IS NOT NULL AND (score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     OR count(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0) AS improved
            FROM (SELECT run, epoch, CASE WHEN n % 7 <> 0 THEN f1_macro END AS score,
                         row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn FROM history) a) b) c""")
_add("history_merged", """
SELECT run, epoch AS round, logloss AS value, 'train' AS dataset FROM history WHERE run < 10
UNION ALL SELECT n.run - 5, n.epoch + coalesce(o.last, 0), n.logloss, 'train' FROM history n
LEFT JOIN (SELECT run, max(epoch) AS last FROM history WHERE run < 10 GROUP BY run) o ON o.run = n.run - 5 WHERE n.run >= 10""")
_add("latest_checkpoint", """
SELECT user_id % 20 AS run, 'model_' || max(event_id % 150) || '.json' AS latest, max(event_id % 150) AS number FROM events GROUP BY 1""")
_RANKED = """
SELECT m.experiment_name, m.status, m.model_type, CAST(m.embedding_prefix_dim AS INTEGER) AS embedding_prefix_dim, m.class_imbalance_handling,
       v.f1_macro AS valid_f1_macro, v.balanced_accuracy AS valid_balanced_accuracy, v.accuracy AS valid_accuracy, t.f1_macro AS test_f1_macro,
       'runs/' || m.experiment_name AS run_dir
FROM manifest m LEFT JOIN metrics v ON v.g = m.experiment_name || '/valid' LEFT JOIN metrics t ON t.g = m.experiment_name || '/test'"""
_ORDER = " ORDER BY valid_f1_macro DESC NULLS LAST, valid_balanced_accuracy DESC NULLS LAST, valid_accuracy DESC NULLS LAST, experiment_name"
_add("run_ranking", _RANKED + _ORDER, ev=_RUN_EV)
_add("best_run", f"SELECT experiment_name, valid_f1_macro FROM ({_RANKED}) r{_ORDER.replace(', valid_', ', valid_')} LIMIT 1", ev=_RUN_EV)
_add("incremental_features", """
SELECT w.event_id, w.split, w.query_text_id, w.user_text_id, w.candidate_text_id,
       CAST(CASE WHEN w.cold THEN 0 ELSE 1 END AS TINYINT) AS embedding_user_available, @FEATURES@
FROM with_ids w JOIN cosines c ON c.event_id = w.event_id GROUP BY 1, 2, 3, 4, 5, 6""".replace("@FEATURES@", _FEATURE_COLUMNS))
_add("mock_embeddings", f"""
SELECT role, text_id, {_text("list_transform(range(64), lambda i: CAST(('0x' || substr(sha256(text || ':' || CAST(i // 32 AS VARCHAR)), 2 * (i % 32) + 1, 2)) AS INTEGER) - 128)")} AS embedding
FROM dictionary""")
