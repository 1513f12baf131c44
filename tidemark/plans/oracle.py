"""SQL pieces for the independent checks of the catalog.

The checks run in another engine on the same parquet tables.  They are written from the
meaning of each operator: tokens become rows, windows become self-joins where handy.
"""

from __future__ import annotations

from ..functions import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(q(w) for w in fixed.STOP_WORDS)


def stem(w: str) -> str:
    return (
        f"CASE WHEN regexp_matches({w}, '^.{{4,}}ie[sd]$') THEN regexp_replace({w}, 'ie[sd]$', 'y') "
        f"ELSE regexp_replace({w}, '^(.{{4,}}?)(ingly|edly|ing|ed|es|s|ly)$', '\\1') END"
    )


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(fixed.TOKEN)}), lambda w: lower(w))"


def tokens(x: str, keep: bool = False) -> str:
    found = words(x)
    if not keep:
        found = f"list_filter({found}, lambda w: w NOT IN ({STOP}))"
    return f"list_transform({found}, lambda w: {stem('w')})"


def content_terms(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) > 1))"


def sentences(x: str) -> str:
    cut = f"regexp_replace({x}, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(1) || '\\2', 'g')"
    paras = f"regexp_replace({cut}, '\\n\\s*\\n', chr(1), 'g')"
    tidy = "trim(regexp_replace(s, '\\s+', ' ', 'g'))"
    return f"list_filter(list_transform(string_split({paras}, chr(1)), lambda s: {tidy}), lambda s: s <> '')"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


VIEWS = {
    "docs_v": """docs_v AS (
  SELECT d.lang AS kb_id, d.doc_id, 'doc/' || d.doc_id AS uri, string_split(d.text, chr(10))[1] AS title,
         d.text, d.n_chars, d.source AS source_id,
         CASE WHEN l.toxic = 1 THEN 'quarantined' ELSE 'active' END AS status,
         CASE WHEN l.quality = 0 THEN 'cold' ELSE 'warm' END AS tier,
         0.5::DOUBLE + (d.doc_id % 4) * 0.5::DOUBLE AS authority,
         least(1.0::DOUBLE, d.n_chars / 2000.0::DOUBLE) AS quality,
         round(1.0::DOUBLE / (1.0::DOUBLE + (d.doc_id % 365) / 180.0::DOUBLE), 3) AS freshness,
         d.doc_id % 10 = 0 AS staff_only,
         TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS modified_at
  FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "chunks_v": """chunks_v AS (
  SELECT kb_id, doc_id || '-' || ord AS chunk_id, doc_id, ord, title, 'part ' || (ord // 20) AS section_path,
         text, greatest(1, length(text) // 4) AS token_count
  FROM (SELECT kb_id, doc_id, title, unnest(string_split(text, chr(10))) AS text,
               unnest(range(len(string_split(text, chr(10))))) AS ord FROM docs_v)
  WHERE trim(text) <> '')""",
    "masked_v": """masked_v AS (
  SELECT c.*, d.status AS doc_status, d.tier AS doc_tier, NOT d.staff_only AS readable,
         NOT d.staff_only AND d.status = 'active' AND d.tier <> 'cold' AS allowed,
         NOT d.staff_only AS escalated
  FROM chunks_v c JOIN docs_v d USING (doc_id))""",
    "lens_v": f"""words_v AS (
  SELECT chunk_id, allowed, escalated,
         unnest(regexp_extract_all(lower(title || ' ' || section_path || ' ' || text), {q(fixed.TOKEN)})) AS w
  FROM masked_v),
terms_v AS (
  SELECT chunk_id, allowed, escalated, {stem('w')} AS term FROM words_v WHERE w NOT IN ({STOP})),
lens_v AS (
  SELECT m.chunk_id, m.allowed, m.escalated, coalesce(n, 0) AS doc_len
  FROM masked_v m LEFT JOIN (SELECT chunk_id, count(*) AS n FROM terms_v GROUP BY 1) USING (chunk_id)),
tf_v AS (SELECT chunk_id, allowed, escalated, term, count(*) AS tf FROM terms_v GROUP BY ALL)""",
    "traces_v": """traces_v AS (
  SELECT *, status = 'verified' AND NOT healed AS diagnosed FROM (
  SELECT event_id AS trace_id, 'kb' || (user_id % 3) AS kb_id, user_id,
         user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, k % 20 AS query_cluster_id, ts AS created_at,
         event_type || ' question ' || k AS query,
         CASE WHEN event_type = 'signup' THEN 'direct' WHEN k BETWEEN 90 AND 94 THEN 'deep' ELSE 'standard' END AS route,
         CASE WHEN event_type = 'signup' THEN 'direct' WHEN k BETWEEN 90 AND 94 THEN 'escalated'
              WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'partial' ELSE 'verified' END AS status,
         k % 5 = 0 AS healed, k >= 95 AS is_eval, k % 13 = 0 AS negative_signal,
         CASE WHEN event_type <> 'error' THEN 1 - k / 100.0::DOUBLE END AS groundedness,
         (k % 10) / 20.0::DOUBLE AS contradiction, 1 - (k % 4) / 4.0::DOUBLE AS coverage, k % 7 AS llm_calls,
         floor(value * 10)::BIGINT AS tokens_in, floor(value)::BIGINT AS tokens_out,
         floor(value * 100)::BIGINT AS latency_ms, 1 + k % 2 AS config_version, k
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)))""",
    "feedback_v": """feedback_v AS (
  SELECT trace_id, CASE k % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'copy' WHEN 2 THEN 'citation_click' ELSE 'rephrase' END AS kind,
         CASE WHEN negative_signal THEN -1 ELSE 1 END AS rating,
         CASE WHEN negative_signal THEN 'correct answer ' || k ELSE '' END AS correction, created_at AS ts FROM traces_v)""",
    "citations_v": """citations_v AS (
  SELECT trace_id, doc_id, doc_id || '-0' AS chunk_id
  FROM (SELECT trace_id, unnest([trace_id % (SELECT max(doc_id) + 1 FROM documents), (trace_id + 7) % (SELECT max(doc_id) + 1 FROM documents)]) AS doc_id FROM traces_v))""",
    "turns_v": """turns_v AS (
  SELECT conv_id AS session_id, turn, conv_id * 1000 + turn AS trace_id, text AS query,
         TIMESTAMP '2024-01-01' + to_minutes(turn) AS created_at
  FROM conversations WHERE role = 'user')""",
    "diagnoses_v": """diagnoses_v AS (
  SELECT kb_id || '-' || c AS diagnosis_id, kb_id,
    CASE c % 4 WHEN 0 THEN 'missing_content' WHEN 1 THEN 'stale_content' WHEN 2 THEN 'ranking_miss' ELSE 'generation_error' END AS root_cause,
    'gap:' || c AS target,
    CASE c % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'fixing' WHEN 2 THEN 'needs_human' WHEN 3 THEN 'fixed' ELSE 'wont_fix' END AS status,
    impact, created_at, updated_at, c
  FROM (SELECT kb_id, query_cluster_id AS c, min(created_at) AS created_at, max(created_at) AS updated_at,
          sum(CASE WHEN negative_signal THEN 1.0::DOUBLE ELSE 0.5 END) AS impact
        FROM traces_v WHERE status IN ('failed', 'partial') GROUP BY 1, 2)),
fixes_v AS (
  SELECT 'fix-' || diagnosis_id AS fix_id, diagnosis_id, kb_id,
    CASE c % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'pending_approval' WHEN 2 THEN 'proposed' ELSE 'canary' END AS status,
    CASE WHEN c % 4 = 0 THEN updated_at END AS applied_at, created_at FROM diagnoses_v)""",
    "golden_v": """golden_v AS (
  SELECT item_id, 'kb' || (item_id % 3) AS kb_id, text AS question, string_split(text, '.')[1] AS expected_answer,
         item_id % 4 <> 3 AS active FROM benchmark)""",
    "users_v": """users_v AS (
  SELECT user_id, 'user' || user_id || '@example.org' AS email, 'User ' || user_id AS name,
    CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'old' END AS plan,
    CASE WHEN user_id % 7 = 0 THEN 5 END AS daily_limit_override,
    CASE WHEN user_id % 50 = 0 THEN 'admin' ELSE 'user' END AS role FROM (SELECT DISTINCT user_id FROM events))""",
    "usage_v": """usage_v AS (
  SELECT user_id, created_at::DATE AS day, count(*) AS questions, count(*) FILTER (route = 'deep') AS deep,
    sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out
  FROM traces_v WHERE status <> 'error' GROUP BY 1, 2)""",
    "live_v": """live_v AS (
  SELECT *, route <> 'direct' AND status <> 'escalated' AS answered FROM traces_v
  WHERE NOT is_eval AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)""",
}
NEEDS = {
    "diagnoses_v": ("traces_v",),
    "usage_v": ("traces_v",),
    "live_v": ("traces_v",),
    "chunks_v": ("docs_v",),
    "masked_v": ("docs_v", "chunks_v"),
    "lens_v": ("docs_v", "chunks_v", "masked_v"),
    "feedback_v": ("traces_v",),
    "citations_v": ("traces_v",),
}


def with_views(names: str, rest: str) -> str:
    """``rest`` is either a SELECT or further ``name AS (...)`` items and a SELECT."""
    wanted: list[str] = []
    for name in names.split():
        for n in (*NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    head = "WITH " + ",\n".join(VIEWS[n] for n in wanted)
    return head + ("\n" if rest.lstrip().upper().startswith("SELECT") else ",\n") + rest
