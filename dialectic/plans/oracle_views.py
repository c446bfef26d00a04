"""DuckDB text of the fixture views (same rows as :mod:`dialectic.sources.fixtures`)."""

from __future__ import annotations

VIEWS = {
    "f_submissions": """
        SELECT concat('s', conv_id) AS id, role AS author, concat('title ', conv_id) AS title,
               text AS selftext
        FROM conversations WHERE turn = 0""",
    "f_comments": """
        SELECT role AS author, text AS body,
               CAST(1700000000 + conv_id * 1000 + turn * 60 AS BIGINT) AS created_utc,
               concat('c', conv_id, '_', turn) AS id, concat('t3_s', conv_id) AS link_id,
               CASE WHEN turn = 1 THEN concat('t3_s', conv_id)
                    ELSE concat('t1_c', conv_id, '_', CAST(floor(turn / 2) AS BIGINT)) END AS parent_id
        FROM conversations WHERE turn > 0""",
    "f_faulty_comments": """
        SELECT role AS author, CASE WHEN conv_id % 7 <> 3 THEN text END AS body,
               CAST(1700000000 + conv_id * 1000 + turn * 60 AS BIGINT) AS created_utc,
               concat('c', conv_id, '_', turn) AS id, concat('t3_s', conv_id) AS link_id,
               CASE WHEN turn = 1 AND conv_id % 11 = 5 THEN concat('t1_c', conv_id, '_2')
                    WHEN turn = 1 THEN concat('t3_s', conv_id)
                    ELSE concat('t1_c', conv_id, '_', CAST(floor(turn / 2) AS BIGINT)) END AS parent_id
        FROM conversations WHERE turn > 0""",
    "f_preferences": """
        SELECT d.doc_id AS row_id, concat(d.source, '/', d.lang) AS prompt, d.text AS chosen,
               n.text AS rejected
        FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1""",
    "f_pair_scores": """
        SELECT CAST(floor(vec_id / 4) AS BIGINT) AS sample_id,
               concat('run', CAST(floor(vec_id / 4) AS BIGINT) % 3) AS run_id,
               CASE WHEN CAST(floor(vec_id / 4) AS BIGINT) % 5 = 0 THEN 'eval' ELSE 'train' END AS type,
               CAST(floor(vec_id / 32) AS BIGINT) AS step,
               CASE WHEN vec_id % 4 < 2 THEN 'policy' ELSE 'reference' END AS model,
               CASE WHEN vec_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
               CAST(embedding[1] AS DOUBLE) * 10 - 20 AS logp
        FROM embeddings""",
    "f_token_scores": """
        SELECT CAST(floor(vec_id / 10) AS BIGINT) AS seq_id, CAST(vec_id % 10 AS BIGINT) AS pos,
               CASE WHEN label = 0 THEN -100 ELSE label END AS label,
               CAST(embedding[label + 1] AS DOUBLE)
                 - ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))) AS logp
        FROM embeddings""",
    "f_side_logits": """
        SELECT CAST(floor(vec_id / 4) AS BIGINT) AS sample_id,
               concat('run', CAST(floor(vec_id / 4) AS BIGINT) % 3) AS run_id,
               CASE WHEN CAST(floor(vec_id / 4) AS BIGINT) % 5 = 0 THEN 'eval' ELSE 'train' END AS type,
               CAST(floor(vec_id / 32) AS BIGINT) AS step,
               CASE WHEN vec_id % 4 < 2 THEN 'policy' ELSE 'reference' END AS model,
               CASE WHEN vec_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
               p AS pos, CASE WHEN (vec_id + p) % 5 = 0 THEN -100 ELSE (label + p) % 8 END AS label,
               list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS logits
        FROM (SELECT *, unnest(range(8)) AS p FROM embeddings)""",
    "f_vocab": """
        SELECT * FROM (VALUES (0,'a'),(1,'b'),(2,'c'),(3,'d'),(4,'e'),(5,'f'),(6,'g'),(7,'h'),
                              (8,'i'),(9,'j')) AS v(token_id, piece)""",
    "f_history": """
        SELECT concat('run', user_id) AS run_id, event_id AS pos,
               CASE WHEN event_type = 'click' THEN value END AS loss,
               CASE WHEN event_type = 'view' THEN value END AS eval_loss
        FROM events""",
    "f_trials": """
        SELECT user_id AS number,
               CASE WHEN user_id % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE max_by(value, event_id) END AS value,
               concat('run', user_id) AS wandb_run_id
        FROM events WHERE event_type = 'view' GROUP BY user_id""",
    "f_long_logits": """
        SELECT CAST(floor(vec_id / 10) AS BIGINT) AS seq_id, CAST(vec_id % 10 AS BIGINT) AS pos,
               CASE WHEN vec_id % 6 = 0 THEN -100 ELSE label END AS label, t AS token,
               CAST(embedding[t + 1] AS DOUBLE) + CASE WHEN vec_id % 10 = 3 THEN 2000 ELSE 0 END AS logit
        FROM (SELECT *, unnest(range(len(embedding))) AS t FROM embeddings)""",
    "f_labeled_documents": """
        SELECT d.doc_id, concat(d.source, '/', d.lang) AS prompt, d.text, CAST(l.quality AS INTEGER) AS quality
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
}


def with_views(views: list[str], ctes: list[tuple[str, str]], body: str, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <fixture views>, <ctes> <body>``."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{n} AS ({q})" for n, q in ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body
