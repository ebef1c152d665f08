"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .distinctive import p6_found, p6_scores
from .encoding import p8_ids
from .markup import p4_clean, p4_found
from .mixing import p9_selection, p9_shares
from .neighbors import p5_found, p5_nearest
from .rank_fusion import p2_loadings, p2_quality, p2_ranking
from .shared_spans import p10_found, p10_shares
from .splitting import p7_found, p7_pieces
from .visual import p1_forms, p1_found, p1_tokens


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_forms, p1_tokens, p2_ranking, p2_quality, p2_loadings, p4_found, p4_clean, p5_found, p5_nearest, p6_found, p6_scores, p7_found, p7_pieces, p8_ids, p9_selection, p9_shares, p10_found, p10_shares)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            WITH held AS (SELECT DISTINCT f.record_id, g.gram FROM lexical_ngrams g JOIN lexical_fields f ON f.field_id = g.field_id WHERE g.gram <> ''),
            rare AS (SELECT gram FROM held GROUP BY gram HAVING count(*) BETWEEN 2 AND 3)
            SELECT DISTINCT a.record_id AS record_id_a, b.record_id AS record_id_b
            FROM held a JOIN held b ON a.gram = b.gram AND a.record_id < b.record_id JOIN rare ON rare.gram = a.gram""",
        "p6_scores": """
            WITH f AS (SELECT DISTINCT field_id, record_id, normalized_value FROM lexical_fields WHERE record_id IS NOT NULL AND field_id IS NOT NULL),
            own AS (SELECT field_id, min(record_id) AS record_id FROM f GROUP BY 1),
            occ AS (SELECT 'gram' AS kind, o.record_id, g.gram AS term FROM (SELECT DISTINCT field_id, gram FROM lexical_ngrams WHERE gram <> '') g JOIN own o ON o.field_id = g.field_id
              UNION ALL SELECT 'value', record_id, normalized_value FROM f WHERE normalized_value <> ''),
            counts AS (SELECT kind, record_id, term, count(*) AS k FROM occ GROUP BY ALL),
            x AS (SELECT *, sum(k) OVER (PARTITION BY kind, record_id)::BIGINT AS n, sum(k) OVER (PARTITION BY kind, term)::BIGINT AS kk, count(*) OVER (PARTITION BY kind, term) AS n_records,
              sum(k) OVER (PARTITION BY kind)::BIGINT AS nn, count(*) OVER (PARTITION BY kind) AS m FROM counts),
            p AS (SELECT *, least(1.0, list_sum(list_transform(range(k, least(n, kk) + 1), lambda i: exp(lgamma(kk + 1) - lgamma(i + 1) - lgamma(kk - i + 1) + lgamma(nn - kk + 1) - lgamma(n - i + 1)
              - lgamma(nn - kk - n + i + 1) - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1))))) AS p FROM x),
            r AS (SELECT *, p * m / count(*) OVER (PARTITION BY kind ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM p),
            q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY kind ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
            SELECT kind, record_id, term, k, n_records, round(p, 6) AS p_value, round(q, 6) AS q_value, round(abs(log10(q)), 6) AS score FROM q""",
        "p7_found": "SELECT DISTINCT 'entities' AS table_name, entity_path AS record_key FROM entities WHERE length(content) > 2000 "
        "UNION ALL SELECT DISTINCT 'chunks', chunk_id FROM chunks WHERE length(text) > 2000",
    }
