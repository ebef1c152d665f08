"""SQL of the retrieval queries, for comparison."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from ..operators.embedding import EmbeddingConfig

#: White space as a character class.
_WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ALL_IDS = r"""list_transform(from_json({0}, '["VARCHAR"]'), lambda e: regexp_replace(regexp_replace(e, '^[ \t\n\x0B\f\r]*((?i:ref:)[ \t\n\x0B\f\r]*)?', ''), '[ \t\n\x0B\f\r]+$', ''))"""
_IDS = r"""list_filter(list_transform(from_json({0}, '["VARCHAR"]'), lambda e: regexp_replace(regexp_replace(e, '^[ \t\n\x0B\f\r]*((?i:ref:)[ \t\n\x0B\f\r]*)?', ''), '[ \t\n\x0B\f\r]+$', '')), lambda e: e <> '')"""


def _newest(name: str, key: str, deletes: bool = False) -> str:
    order = "loaded_at DESC" + (", (deleted_at IS NOT NULL) DESC" if deletes else "")
    live = " AND deleted_at IS NULL" if deletes else ""
    return f"(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _n FROM {name} WHERE {key} IS NOT NULL) WHERE _n = 1{live})"


_BASE = f"""WITH
ents AS {_newest("entities", "entity_path", True)},
chs AS {_newest("chunks", "chunk_id")},
rels AS {_newest("relations", "relation_id")},
cls AS {_newest("claims", "claim_key")},
refs AS {_newest("kb_references", "reference_id", True)},
evs AS {_newest("eval_cases", "query_id")},
pks AS (SELECT * EXCLUDE (retriever), lower(trim(retriever)) AS retriever FROM {_newest("evidence_packets", "packet_id")})"""

# Lexical search. The test tables need no compatibility forms beyond these in the query texts.
_Q = r""", qs AS (SELECT query_id, q FROM (SELECT query_id, regexp_replace(replace(lower(query_text), 'ß', 'ss'), '\s', '', 'g') AS q FROM evs) WHERE q <> ''),
qg AS (SELECT DISTINCT query_id, q, CASE WHEN length(q) <= 2 THEN q ELSE substr(q, i, 2) END AS gram FROM qs, range(1, greatest(length(q), 2)) t(i)),
qn AS (SELECT query_id, q, count(*) AS n_grams FROM qg GROUP BY ALL)"""
_SCORED = """, cand AS (SELECT g.query_id, f.field_id, count(*) AS shared FROM (SELECT DISTINCT field_id, gram FROM grams) f JOIN qg g ON f.gram = g.gram GROUP BY ALL),
m AS (SELECT c.query_id, n.q, n.n_grams, c.shared, f.* FROM cand c JOIN fields f ON f.field_id = c.field_id JOIN qn n ON n.query_id = c.query_id),
s AS (SELECT *, contains(normalized_value, q) AS inside, CASE WHEN contains(normalized_value, q) THEN 1.0::DOUBLE ELSE shared / n_grams END AS coverage FROM m),
best AS (SELECT query_id, record_id, field_name, max(coverage + CASE WHEN normalized_value = q THEN 2.0 WHEN inside THEN 0.5 ELSE 0.0 END) AS v FROM s GROUP BY ALL),
scores AS (SELECT query_id, record_id, sum(v * w.weight) AS score FROM best JOIN weights w ON w.field_name = best.field_name GROUP BY ALL)"""
_INDEX = ", fields AS (SELECT DISTINCT * FROM lexical_fields WHERE field_id IS NOT NULL), grams AS (SELECT DISTINCT * FROM lexical_ngrams WHERE field_id IS NOT NULL), weights AS (SELECT * FROM (VALUES ('title', 8.0::DOUBLE), ('aliases', 7.0), ('tags', 2.0), ('entity_type', 1.0)) t(field_name, weight))"
_TOP = " SELECT query_id, rank, {0}, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, record_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 5"

# Fusion.
_HITS = """, hits AS (SELECT query_id, retriever AS backend, rank, entity_path, section, text, source_ids FROM pks),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, backend, entity_path ORDER BY rank, coalesce(section, ''), coalesce(text, '')) AS _b FROM hits {0}) WHERE _b = 1)"""


def _fused(constant: float = 60.0, weights: tuple = (1.0, 1.0, 1.0), cutoff: str = "", backends: tuple = ("lexical.chunk", "lexical.entity", "vector.chunk"), name: str = "fused") -> str:
    terms = " + ".join(f"coalesce({w}::DOUBLE / ({constant}::DOUBLE + min(rank) FILTER (backend = '{b}')), 0.0::DOUBLE)" for b, w in zip(backends, weights))
    keep = f"WHERE backend IN ({', '.join(repr(b) for b in backends)})" if name != "fused" else ""
    return f""", {name} AS (SELECT query_id, entity_path, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, entity_path) AS rank
 FROM (SELECT query_id, entity_path, {terms} AS score FROM best {keep} GROUP BY ALL))"""


# Graph.
_EDGES = f""", rr AS (SELECT relation_id, source_path, target, predicate, confidence,
  CASE WHEN len(own) > 0 THEN own ELSE owner END AS ids FROM (
    SELECT *, coalesce({_IDS.format("source_ids_json")}, []) AS own, coalesce({_IDS.format("owner_source_ids_json")}, []) AS owner FROM rels
    WHERE source_path IS NOT NULL AND target IS NOT NULL AND predicate IS NOT NULL)),
flat AS (SELECT source_path, target, predicate, confidence, relation_id, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS e FROM rr),
firsts AS (SELECT source_path, target, predicate, confidence, e, min(struct_pack(a := relation_id, b := i)) AS pos FROM flat GROUP BY ALL),
joined AS (SELECT source_path, target, predicate, confidence, string_agg(e, '|' ORDER BY pos) AS source_ids FROM firsts GROUP BY ALL),
merged AS (SELECT r.source_path AS source, r.target, r.predicate, r.confidence, coalesce(any_value(j.source_ids), '') AS source_ids, count(*) AS n
  FROM rr r LEFT JOIN joined j ON j.source_path = r.source_path AND j.target = r.target AND j.predicate = r.predicate AND j.confidence IS NOT DISTINCT FROM r.confidence
  GROUP BY r.source_path, r.target, r.predicate, r.confidence),
ce AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY source, target, predicate, claim_ref ORDER BY claim_key) AS _n FROM (
  SELECT subject AS source, CASE WHEN predicate IS NOT NULL AND target IS NOT NULL THEN target ELSE subject END AS target,
    CASE WHEN predicate IS NOT NULL AND target IS NOT NULL THEN predicate ELSE property END AS predicate, property IS NOT NULL AS is_value, claim_key, claim_path, coalesce(claim_path, claim_id) AS claim_ref,
    status, confidence, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_position(ids, ids[i]) = i THEN ids[i] END), '|') AS source_ids
  FROM (SELECT *, coalesce({_IDS.format("source_ids_json")}, []) AS ids FROM cls) WHERE subject IS NOT NULL AND ((predicate IS NOT NULL AND target IS NOT NULL) OR property IS NOT NULL))) WHERE _n = 1),
edges AS (SELECT * FROM (
  SELECT source, target, predicate, 'relation' AS kind, false AS is_value, NULL::VARCHAR AS claim_ref, NULL::VARCHAR AS claim_path, NULL::VARCHAR AS status, confidence, source_ids FROM merged
  UNION ALL SELECT source, target, predicate, 'claim', is_value, claim_ref, claim_path, status, confidence, source_ids FROM ce)
  WHERE source IN (SELECT entity_path FROM ents) AND target IN (SELECT entity_path FROM ents))"""


def _policy(where: str, name: str = "pol") -> str:
    return f""", {name} AS (SELECT *, (CASE WHEN kind = 'relation' AND confidence IS NULL THEN 1.0 ELSE coalesce(map {{'A': 1.0, 'B': 0.75, 'C': 0.5, 'D': 0.25}}[confidence], 0.5) END
  * CASE WHEN kind = 'claim' AND lower(coalesce(status, '')) <> 'accepted' THEN 0.5 ELSE 1.0 END)::DOUBLE AS factor,
  kind = 'relation' OR lower(coalesce(status, '')) = 'accepted' AS affirmative, coalesce(confidence IN ('C', 'D'), false) AS requires_hedging FROM edges WHERE {where})"""


_ADMIT = "(kind = 'relation' OR lower(coalesce(status, '')) IN ('accepted', 'proposed', 'disputed'))"
_POLICY = " SELECT source, target, predicate, kind, claim_ref, confidence, round(factor, 9) AS factor, affirmative, requires_hedging FROM pol"
_EXPAND = """, seeds AS (SELECT query_id, entity_path, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, -score, entity_path) AS rank
  FROM fused WHERE rank <= 20 AND entity_path IN (SELECT entity_path FROM ents)),
both_ways AS (SELECT *, source AS seed, CASE WHEN is_value THEN 'assertion' ELSE 'outgoing' END AS direction, CASE WHEN is_value THEN source ELSE target END AS neighbor FROM pol
  UNION ALL SELECT *, target, 'incoming', source FROM pol WHERE source <> target),
reached AS (SELECT s.query_id, s.score AS seed_score, s.rank AS seed_rank, b.* FROM seeds s JOIN both_ways b ON b.seed = s.entity_path),
grown AS (SELECT *, seed_score * 0.75 * factor AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, neighbor, direction, source, target, predicate, kind, claim_ref, source_ids
  ORDER BY seed_rank, seed, coalesce(confidence, ''), coalesce(status, '')) AS _x FROM reached) WHERE _x = 1)"""
_GROWN = _BASE + _HITS.format("") + _fused() + _EDGES + _policy(_ADMIT) + _EXPAND


# Evaluation.
def _results(fused: str, name: str) -> str:
    return f""", x{name} AS (SELECT DISTINCT query_id, unnest(from_json(expected_json, '["VARCHAR"]')) AS entity_path FROM evs),
f{name} AS (SELECT x.query_id, count(*) AS n, count(h.rank) AS hit, min(h.rank) AS first FROM x{name} x
  LEFT JOIN {fused} h ON h.query_id = x.query_id AND h.entity_path = x.entity_path AND h.rank <= 5 GROUP BY ALL),
{name} AS (SELECT e.query_id, e.kind, e.gap, coalesce(f.hit / f.n, 0.0) AS recall_at_k, coalesce(1 / f.first, 0.0) AS reciprocal_rank, coalesce(f.hit = f.n, false) AS success, coalesce(f.n - f.hit, 0) AS n_missing
  FROM evs e LEFT JOIN f{name} f ON f.query_id = e.query_id)"""


_EVAL = _BASE + _HITS.format("") + _fused() + _results("fused", "res")
_TOTALS = "count(*) AS n_cases, round(avg(recall_at_k), 9) AS recall_at_k, round(avg(reciprocal_rank), 9) AS mrr, coalesce(sum(success::INT), 0) AS n_success"
_SOURCES = f""", ps AS (SELECT packet_id, list_filter(list_transform(source_ids, lambda e: regexp_replace(regexp_replace(e, '^[ \\t\\n\\x0B\\f\\r]*((?i:ref:)[ \\t\\n\\x0B\\f\\r]*)?', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')), lambda e: e <> '') AS ids FROM pks),
src AS (SELECT DISTINCT packet_id, unnest(ids) AS source_id FROM ps),
rsv AS (SELECT s.packet_id, s.source_id, r.title, r.year, r.reference_id IS NOT NULL AS resolved FROM src s LEFT JOIN refs r ON r.reference_id = s.source_id)"""
_VECTOR = """SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round({0}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, round({0}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS exact
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL)) WHERE rank <= 10"""
_KEYS = {"entities": "entity_path", "chunks": "chunk_id", "claims": "claim_key", "relations": "relation_id", "kb_references": "reference_id"}

#: The identity of the embedder of the query of stored vectors.
_FINGERPRINT = EmbeddingConfig("hash-embedder", "sha256", 8).fingerprint

# Provenance of entities.
_ORIGINS = f""", own_ids AS (SELECT entity_path AS e, coalesce({_IDS.format("source_ids_json")}, []) AS own FROM ents),
asserted AS (
  SELECT source_path AS e, 0 AS part, lpad(CAST(relation_id AS VARCHAR), 20, '0') AS ord, confidence, CASE WHEN len(ids) > 0 THEN ids ELSE own END AS ids FROM rr JOIN own_ids ON e = source_path
  UNION ALL SELECT subject, 1, claim_key, confidence, coalesce({_IDS.format("source_ids_json")}, []) FROM cls WHERE subject IN (SELECT entity_path FROM ents)),
places AS (SELECT e, id, min(struct_pack(part := part, ord := ord, i := i)) AS p, min(struct_pack(ord := ord, i := i)) FILTER (part = 1) AS c
  FROM (SELECT e, part, ord, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS id FROM asserted) GROUP BY e, id),
orig AS (SELECT f.e, coalesce(l.r, '') AS relation_source_ids, coalesce(l.c, '') AS claim_source_ids, requires_hedging, n_assertions
  FROM (SELECT e, bool_or(coalesce(confidence IN ('C', 'D'), false)) AS requires_hedging, count(*) AS n_assertions FROM asserted GROUP BY e) f
  LEFT JOIN (SELECT e, string_agg(id, '|' ORDER BY p) AS r, string_agg(id, '|' ORDER BY c) FILTER (c IS NOT NULL) AS c FROM places GROUP BY e) l ON l.e = f.e)"""
_SPACE_CODES = "[" + ", ".join(str(i) for i in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)) + "]"


@lru_cache(maxsize=1)
def _folds() -> str:
    """A map of the code points that the compatibility form and case folding change to what they become, by rule from the Unicode database."""
    out = {}
    for i in range(0x30000):
        c = chr(i)
        if unicodedata.category(c)[0] != "C" and c != "'":
            folded = unicodedata.normalize("NFKC", c).casefold()
            if folded != c:
                out[c] = folded
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in out.items()) + "}"


def _normalized(values: str) -> str:
    """(v, nv) of the distinct values of a query of one column v: folded by code point, composed, and without white space."""
    return f"""(SELECT v, nfc_normalize(coalesce(string_agg(coalesce(m[c], c), '' ORDER BY i) FILTER (NOT list_contains({_SPACE_CODES}, unicode(c))), '')) AS nv
        FROM (SELECT v, i, substr(v, i, 1) AS c FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM ({values}))), folds GROUP BY v)"""


def _folded(sql: str) -> str:
    return sql.replace("WITH\n", f"WITH folds AS MATERIALIZED (SELECT {_folds()} AS m),\n", 1)


# Sections: the fence that is open before each line is folded along the lines.
_SECTIONS = rf""", parts AS (SELECT entity_path, string_split_regex(regexp_replace(content, '\r\n', chr(10), 'g'), '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM ents WHERE content IS NOT NULL),
marked AS (SELECT *, list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^[ \t]{{0,3}}(```+|~~~+)') THEN regexp_extract(x, '^[ \t]{{0,3}}(`+|~+)', 1) || CASE WHEN regexp_matches(x, '^[ \t]{{0,3}}(`+|~+){_WS}*$') THEN ';' ELSE ':' END ELSE '' END) AS ms FROM parts),
folded AS (SELECT *, string_split(list_reduce(list_prepend('', ms), lambda acc, x: acc || chr(10) || CASE WHEN regexp_extract(acc, '[^\n]*$') = '' THEN rtrim(x, ';:')
  WHEN x LIKE '%;' AND starts_with(x, regexp_extract(acc, '[^\n]*$')) THEN '' ELSE regexp_extract(acc, '[^\n]*$') END), chr(10)) AS states FROM marked),
lines AS (SELECT entity_path, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line, unnest(ms) AS mark, unnest(states[1:len(ls)]) AS before FROM folded),
titled AS (SELECT *, CASE WHEN before = '' AND mark = '' AND regexp_matches(line, '^[ \t]{{0,3}}#{{1,6}}[ \t]') THEN
  regexp_replace(regexp_replace(regexp_replace(line, '^[ \t]{{0,3}}#+{_WS}*|{_WS}+$', '', 'g'), '(^|[ \t]+)#+$', ''), '{_WS}+$', '') ELSE '' END AS title FROM lines),
numbered AS (SELECT *, sum((title <> '')::INT) OVER (PARTITION BY entity_path ORDER BY i) AS section FROM titled),
secs AS (SELECT entity_path, section, max(title) FILTER (title <> '') AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (title = ''), ''), '^{_WS}+|{_WS}+$', '', 'g') AS text FROM numbered GROUP BY ALL),
full_secs AS (SELECT *, row_number() OVER (PARTITION BY entity_path ORDER BY section) - 1 AS ordinal, row_number() OVER (PARTITION BY entity_path, heading ORDER BY section) AS nth FROM secs WHERE text <> '')"""
_CHUNK_LINE = ", ".join(f"'{c}', {c}" for c in ("chunk_id", "content_hash", "entity_path", "entity_type", "heading", "metadata_json", "ordinal", "source_ids_json", "tags_json", "text", "title"))


def folded_sql() -> dict[str, str]:
    """The SQL of the queries that normalise text."""
    titles = _normalized("SELECT DISTINCT title AS v FROM ents WHERE title <> ''")
    fields = """SELECT chunk_id AS record_id, 'text' AS field_name, text AS v FROM chs UNION ALL SELECT chunk_id, 'heading', heading FROM chs UNION ALL SELECT chunk_id, 'title', title FROM chs
          UNION ALL SELECT chunk_id, 'entity_type', entity_type FROM chs UNION ALL SELECT chunk_id, 'tags', unnest(from_json(tags_json, '["VARCHAR"]')) FROM chs"""
    entity_fields = """SELECT entity_path AS id, 'title' AS f, title AS v FROM ents UNION ALL SELECT entity_path, 'description', description FROM ents UNION ALL SELECT entity_path, 'entity_type', entity_type FROM ents
          UNION ALL SELECT entity_path, 'content', content FROM ents UNION ALL SELECT entity_path, 'aliases', unnest(from_json(aliases_json, '["VARCHAR"]')) FROM ents UNION ALL SELECT entity_path, 'tags', unnest(from_json(tags_json, '["VARCHAR"]')) FROM ents"""
    counted = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for n, t, k in (("entities", "ents", "entity_path"), ("chunks", "chs", "chunk_id"), ("relations", "rels", "relation_id"), ("claims", "cls", "claim_key"), ("kb_references", "refs", "reference_id")))
    return {
        "stored_index": _folded(
            _BASE + f""", vals AS (SELECT row_number() OVER () AS field_id, v FROM ({entity_fields} UNION ALL SELECT record_id, field_name, v FROM ({fields})) WHERE v IS NOT NULL),
            norm AS MATERIALIZED {_normalized("SELECT DISTINCT v FROM vals WHERE v <> ''")},
            grams AS (SELECT DISTINCT field_id, CASE WHEN length(v) <= 2 THEN v ELSE substr(v, i, 2) END AS gram FROM (SELECT field_id, nv AS v, unnest(range(1, greatest(length(nv), 2))) AS i FROM vals JOIN norm USING (v) WHERE nv <> ''))
            {counted} UNION ALL SELECT 'lexical_fields', count(*), count(DISTINCT field_id) FROM vals UNION ALL SELECT 'lexical_ngrams', count(*), count(DISTINCT gram) FROM grams"""
        ),
        "normalized_titles": _folded(_BASE + f" SELECT e.entity_path, CASE WHEN e.title = '' THEN '' ELSE n.nv END AS normalized_title FROM ents e LEFT JOIN {titles} n ON n.v = e.title"),
        "lexical_chunk_topk": _folded(
            _BASE + f""", raw AS ({fields}), norm AS MATERIALIZED {_normalized("SELECT DISTINCT v FROM raw WHERE v <> '' UNION SELECT query_text FROM evs WHERE query_text <> ''")},
            qs AS (SELECT query_id, nv AS q FROM evs JOIN norm ON v = query_text WHERE nv <> ''),
            qg AS (SELECT DISTINCT query_id, q, CASE WHEN length(q) <= 2 THEN q ELSE substr(q, i, 2) END AS gram FROM (SELECT *, unnest(range(1, greatest(length(q), 2))) AS i FROM qs)),
            qn AS (SELECT query_id, q, count(*) AS n_grams FROM qg GROUP BY ALL),
            fields AS (SELECT row_number() OVER () AS field_id, record_id, field_name, nv AS normalized_value FROM raw JOIN norm ON norm.v = raw.v WHERE nv <> ''),
            grams AS (SELECT DISTINCT field_id, CASE WHEN length(v) <= 2 THEN v ELSE substr(v, i, 2) END AS gram FROM (SELECT field_id, normalized_value AS v, unnest(range(1, greatest(length(normalized_value), 2))) AS i FROM fields)
              WHERE CASE WHEN length(v) <= 2 THEN v ELSE substr(v, i, 2) END IN (SELECT gram FROM qg)),
            weights AS (SELECT * FROM (VALUES ('text', 4.0::DOUBLE), ('heading', 5.0), ('title', 3.0), ('tags', 1.0), ('entity_type', 1.0)) t(field_name, weight))""" + _SCORED + _TOP.format("record_id AS chunk_id")
        ),
    }


SQL: dict[str, str] = {
    "entity_fallback_text": _BASE + f""" SELECT entity_path, sha256(t) AS text_hash, length(t) AS n_chars FROM (
        SELECT entity_path, coalesce(nullif(regexp_replace(content, '^{_WS}+|{_WS}+$', '', 'g'), ''), nullif(description, ''), title) AS t FROM ents)""",
    "diverse_select": _GROWN + """, both_hits AS (
          SELECT g.query_id, g.neighbor AS entity_path, 'graph.one-hop' AS retriever, g.claim_path, g.score, coalesce(a.entity_type = b.entity_type, a.entity_type IS NULL AND b.entity_type IS NULL) AS same_type,
            concat_ws(':', direction, predicate, coalesce(claim_ref, ''), '[' || CASE WHEN source_ids = '' THEN '' ELSE '"' || replace(source_ids, '|', '","') || '"' END || ']', coalesce(confidence, '')) AS tag
          FROM grown g JOIN ents a ON a.entity_path = g.seed JOIN ents b ON b.entity_path = g.neighbor
          UNION ALL SELECT f.query_id, f.entity_path, 'rrf.entity', NULL, f.score, NULL, '' FROM fused f JOIN ents e ON e.entity_path = f.entity_path WHERE f.rank <= 20),
        placed AS (SELECT *, CASE WHEN retriever = 'rrf.entity' THEN 'direct' WHEN claim_path IS NULL THEN 'relation' ELSE 'claim' END AS kind,
          row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_path, retriever, tag) AS place FROM both_hits),
        lone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind, claim_path ORDER BY place) AS _l FROM placed) WHERE kind <> 'claim' OR _l = 1),
        nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY CASE WHEN kind = 'relation' THEN NOT same_type ELSE false END, place) AS nth,
          count(*) FILTER (kind = 'relation') OVER (PARTITION BY query_id) AS n_r, count(*) FILTER (kind = 'claim') OVER (PARTITION BY query_id) AS n_c FROM lone),
        room AS (SELECT *, least(1, n_r) AS one, least(n_c, 3 - least(1, n_r)) AS c FROM nth),
        share AS (SELECT *, one + greatest(0, least(n_r - one, 3 - one - c)) AS r FROM room)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_path, retriever, place) AS rank, entity_path, retriever, claim_path, round(score, 9) AS score
        FROM share WHERE nth <= CASE kind WHEN 'claim' THEN c WHEN 'relation' THEN r ELSE 5 - r - c END""",
    "char_ngrams": """SELECT DISTINCT field_id, CASE WHEN length(v) <= 2 THEN v ELSE substr(v, i, 2) END AS gram
        FROM (SELECT *, unnest(range(1, greatest(length(v), 2))) AS i FROM (SELECT DISTINCT field_id, normalized_value AS v FROM lexical_fields WHERE field_id IS NOT NULL AND normalized_value <> ''))""",
    "gram_document_frequency": """SELECT gram, count(DISTINCT record_id) AS n_records FROM lexical_ngrams g JOIN lexical_fields f ON f.field_id = g.field_id GROUP BY gram HAVING count(DISTINCT record_id) > 0""",
    "content_hash_mismatches": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND sha256(text) IS DISTINCT FROM content_hash",
    "source_id_normalize": _BASE + rf""" SELECT entity_path, i - 1 AS position, regexp_replace(regexp_replace(ids[i], '^[ \t\n\x0B\f\r]*((?i:ref:)[ \t\n\x0B\f\r]*)?', ''), '[ \t\n\x0B\f\r]+$', '') AS source_id
        FROM (SELECT entity_path, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT entity_path, from_json(source_ids_json, '["VARCHAR"]') AS ids FROM ents))
        WHERE regexp_replace(regexp_replace(ids[i], '^[ \t\n\x0B\f\r]*((?i:ref:)[ \t\n\x0B\f\r]*)?', ''), '[ \t\n\x0B\f\r]+$', '') <> ''""",
    "confidence_weights": _BASE + " SELECT confidence, coalesce(map {'A': 1.0, 'B': 0.75, 'C': 0.5, 'D': 0.25}[confidence], 0.5)::DOUBLE AS weight, coalesce(confidence IN ('C', 'D'), false) AS requires_hedging, count(*) AS n FROM cls GROUP BY ALL",
    "claim_forms": _BASE + """ SELECT form, count(*) AS n FROM (SELECT CASE WHEN r AND v THEN 'both' WHEN r THEN 'relation' WHEN v THEN 'value' ELSE 'statement' END AS form
        FROM (SELECT subject IS NOT NULL AND predicate IS NOT NULL AND target IS NOT NULL AS r, subject IS NOT NULL AND property IS NOT NULL AS v FROM cls)) GROUP BY form""",
    "postings_candidates": _BASE + _Q + _INDEX + _SCORED + " SELECT DISTINCT query_id, record_id FROM m",
    "lexical_field_scores": _BASE + _Q + _INDEX + _SCORED + " SELECT query_id, field_id, shared, inside, round(coverage, 9) AS coverage FROM s",
    "lexical_entity_topk": _BASE + _Q + _INDEX + _SCORED + _TOP.format("record_id AS entity_path"),
    "chunk_ordinals": _BASE + " SELECT entity_path, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM chs GROUP BY ALL",
    "vector_cosine_topk": _VECTOR.format("list_cosine_similarity"),
    "vector_dot_topk": _VECTOR.format("list_inner_product"),
    "vector_compatibility": """SELECT coalesce(v.chunk_id, c.chunk_id) AS chunk_id, CASE WHEN v.chunk_id IS NULL THEN 'missing' WHEN c.chunk_id IS NULL THEN 'extra' ELSE 'stale' END AS problem
        FROM (SELECT chunk_id, max(content_hash) AS h FROM vectors WHERE chunk_id IS NOT NULL GROUP BY 1) v FULL JOIN (SELECT chunk_id, max(content_hash) AS h FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) c
        ON c.chunk_id = v.chunk_id WHERE v.chunk_id IS NULL OR c.chunk_id IS NULL OR v.h IS DISTINCT FROM c.h""",
    "vector_unusable": """SELECT DISTINCT chunk_id, problem FROM (SELECT chunk_id, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 48 THEN 'dimension'
        WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero' END AS problem
        FROM vectors WHERE chunk_id IS NOT NULL) WHERE problem IS NOT NULL""",
    "rrf_fuse": _BASE + _HITS.format("") + _fused() + " SELECT query_id, rank, entity_path, round(score, 12) AS score FROM fused WHERE rank <= 10",
    "rrf_weighted_cutoff": _BASE + _HITS.format("WHERE backend <> 'lexical.chunk' OR rank <= 5") + _fused(30.0, (1.0, 0.0, 2.0)) + " SELECT query_id, rank, entity_path, round(score, 12) AS score FROM fused WHERE rank <= 10",
    "rrf_passage_choice": _BASE + _HITS.format("") + """ SELECT query_id, entity_path, backend, section, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_path
        ORDER BY coalesce(list_position(['lexical.chunk', 'lexical.entity', 'vector.chunk'], backend), 9), rank, coalesce(section, ''), coalesce(text, ''), backend) AS _p FROM best) WHERE _p = 1""",
    "fallback_passages": _BASE + " SELECT entity_path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_path ORDER BY ordinal, chunk_id) AS _f FROM chs) WHERE _f = 1",
    "relation_merge": _BASE + _EDGES + " SELECT source, target, predicate, confidence, source_ids, n FROM merged",
    "claim_merge": f"""WITH c AS (SELECT DISTINCT * EXCLUDE (loaded_at), coalesce(nullif(claim_path, ''), nullif(claim_id, ''), claim_key) AS claim_ref, coalesce({_IDS.format("source_ids_json")}, []) AS ids FROM claims WHERE claim_key IS NOT NULL),
        s AS (SELECT claim_ref, string_agg(id, '|' ORDER BY p) AS source_ids FROM (SELECT claim_ref, id, min(struct_pack(a := claim_key, b := i)) AS p
          FROM (SELECT claim_ref, claim_key, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS id FROM c) GROUP BY ALL) GROUP BY claim_ref)
        SELECT c.claim_ref, {", ".join(f"arg_min({x}, claim_key) FILTER ({x} <> '') AS {x}" for x in ("claim_id", "claim_path", "statement", "status", "confidence", "subject", "predicate", "target", "property", "value_json"))},
          count(*) AS n, coalesce(any_value(s.source_ids), '') AS source_ids FROM c LEFT JOIN s ON s.claim_ref = c.claim_ref GROUP BY c.claim_ref""",
    "graph_edges": _BASE + _EDGES + " SELECT source, target, predicate, kind, is_value, claim_ref, status, confidence FROM edges",
    "claim_policy": _BASE + _EDGES + _policy(_ADMIT) + _POLICY,
    "claim_opt_in": _BASE + _EDGES + _policy("true") + _POLICY,
    "graph_predicate_filter": _BASE + _EDGES + _policy(_ADMIT + " AND lower(replace(predicate, ' ', '')) IN ('cites', 'related-to')") + _POLICY,
    "seed_dedup": _BASE + """ SELECT query_id, entity_path, row_number() OVER (PARTITION BY query_id ORDER BY rank, -score, entity_path) AS rank, round(score, 9) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, entity_path ORDER BY rank, -score) AS _s FROM pks WHERE score IS NOT NULL AND NOT isnan(score)) WHERE _s = 1""",
    "graph_expand_one_hop": _GROWN + " SELECT query_id, seed, neighbor, direction, predicate, kind, claim_ref, source_ids, round(score, 9) AS score FROM grown",
    "value_claim_assertion": _GROWN + " SELECT query_id, neighbor, predicate, claim_ref, round(score, 9) AS score FROM grown WHERE direction = 'assertion'",
    "applicable_assertions": _BASE + _EDGES + f""", w AS (SELECT map {{'A': 1.0, 'B': 0.75, 'C': 0.5, 'D': 0.25}} AS m),
        all_of AS (SELECT source AS entity_path, 'relation' AS kind, predicate, target, NULL::VARCHAR AS claim_ref, NULL::VARCHAR AS status, confidence,
            (CASE WHEN confidence IS NULL THEN 1.0 ELSE coalesce(m[confidence], 0.5) END)::DOUBLE AS confidence_weight, true AS affirmative, source_ids FROM merged, w
          UNION ALL SELECT DISTINCT subject, 'claim', coalesce(predicate, property), target, coalesce(claim_path, claim_id), lower(status), confidence, coalesce(m[confidence], 0.5)::DOUBLE, lower(status) = 'accepted',
            array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_position(ids, ids[i]) = i THEN ids[i] END), '|')
          FROM (SELECT *, coalesce({_IDS.format("source_ids_json")}, []) AS ids FROM cls), w WHERE subject IS NOT NULL)
        SELECT * FROM all_of WHERE entity_path IN (SELECT entity_path FROM ents)""",
    "hit_assertions": _BASE + _EDGES + _ORIGINS + """ SELECT packet_id, entity_path, coalesce(relation_source_ids, '') AS relation_source_ids, coalesce(claim_source_ids, '') AS claim_source_ids,
        coalesce(requires_hedging, false) AS requires_hedging, coalesce(n_assertions, 0) AS n_assertions FROM (SELECT packet_id, entity_path FROM pks WHERE retriever = 'vector.chunk') LEFT JOIN orig ON e = entity_path""",
    "fused_provenance": _BASE + _HITS.format("") + _fused() + _EDGES + _ORIGINS + """ SELECT f.query_id, f.rank, f.entity_path, coalesce(o.relation_source_ids, '') AS relation_source_ids, coalesce(o.claim_source_ids, '') AS claim_source_ids,
        coalesce(o.requires_hedging, false) AS requires_hedging FROM fused f LEFT JOIN best b ON b.query_id = f.query_id AND b.entity_path = f.entity_path AND b.backend = 'vector.chunk' LEFT JOIN orig o ON o.e = b.entity_path WHERE f.rank <= 10""",
    "context_packets": _BASE + _SOURCES + """, one AS (SELECT *, CASE WHEN score IS NULL OR isnan(score) THEN '-inf'::DOUBLE ELSE score END AS s FROM pks WHERE query_id IS NOT NULL),
        bare AS (SELECT one.*, list_distinct_in_order.ids AS own_ids FROM one LEFT JOIN (SELECT packet_id, list(source_id ORDER BY i) AS ids FROM (SELECT packet_id, source_id, min(i) AS i FROM (
          SELECT packet_id, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS source_id FROM ps) GROUP BY ALL) GROUP BY packet_id) list_distinct_in_order USING (packet_id)),
        kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_path, section, text, coalesce(own_ids, []), retriever ORDER BY rank NULLS FIRST, -s, packet_id) AS _k FROM bare),
        resolved AS (SELECT k.packet_id, string_agg(x.id || CASE WHEN r.reference_id IS NULL THEN '-' ELSE '+' END, '|' ORDER BY x.i) AS refs
          FROM kept k JOIN (SELECT packet_id, unnest(range(1, len(own_ids) + 1)) AS i, unnest(own_ids) AS id FROM kept) x ON x.packet_id = k.packet_id LEFT JOIN refs r ON r.reference_id = x.id GROUP BY k.packet_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS FIRST, -s, entity_path NULLS FIRST, retriever NULLS FIRST, coalesce(section, ''), text NULLS FIRST, packet_id) AS position, packet_id, rank, retriever, entity_path, section,
          md5(text) AS text_md5, coalesce(refs, '') AS "references", confidence, confidence_weight, coalesce(requires_hedging, false) AS requires_hedging FROM kept LEFT JOIN resolved USING (packet_id) WHERE _k = 1""",
    "chunk_entities": _BASE + _SECTIONS + """ SELECT entity_path || '#' || CASE WHEN heading IS NULL THEN 'preamble' WHEN nth > 1 THEN heading || '-' || nth ELSE heading END AS chunk_id, entity_path, ordinal, heading, sha256(text) AS content_hash FROM full_secs""",
    "canonical_chunks": _BASE + f" SELECT CAST(json_object({_CHUNK_LINE}) AS VARCHAR) AS line FROM chs",
    "parsed_documents": _BASE + rf""", docs AS (
          SELECT entity_path AS path, regexp_matches(coalesce(title, ''), '[^{_WS[1:]}') AND regexp_matches(coalesce(description, ''), '[^{_WS[1:]}') AND regexp_matches(coalesce(entity_type, ''), '[^{_WS[1:]}')
            AND timestamp IS NOT NULL AND tags_json IS NOT NULL AS fine, * FROM ents)
        SELECT path, CASE WHEN fine THEN 'entity' ELSE 'problem' END AS kind, CASE WHEN fine THEN entity_type END AS entity_type, CASE WHEN fine THEN title END AS title, CASE WHEN fine THEN len(from_json(tags_json, '["VARCHAR"]')) END AS n_tags,
          CASE WHEN fine THEN md5(coalesce(regexp_replace(regexp_replace(content, '\r\n', chr(10), 'g'), '[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '')) END AS content_md5 FROM docs
        UNION ALL SELECT claim_path, CASE WHEN ok THEN 'claim' ELSE 'problem' END, NULL, NULL, NULL, NULL FROM (SELECT claim_path, coalesce(status, '') <> '' AND coalesce(confidence, '') <> '' AND claim_path LIKE '/%'
          AND len(ids) > 0 AND len(list_filter(ids, lambda e: e = '')) = 0 AND NOT ((predicate IS NOT NULL AND target IS NOT NULL) AND property IS NOT NULL)
          AND NOT (predicate IS NOT NULL AND target IS NULL) AND NOT (property IS NULL AND value_json IS NOT NULL) AND (coalesce(subject, '') <> '' OR NOT ((predicate IS NOT NULL AND target IS NOT NULL) OR property IS NOT NULL)) AS ok
          FROM (SELECT *, coalesce({_ALL_IDS.format("source_ids_json")}, []) AS ids FROM cls WHERE claim_path IS NOT NULL))""",
    "stored_vectors": _BASE + f""", seeds AS (SELECT chunk_id, content_hash, sha256(encode('{{"embedding_fingerprint":"{_FINGERPRINT}","role":"document","text":' || CAST(to_json(text) AS VARCHAR) || '}}') || from_hex('0000000000000000')) AS h FROM chs)
        SELECT chunk_id, content_hash, {", ".join(f"round(('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT / 4294967295.0::DOUBLE * 2 - 1, 9) AS v{i}" for i in range(8))} FROM seeds""",
    "context_references": _BASE + _SOURCES + " SELECT packet_id, source_id, title, year, resolved FROM rsv",
    "context_unresolved": _BASE + _SOURCES + " SELECT source_id, count(DISTINCT packet_id) AS n_packets FROM rsv WHERE NOT resolved GROUP BY ALL",
    "context_dedup": _BASE + """ SELECT query_id, packet_id, entity_path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_path, section, text, source_ids, retriever
        ORDER BY rank, -coalesce(score, '-inf'::DOUBLE), packet_id) AS _c FROM pks) WHERE _c = 1""",
    "eval_recall_mrr": _EVAL + " SELECT query_id, round(recall_at_k, 9) AS recall_at_k, round(reciprocal_rank, 9) AS reciprocal_rank, success, n_missing FROM res",
    "eval_totals": _EVAL + f" SELECT {_TOTALS} FROM res",
    "eval_by_kind": _EVAL + f" SELECT kind, {_TOTALS} FROM res WHERE kind IS NOT NULL GROUP BY kind",
    "eval_compare": _EVAL + _fused(60.0, (1.0,), backends=("lexical.chunk",), name="lone") + _results("lone", "bas") + """,
        row AS (SELECT round(avg(c.recall_at_k) - avg(b.recall_at_k), 9) AS improvement, round(avg(c.reciprocal_rank) - avg(b.reciprocal_rank), 9) AS mrr_delta,
          coalesce(sum((c.recall_at_k < b.recall_at_k)::INT), 0) AS regressions, coalesce(bool_or(coalesce(b.gap, false) AND NOT b.success AND c.success), false) AS gap_fixed, count(*) FILTER (b.query_id IS NULL OR c.query_id IS NULL) AS unmatched
          FROM bas b FULL JOIN res c ON c.query_id = b.query_id)
        SELECT *, coalesce(improvement >= 0 AND mrr_delta >= 0 AND regressions <= 0 AND unmatched = 0 AND gap_fixed, false) AS admitted FROM row""",
    "integrity_duplicates": " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS record_key, count(*) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1" for t, k in _KEYS.items()),
    "edge_sync_diff": _BASE + """, a AS (SELECT DISTINCT source_path AS source, predicate, target FROM rels WHERE source_path IS NOT NULL AND predicate IS NOT NULL AND target IS NOT NULL),
        b AS (SELECT DISTINCT subject AS source, predicate, target FROM cls WHERE subject IS NOT NULL AND predicate IS NOT NULL AND target IS NOT NULL)
        SELECT *, 'missing' AS difference FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "manifest_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in (*_KEYS, "lexical_fields", "lexical_ngrams", "vectors")),
    "inspect_entity": _BASE + """ SELECT entity_path, entity_type, coalesce(c.n, 0) AS n_chunks, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(k.n, 0) AS n_claims FROM ents
        LEFT JOIN (SELECT entity_path AS p, count(*) AS n FROM chs GROUP BY 1) c ON c.p = entity_path LEFT JOIN (SELECT source_path AS p, count(*) AS n FROM rels GROUP BY 1) o ON o.p = entity_path
        LEFT JOIN (SELECT target AS p, count(*) AS n FROM rels GROUP BY 1) i ON i.p = entity_path LEFT JOIN (SELECT subject AS p, count(*) AS n FROM cls GROUP BY 1) k ON k.p = entity_path""",
}
