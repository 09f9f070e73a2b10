"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from skein.functions import text as T
from skein.operators.hypergraph import PATTERN_BOOSTS, TYPE_KEYWORDS
from skein.operators.retrieve import HEADER

ORACLES: dict = {}

# Shared table expressions; each list names what it needs before it.
PARTS = {
    "p": "SELECT 'passage-' || sha256('passage-' || text) AS passage_id, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)",
    "tk": "SELECT DISTINCT passage_id, entity FROM (SELECT passage_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS entity FROM p)",
    "lx": "SELECT entity, count(*) AS df FROM tk GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.05::DOUBLE * (SELECT count(*) FROM p)",
    "pe": "SELECT passage_id, entity FROM tk SEMI JOIN lx USING (entity)",
    "ps": r"SELECT DISTINCT passage_id, sentence FROM (SELECT passage_id, regexp_replace(unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')), '^\s+|\s+$', '', 'g') AS sentence FROM p) WHERE length(sentence) >= 10",
    "se": "SELECT DISTINCT sentence, entity FROM (SELECT sentence, unnest(regexp_extract_all(lower(sentence), '[a-z]{5,}')) AS entity FROM (SELECT DISTINCT sentence FROM ps)) SEMI JOIN lx USING (entity)",
    "ee": "SELECT passage_id, entity, cnt, cnt / sum(cnt) OVER (PARTITION BY passage_id) AS weight FROM (SELECT passage_id, entity, CAST((length(text) - length(replace(text, entity, ''))) // length(entity) AS BIGINT) AS cnt FROM pe JOIN p USING (passage_id)) WHERE cnt > 0",
    "h0": "SELECT sentence, count(*) AS n, string_agg(entity, '|' ORDER BY entity) AS entities FROM se GROUP BY 1 HAVING length(sentence) BETWEEN 20 AND 500 AND count(*) BETWEEN 2 AND 10",
    "he": "SELECT left(md5(sentence || '|' || entities), 16) AS he_id, sentence, entities, CAST(n AS INT) AS n_entities, round(n / (SELECT max(n) FROM h0), 6) AS score FROM h0",
    "inc": "SELECT DISTINCT he_id, left(md5(entity), 16) AS entity_id, entity FROM (SELECT he_id, unnest(string_split(entities, '|')) AS entity FROM he)",
    "ph": "SELECT DISTINCT passage_id, he_id FROM ps JOIN he USING (sentence)",
    "q": "SELECT item_id AS q, text FROM benchmark",
    "mt": "SELECT DISTINCT q, mention FROM (SELECT q, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS mention FROM q)",
    "gt": "SELECT entity AS t FROM lx UNION SELECT mention FROM mt",
    "gv": "SELECT t, b, c / sqrt(sum(c * c) OVER (PARTITION BY t)) AS w FROM (SELECT t, {bucket} AS b, count(*)::DOUBLE AS c FROM (SELECT t, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS piece FROM gt) GROUP BY 1, 2)",
    "ms": "SELECT m.t AS mention, e.t AS entity, round(sum(m.w * e.w), 6) AS score FROM gv m JOIN gv e USING (b) WHERE m.t IN (SELECT mention FROM mt) AND e.t IN (SELECT entity FROM lx) GROUP BY 1, 2",
    "sd": "SELECT q, mention, entity, score FROM mt JOIN (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity) = 1) USING (mention)",
    "ss": "SELECT q, entity, arg_max(score, mention) AS score, row_number() OVER (PARTITION BY q ORDER BY entity) AS pos FROM sd GROUP BY q, entity",
    "wt": "SELECT 'q' AS k, q::VARCHAR AS id, text FROM q UNION ALL SELECT 'p', passage_id, text FROM p UNION ALL SELECT 's', sentence, sentence FROM (SELECT DISTINCT sentence FROM se)",
    "wv": "SELECT k, id, b, c / sqrt(sum(c * c) OVER (PARTITION BY k, id)) AS w FROM (SELECT k, id, {bucket} AS b, count(*)::DOUBLE AS c FROM (SELECT k, id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS piece FROM wt) GROUP BY 1, 2, 3)",
    "qv": "SELECT id::BIGINT AS q, b, w FROM wv WHERE k = 'q'",
    "ds": "SELECT q, passage_id, coalesce(s, 0.0) AS score FROM (SELECT q.q, p.passage_id FROM q CROSS JOIN p) LEFT JOIN (SELECT q, id AS passage_id, round(sum(qv.w * v.w), 6) AS s FROM qv JOIN wv v USING (b) WHERE v.k = 'p' GROUP BY 1, 2) USING (q, passage_id)",
    "sm": "SELECT q, id AS sentence, round(sum(qv.w * v.w), 6) AS sim FROM qv JOIN wv v USING (b) WHERE v.k = 's' GROUP BY 1, 2 HAVING round(sum(qv.w * v.w), 6) >= 0.25",
    "hs": "SELECT q, he_id, sentence, entities, round(sum(qv.w * v.w) * any_value(he.score), 6) AS score FROM he JOIN wv v ON v.k = 's' AND v.id = he.sentence JOIN qv USING (b) GROUP BY 1, 2, 3, 4",
    "hf": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, he_id) AS INT) AS rank FROM hs) WHERE rank <= 30 AND score >= 0.3",
    "pl": "SELECT * FROM (SELECT q, passage_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS dpr, row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS r FROM ds WINDOW w AS (PARTITION BY q)) WHERE r <= 500",
    # Spreading activation: seeds in order claim up to five most similar sentences that none before them did.
    "c0": "SELECT q, pos, list(sentence ORDER BY sim DESC, sentence) AS names FROM ss JOIN se USING (entity) JOIN sm USING (q, sentence) WHERE score >= 0.3 GROUP BY 1, 2",
    "ps0": "SELECT ss.q, ss.pos, c0.names FROM ss LEFT JOIN c0 ON c0.q = ss.q AND c0.pos = ss.pos",
    "rc": "SELECT DISTINCT q, 0::BIGINT AS pos, []::VARCHAR[] AS used, []::VARCHAR[] AS got FROM ss UNION ALL SELECT q, pos, list_concat(used, g), g FROM (SELECT r.q, s.pos, r.used, coalesce(list_slice(list_filter(s.names, lambda x: NOT list_contains(r.used, x)), 1, 5), []::VARCHAR[]) AS g FROM rc r JOIN ps0 s ON s.q = r.q AND s.pos = r.pos + 1)",
    "cm": "SELECT q, entity, n, s FROM (SELECT c.q, se.entity, c.pos * 10 + c.i AS n, ss.score * sm.sim AS s FROM (SELECT q, pos, unnest(got) AS sentence, unnest(range(len(got))) AS i FROM rc) c JOIN ss ON ss.q = c.q AND ss.pos = c.pos JOIN sm ON sm.q = c.q AND sm.sentence = c.sentence JOIN se ON se.sentence = c.sentence) WHERE s >= 0.3",
    "na": "SELECT q, entity, sum(s) AS total, arg_max(s, n) AS score FROM cm GROUP BY 1, 2",
    "aw": "SELECT q, entity, coalesce(n.score, o.score) AS score, CAST(CASE WHEN n.q IS NULL THEN 1 ELSE 2 END AS INT) AS tier, coalesce(o.score, 0) + coalesce(n.total, 0) AS weight FROM ss o FULL JOIN na n USING (q, entity)",
    "bo": "SELECT q, passage_id, sum(score * ln(1 + (length(low) - length(replace(low, entity, ''))) // length(entity)) / tier) AS bonus FROM pl JOIN (SELECT passage_id, lower(text) AS low FROM p) USING (passage_id) JOIN aw USING (q) GROUP BY 1, 2",
    "sc": "SELECT q, passage_id, round(0.7::DOUBLE * dpr + ln(1 + coalesce(bonus, 0)), 6) AS score FROM pl LEFT JOIN bo USING (q, passage_id)",
    "eg": "SELECT passage_id AS src, 'entity-' || sha256('entity-' || entity) AS dst, weight FROM ee",
    "nd": "SELECT passage_id AS id FROM p UNION ALL SELECT 'entity-' || sha256('entity-' || entity) FROM lx",
    "rk": "SELECT * FROM (SELECT q, passage_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS rank FROM ds) WHERE rank <= 10",
    "nt": "SELECT doc_id, concat(coalesce(text, ''), ' ', {notes}[(((doc_id % 5) + 5) % 5) + 1]) AS text FROM documents",
    "a0": "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL",
    "rs": "SELECT conv_id * 1000 + turn AS idx, text AS question, CASE conv_id % 3 WHEN 0 THEN 'medqa' WHEN 1 THEN 'pubmedqa' ELSE 'bioasq' END AS dataset, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'yes' ELSE 'no' END AS answer, (turn % 4 = 1) AS has_entities FROM a0",
    "pr": "SELECT *, CASE dataset WHEN 'medqa' THEN {choice} WHEN 'pubmedqa' THEN {ynm} ELSE {yn} END AS pred FROM (SELECT *, question AS text FROM rs)",
    "jd": r"SELECT idx, dataset, question, pred, CAST(CASE dataset WHEN 'medqa' THEN lower(pred) IN ('a', 'b', 'c', 'd') WHEN 'pubmedqa' THEN lower(pred) IN ('yes', 'no', 'maybe') ELSE lower(pred) IN ('yes', 'no') END AS INT) AS valid, CAST(lower(pred) = lower(answer) AS INT) AS same, CAST(CASE WHEN dataset = 'medqa' THEN coalesce(contains(lower(question), nullif(lower(regexp_replace(regexp_replace(list_filter(list_transform(regexp_split_to_array(question, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(lower(x), 'a.'))[1], '^[^.]*\.', ''), '^\s+|\s+$', '', 'g')), '')), false) ELSE contains(lower(question), lower(answer)) END AS INT) AS contain_correct, CAST(NOT has_entities AS INT) AS no_entity FROM pr",
}
_UP = r"upper(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
_EDGE = r"(?:^|[^\pL\pN_])"
_END = r"(?:$|[^\pL\pN_])"
_CHOICE = rf"(CASE WHEN {_UP} IN ('A', 'B', 'C', 'D') THEN {_UP} WHEN regexp_extract({_UP}, '{_EDGE}([ABCD]){_END}', 1) <> '' THEN regexp_extract({_UP}, '{_EDGE}([ABCD]){_END}', 1) WHEN regexp_extract({_UP}, '[ABCD]') <> '' THEN regexp_extract({_UP}, '[ABCD]') ELSE 'INVALID' END)"


def _words(words: str) -> str:
    hit = rf"regexp_extract(text, '(?i){_EDGE}({words}){_END}', 1)"
    return f"(CASE WHEN {hit} = '' THEN 'INVALID' ELSE upper(left({hit}, 1)) || lower(substr({hit}, 2)) END)"


_HEX = "0123456789abcdef"
#: Medical notes that stand behind the documents where extractors run.
NOTES = ["Amoxicillin was given for pain and fever.", "Omeprazole; glucose level and platelet  count were normal.", "No disease.", "A lymphoma, then a carcinoma, was seen: cough, painful.", "Losartan for hypertension, drug therapy."]
_FILL = {
    "notes": "[" + ", ".join(f"'{x}'" for x in NOTES) + "]",
    "bucket": f"(instr('{_HEX}', substr(md5(piece), 8, 1)) - 1 + 16 * ((instr('{_HEX}', substr(md5(piece), 7, 1)) - 1) % 4))",
    "choice": _CHOICE,
    "yn": _words("yes|no"),
    "ynm": _words("yes|no|maybe"),
}


def _fill(sql: str) -> str:
    for k, v in _FILL.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _needs(sql: str, known: list) -> list:
    """Names of PARTS that an expression uses, each after what it needs."""
    import re

    for name in PARTS:
        if name not in known and re.search(rf"\b(FROM|JOIN) {name}\b", sql):
            for x in _needs(re.sub(rf"\bFROM {name}\b", "", PARTS[name]), known):
                if x not in known:
                    known.append(x)
            known.append(name)
    return known


def oracle(name: str, sql: str, more: str = "", every: int = 1) -> None:
    """every: questions are the items whose id it divides."""
    names = _needs(sql + " " + more, [])
    parts = [f"{n} AS MATERIALIZED ({_fill(PARTS[n])})" for n in names] + ([_fill(more)] if more else [])
    if every > 1:
        parts = [f"{x[:-1]} WHERE item_id % {every} = 0)" if x.startswith("q AS ") else x for x in parts]
    ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + _fill(sql)


oracle("dense_topk", "SELECT * FROM (SELECT q, item, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS INT) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS item, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10")
oracle("dense_minmax", "SELECT q, item, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM (SELECT a.vec_id AS q, b.vec_id AS item, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0) WINDOW w AS (PARTITION BY q)")
oracle("candidate_pool", "SELECT * FROM (SELECT q, passage_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS INT) AS rank FROM ds) WHERE rank <= 500")
oracle("seed_entity_argmax", "SELECT q, mention, entity, score FROM sd")
oracle("passage_dedup_ids", "SELECT 'passage-' || sha256('passage-' || text) AS passage_id, length(text) AS n_chars FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
oracle("sentence_split", "SELECT passage_id, sentence FROM ps")
_kw = " || ".join(rf"regexp_extract_all(lower(text), '\b(?:{k})\b')" for k in T.KEYWORDS)
# Letters beyond ASCII become one that no keyword has a boundary at, as here a boundary knows ASCII words only.
_nn = "nn AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ʯ]', 'x', 'g') AS text FROM nt)"
oracle("keyword_entities", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_kw})), ',') AS keywords FROM nn", _nn)
_ty = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS entity, '{k}' AS type FROM nn" for k, p in T.TYPED.items())
oracle("typed_entities", f"SELECT DISTINCT doc_id, entity, type FROM ({_ty})", _nn)
_lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
oracle(
    "dictionary_entities",
    rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter({_lists(T.TERMS)}, lambda t: contains(lower(text), lower(t))), list_filter({_lists(T.ABBREVIATIONS)}, lambda t: contains(text, t))), list_concat(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: regexp_replace(w, '[^a-zA-Z0-9_\s-]', '', 'g')), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 2 AND NOT list_contains({_lists(T.NOT_NAMES)}, w)), regexp_extract_all(lower(text), '\d+[\s-]?(?:mg|ml|kg|mm|cm|m|g|l)'))))), ',') AS entities FROM nt",
)
oracle("gazetteer_entities", "SELECT passage_id, entity FROM pe")
oracle("question_entities", f"SELECT q, CASE WHEN n > 0 THEN es ELSE array_to_string(list_sort(list_distinct({_kw})), ',') END AS entities FROM q LEFT JOIN (SELECT q, count(*) AS n, string_agg(mention, ',' ORDER BY mention) AS es FROM mt WHERE mention IN (SELECT entity FROM lx) GROUP BY 1) USING (q)")
oracle(
    "bio_decode",
    "SELECT doc, start, text, type, score FROM (SELECT doc, CAST(first_start AS BIGINT) AS start, lower(regexp_replace(substr(t, first_start + 1, coalesce(end_at, length(t)) - first_start), '^\\s+|\\s+$', '', 'g')) AS text, 'NAME' AS type, round(avg_p, 6) AS score FROM runs JOIN (SELECT passage_id AS doc, text AS t FROM p) USING (doc) WHERE opens) WHERE score >= 0.5 AND length(text) > 2",
    "w0 AS (SELECT passage_id AS doc, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS pos FROM p), "
    "w1 AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'B' WHEN contains(token, 'th') THEN 'I' ELSE 'O' END AS l, 1.0::DOUBLE / (1 + length(token) % 4) AS prob FROM w0), "
    "w2 AS (SELECT *, lead(start) OVER (PARTITION BY doc ORDER BY pos) AS nxt, CASE WHEN l = 'I' AND lag(l) OVER (PARTITION BY doc ORDER BY pos) IN ('B', 'I') THEN 0 ELSE 1 END AS brk FROM (SELECT * FROM w1 WHERE length(token) > 0)), "
    "w3 AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY pos) AS run FROM w2), "
    "runs AS (SELECT doc, run, arg_min(l, pos) = 'B' AS opens, min(start)::BIGINT AS first_start, last(nxt ORDER BY pos)::BIGINT AS end_at, avg(prob) AS avg_p FROM w3 GROUP BY 1, 2)",
)
oracle("passage_entity_edges", "SELECT passage_id, entity, cnt, round(weight, 6) AS weight FROM ee")
oracle("adjacent_edges", r"SELECT * FROM (SELECT id AS src, lead(id) OVER (ORDER BY doc_id, id) AS dst, 1.0::DOUBLE AS weight FROM (SELECT doc_id, 'passage-' || sha256('passage-' || doc_id::VARCHAR || ':' || coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) AS id FROM documents)) WHERE dst IS NOT NULL")
oracle("graph_node_types", "SELECT split_part(id, '-', 1) AS kind, count(*) AS n_nodes, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM nd GROUP BY 1")
oracle("graph_degree_stats", "SELECT coalesce(d, 0) AS degree, count(*) AS n_nodes FROM nd LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM eg UNION ALL SELECT dst FROM eg) GROUP BY 1) USING (id) GROUP BY 1")
_stat = "SELECT count(*) AS n_values, round(sum(v) / count(*), 6) AS avg_value, min(v) AS min_value, max(v) AS max_value, list_sort(list(v))[count(*) // 2 + 1] AS median_value FROM"
oracle("edge_weight_stats", f"{_stat} (SELECT round(weight, 6) AS v FROM eg)")
oracle("score_stats", f"{_stat} (SELECT round(value, 6) AS v FROM events WHERE value IS NOT NULL)")
oracle("hyperedges_build", "SELECT * FROM he")
_type = "CASE " + " ".join(f"WHEN regexp_matches(e, '{'|'.join(w)}') THEN '{k}'" for k, w in TYPE_KEYWORDS.items()) + " ELSE 'UNKNOWN' END"
_boost = "greatest(1.0::DOUBLE, " + ", ".join("CASE WHEN " + " AND ".join(f"list_contains(ts, '{x}')" for x in sorted(p)) + f" THEN {b}::DOUBLE ELSE 1.0 END" for p, b in PATTERN_BOOSTS) + ")"
oracle("hyperedge_types_inferred", f"SELECT he_id, array_to_string(ts, ',') AS types, {_boost} AS boost, round(least(score * {_boost}, 1.5::DOUBLE), 6) AS score FROM (SELECT he_id, score, list_sort(list_distinct(list_transform(string_split(entities, '|'), lambda e: {_type}))) AS ts FROM he)")
oracle("hyperedge_boost_literal", "SELECT he_id, 1.0::DOUBLE AS boost, round(least(score, 1.5::DOUBLE), 6) AS score FROM he")
oracle("hypergraph_incidence", "SELECT he_id, entity_id, entity FROM inc")
oracle("hypergraph_stats", "SELECT (SELECT count(*) FROM he) AS n_hyperedges, count(DISTINCT entity_id) AS n_entities, round(count(*) / (SELECT count(*) FROM he), 6) AS avg_entities, round(count(*) / count(DISTINCT entity_id), 6) AS avg_hyperedges, (SELECT round(avg(score), 6) FROM he) AS avg_score FROM inc")
oracle("passage_hyperedges", "SELECT passage_id, he_id FROM ph")
oracle("hyperedge_retrieve", "SELECT q, he_id, score, rank FROM hf")
oracle("hyperedge_seed_expansion", "SELECT q, count(*) AS n_hyperedges, CAST(count(*) AS INT) AS last_rank, round(min(score), 6) AS least_score FROM (SELECT q, he_id, score FROM hf UNION ALL SELECT q, he_id, 0.5 FROM (SELECT DISTINCT q, he_id FROM ss JOIN inc USING (entity)) ANTI JOIN hf USING (q, he_id)) GROUP BY 1")
oracle("entity_boost_rerank", "SELECT q, passage_id, matches, boosted AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY boosted DESC, rank) AS INT) AS rank FROM (SELECT q, passage_id, rank, CAST(coalesce(m, 0) AS INT) AS matches, round(score * (1 + (1.2::DOUBLE - 1) * least(coalesce(m, 0), 3) / 3), 6) AS boosted FROM rk LEFT JOIN (SELECT q, passage_id, count(*) AS m FROM rk JOIN p USING (passage_id) JOIN (SELECT DISTINCT q, unnest(string_split(entities, '|')) AS e FROM hf) USING (q) WHERE contains(lower(text), e) GROUP BY 1, 2) USING (q, passage_id))")
oracle("hyperedge_context", f"SELECT q, '{HEADER.strip()}' || chr(10) || string_agg(rank || '. ' || CASE WHEN length(sentence) > 200 THEN left(sentence, 200) || '...' ELSE sentence END || chr(10), '' ORDER BY rank) AS context FROM hf WHERE rank <= 5 GROUP BY 1")
oracle(
    "activation_one_hop",
    "SELECT q, entity, round(coalesce(n.score, o.score) + 1e-9::DOUBLE, 6) AS score, CAST(CASE WHEN n.q IS NULL THEN 1 ELSE 2 END AS INT) AS tier, round(coalesce(o.score, 0) + coalesce(n.total, 0) + 1e-9::DOUBLE, 6) AS weight FROM one o FULL JOIN nw n USING (q, entity)",
    "one AS (SELECT q, entity, score FROM ss WHERE pos = 1), "
    "cl AS (SELECT q, sentence, sim, seed_score FROM (SELECT q, sentence, sim, one.score AS seed_score, row_number() OVER (PARTITION BY q ORDER BY sim DESC, sentence) AS r FROM one JOIN se USING (entity) JOIN sm USING (q, sentence) WHERE one.score >= 0.3) WHERE r <= 5), "
    "nw AS (SELECT q, entity, sum(seed_score * sim) AS total, min(seed_score * sim) AS score FROM cl JOIN se USING (sentence) WHERE seed_score * sim >= 0.3 GROUP BY 1, 2)",
)
oracle("activation_all_seeds", "SELECT q, entity, round(score + 1e-9::DOUBLE, 6) AS score, tier, round(weight + 1e-9::DOUBLE, 6) AS weight FROM aw")
oracle("passage_scores", "SELECT q, passage_id, score FROM sc", every=20)


def _walk(reset: str, edges: str, steps: int = 45) -> str:
    """Chebyshev iteration for PageRank; 45 steps leave 2 * 0.557^45 of the error."""
    parts = [f"rw AS MATERIALIZED (SELECT q, id, sum(w) / sum(sum(w)) OVER (PARTITION BY q) AS w FROM ({reset}) WHERE w > 0 GROUP BY q, id)"]
    parts += [f"bw AS MATERIALIZED (SELECT src, dst, sum(weight) / sum(sum(weight)) OVER (PARTITION BY src) AS pw FROM (SELECT src, dst, weight FROM ({edges}) UNION ALL SELECT dst, src, weight FROM ({edges})) GROUP BY src, dst)", "v0 AS MATERIALIZED (SELECT q, id, 0.15::DOUBLE * w AS s FROM rw)"]
    w = 1.0
    for k in range(steps):
        w = 1 / (1 - 0.85**2 / 2) if k == 0 else 1 / (1 - w * 0.85**2 / 4)
        old = f" UNION ALL SELECT q, id, {1 - w!r}::DOUBLE * s FROM v{k - 1}" if k else ""
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT q, id, sum(s) AS s FROM (SELECT q, dst AS id, {0.85 * w!r}::DOUBLE * sum(s * pw) AS s FROM v{k} JOIN bw ON src = id GROUP BY 1, 2 UNION ALL SELECT q, id, {0.15 * w!r}::DOUBLE * w FROM rw{old}) GROUP BY 1, 2)")
    return ", ".join(parts)


_scores = "SELECT q, id AS passage_id, round(s / sum(s) OVER (PARTITION BY q), 6) AS score FROM v45"
_ranked = f"SELECT * FROM (SELECT q, passage_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS INT) AS rank FROM ({_scores}) WHERE starts_with(passage_id, 'passage-')) WHERE rank <= 10"
_reset = "SELECT q, 'entity-' || sha256('entity-' || entity) AS id, weight AS w FROM aw UNION ALL SELECT q, passage_id, score FROM sc"
_graph = "SELECT src, dst, weight FROM eg"
oracle("ppr_passages", _ranked, _walk(_reset, _graph), every=20)
oracle("ppr_unified", _ranked, _walk(f"{_reset} UNION ALL SELECT q, 'hyperedge-' || he_id, score * 1.2::DOUBLE FROM hf", f"{_graph} UNION ALL SELECT passage_id, 'hyperedge-' || he_id, score FROM ph JOIN he USING (he_id) UNION ALL SELECT 'entity-' || sha256('entity-' || entity), 'hyperedge-' || he_id, 0.8::DOUBLE * score FROM inc JOIN he USING (he_id)"), every=20)
# Ranking before the boost: by PageRank, for a question without seeds by its vectors from a pool of six.
_order = (
    f"pg AS MATERIALIZED (SELECT q, passage_id, score FROM (SELECT q, id AS passage_id, round(s / sum(s) OVER (PARTITION BY q), 6) AS score FROM v45) WHERE starts_with(passage_id, 'passage-') AND q IN (SELECT q FROM ss)), "
    "rr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS rank FROM (SELECT * FROM pg UNION ALL SELECT q, passage_id, score FROM ds WHERE q NOT IN (SELECT q FROM ss) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) <= 6))"
)
_out = "CAST(rank AS INT) AS rank, {text} AS passage, score, q IN (SELECT q FROM ss) AS has_entities, {ctx} AS has_hyperedge_context"
oracle("graph_retrieval", f"SELECT q, {_out.format(text='text', ctx='false')} FROM rr JOIN p USING (passage_id) WHERE rank <= 3", f"{_walk(_reset, _graph)}, {_order}", every=20)
_boosted = (
    "em AS (SELECT q, passage_id, count(*) AS m FROM rr JOIN p USING (passage_id) JOIN (SELECT DISTINCT q, unnest(string_split(entities, '|')) AS e FROM hf) USING (q) WHERE contains(lower(text), e) GROUP BY 1, 2), "
    "bs AS (SELECT q, passage_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS rank FROM (SELECT q, passage_id, rank, round(score * (1 + (1.2::DOUBLE - 1) * least(coalesce(m, 0), 3) / 3), 6) AS score FROM rr LEFT JOIN em USING (q, passage_id))), "
    f"cx AS (SELECT q, '{HEADER.strip()}' || chr(10) || string_agg(rank || '. ' || CASE WHEN length(sentence) > 200 THEN left(sentence, 200) || '...' ELSE sentence END || chr(10), '' ORDER BY rank) AS context FROM hf WHERE rank <= 5 GROUP BY 1)"
)
_first = "CASE WHEN rank = 1 AND context IS NOT NULL THEN context || chr(10) || text ELSE text END"
oracle("hybrid_retrieval", f"SELECT q, {_out.format(text=_first, ctx='context IS NOT NULL')} FROM bs JOIN p USING (passage_id) LEFT JOIN cx USING (q) WHERE rank <= 3", f"{_walk(_reset, _graph)}, {_order}, {_boosted}", every=20)
oracle("dense_retrieval", f"SELECT q, {_out.format(text='text', ctx='false').replace('q IN (SELECT q FROM ss)', 'false')} FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS rank FROM ds) JOIN p USING (passage_id) WHERE rank <= 3")
oracle(
    "connected_components",
    "SELECT n_nodes, count(*) AS n_components, min(component) AS first FROM (SELECT component, count(*) AS n_nodes FROM lb GROUP BY 1) GROUP BY 1",
    "re AS MATERIALIZED (SELECT passage_id AS a, 'hyperedge-' || he_id AS b FROM ph), "
    "be AS MATERIALIZED (SELECT a, b FROM re UNION ALL SELECT b, a FROM re), "
    "rl AS (SELECT id, id AS component FROM (SELECT passage_id AS id FROM p UNION ALL SELECT 'hyperedge-' || he_id FROM he) UNION SELECT be.b, rl.component FROM rl JOIN be ON be.a = rl.id WHERE rl.component < be.b), "
    "lb AS MATERIALIZED (SELECT id, min(component) AS component FROM rl GROUP BY 1)",
)
_ck = " || ".join(f"regexp_extract_all(lower(text), '{p}')" for p in T.CLINICAL_PATTERNS)
_has = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words)
oracle("clinical_rerank", f"SELECT q, passage_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, passage_id) AS INT) AS rank FROM (SELECT q, passage_id, round(score * (1 + least(len(list_filter(ks, lambda k: contains(t, k))) * 0.12::DOUBLE, 0.6::DOUBLE) + least(({_has(T.CLINICAL_TERMS)}) * 0.05::DOUBLE, 0.35::DOUBLE) - CASE WHEN regexp_matches(t, '19[67][0-9]') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN ({_has(T.RESEARCH_TERMS)}) >= 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN ({_has(T.CASE_PHRASES)}) > 0 THEN 0.15::DOUBLE ELSE 0 END), 6) AS score FROM rk JOIN (SELECT q, list_distinct({_ck}) AS ks FROM q) USING (q) JOIN (SELECT passage_id, lower(text) AS t FROM p) USING (passage_id))")
_ex = ", ".join(rf"CASE WHEN regexp_matches(lower(text), '{_EDGE}{t}{_END}') THEN '{x}' END" for t, x in T.EXPANSIONS.items())
oracle("query_expansion", f"SELECT doc_id, concat_ws(' ', text, {_ex}) AS expanded FROM nt")
oracle("answer_parse_mcq", "SELECT conv_id, turn, {choice} AS pred FROM a0")
oracle("answer_parse_yesno", "SELECT conv_id, turn, {yn} AS yesno, {ynm} AS yesnomaybe FROM a0")
_np = r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')"
_art = lambda x: rf"regexp_replace({x}, '({_EDGE})(?:a|an|the)({_END})', '\1 \2', 'g')"
# Twice, since neighbouring articles share the character between them.
oracle("normalize_answer", rf"SELECT doc_id, trim(regexp_replace({_art(_art(_np))}, '\s+', ' ', 'g')) AS normalized FROM documents")
oracle("contain_accuracy", "SELECT idx, valid * same AS correct, 1 - valid AS invalid, contain_correct, no_entity FROM jd")
oracle("summary_by_dataset", "SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, count(*) AS total, CAST(sum(valid * same) AS BIGINT) AS correct, CAST(sum(1 - valid) AS BIGINT) AS invalid, CAST(sum(contain_correct) AS BIGINT) AS contain_correct, CAST(sum(no_entity) AS BIGINT) AS no_entity, round(100.0::DOUBLE * sum(valid * same) / count(*), 6) AS accuracy, round(100.0::DOUBLE * sum(contain_correct) / count(*), 6) AS contain_accuracy, round(100.0::DOUBLE * sum(valid) / count(*), 6) AS valid_rate FROM jd GROUP BY ROLLUP (dataset)")
oracle("invalid_samples", r"SELECT idx, dataset, left(pred, 120) AS pred_answer, left(regexp_replace(question, '^\s+|\s+$', '', 'g'), 200) AS question FROM jd WHERE valid = 0 ORDER BY idx LIMIT 20")
oracle("answer_distribution", "SELECT pred AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pr GROUP BY 1")
oracle("question_answering", "SELECT dataset, CASE WHEN dataset = 'medqa' THEN 'A' ELSE 'Yes' END AS pred_answer, count(*) AS n FROM rs GROUP BY 1, 2")
oracle("running_accuracy", "SELECT idx, dataset, round(avg(valid * same) OVER (PARTITION BY dataset ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS running FROM jd")
oracle("gold_found", "SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE coalesce(d.text, '') <> '' AND (contains(d.text, left(b.text, 100)) OR contains(b.text, left(d.text, 100)))) AS found FROM benchmark b")
oracle("dataset_counts", "SELECT source, count(*) AS n_docs, CAST(sum(CASE WHEN coalesce(trim(text), '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS with_text, round(avg(length(text)), 6) AS avg_chars FROM documents GROUP BY 1")
oracle("label_accuracy", "SELECT source, count(*) AS total, CAST(sum(quality) AS BIGINT) AS good, round(100.0::DOUBLE * sum(quality) / count(*), 6) AS pct FROM labels JOIN documents USING (doc_id) GROUP BY 1")
oracle("json_props", "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
oracle("incremental_new_docs", "SELECT doc_id, md5(text) AS doc_hash FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source <= 'src1' AND text IS NOT NULL)")
_ne = "max(len(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))))"
oracle("ner_merge_upsert", "SELECT key, n_entities, 'new' AS origin FROM nn UNION ALL SELECT key, n_entities, 'old' FROM oo WHERE key NOT IN (SELECT key FROM nn)", f"nn AS (SELECT md5(text) AS key, {_ne} AS n_entities FROM documents WHERE text IS NOT NULL AND source > 'src1' GROUP BY 1), oo AS (SELECT md5(text) AS key, {_ne} AS n_entities FROM documents WHERE text IS NOT NULL AND source <= 'src1' GROUP BY 1)")
oracle("cache_hit_rate", "SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(count(*) - sum(hit) AS BIGINT) AS misses, round(sum(hit) / count(*), 6) AS hit_rate FROM (SELECT CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL AS INT) AS hit FROM events)")
