"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from lodeseam.plans.fixtures import CASE_SOURCES, MARKERS, RUNS, VOCABULARY

_NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
_TOK = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_QTOK = r"regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_+\-\.]*')"
_STRIP = r"regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

NORM, QTOK = _NORM.format, _QTOK.format


def TOK(x: str) -> str:
    return _TOK.format(x)


def STRIP(x: str) -> str:
    return _STRIP.format(x)


def est(x: str) -> str:
    return rf"greatest(1, floor(len(regexp_extract_all({x}, '[^\s\v]+')) * 1.33))"


def dedup(x: str) -> str:
    """A list's distinct values in order of first occurrence."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


DOCS = """dd AS (SELECT doc_id, source AS source_id, 'Source ' || source AS source_name, source || ' ' || doc_id AS title, [lang, source] AS categories,
  ['official', 'trusted', 'user', 'unknown'][substr(source, 4)::INT % 4 + 1] AS authority, text, lang FROM documents)"""
CHUNKS = (
    DOCS
    + rf""", cw AS (SELECT *, regexp_extract_all(text, '[^\s\v]+') AS w FROM dd),
cp AS (SELECT *, CASE WHEN {est("text")} <= 400 THEN [{STRIP("text")}] ELSE list_transform(range(0, len(w), 300), lambda k: array_to_string(w[k + 1 : k + 300], ' ')) END AS p FROM cw),
ch AS (SELECT doc_id * 1000 + i - 1 AS chunk_id, doc_id, source_id, source_name, title, categories, authority, lang, i - 1 AS ordinal, p[i] AS text
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cp) WHERE p[i] <> '')"""
)
TOKENS = CHUNKS + f", tk AS (SELECT chunk_id, source_id, doc_id, {TOK('title')} AS t1, {TOK('lang')} AS t2, {TOK('text')} AS t3 FROM ch)"


def bm25(queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark", allowed: str = "true") -> str:
    return (
        TOKENS
        + rf""", st AS (SELECT count(*) AS total, sum(len(t1) + len(t2) + len(t3))::DOUBLE / count(*) AS avgdl FROM tk),
qs AS ({queries}),
qt AS (SELECT query_id, unnest({dedup(QTOK("query"))}) AS qtok FROM qs),
ph AS (SELECT query_id, {TOK("qtok")} AS phrase FROM qt WHERE len({TOK("qtok")}) > 0),
pd AS (SELECT DISTINCT phrase, phrase[1] AS term, len(phrase) AS m FROM ph),
oc AS (SELECT chunk_id, f, i, t[i] AS term, t FROM (SELECT chunk_id, f, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT chunk_id, 1 AS f, t1 AS t FROM tk UNION ALL SELECT chunk_id, 2, t2 FROM tk UNION ALL SELECT chunk_id, 3, t3 FROM tk))),
fr AS (SELECT chunk_id, phrase, count(*) AS f FROM oc JOIN pd USING (term) WHERE m = 1 OR t[i : i + m - 1] = phrase GROUP BY ALL),
nf AS (SELECT phrase, count(*) AS n FROM fr GROUP BY phrase),
idf AS (SELECT phrase, avgdl, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END AS idf FROM nf, st),
bm AS (SELECT query_id, fr.chunk_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(t1) + len(t2) + len(t3)) / avgdl))) AS bm25
  FROM fr JOIN idf USING (phrase) JOIN ph USING (phrase) JOIN tk ON fr.chunk_id = tk.chunk_id WHERE {allowed} GROUP BY ALL),
sc AS (SELECT *, greatest(-bm25, 0) / (1 + greatest(-bm25, 0)) AS score FROM bm),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)"""
    )


_TOLD = "SELECT query_id, chunk_id, round(bm25, 6) AS bm25, round(score, 6) AS score, rank::BIGINT AS rank FROM rk WHERE {}"
PHRASE_QUERIES = """SELECT query_id, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '-' || w[i + 1]), ' ') AS query
 FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) > 1"""

COSINE = """v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
cs AS (SELECT q.chunk_id AS query_id, v.chunk_id, list_dot_product(v.v, q.v) AS c FROM v, v q WHERE q.chunk_id % 20 = 0 AND {}),
cr AS (SELECT *, greatest(c, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM cs)"""

POOL = (
    bm25()
    + f""", pq AS (SELECT item_id AS query_id, text || ' src3 de en' AS query, ['case_similarity', 'technique', 'keyword'][item_id % 3 + 1] AS mode, CASE WHEN item_id % 2 = 0 THEN 'en' END AS platform FROM benchmark),
po AS (SELECT rk.query_id, rk.chunk_id, score, rank AS merge_pos, query, mode, platform, ch.doc_id, CASE WHEN ch.doc_id % 10 = 0 THEN title || ' Clown' ELSE title END || ' ' || lang AS hay, list_transform(categories, lambda c: lower(c)) AS cats, authority, ch.text
  FROM rk JOIN pq USING (query_id) JOIN ch ON rk.chunk_id = ch.chunk_id WHERE rank <= 30),
ov AS (SELECT *, len(list_filter(list_distinct({QTOK("query")}), lambda t: contains(lower(hay), t)))::DOUBLE / len(list_distinct({QTOK("query")})) AS overlap,
  CASE WHEN (mode = 'case_similarity' AND list_has_any(cats, {_LIST(MARKERS)})) OR (mode = 'technique' AND ({" OR ".join(f"contains(lower(hay), '{t}')" for t in VOCABULARY["technique"])})) THEN 0.3 ELSE 0.0 END AS intent FROM po),
sd AS (SELECT *, 0.25 * overlap + (CASE WHEN platform IS NOT NULL AND list_contains(cats, platform) THEN 0.15 ELSE 0.0 END + CASE WHEN list_has_any(cats, ['src1', 'fr']) THEN 0.15 ELSE 0.0 END) + intent AS bonus FROM ov),
fi AS (SELECT *, score * CASE authority WHEN 'official' THEN 1.0 WHEN 'trusted' THEN 0.9 WHEN 'user' THEN 0.75 ELSE 0.6 END * (1.0 + bonus) AS final FROM sd)"""
)


def greedy(source: str, limit: int) -> str:
    """source: query_id, chunk_id, doc_id, final, merge_pos, text."""
    return f""", gs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, merge_pos, chunk_id) AS pos FROM {source}),
gt AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT chunk_id, text FROM gs)),
gg AS (SELECT chunk_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM gt WHERE len(w) > 0),
gu AS (SELECT chunk_id, len(g) AS n, unnest(g) AS s FROM gg),
gp AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b FROM gs a JOIN gs b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id),
gj AS (SELECT a, b FROM gp JOIN gu x ON x.chunk_id = a JOIN gu y ON y.chunk_id = b AND y.s = x.s GROUP BY a, b HAVING count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.9),
gn AS (SELECT gs.query_id, pos, gs.chunk_id, doc_id, final, coalesce((SELECT list(b) FROM gj WHERE a = gs.chunk_id), []) AS near FROM gs),
gr AS (SELECT query_id, 0::BIGINT AS pos, []::BIGINT[] AS sel, []::BIGINT[] AS docs FROM (SELECT DISTINCT query_id FROM gn)
  UNION ALL SELECT query_id, p2, CASE WHEN ok THEN list_append(sel, c) ELSE sel END, CASE WHEN ok THEN list_append(docs, d) ELSE docs END
  FROM (SELECT gr.query_id, gr.sel, gr.docs, gn.chunk_id AS c, gn.doc_id AS d, gn.pos AS p2, len(gr.sel) < {limit} AND len(list_filter(gr.docs, lambda x: x = gn.doc_id)) < 2 AND NOT list_has_any(gr.sel, gn.near) AS ok
    FROM gr JOIN gn ON gn.query_id = gr.query_id AND gn.pos = gr.pos + 1)),
ge AS (SELECT query_id, arg_max(sel, pos) AS sel FROM gr GROUP BY query_id),
gx AS (SELECT query_id, unnest(sel) AS chunk_id, unnest(range(1, len(sel) + 1)) AS rank FROM ge)"""


def snippet_of(text: str, query: str) -> str:
    first = f"coalesce(list_min(list_filter(list_transform({QTOK(query)}, lambda k: instr(lower({text}), k)), lambda p: p > 0)) - 1, 0)"
    start = f"greatest({first} - 133, 0)"
    end = f"least({start} + 400, length({text}))"
    return f"CASE WHEN {start} > 0 THEN '…' ELSE '' END || " + STRIP(f"substr({text}, ({start} + 1)::BIGINT, ({end} - {start})::BIGINT)") + f" || CASE WHEN {end} < length({text}) THEN '…' ELSE '' END"


MARKDOWN = r"""mp AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS h, regexp_extract_all(html, '<p>([^<]*)', 1) AS p FROM pages),
md AS (SELECT page_id, array_to_string(list_concat(['# ' || h], list_transform(p, lambda x, j: CASE WHEN (j - 1) % 4 = 0 THEN '## Part ' || (j - 1) || chr(10) || x WHEN (j - 1) % 4 = 2 THEN '### Detail ' || (j - 1) || ' ##' || chr(10) || chr(10) || x
  WHEN (j - 1) % 5 = 3 THEN '```sh' || chr(10) || x || chr(10) || chr(10) || '# no heading' || chr(10) || '```' ELSE x END)), chr(10) || chr(10)) AS text FROM mp),
ml AS (SELECT page_id, i AS pos, l[i] AS line, len(l) AS n FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(text, chr(10)) AS l FROM md)) WHERE NOT (i = len(l) AND l[i] = '')),
mf AS (SELECT *, line LIKE '```%' AS fence, sum((line LIKE '```%')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS nf FROM ml),
mt AS (SELECT *, CASE WHEN fence AND nf % 2 = 1 THEN 'open' WHEN fence THEN 'close' WHEN nf % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS type FROM mf),
mh AS (SELECT *, CASE WHEN type = 'heading' THEN length(regexp_extract(line, '^#+')) END AS level, regexp_extract(line, '^#{1,6}\s+(.*?)\s*#*\s*$', 1) AS title, lag(type) OVER w AS before, coalesce(lead(type) OVER w, 'end') AS after FROM mt WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
mc AS (SELECT *, sum((type IN ('open', 'heading') OR coalesce(before IN ('blank', 'close'), true))::INT) OVER w AS cid,
  last_value(CASE WHEN level = 1 THEN {'p': pos, 't': title} END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN {'p': pos, 't': title} END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level = 3 THEN {'p': pos, 't': title} END IGNORE NULLS) OVER w AS h3
  FROM mh WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
mv AS (SELECT *, list_filter([h1.t, CASE WHEN h2.p > coalesce(h1.p, 0) THEN h2.t END, CASE WHEN h3.p > greatest(coalesce(h1.p, 0), coalesce(h2.p, 0)) THEN h3.t END], lambda x: x IS NOT NULL) AS path FROM mc WHERE type <> 'blank'),
mg AS (SELECT page_id, cid, string_agg(line, chr(10) ORDER BY pos) AS text, arg_max(path, pos) AS path, arg_max(after, pos) AS after, arg_max(type, pos) AS last, arg_min(type, pos) AS first FROM mv GROUP BY page_id, cid),"""


def markdown(budget: int) -> str:
    run = int(budget / 1.33)
    return (
        MARKDOWN
        + rf"""
mw AS (SELECT *, regexp_extract_all(text, '[^\s\v]+') AS w FROM mg),
mx AS (SELECT *, CASE WHEN last <> 'close' AND after IN ('blank', 'end') AND {est("text")} > {budget} THEN list_transform(range(0, len(w), {run}), lambda k: array_to_string(w[k + 1 : k + {run}], ' ')) ELSE [{STRIP("text")}] END AS parts FROM mw),
my AS (SELECT page_id, cid, array_to_string(path, ' > ') AS path, CASE WHEN first = 'open' THEN 'code' ELSE 'text' END AS kind, i, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM mx) WHERE parts[i] <> ''),
mz AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cid, i) - 1 AS ordinal FROM my)"""
    )


def _found(kind: str, text: str) -> str:
    return f"list_filter({_LIST(sorted(VOCABULARY[kind]))}, lambda v: contains(lower({text}), v))"


GRAPH = (
    CHUNKS
    + f""", gd AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'Linux' END AS os, source_id IN ({", ".join(f"'{s}'" for s in CASE_SOURCES)}) OR list_has_any(categories, {_LIST(MARKERS)}) AS is_case FROM dd),
gb AS (SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY ordinal), 1, 500000) AS body, any_value(title) || chr(10) || string_agg(lang, chr(10)) AS head FROM ch GROUP BY doc_id),
g1 AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest({_found(k, c)}) AS term, {n} AS tier FROM gb" for k in VOCABULARY for c, n in (("head", 2), ("body", 0)))} UNION ALL SELECT doc_id, 'tool', 'leau', 1 FROM dd WHERE doc_id % 6 = 0),
gm AS (SELECT doc_id, kind, term, max(tier) AS tier FROM g1 GROUP BY ALL),
g2 AS (SELECT title AS subject, 'writeup' AS subject_type, 'documented_by' AS predicate, source_name AS object, 'source' AS object_type, doc_id, 1.0 AS confidence, false AS inferred FROM gd WHERE is_case
 UNION ALL SELECT title, 'writeup', 'runs_on', os, 'os', doc_id, 1.0, false FROM gd WHERE is_case AND os IS NOT NULL
 UNION ALL SELECT term, kind, CASE kind WHEN 'technique' THEN 'demonstrated_in' WHEN 'tool' THEN 'used_in' ELSE 'present_in' END, title, 'writeup', doc_id, [0.6, 0.75, 0.9][tier + 1], true FROM gm JOIN gd USING (doc_id) WHERE is_case
 UNION ALL SELECT term, 'technique', 'documented_by', source_name, 'source', doc_id, CASE WHEN tier = 2 THEN 0.9 ELSE 0.6 END, true FROM gm JOIN gd USING (doc_id) WHERE kind = 'technique'
 UNION ALL SELECT a.term, 'technique', CASE WHEN b.kind = 'tool' THEN 'uses' ELSE 'targets' END, b.term, b.kind, doc_id, 0.5, true FROM gm a JOIN gm b USING (doc_id) WHERE a.kind = 'technique' AND b.kind <> 'technique'),
ed AS (SELECT subject, subject_type, predicate, object, object_type, doc_id, max(confidence)::DOUBLE AS confidence, bool_and(inferred) AS inferred FROM g2 GROUP BY ALL),
g3 AS (SELECT term AS name, kind AS entity_type, '' AS description, NULL::BIGINT AS doc_id FROM gm UNION ALL SELECT source_name, 'source', 'source:' || source_id, NULL FROM gd
 UNION ALL SELECT title, 'writeup', '', doc_id FROM gd WHERE is_case UNION ALL SELECT os, 'os', '', NULL FROM gd WHERE is_case AND os IS NOT NULL),
en AS (SELECT name, entity_type, min(description) AS description, min(doc_id) AS doc_id FROM g3 GROUP BY ALL)"""
)

HALVES = """hd AS (SELECT source AS source_id, doc_id::VARCHAR AS external_id, doc_id, text FROM documents),
hs AS (SELECT *, sha256(text) AS stored FROM hd WHERE doc_id % 2 = 0),
hp AS (SELECT source_id, external_id, CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END AS text FROM hd WHERE doc_id % 5 <> 4),
hm AS (SELECT hp.source_id, hp.external_id, hp.text, hs.doc_id, sha256(hp.text) AS content_hash, CASE WHEN hs.doc_id IS NULL THEN 'new' WHEN sha256(hp.text) = stored THEN 'unchanged' ELSE 'changed' END AS status FROM hp LEFT JOIN hs ON hp.source_id = hs.source_id AND hp.external_id = hs.external_id)"""

#: The state after the even documents and then the parsed ones were ingested as one source: new ids follow the largest, by name.
INGESTED = (
    HALVES
    + """, i0 AS (SELECT doc_id AS own, external_id, source_id || ' ' || external_id AS title, source_id, text, row_number() OVER (ORDER BY external_id) AS doc_id FROM hs),
i1 AS (SELECT hp.external_id, hp.source_id || ' ' || hp.external_id AS title, hp.source_id, hp.text, i0.doc_id FROM hp LEFT JOIN i0 USING (external_id)),
iz AS (SELECT doc_id, external_id, title, source_id, text FROM i1 WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, external_id, title, source_id, text FROM i0 WHERE external_id NOT IN (SELECT external_id FROM i1)
 UNION ALL SELECT (SELECT max(doc_id) FROM i0) + row_number() OVER (ORDER BY external_id), external_id, title, source_id, text FROM i1 WHERE doc_id IS NULL)"""
)
INGESTED_CHUNKS = (
    INGESTED
    + ", "
    + markdown(400)[markdown(400).index("ml AS") :].replace("FROM md)", "FROM (SELECT doc_id AS page_id, text FROM iz))", 1)
    + f""", id AS (SELECT mz.*, title, iz.source_id, sha256({NORM("mz.text")}) AS content_hash FROM mz JOIN iz ON page_id = doc_id),
ic AS (SELECT page_id * 1000000 + ordinal AS chunk_id, page_id AS doc_id, ordinal::BIGINT AS ordinal, source_id || ' > ' || title || CASE WHEN path = '' THEN '' ELSE ' > ' || path END AS path, title, CASE WHEN path = '' THEN title ELSE string_split(path, ' > ')[-1] END AS head, kind, text, content_hash
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, content_hash ORDER BY ordinal) AS k FROM id) WHERE k = 1)"""
)

GOLD = f"""gi AS (SELECT item_id AS query_id, ' ' || {NORM("text")} || ' ' AS p FROM benchmark), go AS (SELECT doc_id, ' ' || {NORM("text")} || ' ' AS n FROM documents),
gl AS (SELECT query_id, list(DISTINCT doc_id) AS relevant FROM go JOIN gi ON contains(n, p) GROUP BY query_id)"""
RANKING = ", ht AS (SELECT rk.*, ch.doc_id FROM rk JOIN ch ON rk.chunk_id = ch.chunk_id WHERE rank <= 15), dk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS rank FROM ht GROUP BY query_id, doc_id)"

_RUNS = "ru(doc, page, idx, text, font, size) AS (VALUES " + ", ".join("('{}', {}, {}, '{}', '{}', {}::DOUBLE)".format(d, p, i, t.replace("\n", "' || chr(10) || '"), f, s) for d, p, i, t, f, s in RUNS) + ")"
_VECTORS = "vt AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'now' END AS model, len(embedding)::BIGINT AS dim, vec_id % 5 = 0 AS stale FROM embeddings)"
SLUG = "translate(regexp_replace(url, '^https?://|[?].*$', '', 'g'), '/', '-')"


def oracle_sql() -> dict[str, str]:
    w = lambda *ctes: "WITH RECURSIVE " + ", ".join(ctes) + " "
    near = f"""n0 AS (SELECT {NORM("text")} AS t, min(doc_id) AS id FROM documents GROUP BY 1),
n1 AS (SELECT id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM n0), n2 AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM n1 WHERE len(w) > 0),
n3 AS (SELECT id, len(g) AS n, unnest(g) AS s FROM n2), n4 AS (SELECT s, count(*) AS df FROM n3 GROUP BY s),
n5 AS (SELECT id, n, s, row_number() OVER (PARTITION BY id ORDER BY df, s) AS k FROM n3 JOIN n4 USING (s)),
n6 AS (SELECT id, n, s FROM n5 WHERE k <= n - ceil(n * 0.85) + 1), n7 AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM n6 a JOIN n6 b ON a.s = b.s AND a.id < b.id),
n8 AS (SELECT a, b, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) AS overlap FROM n7 JOIN n3 x ON x.id = a JOIN n3 y ON y.id = b AND x.s = y.s GROUP BY a, b)"""
    pack = f"""p0 AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {STRIP("x")}), lambda x: x <> '') AS p FROM conversations),
p1 AS (SELECT conv_id, turn, i, p[i] AS t, {est("p[i]")} AS e FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p0)),
p2 AS (SELECT conv_id, turn, i, t, e AS n, 1 AS c FROM p1 WHERE i = 1 UNION ALL
  SELECT p1.conv_id, p1.turn, p1.i, p1.t, CASE WHEN p2.n + p1.e > 60 THEN p1.e ELSE p2.n + p1.e END, CASE WHEN p2.n + p1.e > 60 THEN c + 1 ELSE c END FROM p2 JOIN p1 ON p1.conv_id = p2.conv_id AND p1.turn = p2.turn AND p1.i = p2.i + 1),
p3 AS (SELECT conv_id, turn, c, string_agg(t, chr(10) ORDER BY i) AS text FROM p2 GROUP BY conv_id, turn, c)"""
    title = """'^(HTB|PG|OSCP|VulnHub|TryHackMe|HackTheBox)\\s*[:\\-]\\s*'"""
    return {
        "token_estimate": f"SELECT doc_id, {est('text')}::BIGINT AS tokens FROM documents",
        "normalized_hash": f"SELECT doc_id, sha256({NORM('text')}) AS h, sha256(text) AS content FROM documents",
        "exact_dup_groups": f"SELECT sha256({NORM('text')}) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "shingle_counts": "SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
        "near_dup_pairs": w(near) + "SELECT a, b, round(overlap, 6) AS overlap FROM n8 WHERE overlap >= 0.85",
        "front_matter": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE '--- ' || text END AS body FROM benchmark",
        "title_split": f"SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE nullif(trim(regexp_replace(x, {title}, '', 'i')), '') END AS name, ['htb', 'pg', 'htb', 'unknown'][page_id % 4 + 1] AS kind FROM (SELECT page_id, ['HTB: ', 'pg - ', 'HackTheBox:', 'other: '][page_id % 4 + 1] || url AS x FROM pages)",
        "humanize": f"SELECT page_id, array_to_string(list_transform(l, lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(l[i - 1], '\\p{{L}}') THEN upper(c) ELSE c END), '') AS title, 'https://book.example/' || {SLUG} AS url FROM (SELECT page_id, url, string_split(lower(trim(translate({SLUG}, '-_', '  '))), '') AS l FROM pages)",
        "json_lists": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ',' || source ELSE '' END AS items FROM documents",
        "query_tokens": f"SELECT item_id AS query_id, array_to_string({dedup(QTOK('text'))}, ' ') AS tokens FROM benchmark",
        "snippets": w("nn AS (SELECT count(*) AS n FROM benchmark)") + f"SELECT doc_id, {snippet_of('d.text', 'b.text')} AS snippet FROM documents d, nn JOIN benchmark b ON b.item_id = d.doc_id % n",
        "hard_split_chunks": w(CHUNKS) + f"SELECT chunk_id, doc_id, ordinal::BIGINT AS ordinal, text, {est('text')}::BIGINT AS tokens FROM ch",
        "chunk_dedup": f"SELECT doc_id, (i - 1)::BIGINT AS ordinal, h AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM (SELECT doc_id, i, sha256({NORM('l[i]')}) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))) WHERE k = 1",
        "markdown_chunks": w(markdown(60)) + f"SELECT page_id, ordinal::BIGINT AS ordinal, text, path, kind, {est('text')}::BIGINT AS tokens FROM mz",
        "section_paths": w(markdown(400)) + "SELECT page_id, path, count(*) AS n FROM mz GROUP BY ALL",
        "page_pack_chunks": w(pack) + "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, c) - 1)::BIGINT AS ordinal, text FROM p3",
        "carry_forward_section": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 = 0 THEN 'Turn ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS section FROM conversations",
        "postings_terms": w(TOKENS) + "SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(list_concat(t1, t2, t3)) AS term FROM tk) GROUP BY ALL) GROUP BY term",
        "index_ranges": w(TOKENS) + "SELECT term, count(*)::BIGINT AS df, max(tf)::BIGINT AS most, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(list_concat(t1, t2, t3)) AS term FROM tk) GROUP BY ALL) GROUP BY term",
        "bm25_topk": w(bm25()) + _TOLD.format("rank <= 10"),
        "bm25_offset": w(bm25()) + _TOLD.format("rank > 10 AND rank <= 15"),
        "bm25_source_filter": w(bm25(allowed="source_id IN ('src1', 'src2', 'src3')")) + _TOLD.format("rank <= 10"),
        "bm25_phrase": w(bm25(PHRASE_QUERIES)) + _TOLD.format("rank <= 10"),
        "cosine_topk": w(COSINE.format("true")) + "SELECT query_id, chunk_id, round(score, 6) AS score, rank::BIGINT AS rank FROM cr WHERE rank <= 20",
        "cosine_filtered": w(COSINE.format("v.label < 3")) + "SELECT query_id, chunk_id, round(score, 6) AS score, rank::BIGINT AS rank FROM cr WHERE rank <= 20",
        "hybrid_merge": w(bm25(), COSINE.format("true").replace("vec_id AS chunk_id", "vec_id * 1000 AS chunk_id").replace("q.chunk_id AS query_id", "q.chunk_id // 1000 AS query_id").replace("q.chunk_id % 20 = 0", "q.chunk_id % 20000 = 0"), "mm AS (SELECT query_id, chunk_id, score, 0 AS b, rank FROM rk WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM cr WHERE rank <= 30), m2 AS (SELECT query_id, chunk_id, max(score) AS score, min(b * 1000 + rank) AS place FROM mm GROUP BY ALL)") + "SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id)::BIGINT AS merge_pos FROM m2",
        "missing_vectors": w(DOCS, _VECTORS) + "SELECT doc_id AS chunk_id, source_id FROM dd WHERE source_id IN ('src1', 'src2', 'src3') AND NOT EXISTS (SELECT 1 FROM vt WHERE vt.chunk_id = doc_id AND model = 'now')",
        "embedding_coverage": w(DOCS, _VECTORS) + "SELECT source_id, count(*) AS chunks, count(vt.chunk_id) AS embedded FROM dd LEFT JOIN vt ON vt.chunk_id = doc_id AND model = 'now' GROUP BY source_id",
        "stale_dims": w(DOCS, _VECTORS) + "SELECT chunk_id, dim FROM vt WHERE model = 'now' AND NOT stale AND EXISTS (SELECT 1 FROM dd WHERE doc_id = chunk_id)",
        "vector_upkeep": w(DOCS, _VECTORS) + "SELECT chunk_id, CASE WHEN chunk_id % 7 = 0 THEN 'now' ELSE model END AS model, dim FROM vt WHERE chunk_id % 7 = 0 OR NOT (model = 'old' AND chunk_id IN (SELECT doc_id FROM dd WHERE source_id IN ('src1', 'src2', 'src3')))",
        "hashed_vectors": "SELECT doc_id, place, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS x FROM (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY ALL)",
        "vector_bytes": "SELECT vec_id AS chunk_id, (4 * len(embedding))::BIGINT AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
        "rerank_scores": w(POOL) + "SELECT query_id, chunk_id, round(bonus, 6)::DOUBLE AS bonus, round(final, 6)::DOUBLE AS final FROM fi",
        "keyword_overlap": w(POOL) + "SELECT query_id, chunk_id, round(overlap, 6) AS overlap FROM fi",
        "intent_bonus": w(POOL) + "SELECT query_id, chunk_id, intent::DOUBLE AS bonus FROM fi",
        "doc_cap_greedy": w(POOL + ", f6 AS (SELECT * REPLACE (round(final, 6)::DOUBLE AS final) FROM fi)" + greedy("f6", 8)) + "SELECT gx.query_id, gx.chunk_id, final, rank::BIGINT AS rank FROM gx JOIN f6 ON f6.query_id = gx.query_id AND f6.chunk_id = gx.chunk_id",
        "search_endtoend": w(POOL.split(", pq AS")[0] + f""", e0 AS (SELECT rk.query_id, query, rk.chunk_id, ch.doc_id, score, rank AS merge_pos, title || ' ' || lang AS hay, authority, ch.text FROM rk JOIN qs USING (query_id) JOIN ch ON rk.chunk_id = ch.chunk_id WHERE rank <= 30),
e1 AS (SELECT *, score * CASE authority WHEN 'official' THEN 1.0 WHEN 'trusted' THEN 0.9 WHEN 'user' THEN 0.75 ELSE 0.6 END * (1 + 0.25 * len(list_filter(list_distinct({QTOK("query")}), lambda t: contains(lower(hay), t)))::DOUBLE / len(list_distinct({QTOK("query")}))) AS final FROM e0)""" + greedy("e1", 8)) + f"SELECT gx.query_id, gx.rank::BIGINT AS rank, gx.chunk_id, doc_id, round(final, 4)::DOUBLE AS relevance, {snippet_of('text', 'query')} AS snippet FROM gx JOIN e1 ON e1.query_id = gx.query_id AND e1.chunk_id = gx.chunk_id",
        "vocab_scan": "SELECT doc_id, " + ", ".join(f"array_to_string({_found(k, 'text')}, ',') AS {k}" for k in VOCABULARY) + " FROM documents",
        "technique_resolve": "SELECT item_id, ['kerberoasting', 'as-rep roasting', 'sql injection', NULL, 'pass the hash', 'dcsync'][item_id % 6 + 1] AS term FROM benchmark",
        "graph_entities": w(GRAPH) + "SELECT * FROM en",
        "graph_edges": w(GRAPH) + "SELECT * FROM ed",
        "graph_stats": w(GRAPH) + "SELECT 'entity' AS what, entity_type AS name, count(*) AS n FROM en GROUP BY ALL UNION ALL SELECT 'edge', predicate, count(*) FROM ed GROUP BY ALL",
        "graph_neighbours": w(GRAPH) + "SELECT 'out' AS direction, object AS other, object_type AS other_type, predicate, confidence, inferred, doc_id FROM ed WHERE subject = 'clown' AND subject_type = 'technique' UNION ALL SELECT 'in', subject, subject_type, predicate, confidence, inferred, doc_id FROM ed WHERE object = 'clown' AND object_type = 'technique'",
        "entity_like": w(GRAPH) + "SELECT name, entity_type FROM en WHERE entity_type = 'source' AND contains(lower(name), 'src7')",
        "doc_techniques": w(GRAPH) + "SELECT en.doc_id, string_agg(DISTINCT subject, ',' ORDER BY subject) AS techniques FROM ed JOIN en ON en.name = object AND en.entity_type = 'writeup' WHERE predicate = 'demonstrated_in' AND subject_type = 'technique' GROUP BY en.doc_id",
        "ingest_documents": w(INGESTED) + "SELECT doc_id, 'book' AS source_id, external_id, title, sha256(text) AS content_hash FROM iz",
        "ingest_chunks": w(INGESTED_CHUNKS) + f"SELECT chunk_id, doc_id, ordinal, path, kind, NULL::INT AS page, text, content_hash, {est('text')}::BIGINT AS tokens FROM ic",
        "ingest_tokens": w(INGESTED_CHUNKS) + f"SELECT chunk_id, array_to_string({TOK('title')}, ' ') AS title, array_to_string({TOK('head')}, ' ') AS section, len({TOK('text')})::BIGINT AS words, (len({TOK('title')}) + len({TOK('head')}) + len({TOK('text')}))::BIGINT AS dl FROM ic",
        "source_upsert": w(DOCS) + """SELECT DISTINCT source_id, CASE WHEN source_id IN ('src1', 'src2', 'src3') THEN 'New ' || source_id ELSE source_name END AS name, CASE WHEN source_id IN ('src1', 'src2', 'src3') THEN 'official' ELSE authority END AS authority,
 CASE WHEN source_id IN ('src1', 'src2', 'src3') THEN 'markdown' END AS source_type, CASE WHEN source_id IN ('src1', 'src2', 'src3') THEN 'https://' || source_id || '.example' END AS url, source_id <> 'src2' AS enabled, 'v-' || source_id AS version FROM dd
 UNION ALL SELECT 'added', 'New added', 'official', 'markdown', 'https://added.example', true, NULL""",
        "upsert_changed": w(HALVES) + "SELECT external_id, status, doc_id, content_hash FROM hm",
        "ingest_stats": w(HALVES) + "SELECT source_id, status, count(*) AS n FROM hm GROUP BY ALL",
        "replace_chunks": w(HALVES, f"""ra AS (SELECT doc_id, text FROM hs WHERE doc_id NOT IN (SELECT doc_id FROM hm WHERE status = 'changed') UNION ALL SELECT doc_id, text FROM hm WHERE status = 'changed'),
rb AS (SELECT doc_id, CASE WHEN {est("text")} <= 400 THEN [{STRIP("text")}] ELSE list_transform(range(0, len(w), 300), lambda k: array_to_string(w[k + 1 : k + 300], ' ')) END AS p FROM (SELECT *, regexp_extract_all(text, '[^\\s\\v]+') AS w FROM ra))""") + f"SELECT doc_id, (i - 1)::BIGINT AS ordinal, sha256({NORM('p[i]')}) AS h FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rb) WHERE p[i] <> ''",
        "case_list": "SELECT conv_id AS case_id, 'case ' || conv_id AS name, count(*) AS observations FROM conversations GROUP BY conv_id",
        "case_state": "SELECT conv_id AS case_id, 'case ' || conv_id AS name, conv_id * 1000 + turn AS obs_id, role AS kind, text, 'open' AS status FROM conversations",
        "source_stats": w(CHUNKS) + "SELECT source_id, count(DISTINCT doc_id) AS documents, count(chunk_id) AS chunks FROM ch GROUP BY source_id",
        "table_counts": w(CHUNKS) + "SELECT 'sources' AS name, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'entities', 0 UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'cases', count(DISTINCT conv_id) FROM conversations",
        "source_listing": w(DOCS) + "SELECT doc_id, title FROM dd WHERE source_id = 'src5' ORDER BY title LIMIT 20",
        "excerpt_lookup": w(CHUNKS) + "SELECT chunk_id, source_id, source_name, title, authority, text AS excerpt FROM ch",
        "section_filter": w(CHUNKS) + "SELECT lang, count(*) AS n FROM ch WHERE contains(lower(lang), 'e') GROUP BY lang",
        "document_ranking": w(bm25() + RANKING) + "SELECT query_id, doc_id, rank::BIGINT AS rank FROM dk",
        "recall_precision_mrr_hit": w(bm25() + RANKING, GOLD, """dl AS (SELECT query_id, list(doc_id ORDER BY rank) AS r FROM dk GROUP BY query_id), ev AS (SELECT gl.query_id, relevant, coalesce(r, []) AS r FROM gl LEFT JOIN dl USING (query_id)),
e2 AS (SELECT len(list_intersect(r[1:5], relevant))::DOUBLE / len(relevant) AS recall, CASE WHEN len(r) = 0 THEN 0 ELSE len(list_filter(r[1:5], lambda d: list_contains(relevant, d)))::DOUBLE / len(r[1:5]) END AS precision, coalesce(1.0 / list_min(list_filter(list_transform(r, lambda d, i: CASE WHEN list_contains(relevant, d) THEN i END), lambda i: i IS NOT NULL)), 0)::DOUBLE AS rr, list_has_any(r[1:5], relevant)::INT AS hit FROM ev)""") + "SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM e2",
        "latency_percentile": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events",
        "citation_integrity": w(bm25() + RANKING) + "SELECT count(*) AS returned, sum((rank <> 15 OR chunk_id = 0)::INT)::BIGINT AS resolved, round(sum((rank <> 15 OR chunk_id = 0)::INT) / count(*), 6) AS integrity FROM ht",
        "post_links": "SELECT page_id, 0::BIGINT AS pos, printf('/2024/%02d/%02d/p%d.html', page_id % 12 + 1, page_id % 28 + 1, page_id % 50) AS url FROM pages",
        "pdf_headings": w(_RUNS, """rb AS (SELECT doc, page, CASE WHEN count(*) FILTER (size > 0) = 0 THEN 0 ELSE list(size ORDER BY size) FILTER (size > 0)[(count(*) FILTER (size > 0)) // 2 + 1] END AS body FROM ru GROUP BY ALL),
rc AS (SELECT ru.*, trim(text) AS t, body > 0 AND size >= body * 1.15 AND length(trim(text)) <= 100 AS big FROM ru JOIN rb USING (doc, page)),
rd AS (SELECT *, sum((NOT big)::INT) OVER (PARTITION BY doc, page ORDER BY idx) AS isl FROM rc),
re AS (SELECT doc, page, 0 AS part, min(idx) AS idx, 0 AS k, string_agg(t, ' ' ORDER BY idx) AS heading FROM rd WHERE big GROUP BY doc, page, isl
  UNION ALL SELECT doc, page, 1, idx, k, trim(l[k]) FROM (SELECT doc, page, idx, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT *, string_split(text, chr(10)) AS l FROM ru)) WHERE regexp_matches(trim(l[k]), '^(\\d+(?:\\.\\d+)*)[.\\s]\\s+(\\S.{1,90})$')),
rf AS (SELECT doc, page, heading, min(part * 1000000 + idx * 1000 + k) AS at_ FROM re GROUP BY ALL)""") + "SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY at_)::BIGINT AS n, heading FROM rf",
        "pdf_code_blocks": w(_RUNS, """rc AS (SELECT *, regexp_matches(lower(font), 'mono|courier|consol|menlo|typewriter|fixedsys|code') AS big FROM ru), rd AS (SELECT *, sum((NOT big)::INT) OVER (PARTITION BY doc, page ORDER BY idx) AS isl FROM rc),
re AS (SELECT doc, page, min(idx) AS idx, trim(string_agg(text, '' ORDER BY idx), ' ' || chr(10)) AS block FROM rd WHERE big GROUP BY doc, page, isl)""") + "SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY idx)::BIGINT AS n, block FROM re WHERE length(block) > 2",
        "median_size": w(_RUNS) + "SELECT doc, page, CASE WHEN count(*) FILTER (size > 0) = 0 THEN 0.0::DOUBLE ELSE (list(size ORDER BY size) FILTER (size > 0))[(count(*) FILTER (size > 0)) // 2 + 1] END AS body FROM ru GROUP BY ALL",
        "pages_to_fetch": "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 3)",
    }
