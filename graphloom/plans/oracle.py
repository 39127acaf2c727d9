"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from graphloom.functions import noise as N
from graphloom.operators import triples as R
from graphloom.plans import fixtures as X

ORACLE: dict[str, str] = {}

DOCS = "docs AS (SELECT doc_id AS chunk_id, source AS book_id, coalesce(text, '') AS content FROM documents)"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BM25 = f"""{DOCS}, kept AS (SELECT * FROM docs{{kept}}), tk AS (SELECT chunk_id, {TOK.format('content')} AS t FROM kept),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), po AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term), raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS w FROM df, st),
idf AS (SELECT term, df, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest({TOK.format("'with then that inthion of the ring'")}) AS term) GROUP BY term),
sc AS (SELECT chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM po JOIN q USING (term) JOIN idf USING (term), st GROUP BY chunk_id)"""
L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"

ORACLE["bm25_topk"] = f"WITH {BM25.format(kept=' WHERE length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) > 20')} SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10"
ORACLE["corpus_term_stats"] = f"WITH {BM25.format(kept='')} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLE["vector_knn_l2"] = f"SELECT b.vec_id AS query_id, a.vec_id, round({L2}, 6) AS distance, row_number() OVER (PARTITION BY b.vec_id ORDER BY {L2}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 QUALIFY rank <= 5"
ORACLE["hybrid_search"] = f"""WITH {BM25.format(kept=' WHERE chunk_id IN (SELECT vec_id FROM embeddings)')}, d AS (SELECT a.vec_id AS chunk_id, {L2} AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id IN (SELECT chunk_id FROM docs)),
j AS (SELECT chunk_id, coalesce(score, 0) AS kw, distance FROM d LEFT JOIN sc USING (chunk_id)), x AS (SELECT min(kw) AS lo, max(kw) AS hi, max(distance) AS far FROM j)
SELECT chunk_id, round(0.5 * (kw - lo) / (hi - lo + 1e-6) + 0.5 * (1 - distance / (far + 1e-6)), 6) AS score FROM j, x ORDER BY 0.5 * (kw - lo) / (hi - lo + 1e-6) + 0.5 * (1 - distance / (far + 1e-6)) DESC, chunk_id LIMIT 5"""
ORACLE["minmax_norm"] = "SELECT doc_id, round((n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER () + 1e-6), 6) AS y FROM documents"
ORACLE["zscore_norm"] = "SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS z FROM documents"
TIERED = "CASE WHEN {0} >= (SELECT quantile_cont({0}, 0.85) FROM {1}) THEN 1 WHEN {0} >= (SELECT quantile_cont({0}, 0.55) FROM {1}) THEN 2 WHEN {0} >= (SELECT quantile_cont({0}, 0.20) FROM {1}) THEN 3 ELSE 4 END"
ORACLE["percentile_tiers"] = f"SELECT doc_id, {TIERED.format('n_chars', 'documents')} AS tier FROM documents"
ORACLE["citations"] = f"WITH {DOCS} SELECT chunk_id, book_id AS source, 'intro_' || chunk_id || '_x' AS chapter, CAST(chunk_id AS VARCHAR) AS page, substr(content, 1, 300) AS snippet, round_even(length(content) / 7000, 3) AS score FROM docs"
HAY = "(name || ' ' || essence || ' ' || reasoning || ' ' || book)"
ORACLE["graph_query"] = f"WITH {X.NODES_P}, s AS (SELECT *, " + " + ".join(f"CASE WHEN contains(name, '{t}') THEN 3 WHEN contains({HAY}, '{t}') THEN 1 ELSE 0 END" for t in ("red", "ring", "Brand#3")) + " AS score FROM p) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, val DESC, pos LIMIT 8"
DEG = "dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM m UNION ALL SELECT target FROM m) GROUP BY id)"
ORACLE["related_links"] = f"WITH {X.TRIPLES_A}, {DEG}, t AS (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 3) SELECT source || '>' || target AS pos, source, target FROM m WHERE source IN (SELECT id FROM t) OR target IN (SELECT id FROM t) ORDER BY pos LIMIT 20"
V1 = " + ".join(f"contains(lower({HAY}), '{c}')::INT" for c in "red ring")
ORACLE["kg_search_v1"] = f"WITH {X.NODES_P}, s AS (SELECT id, pos, contains(name, 'red ring')::INT * 4 + contains(lower({HAY}), 'red ring')::INT + ({V1}) / 8.0 * 2 AS raw FROM p) SELECT id, round(least(raw / 8, 1.0), 6)::DOUBLE AS score FROM s WHERE raw > 0 ORDER BY raw DESC, pos LIMIT 20"


def _v2(words: list[str], whole: str) -> str:
    s = " + ".join(f"CASE WHEN contains(lower(name), '{t}') THEN 8 WHEN contains(lower(essence), '{t}') THEN 3 ELSE 0 END" for t in words)
    return f"WITH {X.NODES_P}, s AS (SELECT id, pos, ({s} + CASE WHEN contains(lower(name), '{whole}') THEN 10 ELSE 0 END) * CASE type WHEN 'merged' THEN 1.4 ELSE 1.0 END * CASE WHEN val > 10 THEN 1.3 ELSE 1.0 END AS raw FROM p) SELECT id, round(least(raw::DOUBLE / 15, 1.0), 6) AS score FROM s WHERE raw > 1 ORDER BY raw::DOUBLE DESC, pos LIMIT 20"


ORACLE["kg_search_v2"] = _v2(["red", "ring", "ECONOMY", "economy"], "red ring，economy economy")
ORACLE["kg_search_v3"] = _v2(["blue", "ring"], "blue、ring")
ORACLE["snippet_choice"] = f"WITH {X.NODES_P} SELECT id, CASE WHEN val % 2 = 1 THEN essence WHEN val % 3 <> 0 THEN reasoning ELSE '来自「' || book || '」，在图谱中可查看其邻接关系与原文出处。' END AS snippet FROM p"
ORACLE["ui_search"] = f"WITH {X.NODES_P} SELECT id, round(contains(name, 'widget')::INT * 4 + contains({HAY}, 'widget')::INT + val / 50, 6) AS score FROM p ORDER BY contains(name, 'widget')::INT * 4 + contains({HAY}, 'widget')::INT + val / 50 DESC, pos LIMIT 1"
ORACLE["ui_filter"] = f"WITH {X.TRIPLES_A} SELECT source, target, relation FROM m WHERE relation IN ('application', 'parallel') AND contains(source, '1') AND contains(target, '1')"

# text

BLANK = "[\\s　]"


def _chain(c: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


ENDS = ((f"^{BLANK}+", ""), (f"{BLANK}+$", ""))


def _label(c: str) -> str:
    return "trim(" + _chain(c, ("<!--.*?-->", ""), *ENDS, ("^#+\\s*", ""), ("\\.{3,}\\s*\\d*\\s*$", ""), ("[_\\s]+", " "), ("^[一二三四五六七八九十]+[、.．]\\s*", ""), ("^[(（][一二三四五六七八九十\\d]+[)）]\\s*", "")) + ", ' ' || chr(9) || chr(13) || chr(10) || '-—|:：，,。；;')"


LABEL = _label("t")
LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _noise(f: N.Noise, c: str) -> str:
    ratio, n = f"{LETTERS.format(c)} / greatest(length({c}), 1)", f"length({c})"
    parts = [f"{n} < {f.least}", f"{n} > {f.most}", f"regexp_matches({c}, '{'|'.join(f'({p})' for p in f.patterns).replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}')", f"{ratio} < {f.ratio}"]
    if f.short:
        parts += [f"({n} < 5 AND {LETTERS.format(c)} < 3)", f"({ratio} < 0.5 AND {n} < 10)"]
    if f.names:
        plain = f"replace(replace({c}, ' ', ''), '　', '')"
        spared = f"({plain} IN {_in(N.SHORT_TERMS)} OR regexp_matches({plain}, '{'|'.join(f.hints)}'))" if f.hints else f"{plain} IN {_in(N.ORGANS)}"
        parts.append(f"(regexp_full_match({plain}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,4}}') AND NOT {spared})")
    out = "(" + " OR ".join(parts) + ")"
    return f"({c} NOT IN {_in(f.always)} AND {out})" if f.always else out


def _valid(c: str) -> str:
    return f"NOT ({c} = '' OR {c} IN {_in(N.GENERIC)} OR (length({c}) < 4 AND {c} NOT IN {_in(N.SHORT_TERMS)}) OR length({c}) > 48 OR {_noise(N.BUILDER, c)} OR regexp_matches({c}, '{N.PUBLISHER}'))"


LIT = X.LABELS_SQL
ORACLE["chunk_filter"] = f"WITH {DOCS} SELECT chunk_id, length(content) AS chars FROM docs WHERE length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) > 20"
ORACLE["clean_text"] = f"WITH {X.DOCUMENTS}, lit AS (SELECT i, {X.picked_sql(X.DIRTY, 'i')} || body AS t FROM dw) SELECT i, md5(" + _chain("replace(replace(t, '　', ' '), '�', '')", ("\\.{4,}", "..."), ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), *ENDS) + ") AS clean FROM lit"
ORACLE["clean_label"] = f"WITH {LIT} SELECT i, {LABEL} AS label FROM lit"
STRIPPED = f"s AS (SELECT i, {_chain('t', *ENDS)} AS t FROM lit)"
ORACLE["noise_flags"] = f"WITH {LIT}, {STRIPPED} SELECT i, {_noise(N.BUILDER, 't')} AS builder, {_noise(N.MERGER, 't')} AS merger, {_noise(N.ESSENCE, 't')} AS essence, {_noise(N.EXPORT, 't')} AS export FROM s"
ORACLE["valid_label"] = f"WITH {LIT}, c AS (SELECT i, {LABEL} AS t FROM lit) SELECT i, {_valid('t')} AS valid FROM c"
ORACLE["noise_chunks"] = f"WITH {DOCS}, p AS (SELECT chunk_id, regexp_replace(regexp_replace(substr(content, 1, 200), '^\\s+', ''), '\\s+$', '') AS t FROM docs) SELECT chunk_id, length(t) > 20 AND {LETTERS.format('t')} / greatest(length(t), 1) < 0.2 AS noise FROM p"
ORACLE["letter_ratio"] = f"WITH {DOCS} SELECT chunk_id, round({LETTERS.format('content')} / greatest(length(content), 1), 6) AS ratio FROM docs"
ORACLE["markdown_table"] = """WITH r AS (SELECT n_regionkey, '| ' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || ' | ' || n_name || '\\|x |' AS line FROM nation), f AS (SELECT n_regionkey, list(line ORDER BY line) AS l FROM r GROUP BY 1)
SELECT n_regionkey, l[1] || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN len(l) > 1 THEN array_to_string(l[2:], chr(10)) ELSE '|  |  |' END AS md FROM f"""
ORACLE["natural_sort"] = "SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey, s_suppkey % 7) AS pos FROM supplier"
MARKS = X.MARKS_SQL
SENT = "string_split(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}\\s+.*$', '', 'g'), '\\s+', '', 'g'), '([。；;])', '\\1' || chr(1), 'g'), chr(1))"
ORACLE["sentences"] = f"WITH {MARKS}, s AS (SELECT i, list_filter({SENT}, lambda x: length(x) >= 12) AS l FROM lit) SELECT i, k - 1 AS k, l[k] AS sentence FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k)"
NUMERAL = "[一二三四五六七八九十百零〇\\d]"
ORACLE["heading_levels"] = f"""WITH {X.DOCUMENTS}, h AS (SELECT i, trim(CASE WHEN i % 2 = 0 THEN {X.picked_sql(X.HEADS, 'i')} ELSE {X.picked_sql(X.HEADS, 'i')} || ' ' || word END) AS t, 9 + i % 11 AS size, CASE WHEN i % 3 > 0 THEN 18 END AS largest, i % 5 = 0 AS bold FROM dw)
SELECT i, CASE WHEN t IN ('绪论', '前言', '导论', '总论') OR regexp_matches(t, '(?i)^(chapter|part|section)\\s+\\d+') OR regexp_matches(t, '^第\\s*{NUMERAL}+\\s*[篇编章]($|[^\\p{{L}}\\p{{N}}_])') THEN 1 WHEN regexp_matches(t, '^第\\s*{NUMERAL}+\\s*节($|[^\\p{{L}}\\p{{N}}_])') THEN 2
 WHEN regexp_matches(t, '^[一二三四五六七八九十]+[、.．]') THEN 3 WHEN regexp_matches(t, '^[(（][一二三四五六七八九十\\d]+[)）]') THEN 4 WHEN regexp_matches(t, '^\\d+(\\.\\d+){{1,3}}\\s+') THEN 3 WHEN length(t) > 60 THEN 0
 WHEN size >= 13.5 THEN CASE WHEN largest IS NULL OR size >= 17.8 THEN 1 ELSE 2 END WHEN size >= 12.2 OR (bold AND size >= 11.5) THEN 3 ELSE 0 END AS level FROM h"""
ORACLE["page_numbers"] = f"WITH {DOCS} SELECT chunk_id, '0' || chunk_id AS page FROM docs"
ORACLE["display_labels"] = f"WITH {DOCS} SELECT chunk_id, substr(regexp_replace(" + _chain("content", ("[\\x00-\\x1f]", ""), ("\\s+", " "), *ENDS) + ", '\\.{3,}\\s*\\d*$', ''), 1, 60) AS label FROM docs"

# sections and chunks

ORACLE["split_sections"] = f"WITH {X.MARKDOWN} SELECT conv_id, title, length(markdown) AS chars, md5(markdown) AS md5, idx, level FROM sections"
ORACLE["section_manifest"] = f"""WITH {X.MARKDOWN}, pg AS (SELECT DISTINCT conv_id, unnest(range(idx + 1, idx + level + 2)) AS page FROM sections),
a AS (SELECT conv_id, count(*) AS sections, sum(length(markdown)) AS characters FROM sections GROUP BY ROLLUP (conv_id)), b AS (SELECT conv_id, count(*) AS pages, min(page) AS page_min, max(page) AS page_max FROM pg GROUP BY ROLLUP (conv_id))
SELECT a.conv_id, sections, characters, pages, page_min, page_max FROM a JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""
ORACLE["section_metadata"] = f"WITH {X.MARKDOWN} SELECT conv_id, idx, conv_id || ':' || lpad(CAST(idx AS VARCHAR), 4, '0') AS section_id, CAST(length(markdown) AS VARCHAR) AS char_count FROM sections"
CHUNKS = f"""{MARKS}, l AS (SELECT i, k AS pos, x[k] AS raw FROM (SELECT i, string_split(t, chr(10)) AS x FROM lit), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k)),
h AS (SELECT *, regexp_extract(raw, '^#\\s+((?:第[一二三四五六七八九十]+章|绪论|前言|目录|附录))(.*)', 1) AS c1, trim(regexp_extract(raw, '^#\\s+(?:第[一二三四五六七八九十]+章|绪论|前言|目录|附录)(.*)', 1)) AS c2, regexp_extract(raw, '^#+\\s+(第[一二三四五六七八九十]+节)', 1) AS s1, trim(regexp_extract(raw, '^#+\\s+第[一二三四五六七八九十]+节(.*)', 1)) AS s2 FROM l),
g AS (SELECT *, sum(CASE WHEN c1 <> '' OR s1 <> '' THEN 1 ELSE 0 END) OVER w AS part, coalesce(last_value(CASE WHEN c1 <> '' THEN c1 || c2 END IGNORE NULLS) OVER w, '00_绪论') AS chapter,
  coalesce(last_value(CASE WHEN c1 <> '' THEN '00_概要' WHEN s1 <> '' THEN s1 || s2 END IGNORE NULLS) OVER w, '00_开篇') AS section FROM h WINDOW w AS (PARTITION BY i ORDER BY pos)),
ch AS (SELECT i, part, any_value(chapter) AS chapter, any_value(section) AS section, string_agg(raw, chr(10) ORDER BY pos) AS content FROM g GROUP BY i, part)"""
ORACLE["chapter_chunks"] = f"WITH {CHUNKS} SELECT i, part, chapter, section, length(content) AS chars FROM ch"
ORACLE["chunk_last_wins"] = f"WITH {CHUNKS}, n AS (SELECT i, part, content, chapter || '_' || substr(section, 1, 3) || '.md' AS name FROM ch WHERE length(trim(content, ' ' || chr(10))) >= 10) SELECT i, name, count(*) - 1 AS overwritten, length(arg_max(content, part)) AS chars FROM n GROUP BY i, name"
ORACLE["virtual_chunks"] = f"""WITH {MARKS}, l AS (SELECT i, k AS pos, x[k] AS t FROM (SELECT i, string_split(t, chr(10)) AS x FROM lit), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k)), c AS (SELECT i, pos, t AS raw, {LABEL} AS t FROM l),
h AS (SELECT *, regexp_matches(raw, '^#{{1,2}}\\s+\\S') AND {_valid('t')} AS head FROM c), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY i ORDER BY pos) AS part FROM h)
SELECT i, part, arg_min(t, pos) AS title FROM g WHERE part > 0 GROUP BY i, part HAVING length(trim(string_agg(raw, chr(10) ORDER BY pos), ' ' || chr(10))) >= 20"""
BOOK = f"""{MARKS}, pt AS (SELECT i, t, regexp_extract(t, '(\\p{{L}}+)', 1) AS word, regexp_extract(t, '(?m)^\\s*(#.*)$', 1) AS head FROM lit),
bk AS (SELECT i, '03_生理学 ' || i AS book_id, t AS content, 'chunks/03_生理学/' || word || '_' || i || '.md' AS path, {_label('word')} AS chapter, CASE WHEN {_label('head')} <> '' THEN {_label('head')} ELSE CAST(i AS VARCHAR) END AS section FROM pt),
ln AS (SELECT i, k AS pos, x[k] AS raw, {_label('x[k]')} AS heading FROM (SELECT i, string_split(content, chr(10)) AS x FROM bk), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) WHERE regexp_matches(x[k], '^\\s*#{{2,6}}\\s+\\S')),
sh AS (SELECT i, heading, min(pos) AS pos FROM ln WHERE {_valid('heading')} GROUP BY i, heading),
ct AS (SELECT book_id, chapter, section, book_id AS subject, chapter AS object, 0.95::DOUBLE AS confidence FROM bk WHERE {_valid('chapter')} UNION ALL SELECT book_id, chapter, section, chapter, section, 0.9 FROM bk WHERE {_valid('section')} AND chapter <> section UNION ALL SELECT book_id, chapter, section, section, heading, 0.88 FROM bk JOIN sh USING (i))"""
ORACLE["chunk_identity"] = f"WITH {BOOK} SELECT i AS chunk_pos, chapter, section FROM bk"

# triples

EV = "ev AS (SELECT user_id, event_id, event_type, row_number() OVER w AS idx, lead(event_type) OVER w AS next, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
ORACLE["adjacent_parallel"] = f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS book_id, event_type AS subject, next AS object, idx * 2 AS idx FROM ev WHERE next IS NOT NULL UNION ALL SELECT CAST(user_id AS VARCHAR), next, event_type, idx * 2 + 1 FROM ev WHERE next IS NOT NULL"
ORACLE["section_order_prereq"] = f"WITH {EV} SELECT prev AS source, event_type AS target, count(*) AS n FROM ev WHERE prev IS NOT NULL GROUP BY ALL"
HELD = "list_filter(w.reach, lambda x: x.b = c.source)"
AFTER = "list_filter(w.reach, lambda x: x.a = c.target)"
FROM_ = f"list_append(list_transform({HELD}, lambda x: x.a), c.source)"
TO = f"list_append(list_transform({AFTER}, lambda x: x.b), c.target)"
OK = "c.source <> c.target AND NOT list_contains(w.reach, {'a': c.target, 'b': c.source})"
ORACLE["acyclic_prereqs"] = f"""WITH RECURSIVE {EV}, c AS (SELECT CAST(user_id AS VARCHAR) AS book_id, prev AS source, event_type AS target, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev WHERE prev IS NOT NULL),
w(book_id, k, reach, source, target, seq, accepted) AS (SELECT book_id, 0::BIGINT, list_filter([{{'a': source, 'b': target}}], lambda x: false), source, target, seq, false FROM c WHERE k = 1
 UNION ALL SELECT c.book_id, c.k, CASE WHEN {OK} THEN list_distinct(list_concat(w.reach, flatten(list_transform({FROM_}, lambda p: list_transform({TO}, lambda q: {{'a': p, 'b': q}}))))) ELSE w.reach END, c.source, c.target, c.seq, {OK} FROM w JOIN c ON c.book_id = w.book_id AND c.k = w.k + 1)
SELECT book_id, source, target, seq, accepted FROM w WHERE k > 0"""
ORACLE["containment_triples"] = f"WITH {BOOK} SELECT book_id, chapter, section, subject, object, confidence FROM ct"


def _topic(c: str) -> str:
    """The text around the first topic that a sentence has."""
    out = []
    for t in R.TOPICS:
        at = f"strpos({c}, '{t}')"
        near = _label(f"substr({c}, greatest(1, {at} - 10), {at} + 17 - greatest(0, {at} - 11))")
        out.append(f"CASE WHEN {at} > 0 THEN substr(regexp_replace({near}, '^[，,。；;、]+', ''), 1, 32) END")
    return f"coalesce({', '.join(out)}, '')"


CANDIDATES = " UNION ALL ".join(f"SELECT i, idx, {k} AS ord, regexp_extract(s, '{p}', 1) AS subject, regexp_extract(s, '{p}', 2) AS object, 0.72::DOUBLE AS confidence FROM st" for k, p in enumerate(R.APPLICATIONS))
APPLIED = f"""st AS (SELECT i, k - 1 AS idx, l[k] AS s FROM (SELECT i, list_filter({SENT}, lambda x: length(x) >= 12) AS l FROM lit), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k) WHERE regexp_matches(l[k], '{'|'.join(R.APPLICATION_HINTS)}')),
ca AS ({CANDIDATES} UNION ALL SELECT i, idx, 5, section, {_topic('s')}, 0.62 FROM st JOIN bk USING (i)),
cl AS (SELECT i, idx, ord, CASE WHEN ord < 5 THEN regexp_replace({_label('subject')}, '[可能]$', '') ELSE subject END AS subject, {_label('object')} AS object, confidence FROM ca WHERE subject <> '' AND object <> ''),
ap AS (SELECT * FROM (SELECT * FROM cl WHERE {_valid(_label('subject'))} AND {_valid(_label('object'))} QUALIFY row_number() OVER (PARTITION BY i, idx ORDER BY ord) = 1) QUALIFY row_number() OVER (PARTITION BY i ORDER BY idx) <= 6)"""
ORACLE["application_triples"] = f"WITH {BOOK}, {APPLIED} SELECT i AS chunk_pos, subject, object, confidence FROM ap"
ORACLE["extract_triples"] = f"""WITH {BOOK}, {APPLIED}, pv AS (SELECT i, regexp_replace(regexp_replace(substr(content, 1, 200), '^\\s+', ''), '\\s+$', '') AS v, length(content) AS n, section FROM bk),
ok AS (SELECT i, book_id FROM bk WHERE i NOT IN (SELECT i FROM pv WHERE ({_noise(N.BUILDER, 'section')} OR (length(v) > 20 AND {LETTERS.format('v')} / greatest(length(v), 1) < 0.2)) AND n < 1200)), nh AS (SELECT i, count(*) AS n FROM sh WHERE i IN (SELECT i FROM ok) GROUP BY i HAVING count(*) > 1),
al AS (SELECT 'containment' AS relation, count(*) AS n FROM (SELECT DISTINCT book_id, subject, object FROM ct WHERE book_id IN (SELECT book_id FROM ok)) UNION ALL SELECT 'parallel', sum(2 * (n - 1)) FROM nh UNION ALL SELECT 'prerequisite', sum(n - 1) FROM nh UNION ALL SELECT 'application', count(*) FROM (SELECT DISTINCT i, subject, object FROM ap WHERE i IN (SELECT i FROM ok)))
SELECT relation, n FROM al WHERE n > 0"""
ORACLE["dedup_triples"] = f"WITH {X.TRIPLES_A}, d AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, source_path ORDER BY seq) AS k FROM a) SELECT book_id, relation, count(*) AS n, round(sum(confidence), 6) AS confidence FROM d WHERE k = 1 GROUP BY ALL"
ORACLE["validate_triples"] = f"WITH {X.TRIPLES_A} SELECT CASE chapter WHEN 'ch1' THEN 'unsupported relation: unknown' WHEN 'ch2' THEN 'empty evidence' WHEN 'ch3' THEN 'self-loop' ELSE 'valid' END AS reason, count(*) AS n FROM a GROUP BY 1"

# graphs

ORACLE["edges_first_wins"] = f"WITH {X.TRIPLES_A} SELECT * FROM e"
ORACLE["edges_last_wins"] = f"WITH {X.TRIPLES_A} SELECT book_id, subject AS source, object AS target, arg_max(relation, seq) AS relation, arg_max(confidence, seq) AS confidence, arg_max(evidence, seq) AS evidence FROM a GROUP BY ALL"
ORACLE["merged_edges"] = f"WITH {X.TRIPLES_A} SELECT * FROM m"
ORACLE["node_attrs"] = f"WITH {X.TRIPLES_A}, n AS (SELECT subject AS id, (seq, 0) AS place, book_id, chapter FROM a UNION ALL SELECT object, (seq, 1), book_id, chapter FROM a) SELECT id, arg_max(book_id, place) AS book_id, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS chapters FROM n GROUP BY id"
ORACLE["relation_distribution"] = f"WITH {X.TRIPLES_A} SELECT relation, count(*) AS n FROM e GROUP BY 1"
BD = "bd AS (SELECT book_id, id, count(*) AS degree FROM (SELECT book_id, source AS id FROM e UNION ALL SELECT book_id, target FROM e) GROUP BY ALL)"
ORACLE["graph_quality"] = f"WITH {X.TRIPLES_A}, {BD} SELECT book_id, count(*) AS triples, " + ", ".join(f"count(*) FILTER (relation = '{r}') AS {r}" for r in ("prerequisite", "parallel", "containment", "application")) + ", count(*) FILTER (subject = object) AS invalid, (SELECT count(*) FROM e WHERE e.book_id = a.book_id) AS edges, (SELECT count(*) FROM bd WHERE bd.book_id = a.book_id) AS nodes, (SELECT count(*) FROM bd WHERE bd.book_id = a.book_id AND degree <= 1) AS low_degree, (SELECT count(*) FROM e x JOIN e y ON x.book_id = y.book_id AND x.source = y.target AND x.target = y.source WHERE x.source < x.target AND x.relation = 'prerequisite' AND y.relation = 'prerequisite' AND x.book_id = a.book_id) AS cycles FROM a GROUP BY book_id"
ORACLE["low_degree"] = f"WITH {X.EDGES_B} SELECT id FROM ends GROUP BY id HAVING count(*) <= 30"
ORACLE["degree"] = f"WITH {X.EDGES_B} SELECT id, count(*) AS degree FROM ends GROUP BY id"
CLUSTER = "tr AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM und x JOIN und y ON x.v = y.u JOIN und z ON z.u = x.u AND z.v = y.v), tc AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr) GROUP BY id), ud AS (SELECT id, count(*) AS d FROM (SELECT u AS id FROM und UNION ALL SELECT v FROM und) GROUP BY id), cl AS (SELECT id, coalesce(t, 0) AS triangles, CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END::DOUBLE AS clustering FROM (SELECT DISTINCT id FROM ends) LEFT JOIN tc USING (id) LEFT JOIN ud USING (id))"
ORACLE["clustering"] = f"WITH {X.EDGES_B}, {CLUSTER} SELECT id, triangles, round(clustering, 6) AS clustering FROM cl"


def _pagerank(rounds: int) -> str:
    out = "od AS (SELECT source AS id, count(*) AS o FROM b GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS r FROM (SELECT DISTINCT id FROM ends))"
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT v.id, 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT id FROM od)) / (SELECT count(*) FROM r0)) + 0.15 / (SELECT count(*) FROM r0) AS r FROM r{k} v LEFT JOIN (SELECT target AS id, sum(r / o) AS s FROM b JOIN r{k} q ON q.id = b.source JOIN od ON od.id = b.source GROUP BY 1) g ON g.id = v.id)"
    return out


ORACLE["pagerank_k"] = f"WITH {X.EDGES_B}, {_pagerank(6)} SELECT id, round(r, 6) AS rank FROM r6"
ORACLE["centrality_tiers"] = f"""WITH {X.EDGES_B}, {CLUSTER}, {_pagerank(6)}, dd AS (SELECT id, count(*) AS degree FROM ends GROUP BY id), j AS (SELECT id, r, degree, clustering FROM r6 JOIN dd USING (id) JOIN cl USING (id)),
z AS (SELECT id, """ + " + ".join(f"{w} * CASE WHEN stddev_pop({c}) OVER () < 1e-10 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END" for w, c in ((0.5, "r"), (0.3, "degree"), (0.2, "clustering"))) + f" AS raw FROM j), y AS (SELECT id, round(raw, 9) AS score FROM z) SELECT id, round(score, 6) AS score, {TIERED.format('score', 'y')} AS tier FROM y"
ORACLE["bounded_cycles"] = f"WITH {X.EDGES_B}, c AS (SELECT 1 AS length FROM b WHERE source = target UNION ALL SELECT 2 FROM b x JOIN b y ON x.target = y.source AND y.target = x.source WHERE x.source < x.target UNION ALL SELECT 3 FROM b x JOIN b y ON x.target = y.source JOIN b z ON y.target = z.source AND z.target = x.source WHERE x.source < x.target AND x.source < y.target AND x.target <> y.target) SELECT length, count(*) AS n FROM c GROUP BY 1"
ORACLE["two_cycles"] = f"WITH {X.EDGES_B} SELECT source AS nodes FROM b WHERE source = target UNION ALL SELECT x.source || ',' || x.target FROM b x JOIN b y ON x.target = y.source AND y.target = x.source WHERE x.source < x.target"


def _search(seeds: int, neighbours: int, most: int) -> str:
    """The bounded breadth-first search, level by level; a level that is not the last adds a node at least."""
    out = f"""{DEG}, ad AS (SELECT source AS id, target AS nb, source || '>' || target AS epos FROM m UNION ALL SELECT target, source, source || '>' || target FROM m),
near AS MATERIALIZED (SELECT ad.id, nb, row_number() OVER (PARTITION BY ad.id ORDER BY degree DESC, epos) AS k FROM ad JOIN dg ON dg.id = nb QUALIFY k <= {neighbours}),
l0 AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM dg QUALIFY rank <= {seeds}), s0 AS MATERIALIZED (SELECT * FROM l0)"""
    for k in range(1, most - seeds + 1):
        out += f""", l{k} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY place) + (SELECT count(*) FROM s{k - 1}) AS rank FROM (SELECT nb AS id, min((l.rank, n.k)) AS place FROM l{k - 1} l JOIN near n ON n.id = l.id WHERE nb NOT IN (SELECT id FROM s{k - 1}) GROUP BY nb) QUALIFY rank <= {most}),
s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""
    return f"{out} SELECT id, rank FROM s{most - seeds}"


ORACLE["readable_subgraph"] = f"WITH {X.TRIPLES_A}, {_search(5, 3, 40)}"
ORACLE["reachability"] = f"WITH RECURSIVE {X.EDGES_B}, w(id, hops) AS (SELECT 'N1', 0 UNION SELECT target, hops + 1 FROM w JOIN b ON b.source = w.id WHERE hops < 8) SELECT id, min(hops) AS hops FROM w GROUP BY id"
ORACLE["out_edges"] = f"WITH {X.TRIPLES_A} SELECT source AS id, string_agg(target || ':' || relation, ',' ORDER BY target) AS relations FROM m GROUP BY 1"

# merging

BN = "bn AS (SELECT DISTINCT book_id, label FROM (SELECT book_id, subject AS label FROM a UNION ALL SELECT book_id, object FROM a))"
EXACT = f"{BN}, ex AS (SELECT label, string_agg(book_id, ',' ORDER BY book_id) AS books FROM bn WHERE length(label) >= 2 GROUP BY label HAVING count(*) >= 2)"
ORACLE["exact_label_merge"] = f"WITH {X.TRIPLES_A}, {EXACT} SELECT label, books, 0.95::DOUBLE AS confidence FROM ex"
RB = "rb AS (SELECT source, target, relation, string_agg(book_id, ',' ORDER BY book_id) AS books FROM e GROUP BY 1, 2, 3)"
ORACLE["relation_conflicts"] = f"WITH {X.TRIPLES_A}, {RB} SELECT x.source, x.target, x.relation, x.books || ',' || y.books AS books, 0.5::DOUBLE AS confidence FROM rb x JOIN rb y ON x.source = y.target AND x.target = y.source AND x.relation = y.relation"
CONF = "cf AS (SELECT x.source, x.target, x.relation, x.books || ',' || y.books AS books FROM rb x JOIN rb y ON x.source = y.target AND x.target = y.source AND x.relation = y.relation WHERE x.source < x.target AND x.relation <> 'parallel')"
ORACLE["relation_conflicts_corrected"] = f"WITH {X.TRIPLES_A}, {RB}, {CONF} SELECT source, target, relation FROM cf"
COMP = "en AS (SELECT DISTINCT book_id, id FROM (SELECT book_id, source AS id FROM e UNION ALL SELECT book_id, target FROM e)), cp AS (SELECT e.book_id, n.book_id AS other, e.source, count(*) AS missing FROM e JOIN en n ON n.id = e.source AND n.book_id <> e.book_id WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.book_id = n.book_id AND f.source = e.source AND f.target = e.target) GROUP BY ALL)"
ORACLE["complements"] = f"WITH {X.TRIPLES_A}, {COMP} SELECT book_id, other, source, missing, 0.7::DOUBLE AS confidence FROM cp"
ORACLE["noise_stats"] = f"WITH {X.TRIPLES_A}, z AS (SELECT book_id, CASE subject WHEN 'Brand#1' THEN '12345' ELSE subject END AS s, object AS o FROM a) SELECT book_id, count(*) AS before, count(*) FILTER (s <> '12345') AS after, (SELECT count(DISTINCT s) FROM z y WHERE y.book_id = z.book_id AND s = '12345') AS noise_nodes, count(*) FILTER (s = '12345') AS removed FROM z GROUP BY book_id"
DEC = f"""{EXACT}, {RB}, {CONF}, {COMP}, al AS (SELECT 0 AS phase, 'merge' AS type, label AS nodes, label AS k, books, 0.95::DOUBLE AS confidence FROM ex
UNION ALL SELECT 1, 'conflict', source || ',' || target, source, array_to_string(list_sort(list_distinct(string_split(books, ','))), ','), 0.5 FROM cf UNION ALL SELECT 2, 'complement', source, source, book_id || ',' || other, 0.7 FROM cp),
dl AS (SELECT 'D' || lpad(CAST(row_number() OVER (PARTITION BY 1 ORDER BY phase, k, nodes, books) AS VARCHAR), 5, '0') AS decision_id, type, nodes, books, confidence FROM al)"""
ORACLE["decision_log"] = f"WITH {X.TRIPLES_A}, {DEC} SELECT * FROM dl"
ORACLE["merge_report"] = f"WITH {X.TRIPLES_A}, {DEC}, {BD}, {DEG}, r AS (SELECT (SELECT count(*) FROM e) AS edges_before, (SELECT count(*) FROM bd) AS nodes_before, (SELECT count(*) FROM m) AS edges_after, (SELECT count(*) FROM dg) AS nodes_after, count(*) FILTER (type = 'merge') AS n_merge, count(*) FILTER (type = 'conflict') AS n_conflict, count(*) FILTER (type = 'complement') AS n_complement FROM dl) SELECT *, round(1 - nodes_after / greatest(nodes_before, 1), 6) AS dedup_ratio FROM r"
FREE = "list_filter(o.named, lambda m: NOT list_contains(t.sure, m))"
SEMANTIC = f"""aq AS (SELECT chunk_id AS query_id, book_id AS b1, 'label' || chunk_id AS l1, lower(regexp_extract(content, '([A-Za-z]{{6,}})', 1)) AS term FROM docs WHERE chunk_id % 100 = 0 AND regexp_extract(content, '([A-Za-z]{{6,}})', 1) <> ''),
hs AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s FROM po JOIN aq USING (term) JOIN idf USING (term), st GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 10),
hh AS (SELECT b1, l1, chunk_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score, substr(content, 1, 500) AS head FROM hs JOIN aq USING (query_id) JOIN docs USING (chunk_id) QUALIFY score >= 0.7),
lb AS (SELECT DISTINCT book_id AS b2, lower(regexp_extract(content, '^([A-Za-z]+)', 1)) AS l2 FROM docs),
nm AS (SELECT b1, l1, chunk_id, score, list({{'b2': b2, 'l2': l2}} ORDER BY b2, l2) AS named FROM hh JOIN lb ON b2 > b1 AND length(l2) >= 4 AND contains(head, l2) AND l1 <> l2 GROUP BY ALL),
od AS (SELECT *, row_number() OVER (PARTITION BY b1, l1 ORDER BY score DESC, chunk_id) AS pos FROM nm),
took(b1, l1, pos, sure, pick, chunk_id, score) AS (SELECT b1, l1, 0::BIGINT, list_filter(named, lambda m: false), CASE WHEN false THEN named[1] END, NULL::BIGINT, NULL::DOUBLE FROM od WHERE pos = 1
 UNION ALL SELECT o.b1, o.l1, o.pos, CASE WHEN o.score >= 0.85 AND len({FREE}) > 0 THEN list_append(t.sure, {FREE}[1]) ELSE t.sure END, {FREE}[1], o.chunk_id, o.score FROM took t JOIN od o ON o.b1 = t.b1 AND o.l1 = t.l1 AND o.pos = t.pos + 1)"""
ORACLE["semantic_candidates"] = f"WITH RECURSIVE {BM25.format(kept='')}, {SEMANTIC} SELECT b1, l1, pick.b2 AS b2, pick.l2 AS l2, chunk_id FROM took WHERE pick IS NOT NULL QUALIFY row_number() OVER (PARTITION BY b1, l1, pick ORDER BY score DESC, chunk_id) = 1"
ORACLE["label_in_chunk_topk"] = f"""WITH {DOCS}, w AS (SELECT DISTINCT regexp_extract(regexp_extract(text, '(\\w+ \\w+ \\w+)', 1), '(\\w+)$', 1) AS label FROM benchmark), n AS (SELECT label, regexp_replace(label, '[\\d\\s|｜·…]+', '', 'g') AS needle FROM w), h AS (SELECT label, chunk_id, 1 - (strpos(content, needle) - 1) / length(content) AS score FROM n JOIN docs ON length(needle) >= 2 AND contains(content, needle))
SELECT label, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) AS rank FROM h QUALIFY rank <= 3"""
ORACLE["dedup_representatives"] = f"WITH {DOCS} SELECT CAST(chunk_id % 50 AS VARCHAR) AS decision_id, arg_max('n' || chunk_id, (length(content), -chunk_id)) AS representative, count(*) AS members FROM docs GROUP BY chunk_id % 50 HAVING count(*) >= 2"

# essence

PLAIN = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(content, '#+ ', '', 'g'), '\\*+', '', 'g'), '[│|]', '', 'g'), '[。；\\n]'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: length(x) > 5)"
COMPR = f"""{DOCS}, ps AS (SELECT *, length(content)::DOUBLE AS score, {PLAIN} AS s FROM docs), pr AS (SELECT *, list_filter(s, lambda x: length(x) > 8) AS long, list_filter(s, lambda x: regexp_matches(x, 'tion|ment'))[1:5] AS passages FROM ps),
rw AS (SELECT *, CASE WHEN len(long) > 0 THEN long[1] || '。' ELSE 'node ' || chunk_id END AS raw FROM pr), cs AS (SELECT chunk_id AS id, 'node ' || chunk_id AS label, {TIERED.format('score', 'ps')} AS tier, score, content, substr(raw, 1, 80) || CASE WHEN length(raw) > 80 THEN '…' ELSE '' END AS summary, passages FROM rw)"""
ORACLE["rule_summary"] = f"WITH {COMPR} SELECT id, summary FROM cs"
ORACLE["key_passages"] = f"WITH {COMPR} SELECT id, coalesce(array_to_string(passages, '|'), '') AS passages FROM cs"
ORACLE["essence_render"] = f"""WITH {COMPR}, rk AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS rank FROM cs), li AS (SELECT tier, rank, id, CASE WHEN tier >= 3 THEN ['- **' || label || '**: ' || substr(summary, 1, 60)] ELSE
 list_concat(list_concat(['### ' || rank || '. ' || label, '', '> ' || summary, ''], CASE WHEN tier = 1 AND content <> '' THEN list_concat(list_concat(['<details>', '<summary>📖 原文摘录</summary>', '', substr(content, 1, 300)], CASE WHEN length(content) > 300 THEN ['', '*(原文已截断)*'] ELSE [] END), ['', '</details>', '']) ELSE [] END), CASE WHEN tier = 2 AND len(passages) > 0 THEN list_append(list_transform(passages[1:2], lambda p: '- ' || substr(p, 1, 120)), '') ELSE [] END) END AS lines FROM rk)
SELECT tier, rank, id, len(lines) AS n, md5(array_to_string(lines, chr(10))) AS md5 FROM li"""
ORACLE["strict_budget"] = f"""WITH {DOCS}, l AS (SELECT chunk_id AS doc, k - 1 AS pos, regexp_replace(x[k], '\\s+$', '') AS line FROM (SELECT chunk_id, string_split(regexp_replace(content, '(?m)^(T)', '# T', 'g'), chr(10)) AS x FROM docs), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k)),
u AS (SELECT doc, pos, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY pos) AS used FROM l WHERE line = '' OR starts_with(line, '#') OR starts_with(line, '>') OR starts_with(line, '- [')) SELECT doc, pos, used FROM u WHERE used < 400"""
ORACLE["compression_stats"] = f"WITH {COMPR} SELECT count(*) AS nodes, round(avg((tier = 1)::INT), 6) AS core_coverage, sum(length(content)) AS original_chars, sum(length(summary)) AS compressed_chars, round(sum(length(summary)) / sum(length(content)), 6) AS ratio FROM cs"
ORACLE["tier_distribution"] = f"WITH {COMPR} SELECT tier, count(*) AS n FROM cs GROUP BY 1"
ORACLE["tier_samples"] = f"WITH {COMPR} SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS rank, id, round_even(score, 4) AS score, substr(summary, 1, 100) AS summary FROM cs QUALIFY rank <= 5"

# snapshot and feedback

NB = "nb AS (SELECT id, string_agg(DISTINCT book, ',' ORDER BY book) AS books FROM (SELECT id, unnest(string_split(books, ',')) AS book FROM (SELECT source AS id, books FROM m UNION ALL SELECT target, books FROM m)) GROUP BY id)"
ORACLE["snapshot_nodes"] = f"WITH {X.TRIPLES_A}, {DEC}, {DEG}, {NB} SELECT id, id AS name, least(26, degree + 7) AS val, CASE WHEN id IN (SELECT unnest(string_split(nodes, ',')) FROM dl) THEN 'merged' ELSE 'concept' END AS type, books FROM dg JOIN nb USING (id)"
SHOW = f"sh AS (SELECT DISTINCT id FROM (SELECT id, regexp_replace(id, '#0*', ' ') AS label FROM (SELECT source AS id FROM m UNION ALL SELECT target FROM m)) WHERE NOT {_noise(N.EXPORT, 'label')}), re AS (SELECT * FROM m WHERE source IN (SELECT id FROM sh) AND target IN (SELECT id FROM sh))"
ORACLE["snapshot_links"] = f"WITH {X.TRIPLES_A}, {SHOW} SELECT source, target, relation AS type, CASE relation WHEN 'prerequisite' THEN 'Prerequisite' WHEN 'parallel' THEN 'Parallel' WHEN 'containment' THEN 'Inclusion' ELSE 'Application' END AS label, books FROM re"
ORACLE["ranked_links"] = f"WITH {X.TRIPLES_A}, {DEG} SELECT source, target, relation, x.degree + y.degree AS weight FROM m JOIN dg x ON x.id = source JOIN dg y ON y.id = target ORDER BY (relation <> 'application')::INT, len(string_split(books, ',')) DESC, weight DESC, source, target LIMIT 60"
ORACLE["cytoscape_elements"] = f"""WITH {X.EDGES_B} SELECT 'node' AS kind, count(*) AS n, sum(length('{{"data":{{"id":"","label":""}}}}') + 2 * length(id)) AS chars FROM (SELECT DISTINCT id FROM ends)
UNION ALL SELECT 'edge', count(*), sum(length('{{"data":{{"id":"__","source":"","target":"","relation":"parallel"}}}}') + 2 * length(source) + 2 * length(target)) FROM b"""
ORACLE["graph_summary"] = f"WITH {X.TRIPLES_A}, {DEG}, {SHOW} SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM m) AS edges, (SELECT count(*) FROM re) AS visible"
ORACLE["feedback_upsert"] = "WITH f AS (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events WHERE event_type = 'click' GROUP BY 1) SELECT o_orderkey AS decision_id, o_orderstatus AS type, props AS teacher_feedback, CASE WHEN props IS NULL THEN 'open' ELSE 'reviewed' END AS status, props IS NOT NULL AS resolved FROM orders LEFT JOIN f ON user_id = o_orderkey"
ORACLE["windowed_counts"] = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
ORACLE["cache_miss"] = "WITH k AS (SELECT doc_id, substr(md5(source || coalesce(text, '')), 1, 12) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)"
RP = f"{X.REPLIES_SQL}, rp AS (SELECT i, CASE i % 9 WHEN 6 THEN 'ab' WHEN 7 THEN 'q' ELSE 's' END || w1 AS subject, CASE i % 9 WHEN 6 THEN 'contains' WHEN 7 THEN 'parallel' ELSE 'includes' END AS relation, CASE i % 9 WHEN 6 THEN 'cd' WHEN 7 THEN 'r' ELSE 't' END || w2 AS object FROM cw WHERE i % 9 >= 6)"
ORACLE["llm_json_parse"] = f"WITH {RP} SELECT i, subject, relation, object FROM rp"
SPOKEN = "['YES, ' || w1, 'no - ' || w1, 'Maybe NO ' || w1, 'It is YES ' || w1, 'unclear ' || w1, w1, '```json', 'x {\"subject\": \"q', '[not json {']"
ORACLE["verdict_parse"] = f"WITH {X.REPLIES_SQL}, v AS (SELECT i, upper(({SPOKEN})[i % 9 + 1]) AS t, upper(substr(({SPOKEN})[i % 9 + 1], 1, 10)) AS h FROM cw) SELECT i, starts_with(t, 'YES') OR (NOT starts_with(t, 'NO') AND contains(h, 'YES')) AS same, CASE WHEN starts_with(t, 'YES') THEN 0.75 WHEN starts_with(t, 'NO') THEN 0.85 WHEN contains(h, 'YES') THEN 0.7 WHEN contains(h, 'NO') THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM v"
ORACLE["llm_triples"] = f"WITH {RP}, z AS (SELECT i, '心肌细胞膜' || subject AS s, CASE relation WHEN 'parallel' THEN 'parallel' ELSE 'containment' END AS relation, object || '血管内皮细胞' AS o FROM rp) SELECT i, relation, o AS object FROM z WHERE NOT {_noise(N.BUILDER, 's')} AND NOT {_noise(N.BUILDER, 'o')}"

# engine, sources and sinks

ASK3 = f"""{BM25.format(kept=' WHERE chunk_id IN (SELECT vec_id FROM embeddings)')}, d3 AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {L2} AS distance FROM embeddings a, embeddings b WHERE b.vec_id IN (0, 1, 2) AND a.vec_id IN (SELECT chunk_id FROM docs)),
j3 AS (SELECT query_id, chunk_id, coalesce(score, 0) AS kw, distance FROM d3 LEFT JOIN sc USING (chunk_id)), f3 AS (SELECT query_id, chunk_id, 0.5 * (kw - min(kw) OVER w) / (max(kw) OVER w - min(kw) OVER w + 1e-6) + 0.5 * (1 - distance / (max(distance) OVER w + 1e-6)) AS score FROM j3 WINDOW w AS (PARTITION BY query_id))"""
ORACLE["engine_search"] = f"WITH {ASK3} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f3.score DESC, chunk_id) AS rank, chunk_id, 'books/' || book_id || '/c_' || chunk_id || '.md' AS path, round(f3.score, 6) AS score FROM f3 JOIN docs USING (chunk_id) QUALIFY rank <= 5"
ORACLE["rag_answer"] = f"""WITH {BM25.format(kept='')}, h AS (SELECT chunk_id, book_id, substr(substr(content, 1, 500) || '...', 1, 300) AS snippet, round_even(round(score, 9), 3) AS points, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN docs USING (chunk_id) QUALIFY rank <= 5)
SELECT '针对「with then that inthion of the ring」，检索到 ' || count(*) || ' 条相关段落。' || chr(10) || chr(10) || '（LLM 暂不可用，检索结果直出）：' || chr(10) || string_agg('- 《' || book_id || '》c_' || chunk_id || '_x: ' || substr(snippet, 1, 120) || '...', chr(10) ORDER BY rank) FILTER (rank <= 3) AS answer,
 string_agg(book_id || '|c_' || chunk_id || '_x|' || chunk_id || '|' || points, ',' ORDER BY rank) AS cited FROM h"""
ORACLE["compose_answer"] = f"WITH {X.NODES_P}, {X.TRIPLES_A.strip()}, b AS (SELECT *, CASE WHEN contains(name, 'ring') THEN 3 ELSE 1 END AS s FROM p WHERE contains({HAY}, 'ring') ORDER BY s DESC, val DESC, pos LIMIT 1), l AS (SELECT source, target FROM m, b WHERE source = book OR target = book ORDER BY source || '>' || target LIMIT 3) SELECT 'ring: ' || name || '. ' || reasoning || coalesce(' ' || (SELECT string_agg(source || ' -> ' || target, '; ' ORDER BY source || '>' || target) FROM l), '') AS answer FROM b"
ORACLE["markdown_files"] = f"WITH {X.MARKDOWN}, w AS (SELECT conv_id, string_agg(markdown, chr(10) || chr(10) ORDER BY idx) || chr(10) AS t FROM sections GROUP BY conv_id) SELECT 'book' || conv_id AS book_id, 'md' AS source_type, length(t) AS chars, md5(t) AS md5 FROM w"
ORACLE["chunk_files"] = f"WITH {DOCS} SELECT 'c' || chunk_id AS name, length(content) + 1 AS chars FROM docs WHERE length(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')) > 20"
ORACLE["book_chunk_choice"] = f"WITH {DOCS}, h AS (SELECT 'b' || (chunk_id % 97) AS book_id, count(*) AS n, sum(strlen(content)) AS bytes FROM docs GROUP BY 1), r AS (SELECT 'b' || page_id AS book_id, strlen(coalesce(html, '')) AS root FROM pages) SELECT book_id, n, root IS NOT NULL AND (n <= 3 OR root > 2 * bytes) AS virtual FROM h LEFT JOIN r USING (book_id)"
ORACLE["graph_files"] = f"WITH {X.TRIPLES_A} SELECT source, target, relation, books, confidence FROM m"
ORACLE["triple_files"] = f"WITH {X.TRIPLES_A} SELECT book_id, relation, count(*) AS n, count(DISTINCT subject) AS subjects FROM a WHERE book_id IN ('AF', 'RF') GROUP BY ALL"
ORACLE["feedback_log"] = "SELECT user_id AS decision_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(props, (ts, event_id)) AS feedback FROM events WHERE event_type = 'click' GROUP BY 1"
ORACLE["merged_checks"] = f"WITH {X.TRIPLES_A}, {DEG} SELECT count(*) AS nodes, count(*) FILTER (degree <= 1) AS orphans, (SELECT count(*) FROM m) AS edges, (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM (SELECT id FROM dg WHERE degree <= 1 ORDER BY id LIMIT 20)) AS examples, (SELECT count(*) FROM m x JOIN m y ON x.source = y.target AND x.target = y.source WHERE x.source < x.target AND x.relation = 'prerequisite' AND y.relation = 'prerequisite') AS cycles FROM dg"
ORACLE["tier_coverage"] = f"WITH {COMPR} SELECT tier, count(*) AS nodes, count(*) FILTER (id % 4 > 0 AND content <> '') AS mapped FROM cs GROUP BY 1"
ORACLE["induced_subgraph"] = f"WITH {X.EDGES_B}, k AS (SELECT id FROM ends GROUP BY id HAVING count(*) >= 40) SELECT source, target FROM b WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)"

ORACLE["clean_text_script"] = f"WITH {X.DOCUMENTS}, lit AS (SELECT i, {X.picked_sql(X.DIRTY, 'i')} || body AS t FROM dw) SELECT i, md5(" + _chain("replace(t, '�', '')", ("\\.{4,}", "..."), *ENDS) + ") AS clean FROM lit"
ORACLE["script_headings"] = f"""WITH {X.DOCUMENTS}, h AS (SELECT i, trim({X.picked_sql([*X.HEADS, "临床病例分析", "病例"], 'i')} || ' ' || word) AS t, 9 + i % 11 AS size, CASE WHEN i % 4 = 0 THEN 9 + i % 11 ELSE 15 END AS second FROM dw),
f AS (SELECT i, t, regexp_matches(t, '^(第[一二三四五六七八九十]+[章节]|绪论|前言)') AS a, regexp_matches(t, '^[一二三四五六七八九十]、') AS b, contains(t, '病例') AS c, CASE WHEN size <= 12 THEN 0 WHEN size >= 18 THEN 1 WHEN size >= second THEN 2 ELSE 3 END AS font FROM h)
SELECT i, CASE WHEN a THEN 1 WHEN b THEN 3 WHEN c THEN 0 ELSE font END AS level, CASE WHEN NOT a AND NOT b AND c THEN '### 💡 ' || t ELSE t END AS t FROM f"""
ORACLE["shown_sizes"] = """WITH n AS (SELECT page_id, strlen(coalesce(html, '')) AS b, strlen(coalesce(html, '')) * (10 ** (page_id % 5))::BIGINT AS z FROM pages), u AS (SELECT *, CASE WHEN z < 1 THEN 0 WHEN z >= 1024::BIGINT ** 4 THEN 4 WHEN z >= 1024 ** 3 THEN 3 WHEN z >= 1024 ** 2 THEN 2 WHEN z >= 1024 THEN 1 ELSE 0 END AS k FROM n)
SELECT page_id, CASE WHEN z < 1 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.2f', round(z / 1024.0::DOUBLE ** k, 2)), '0+$', ''), '\\.$', '') END || ' ' || (['Bytes', 'KB', 'MB', 'GB', 'TB'])[k + 1] AS size, printf('%.1f%%', (b % 1000) / 1000.0::DOUBLE * 100) AS share FROM u"""
ORACLE["active_report"] = f"""WITH {DOCS}, r AS (SELECT book_id, sum(length(content)) AS o, sum(least(length(content), 900)) AS c, max(chunk_id) % 2 = 0 AS s FROM docs GROUP BY 1), x AS (SELECT *, CASE WHEN s THEN c // 2 ELSE c END AS cc FROM r)
SELECT book_id, o AS original_chars, cc AS compressed_chars, round(cc / o, 6) AS ratio, round(c / o, 6) AS raw_ratio, round(cc / o, 6) <= 0.3 AS target_met, s AS strict FROM x"""
ORACLE["node_preview"] = f"WITH {DOCS} SELECT chunk_id, substr(content, 1, 200) AS chunk_content_preview FROM docs"
ORACLE["summary_prompts"] = f"""WITH {COMPR}, t AS (SELECT id, label, tier, content, list_filter(list_transform({PLAIN}, lambda x: x), lambda x: length(x) > 8 AND NOT starts_with(x, '图') AND NOT starts_with(x, '表'))[1:2] AS two FROM cs), z AS (SELECT *, CASE WHEN len(two) > 0 THEN array_to_string(two, '。') || '。' ELSE label END AS raw, regexp_replace(regexp_replace(' said ' || content || ' ', '^\\s+', ''), '\\s+$', '') AS said FROM t)
SELECT id, CASE WHEN tier < 4 AND content <> '' THEN md5(CASE WHEN tier <= 2 THEN '请用一句话（不超过80字）总结以下医学教材文本的核心知识点。知识点：' || label || chr(10) || chr(10) || '原文：' || chr(10) || substr(content, 1, 1500) || chr(10) || chr(10) || '摘要：' ELSE '用一句话概括：' || label || chr(10) || substr(content, 1, 500) || chr(10) || '摘要：' END) END AS prompt,
 CASE WHEN tier < 4 AND id % 3 = 0 THEN substr(said, 1, CASE WHEN tier <= 2 THEN 150 ELSE 100 END) WHEN tier = 4 THEN substr(raw, 1, 80) ELSE raw END AS summary FROM z"""
ORACLE["chunk_sample"] = f"WITH {DOCS} SELECT book_id, printf('c%09d', chunk_id) AS chunk_name, least(length(content), 2000) AS chars FROM docs WHERE length(content) >= 200 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY chunk_id) <= 5"
ORACLE["hit_content"] = f"WITH {BM25.format(kept='')} SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id, length(content) AS chars FROM sc JOIN docs USING (chunk_id) QUALIFY rank <= 10"
ORACLE["resolutions"] = "SELECT user_id AS decision_id, '教师反馈 (' || strftime(arg_max(ts, (ts, event_id)), '%Y-%m-%d %H:%M') || '): ' || substr(arg_max(props, (ts, event_id)), 1, 120) AS resolution FROM events WHERE event_type = 'click' GROUP BY 1"

#: Column types that the two engines name differently.
TYPES = {
    "INTEGER": {"bm25_topk": "rank", "vector_knn_l2": "rank", "chunk_filter": "chars", "natural_sort": "pos", "sentences": "k", "split_sections": "chars idx level", "section_manifest": "page_min page_max", "section_metadata": "idx", "chapter_chunks": "chars", "chunk_last_wins": "chars", "adjacent_parallel": "idx", "label_in_chunk_topk": "rank", "readable_subgraph": "rank", "engine_search": "query_id rank", "markdown_files": "chars", "chunk_files": "chars", "heading_levels": "level", "script_headings": "level", "chunk_sample": "chars", "hit_content": "rank chars", "essence_render": "rank n", "strict_budget": "pos", "tier_samples": "rank"},
    "BIGINT": {"section_manifest": "characters", "chapter_chunks": "part", "virtual_chunks": "part", "chunk_identity": "chunk_pos", "application_triples": "chunk_pos", "extract_triples": "n", "triple_files": "n subjects", "active_report": "original_chars compressed_chars", "feedback_log": "decision_id event_id", "strict_budget": "used", "compression_stats": "original_chars compressed_chars", "cytoscape_elements": "chars", "llm_json_parse": "i", "llm_triples": "i", "verdict_parse": "i"},
}
for _type, _of in TYPES.items():
    for _name, _columns in _of.items():
        ORACLE[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {_type}) AS {c}' for c in _columns.split())}) FROM ({ORACLE[_name]}) cast_{_type.lower()}"
