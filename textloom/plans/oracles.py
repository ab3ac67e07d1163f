"""DuckDB SQL for the core queries. Written apart from the Spark expressions: windows, recursion and lists instead of folds."""

from __future__ import annotations

from textloom.rules import DEFAULT_SITE, ERROR_SIGNS, IGNORED_EXTENSIONS, QUERY_PERSONAS, TRAINING_BOILERPLATE, TRAINING_ERROR_SIGNS, pdf_noise, persona_rules, web_boilerplate

SP = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def removed(x: str, patterns: list[str], options: str) -> str:
    for p in patterns:
        p = p.replace(r"\d", r"\p{Nd}").replace(r"\s", SP)
        x = f"regexp_replace({x}, {q(p)}, '', {q(options)})"
    return x


def any_of(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def first_of(x: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, n)} THEN {q(k)}" for k, n in rules) + f" ELSE {default} END"


def deduped(source: str, key: str, expression: str) -> str:
    """Lines of an expression without blanks and neighbouring repeats, by windows over exploded lines."""
    return f"""
WITH src AS (SELECT {key}, {expression} AS t FROM {source}),
lines AS (SELECT {key}, unnest(regexp_split_to_array(t, '{LINES}')) AS raw, generate_subscripts(regexp_split_to_array(t, '{LINES}'), 1) AS ix FROM src WHERE t IS NOT NULL),
bare AS (SELECT *, {strip("raw")} AS b FROM lines),
lagged AS (SELECT *, lag(b) OVER (PARTITION BY {key} ORDER BY ix) AS before FROM bare WHERE b <> ''),
joined AS (SELECT {key}, string_agg(raw, chr(10) ORDER BY ix) AS t FROM lagged WHERE before IS NULL OR before <> b GROUP BY {key})
SELECT src.{key}, CASE WHEN src.t IS NULL THEN NULL ELSE coalesce({strip("joined.t")}, '') END AS clean FROM src LEFT JOIN joined USING ({key})
"""


ERR = f"({any_of('lower(coalesce(title, ' + q('') + '))', ERROR_SIGNS)} OR {any_of('left(lower(coalesce(text, ' + q('') + ')), 200)', ERROR_SIGNS)})"
TRAIN_ERR = ERR.replace(f" OR contains(lower(coalesce(title, '')), {q(ERROR_SIGNS[-1])})", "").replace(f" OR contains(left(lower(coalesce(text, '')), 200), {q(ERROR_SIGNS[-1])})", "")
assert len(TRAINING_ERROR_SIGNS) == len(ERROR_SIGNS) - 1
ELIGIBLE = f"coalesce(length(text) BETWEEN 200 AND 3000 AND NOT {TRAIN_ERR} AND NOT {any_of('lower(text)', TRAINING_BOILERPLATE)}, false)"
AUTH = lambda u: f"regexp_extract({u}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"
PATH = lambda u: f"regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
HREFS = """coalesce(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), [])"""
WEB = "source_type IS NULL OR source_type <> 'pdf'"
# The matcher as a loop: keywords in order, one replaces the best if it scores higher than the best one's capped score.
FAQ = """
WITH kw AS (SELECT row_number() OVER (ORDER BY faq_ix, k) AS place, category, url, title, description, keyword FROM (SELECT faq_ix, category, url, title, description, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS k FROM faq_links) WHERE keyword <> ''),
hit AS (
  SELECT chat_id, place, category, keyword, url, title, description,
    length(keyword)::DOUBLE / greatest(length(lower(question)), length(keyword)) + CASE WHEN contains(' ' || lower(question) || ' ', ' ' || keyword || ' ') OR starts_with(lower(question), keyword) OR ends_with(lower(question), keyword) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS raw
  FROM chat_log JOIN kw ON contains(lower(question), keyword)
), tried AS (
  SELECT chat_id, list({'raw': raw, 'best': 0.0::DOUBLE, 'category': category, 'keyword': keyword, 'url': url, 'title': title, 'description': description} ORDER BY place) AS l FROM hit GROUP BY chat_id
), looped AS (
  SELECT chat_id, list_reduce(list_prepend({'raw': 0.0::DOUBLE, 'best': 0.0::DOUBLE, 'category': '', 'keyword': '', 'url': '', 'title': '', 'description': ''}, l),
    lambda a, x: CASE WHEN x.raw > a.best THEN {'raw': x.raw, 'best': least(1.0::DOUBLE, x.raw), 'category': x.category, 'keyword': x.keyword, 'url': x.url, 'title': x.title, 'description': x.description} ELSE a END) AS m FROM tried
), best AS (SELECT chat_id, m.best AS score, m.category AS category, m.keyword AS keyword, m.url AS url, m.title AS title, m.description AS description FROM looped WHERE m.best >= 0.4)
"""
TREE = "list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x, i: {'t': x, 'i': i})"


def sections_of(pages: str) -> str:
    """CTEs that end in `found`: sections of a relation with page_id, url, html and markdown."""
    return rf"""
anchors AS (
  SELECT page_id, ix - 1 AS ix, regexp_extract(tag, '(?is)id="([^"]+)"', 1) AS anchor_id, trim(regexp_extract(tag, '(?is)>([^<]*)$', 1), ' ' || chr(9) || chr(10) || chr(13)) AS header_text, lower(regexp_extract(tag, '(?is)^<(h[1-6])', 1)) AS level
  FROM (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS ix FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\s[^>]*id="[^"]+"[^>]*>[^<]*') AS t FROM {pages} WHERE html IS NOT NULL))
),
first_anchor AS (SELECT page_id, header_text, arg_min(anchor_id, ix) AS anchor_id FROM anchors GROUP BY page_id, header_text),
anchored AS (SELECT DISTINCT page_id FROM anchors),
lines AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS ix FROM {pages} WHERE page_id IN (SELECT page_id FROM anchored)),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}{SP}+.') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ix) AS sec FROM lines),
secs AS (SELECT page_id, sec, arg_min(line, ix) AS head, {strip("string_agg(line, chr(10) ORDER BY ix)")} AS content FROM marked GROUP BY page_id, sec),
kept AS (SELECT page_id, sec, content, CASE WHEN sec > 0 THEN {strip("regexp_extract(head, '^#{1,6}" + SP + "+(.+)', 1)")} END AS title, CASE WHEN sec > 0 THEN 'h' || length(regexp_extract(head, '^(#{{1,6}})', 1)) END AS header_level FROM secs WHERE length(content) > 50),
found AS (
  SELECT k.page_id, CAST(row_number() OVER (PARTITION BY k.page_id ORDER BY sec) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY k.page_id) AS INTEGER) AS total_chunks, title AS section_header, content AS section_content,
    f.anchor_id AS anchor_id, CASE WHEN f.anchor_id IS NULL THEN url ELSE url || '#' || f.anchor_id END AS anchor_url, header_level
  FROM kept k JOIN {pages} p ON p.page_id = k.page_id LEFT JOIN first_anchor f ON f.page_id = k.page_id AND f.header_text = k.title
  UNION ALL SELECT page_id, 0, 1, NULL, markdown, NULL, url, NULL FROM {pages} WHERE length(markdown) > 0 AND page_id NOT IN (SELECT page_id FROM kept)
)"""


ORACLES: dict[str, str] = {
    "knn_topk_filtered": """
WITH v AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], q) AS dist FROM embeddings, v WHERE label IN (1, 2, 3))
SELECT CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, label, round(dist, 6) AS distance FROM d ORDER BY dist, vec_id LIMIT 5""",
    "knn_batch_topk": """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM d)
SELECT query_id, vec_id, CAST(n AS INTEGER) AS rank, round(dist, 6) AS distance FROM r WHERE n <= 5""",
    "persona_search_rows": """
SELECT count(*) FILTER (persona IN ('student', 'all')) AS exact_rows,
  count(*) FILTER (len(list_filter(string_split(persona, ','), lambda x: trim(x) IN ('student', 'all'))) > 0) AS split_rows, count(*) AS all_rows FROM combined_campus_data""",
    "chunk_fixed_rows": """
SELECT doc_id, CAST(s // 450 AS INTEGER) AS chunk_index, CAST(ceil(length(text) / 450.0) AS INTEGER) AS total_chunks, substring(text, s + 1, 500) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS s FROM documents WHERE text IS NOT NULL)""",
    "chunk_fixed_stats": """
WITH c AS (
  SELECT lang, substring(text, s + 1, 500) AS chunk FROM (SELECT lang, text, unnest(range(0, length(text), 450)) AS s FROM documents WHERE length(text) > 500)
  UNION ALL SELECT lang, text AS chunk FROM documents WHERE length(text) <= 500
) SELECT lang, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c GROUP BY lang""",
    "chunk_boundary_rows": rf"""
WITH RECURSIVE w AS (
  SELECT rec_id, text, 0 AS step, CAST(0 AS BIGINT) AS b, CASE WHEN 1000 < length(text) AND length(regexp_extract(substring(text, 801, 200), '(?s)^(.*)(?:[.!?] |\n)', 1)) > 0 THEN 801 + length(regexp_extract(substring(text, 801, 200), '(?s)^(.*)(?:[.!?] |\n)', 1)) ELSE 1000 END AS e
  FROM campus_pdfs WHERE length(text) > 1000
  UNION ALL
  SELECT rec_id, text, step + 1, e - 100, CASE WHEN e + 900 < length(text) AND length(regexp_extract(substring(text, CAST(e + 701 AS BIGINT), 200), '(?s)^(.*)(?:[.!?] |\n)', 1)) > 0 THEN e + 701 + length(regexp_extract(substring(text, CAST(e + 701 AS BIGINT), 200), '(?s)^(.*)(?:[.!?] |\n)', 1)) ELSE e + 900 END
  FROM w WHERE e - 100 < length(text)
), c AS (SELECT rec_id, step, {strip("substring(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))")} AS chunk FROM w)
SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY step) - 1 AS INTEGER) AS ix, chunk FROM c WHERE chunk <> ''
UNION ALL SELECT rec_id, 0 AS ix, text AS chunk FROM campus_pdfs WHERE length(text) <= 1000""",
    "stream_slices": """
SELECT chat_id, CAST(s // 50 AS INTEGER) AS ix, substring(answer, s + 1, 50) AS chunk FROM (SELECT chat_id, answer, unnest(range(0, length(answer), 50)) AS s FROM chat_log WHERE answer IS NOT NULL)""",
    "stream_event_rows": """
SELECT chat_id, 0 AS seq, 'start' AS event, '' AS data FROM chat_log
UNION ALL SELECT chat_id, CAST(s // 50 + 1 AS INTEGER), 'chunk', substring(answer, s + 1, 50) FROM (SELECT chat_id, answer, unnest(range(0, length(answer), 50)) AS s FROM chat_log WHERE answer IS NOT NULL)
UNION ALL SELECT chat_id, CAST(ceil(length(answer) / 50.0) + 1 AS INTEGER), 'complete', '' FROM chat_log WHERE answer IS NOT NULL
UNION ALL SELECT chat_id, 1, 'error', 'no answer' FROM chat_log WHERE answer IS NULL""",
    "adjacent_dedup": deduped("combined_campus_data", "rec_id", "text"),
    "clean_web_text": deduped(f"(SELECT * FROM combined_campus_data WHERE {WEB})", "rec_id", removed("coalesce(text, '')", web_boilerplate(DEFAULT_SITE), "gsi")),
    "clean_pdf_text": f"""
WITH s AS (SELECT rec_id, regexp_replace(regexp_replace({removed("text", pdf_noise(DEFAULT_SITE), "gi")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g') AS t FROM campus_pdfs),
l AS (SELECT rec_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS ix FROM s),
k AS (SELECT rec_id, string_agg(x, chr(10) ORDER BY ix) AS t FROM l WHERE NOT regexp_full_match({strip("x")}, '\\p{{Nd}}{{1,3}}') GROUP BY rec_id)
SELECT s.rec_id, CASE WHEN s.t IS NULL THEN NULL ELSE coalesce({strip("k.t")}, '') END AS clean FROM s LEFT JOIN k USING (rec_id)""",
    "page_text_rows": f"SELECT rec_id, coalesce(array_to_string(list_transform(list_filter({TREE}, lambda p: p.i % 2 = 1), lambda p: p.t), ' '), '') AS page_text FROM campus_pdfs WHERE text IS NOT NULL",
    "header_anchor_rows": "WITH " + sections_of("crawl_pages") + " SELECT a.page_id, CAST(ix AS INTEGER) AS ix, anchor_id, header_text, url || '#' || anchor_id AS anchor_url, level FROM anchors a JOIN crawl_pages USING (page_id)",
    "section_split": "WITH " + sections_of("crawl_pages") + " SELECT * FROM found",
    "index_chunk_rows": """
WITH k AS (SELECT *, coalesce(section_header, '') AS sh, coalesce(pdf_page, 0) AS pp FROM combined_campus_data WHERE text <> ''),
c AS (SELECT *, substring(text, s + 1, 500) AS document, CAST(s // 450 AS INTEGER) AS chunk_ix FROM (SELECT *, unnest(range(0, length(text), 450)) AS s FROM k WHERE length(text) > 500)
  UNION ALL SELECT *, 0 AS s, text AS document, 0 AS chunk_ix FROM k WHERE length(text) <= 500)
SELECT sha256(concat_ws('|', url, sh, CAST(pp AS VARCHAR), CAST(chunk_index AS VARCHAR), CAST(chunk_ix AS VARCHAR), md5(document))) AS chunk_id, chunk_ix, document, url, coalesce(anchor_url, url) AS anchor_url, title, sh AS section_header,
  coalesce(persona, 'all') AS persona, coalesce(source_type, 'web') AS source_type, coalesce(header_level, '') AS header_level, pp AS pdf_page FROM c""",
    "corpus_union": f"""
WITH b AS (SELECT 'web' AS d, title, text, NULL AS source_type, NULL AS pdf_page, page_scraped_at FROM combined_campus_data WHERE {WEB} UNION ALL SELECT 'pdf', title, text, source_type, pdf_page, NULL FROM campus_pdfs)
SELECT coalesce(source_type, 'web') AS kind, count(*) AS n, count(pdf_page) AS with_page, count(page_scraped_at) AS with_time FROM b WHERE NOT {ERR} GROUP BY 1""",
    "merge_stats": f"SELECT coalesce(source_type, 'web') AS source, count(*) FILTER (NOT {ERR}) AS kept, count(*) FILTER ({ERR}) AS filtered FROM combined_campus_data GROUP BY 1",
    "error_page_split": f"SELECT rec_id, {ERR} AS is_error FROM combined_campus_data",
    "train_eligible": f"SELECT rec_id FROM combined_campus_data WHERE {ELIGIBLE}",
    "dataset_profile": f"""
SELECT count(*) AS total, count(*) FILTER ({ELIGIBLE}) AS selected, count(*) FILTER ({ELIGIBLE} AND source_type = 'pdf') AS selected_pdf, count(*) FILTER ({ELIGIBLE} AND faq_category <> '') AS selected_faq,
  round(count(*) FILTER ({ELIGIBLE}) * 1.2::DOUBLE / 60, 4) AS minutes, round(count(*) FILTER ({ELIGIBLE}) * 0.02::DOUBLE, 4) AS cost FROM combined_campus_data""",
    "source_counts": "SELECT count(*) AS total, count(*) FILTER (coalesce(source_type, 'web') = 'web') AS web, count(*) FILTER (source_type = 'pdf') AS pdf FROM combined_campus_data",
    "ingest_counts": "SELECT count(*) AS entries, count(*) FILTER (coalesce(source_type, 'web') <> 'pdf') AS web, count(*) FILTER (source_type = 'pdf') AS pdf FROM combined_campus_data WHERE text <> ''",
    "crawl_counters": "SELECT count(*) FILTER (coalesce(success, false)) AS crawled, count(*) FILTER (NOT coalesce(success, false)) AS failed FROM crawl_pages",
    "coverage_by_persona": """
WITH t AS (SELECT *, text IS NOT NULL AND count(*) OVER (PARTITION BY text) > 1 AS copied FROM combined_campus_data)
SELECT persona, count(*) AS records, count(DISTINCT url) AS urls, count(*) FILTER (copied) AS copies, count(faq_category) AS faq FROM t GROUP BY persona""",
    "length_gates": "SELECT count(*) FILTER (length(text) > 100) AS pages, count(*) FILTER (length(text) >= 50) AS pdf_pages, count(*) FILTER (text <> '') AS with_text FROM combined_campus_data",
    "persona_tag": f"SELECT rec_id, {first_of('lower(url)', persona_rules(DEFAULT_SITE), q('all'))} AS tag FROM combined_campus_data",
    "faq_page_tag": """
WITH m AS (SELECT rec_id, arg_min(category, faq_ix) AS category FROM combined_campus_data c JOIN faq_links f ON contains(c.url, f.url) GROUP BY rec_id)
SELECT c.rec_id, m.category FROM combined_campus_data c LEFT JOIN m USING (rec_id)""",
    "question_persona": f"SELECT chat_id, {first_of('lower(question)', QUERY_PERSONAS, 'NULL')} AS tag FROM chat_log",
    "url_admission": f"""
SELECT rec_id, coalesce({any_of(AUTH("anchor_url"), list(DEFAULT_SITE.allowed))} AND NOT regexp_matches(lower({PATH("anchor_url")}), '\\.(?:{"|".join(IGNORED_EXTENSIONS)})$') AND NOT contains(anchor_url, '#'), false) AS admitted,
  {AUTH("anchor_url")} AS authority, split_part(anchor_url, '#', 1) AS page_url FROM combined_campus_data""",
    "pdf_deep_links": "SELECT rec_id, split_part(split_part(url, '#', 1), '?', 1) || '#page=' || pdf_page AS link, 'Page ' || pdf_page AS header, 'page-' || pdf_page AS anchor FROM campus_pdfs",
    "link_edges": f"SELECT page_id, CAST(ix - 1 AS INTEGER) AS ix, href, split_part(href, '#', 1) AS target FROM (SELECT page_id, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) AS ix FROM crawl_pages)",
    "crawl_reach": f"""
WITH RECURSIVE l AS (SELECT lower({AUTH("url")}) AS src, unnest({HREFS}) AS href FROM crawl_pages), e AS (SELECT DISTINCT src, lower({AUTH("href")}) AS dst FROM l WHERE src <> ''),
r(url, depth) AS (
  SELECT DISTINCT lower({AUTH("url")}), 0 FROM crawl_pages WHERE page_id <= 3 AND {AUTH("url")} <> ''
  UNION SELECT dst, depth + 1 FROM r JOIN e ON e.src = r.url WHERE dst <> '' AND depth < 60
) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url""",
    "new_links": f"""
SELECT DISTINCT split_part(href, '#', 1) AS url FROM (SELECT unnest({HREFS}) AS href FROM crawl_pages)
EXCEPT SELECT split_part(url, '#', 1) FROM crawl_pages WHERE url IS NOT NULL""",
    "faq_match": FAQ + "SELECT chat_id, category, keyword, round(score, 6) AS confidence FROM best",
    "faq_answers": FAQ + "SELECT chat_id, '**Quick Answer:**' || chr(10) || chr(10) || description || chr(10) || chr(10) || '**[Visit ' || title || '](' || url || ')**' || chr(10) || chr(10) || '*This is a high-confidence direct link (confidence: ' || CAST(round_even(score * 100, 0) AS INTEGER) || '%)*' || chr(10) AS answer FROM best",
    "source_extract": f"""
WITH l AS (SELECT rec_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM combined_campus_data WHERE contains(text, 'http')),
h AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY k) - 1 AS ix FROM l WHERE contains(x, 'http'))
SELECT rec_id, CAST(ix AS INTEGER) AS ix, 'http' || {strip("split_part(split_part(x, 'http', 2), ')', 1)")} AS url,
  CASE WHEN {strip("replace(split_part(x, 'http', 1), 'Source:', '')")} = '' THEN 'University Resource' ELSE {strip("replace(split_part(x, 'http', 1), 'Source:', '')")} END AS title FROM h""",
    "hit_format": """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, string_agg('Source: ' || coalesce(title, 'No Title') || CASE WHEN coalesce(source, '') <> '' THEN ' - ' || source ELSE '' END || chr(10) || 'Link: ' || coalesce(url, 'Unknown URL') || chr(10) || 'Content: ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY n) AS answer
FROM d JOIN documents ON doc_id = id WHERE n <= 5 GROUP BY query_id""",
    "cite_links": "SELECT rec_id, CASE WHEN coalesce(section_header, '') <> '' THEN '[' || title || ' - ' || section_header || '](' || anchor_url || ')' ELSE '[' || title || '](' || url || ')' END AS link FROM combined_campus_data",
    "hard_negative_rows": """
WITH s AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL),
n AS (SELECT a.id AS o, a.text AS own, b.text AS doc, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(b.v, a.v), b.id) AS r FROM s a, s b WHERE a.id % 20 = 0),
f AS (SELECT o, doc, row_number() OVER (PARTITION BY o ORDER BY r) AS k FROM n WHERE r <= 13 AND doc <> own AND length(doc) >= 100),
p AS (SELECT text AS doc, row_number() OVER (ORDER BY md5('pad' || id)) AS k FROM s),
pads AS (SELECT a.id AS o, p.doc, 100 + row_number() OVER (PARTITION BY a.id ORDER BY p.k) AS k FROM s a, p WHERE a.id % 20 = 0 AND p.k <= 12 AND p.doc <> a.text),
u AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k) AS j FROM (SELECT o, doc, k FROM f WHERE k <= 3 UNION ALL SELECT o, doc, k FROM pads))
SELECT o AS oracle_id, CAST(j - 1 AS INTEGER) AS ix, doc FROM u WHERE j <= 3""",
    "generation_prompts": """
SELECT raft_id, 'Title: ' || coalesce(title, '') || chr(10) || CASE WHEN coalesce(section_header, '') <> '' THEN 'Section: ' || section_header || chr(10) ELSE '' END
  || CASE WHEN source_type = 'pdf' THEN 'Source: PDF (Page ' || coalesce(CAST(pdf_page AS VARCHAR), 'unknown') || ')' || chr(10) ELSE '' END || 'Target Audience: ' || coalesce(persona, 'all') || chr(10) AS header,
  CASE WHEN distractors IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform(distractors, lambda x, i: chr(10) || 'Distractor ' || i || ':' || chr(10) || '\"\"\"' || left(x, 500) || '\"\"\"'), ''), '') END AS block FROM raft_dataset""".replace('\\"', '"'),
    "parse_outputs": "SELECT raft_id, CASE WHEN raft_id % 10 <> 0 THEN question END AS question, CASE WHEN raft_id % 10 <> 0 THEN thought_process END AS thought_process, CASE WHEN raft_id % 10 <> 0 THEN answer END AS answer FROM raft_dataset",
    "raft_rows": """
SELECT question, oracle, CAST(len(distractors) AS INTEGER) AS n_distractors, thought_process, answer, source_url, title, section_header, coalesce(persona, 'all') AS persona, coalesce(source_type, 'web') AS source_type,
  CASE WHEN source_type = 'pdf' THEN pdf_page END AS pdf_page FROM raft_dataset WHERE len(distractors) >= 2""",
    "prompt_rows": """
SELECT raft_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'You are a campus assistant. ' || chr(10) || 'Use the provided context to answer questions. Show your reasoning before the final answer.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)
  || 'Context: ' || array_to_string(list_transform(list_concat([oracle], list_slice(coalesce(distractors, []), 1, 3)), lambda d, i: 'Document ' || i || ':' || chr(10) || coalesce(d, 'None')), chr(10) || chr(10)) || chr(10) || 'Question: ' || coalesce(question, 'None')
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || '<|thought|>' || chr(10) || coalesce(thought_process, 'None') || chr(10) || '<|answer|>' || chr(10) || coalesce(answer, 'None') || '<|eot_id|><|end_of_text|>' AS text FROM raft_dataset""",
    "context_lists": "SELECT raft_id, CAST(generate_subscripts(list_concat([oracle], distractors), 1) - 1 AS INTEGER) AS ix, unnest(list_concat([oracle], distractors)) AS doc FROM raft_dataset WHERE distractors IS NOT NULL",
    "request_rows": f"SELECT chat_id, {strip('question')} AS question FROM chat_log WHERE length(question) BETWEEN 1 AND 1000 AND {strip('question')} <> ''",
    "session_questions": f"""
WITH x AS (SELECT session_key, min(chat_id) AS stop FROM chat_log WHERE lower({strip("question")}) IN ('exit', 'quit', 'q') GROUP BY 1)
SELECT chat_id FROM chat_log c LEFT JOIN x ON c.session_key IS NOT DISTINCT FROM x.session_key WHERE question IS NOT NULL AND (stop IS NULL OR chat_id < stop)""",
    "page_numbers": "SELECT pdf_key, CAST(unnest(range(0, n)) AS INTEGER) AS page_no FROM (SELECT pdf_key, max(total_pages) AS n FROM campus_pdfs GROUP BY 1)",
    "stripped_titles": f"SELECT rec_id, CASE WHEN coalesce({strip('title')}, '') = '' THEN 'No Title' ELSE {strip('title')} END AS title FROM combined_campus_data",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
}
ORACLES["streamed_chunks"] = ORACLES["index_chunk_rows"].replace("combined_campus_data", "campus_pdfs").replace("SELECT sha256", "SELECT DISTINCT sha256").split(", coalesce(anchor_url")[0] + ", pp AS pdf_page FROM c"

CLEAN_PAGES = f"""
cleaned AS ({deduped("crawl_pages", "page_id", removed("coalesce(markdown, '')", web_boilerplate(DEFAULT_SITE), "gsi"))}),
pages AS (SELECT p.page_id, p.url, p.html, p.metadata, c.clean AS markdown FROM crawl_pages p JOIN cleaned c USING (page_id) WHERE coalesce(p.success, false) AND length(c.clean) > 100),
{sections_of("pages")}"""
VALUE = lambda key, default: f"CASE WHEN list_contains(map_keys(metadata), '{key}') THEN metadata['{key}'] ELSE '{default}' END"
JOINED = lambda base, href: f"CASE WHEN regexp_matches({href}, '^[a-z]+://') THEN {href} WHEN starts_with({href}, '/') THEN regexp_extract({base}, '^([a-z]+://[^/]*)', 1) || {href} ELSE regexp_extract({base}, '^([a-z]+://[^/]*)', 1) || regexp_replace(regexp_extract({base}, '^[a-z]+://[^/]*(.*)$', 1), '[^/]*/?[^/]*$', '') || CASE WHEN regexp_extract({base}, '^[a-z]+://[^/]*(.*)$', 1) LIKE '/%/%' THEN '' ELSE '/' END || regexp_replace({href}, '^\\.\\./', '') END"  # noqa: E731  # of absolute links, paths and ../
ADMITTED = lambda u: f"({any_of(AUTH(u), list(DEFAULT_SITE.allowed))} AND NOT regexp_matches(lower({PATH(u)}), '\\.(?:{'|'.join(IGNORED_EXTENSIONS)})$') AND NOT contains({u}, '#'))"
ORACLES |= {
    "web_section_records": f"""
WITH {CLEAN_PAGES},
quick AS (SELECT page_id, arg_min(category, faq_ix) AS category FROM pages JOIN faq_links f ON contains(pages.url, f.url) GROUP BY page_id)
SELECT {VALUE("title", "No Title")} AS title, section_header, section_content AS text, p.url, anchor_url, anchor_id, header_level, {first_of("lower(p.url)", persona_rules(DEFAULT_SITE), q("all"))} AS persona, q.category AS faq_category, chunk_index, total_chunks, {VALUE("scraped_at", "")} AS page_scraped_at
FROM found f JOIN pages p ON p.page_id = f.page_id LEFT JOIN quick q ON q.page_id = f.page_id""",
    "crawl_report": f"""
WITH {CLEAN_PAGES},
c AS (SELECT count(*) FILTER (coalesce(success, false)) AS crawled, count(*) FILTER (NOT coalesce(success, false)) AS failed FROM crawl_pages), n AS (SELECT count(*) AS sections FROM found)
SELECT crawled, failed, sections, round(sections / greatest(crawled, 1), 4) AS per_page, CASE WHEN failed > 0 THEN 1 ELSE 0 END AS exit_status FROM c, n""",
    "pdf_chunk_records": f"""
WITH RECURSIVE tidy AS ({ORACLES["clean_pdf_text"]}), cleaned AS (SELECT rec_id, clean AS text FROM tidy WHERE length(clean) >= 50),
{ORACLES["chunk_boundary_rows"].replace("campus_pdfs", "cleaned").replace("WITH RECURSIVE", "", 1).replace(")\nSELECT rec_id, CAST(row_number()", "),\nall_chunks AS (SELECT rec_id, CAST(row_number()")})
SELECT p.title, 'Page ' || pdf_page AS section_header, a.chunk AS text, p.url, split_part(split_part(url, '#', 1), '?', 1) || '#page=' || pdf_page AS anchor_url, 'page-' || pdf_page AS anchor_id, 'pdf' AS source_type, pdf_page, total_pages,
  ix AS chunk_index, CAST(count(*) OVER (PARTITION BY a.rec_id) AS INTEGER) AS total_chunks_on_page, coalesce(persona, 'all') AS persona, coalesce(priority, 'medium') AS priority, pdf_key, pdf_filename FROM all_chunks a JOIN campus_pdfs p USING (rec_id)""",
    "link_targets": f"""
WITH h AS (SELECT page_id, url, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) - 1 AS ix FROM crawl_pages)
SELECT page_id, CAST(ix AS INTEGER) AS link_ix, split_part({JOINED("url", "href")}, '#', 1) AS target FROM h""",
    "generation_prompt_length": """
SELECT raft_id, length('Write one training example for retrieval-augmented answering. The ORACLE holds the answer, the DISTRACTORS do not.' || chr(10) || chr(10) || 'Document metadata:' || chr(10) || header || chr(10) || 'ORACLE:' || chr(10) || '\"\"\"' || oracle || '\"\"\"' || chr(10) || chr(10) || 'DISTRACTORS:' || chr(10) || block
  || chr(10) || chr(10) || 'Return one JSON object without code fences, with the keys "question" (what a real ' || coalesce(persona, 'all') || ' would ask and only the oracle answers), "thought_process" (why the oracle answers it and each distractor does not) and "answer" (short, from the oracle only).' || chr(10)) AS chars
FROM (""".replace('\\"', '"') + ORACLES["generation_prompts"] + ") JOIN raft_dataset USING (raft_id)",
    "response_metadata": """
WITH m AS (SELECT chat_id, unnest(map_entries(metadata)) AS e FROM chat_log WHERE metadata IS NOT NULL)
SELECT chat_id, e.key AS key, e.value AS value FROM m WHERE e.key <> 'processing_time' UNION ALL SELECT chat_id, 'processing_time', CAST(round((chat_id % 1000)::DOUBLE / 300, 2) AS VARCHAR) FROM chat_log""",
    "crawl_loop": f"""
WITH RECURSIVE stored AS (SELECT page_id % (SELECT count(*) FROM crawl_pages) AS k, coalesce(success, false) AS success, {HREFS} AS hrefs FROM crawl_pages),
loop AS (
  SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS crawled, (SELECT list(url ORDER BY page_id) FROM (SELECT url, min(page_id) AS page_id FROM crawl_pages WHERE page_id <= 3 AND url IS NOT NULL GROUP BY url)) AS queue
  UNION ALL
  SELECT i + 1, crawled + CASE WHEN s.success THEN 1 ELSE 0 END,
    CASE WHEN s.success THEN list_reduce(list_prepend(queue, list_transform(list_filter(list_transform(s.hrefs, lambda h: split_part({JOINED("queue[i]", "h")}, '#', 1)), lambda u: {ADMITTED("u")}), lambda u: [u])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) ELSE queue END
  FROM loop JOIN stored s ON s.k = CAST('0x' || left(md5(queue[i]), 8) AS BIGINT) % (SELECT count(*) FROM crawl_pages)
  WHERE i <= len(queue) AND crawled < 40
), last AS (SELECT queue, i FROM loop ORDER BY i DESC LIMIT 1), done AS (SELECT unnest(list_slice(queue, 1, i - 1)) AS url FROM last)
SELECT url, s.success FROM done JOIN stored s ON s.k = CAST('0x' || left(md5(url), 8) AS BIGINT) % (SELECT count(*) FROM crawl_pages)""",
    "training_report": "SELECT count(thought_process) AS generated, count(*) - count(thought_process) AS skipped, round(count(thought_process) * 0.02::DOUBLE, 2) AS cost FROM raft_dataset",
    "persona_knn_topk": """
WITH v AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id, persona, list_distance(embedding::DOUBLE[], q) AS dist FROM documents JOIN embeddings ON doc_id = vec_id, v WHERE persona IN ('student', 'all'))
SELECT CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, persona, round(dist, 6) AS distance FROM d ORDER BY dist, vec_id LIMIT 5""",
    "pdf_hits": """
SELECT rec_id, 'Source: ' || coalesce(title, 'No Title') || CASE WHEN coalesce(section_header, '') <> '' THEN ' - ' || section_header ELSE '' END || CASE WHEN coalesce(source_type, 'web') = 'pdf' AND coalesce(pdf_page, 0) <> 0 THEN ' (PDF Page ' || pdf_page || ')' ELSE '' END
  || chr(10) || 'Link: ' || coalesce(anchor_url, url, 'Unknown URL') || chr(10) || 'Content: ' || coalesce(text, '') || chr(10) || chr(10) AS hit FROM campus_pdfs""",
    "citation_lists": "SELECT chat_id, '### Sources & Quick Links' || chr(10) || array_to_string(list_transform(sources, lambda s: '- [' || s['title'] || '](' || s['url'] || ')'), chr(10)) AS list FROM chat_log WHERE len(sources) > 0",
    "command_prefixes": "SELECT chat_id, CASE left(lower(question), 1) WHEN 'c' THEN '/clone' WHEN 'p' THEN '/page' WHEN 'i' THEN '/improve' WHEN 'w' THEN '/what' WHEN 'h' THEN '/how' WHEN '' THEN '/clone' END AS command FROM chat_log",
    "message_histories": "SELECT chat_id, 'user' AS role, question AS content, 0 AS n_sources FROM chat_log UNION ALL SELECT chat_id, 'assistant', answer, CAST(coalesce(len(sources), 0) AS INTEGER) FROM chat_log",
    "pdf_catalogue_rows": f"""
SELECT * FROM (VALUES ('undergraduate_catalog', 'https://catalog.{DEFAULT_SITE.domain}/content.php?catoid=49&navoid=2687&print', 'Undergraduate Catalog 2025-2026', 'prospective,student', 'critical'),
  ('graduate_catalog', 'https://catalog.{DEFAULT_SITE.domain}/content.php?catoid=50&navoid=2688&print', 'Graduate Catalog 2025-2026', 'prospective,student', 'critical')) t(pdf_key, url, title, persona, priority)""",
    "json_strict_rows": "SELECT raft_id, question, oracle, thought_process, answer, source_url, title, section_header, persona, coalesce(source_type, 'web') AS source_type, pdf_page, CAST(len(distractors) AS INTEGER) AS n_distractors FROM raft_dataset",
    "json_drop_rows": "SELECT question, answer, CAST(len(distractors) AS INTEGER) AS n_distractors FROM raft_dataset WHERE raft_id % 7 <> 0",
    "json_absent_rows": "SELECT rec_id, url, CASE WHEN rec_id % 3 = 0 THEN url WHEN rec_id % 5 <> 0 THEN anchor_url END AS anchor_url, CASE WHEN rec_id % 3 = 0 THEN 'all' WHEN rec_id % 5 <> 0 THEN persona END AS persona FROM combined_campus_data",
    "missing_file_rows": "SELECT question, answer FROM raft_dataset WHERE false",
    "fallback_path_rows": "SELECT faq_ix, category FROM faq_links",
    "resumed_rows": "SELECT chat_id, question FROM chat_log",
    "stored_index_rows": "SELECT chunk_id, chunk_ix, document, pdf_page FROM (" + ORACLES["index_chunk_rows"] + ") WHERE source_type = 'pdf'",
    "sitemap_urls": "SELECT url FROM crawl_pages WHERE url IS NOT NULL",
    "fetched_pages": "SELECT DISTINCT url, CASE WHEN url NOT LIKE '%3' THEN '<p>' || url || '</p>' END AS html, url NOT LIKE '%3' AS success, CASE WHEN url NOT LIKE '%3' THEN '200' END AS status FROM crawl_pages WHERE url IS NOT NULL",
    "pdf_downloads": "SELECT DISTINCT pdf_key AS key, true AS ok, false AS cached_first, true AS cached_second FROM campus_pdfs WHERE pdf_key IS NOT NULL AND url IS NOT NULL",
    "pdf_page_rows": """
WITH f AS (SELECT pdf_key, min(url) AS title, CAST(length(min(url)) % 5 + 1 AS INTEGER) AS page_count FROM campus_pdfs WHERE pdf_key IS NOT NULL AND url IS NOT NULL GROUP BY pdf_key)
SELECT pdf_key, page_count, title, 'office' AS author, CAST(n AS INTEGER) AS page_no, 'page ' || n AS page_text FROM (SELECT *, unnest(range(0, page_count)) AS n FROM f)""",
}
