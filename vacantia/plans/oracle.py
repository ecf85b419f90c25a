"""The same queries as plain SQL over the same tables, for comparison with another engine.

Written independently of the DataFrame jobs: folds over lists instead of native chunking, a join on word
buckets instead of matrix products, window functions without bounds.
"""

from __future__ import annotations

from vacantia.functions import rules
from vacantia.plans import catalog
from vacantia.sources import adapters

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"


def quote(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(options: list, number: str) -> str:
    return f"([{', '.join(quote(o) for o in options)}])[({number}) % {len(options)} + 1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def clean(x: str) -> str:
    return f"nullif({collapse(x)}, '')"


def trimmed(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def title_case(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda p: upper(p[1:1]) || p[2:]), '')"


def rnd(x: str, digits: int = 4) -> str:
    """Half-even rounding of the value's ten-digit decimal, in integers."""
    unit = 10 ** (10 - digits)
    v = f"abs(CAST(CAST({x} AS DECIMAL(20,10)) * 10000000000 AS BIGINT))"
    up = f"CASE WHEN {v} % {unit} > {unit // 2} OR ({v} % {unit} = {unit // 2} AND ({v} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"((CASE WHEN {x} < 0 THEN -1 ELSE 1 END) * ({v} // {unit} + {up}))::DOUBLE / {10 ** digits}"


def regex(phrases: list[str]) -> str:
    return "|".join("".join(c if c.isalnum() or c in " _" else "\\" + c for c in p) for p in phrases)


def whole(phrases: list[str]) -> str:
    return f"(^|{NOT_WORD})({regex(phrases)})($|{NOT_WORD})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{NOT_WORD}+'), lambda w: w <> '')"


def date_of(x: str) -> str:
    return (
        f"COALESCE(CAST(try_cast({x} AS TIMESTAMP) AS DATE), CAST(try_strptime({x}, '%m/%d/%Y') AS DATE), "
        f"CAST(try_strptime({x}, '%Y/%m/%d') AS DATE))"
    )


def seniority_synonym(x: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in rules.SENIORITY_SYNONYMS.items())
    return f"CASE lower({x}) {cases} ELSE {title_case(x)} END"


def seniority_rule(x: str) -> str:
    cases = []
    for rule in rules.SENIORITY_RULES:
        tests = [f"regexp_matches({x}, '{regex(rule['phrases'])}')"]
        if rule["words"]:
            tests.append(f"regexp_matches({x}, '{whole(rule['words'])}')")
        cases.append(f"WHEN {' OR '.join(tests)} THEN {quote(rule['label'])}")
    return f"CASE {' '.join(cases)} END"


def category_rule(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{regex(p)}') THEN {quote(c)}" for c, p in rules.ROLE_PHRASES.items())
    return f"CASE {cases} ELSE 'other' END"


def skill_list(x: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, '{whole(p)}') THEN {quote(s)} END" for s, p in rules.SKILL_LEXICON.items())
    return f"list_sort(list_filter([{cases}], lambda s: s IS NOT NULL))"


def hash_of(prefix: str = "") -> str:
    fields = ["category", "company", "date_posted", "description", "location", "seniority", "title", "url"]
    parts = [f"COALESCE(length({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || chr(124) || '.join(parts)})"


def bucket_number(x: str) -> str:
    return f"('0x' || md5({x})[1:3])::BIGINT + 1 + (row_number() OVER (PARTITION BY md5({x})[1:3] ORDER BY {x}) - 1) * 4096"


SHARED = "(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END)::VARCHAR"
NOW = f"TIMESTAMP '{catalog.NOW}'"
EARLIER = f"TIMESTAMP '{catalog.EARLIER}'"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def build(select: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + select


cte("raw", [], f"""
SELECT doc_id AS ordinal, doc_id::VARCHAR AS job_id, source AS company_name, {pick(adapters.TITLES, 'doc_id')} AS title,
  text AS description, {pick(adapters.LOCATIONS, 'doc_id')} AS location, {pick(adapters.LEVELS, 'doc_id')} AS level,
  CASE WHEN doc_id % 7 = 0 THEN (1700000000000 + doc_id * 3600000)::VARCHAR ELSE {pick(adapters.TIMES, 'doc_id')} END AS listed,
  CASE WHEN doc_id % 13 <> 5 THEN 'https://jobs.example.com/' || {SHARED} END AS job_posting_url,
  CASE WHEN doc_id % 26 <> 5 THEN 'https://apply.example.com/' || {SHARED} END AS application_url,
  {pick(adapters.SKILL_PHRASES, 'doc_id')} AS skills_desc
FROM documents""")
cte("raw_skills", [], f"""
SELECT job_id, {clean('w')} AS skill FROM (
  SELECT doc_id::VARCHAR AS job_id, unnest(string_split_regex(concat_ws(' ', p, p), '[ ,;.]')) AS w
  FROM (SELECT doc_id, {pick(adapters.SKILL_PHRASES, 'doc_id')} AS p FROM documents))""")
cte("skill_text", ["raw_skills"], """
SELECT job_id, string_agg(skill, ', ' ORDER BY skill) AS skills_text
FROM (SELECT DISTINCT job_id, skill FROM raw_skills WHERE skill IS NOT NULL) GROUP BY job_id""")
cte("raw_clean", ["raw", "skill_text"], f"""
SELECT ordinal, {clean('title')} AS title, {clean('company_name')} AS company, {clean('location')} AS location,
  level, {clean("concat_ws(' ', " + clean('description') + ', ' + clean('skills_desc') + ', ' + clean('skills_text') + ')')} AS description,
  CASE WHEN try_cast(listed AS DOUBLE) IS NOT NULL
    THEN DATE '1970-01-01' + CAST(floor(try_cast(listed AS DOUBLE) / 86400000) AS INTEGER)
    WHEN regexp_matches(listed, '[+-][0-9]{{2}}:[0-9]{{2}}$')
    THEN DATE '1970-01-01' + (epoch_us(try_cast(listed AS TIMESTAMPTZ)) // 86400000000)::INTEGER ELSE {date_of('listed')} END AS date_posted,
  COALESCE({clean('job_posting_url')}, {clean('application_url')}) AS url
FROM raw LEFT JOIN skill_text USING (job_id)""")
cte("classified", ["raw_clean"], f"""
SELECT *, {seniority_rule('level_title')} AS seniority, {category_rule("lower(COALESCE(title, ''))")} AS category,
  regexp_matches(lower(COALESCE(title, '')), '{regex(rules.TECH_TITLE_WORDS)}') AS is_tech
FROM (SELECT *, COALESCE(nullif(lower(concat_ws(' ', {clean('level')}, title)), ''), lower(description[1:400])) AS level_title FROM raw_clean)""")
cte("usable", ["classified"], """
SELECT * FROM classified WHERE title IS NOT NULL AND description IS NOT NULL AND url IS NOT NULL AND length(description) >= 120""")
cte("prepared", ["usable"], """
SELECT title, company, location, category, seniority, description, date_posted, url,
  row_number() OVER (ORDER BY date_posted DESC NULLS LAST, company NULLS LAST, title NULLS LAST, category = 'other', ordinal) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS n FROM usable)
WHERE n = 1 AND (category <> 'other' OR is_tech)""")

cte("snap", [], f"""
SELECT doc_id AS ordinal, {pick(adapters.TITLES, 'doc_id')} AS title, source AS company,
  {pick(adapters.LOCATIONS, 'doc_id')} AS location, lang AS category, {pick(adapters.LEVELS, 'doc_id')} AS seniority,
  concat_ws(' ', text, {pick(adapters.SKILL_PHRASES, 'doc_id')}) AS description,
  CASE WHEN doc_id % 7 = 0 THEN '2024-03-01' ELSE {pick(adapters.TIMES, 'doc_id')} END AS date_posted,
  CASE WHEN doc_id % 13 <> 5 THEN 'https://jobs.example.com/' || {SHARED} END AS url
FROM documents""")
NORMALIZE = f"""
SELECT *, {hash_of()} AS source_hash FROM (
SELECT ordinal, {trimmed('title')} AS title, {trimmed('company')} AS company,
  nullif({title_case(trimmed("split_part(" + trimmed('location') + ", ',', 1)"))}, '') AS location,
  lower({trimmed('category')}) AS category, {seniority_synonym(trimmed('seniority'))} AS seniority,
  {trimmed('description')} AS description, {date_of(trimmed('date_posted'))} AS date_posted, {trimmed('url')} AS url
FROM @)"""
VALIDATE = """
SELECT *, CASE WHEN url IS NULL THEN 'missing_url' WHEN title IS NULL THEN 'missing_title'
  WHEN COALESCE(length(description), 0) < 30 THEN 'short_description' END AS reject_reason FROM @"""
LAST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal DESC) AS n FROM @ WHERE reject_reason IS NULL) WHERE n = 1"""
cte("norm", ["snap"], NORMALIZE.replace("@", "snap"))
cte("checked", ["norm"], VALIDATE.replace("@", "norm"))
cte("incoming", ["checked"], LAST.replace("@", "checked"))
cte("old_snap", ["snap"], """
SELECT s.* REPLACE (CASE WHEN quality = 0 OR toxic = 1 THEN 'Draft. ' || s.description ELSE s.description END AS description)
FROM snap s JOIN labels ON doc_id = ordinal""")
cte("old_norm", ["old_snap"], NORMALIZE.replace("@", "old_snap"))
cte("old_checked", ["old_norm"], VALIDATE.replace("@", "old_norm"))
cte("old_last", ["old_checked"], LAST.replace("@", "old_checked"))
cte("stored", ["old_last"], f"""
SELECT {bucket_number('url')} AS id, title, company, location, category, seniority, description, date_posted, url,
  CASE WHEN NOT ends_with(url, '7') THEN source_hash END AS source_hash FROM old_last""")
cte("actions", ["incoming", "stored"], """
SELECT i.*, s.id, CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.source_hash IS DISTINCT FROM s.source_hash THEN 'updated' ELSE 'unchanged' END AS action
FROM incoming i LEFT JOIN stored s USING (url)""")
FIELDS = "title, company, location, category, seniority, description, date_posted, url"
cte("state", ["actions", "stored"], f"""
SELECT (SELECT COALESCE(max(id), 0) FROM stored) + {bucket_number('url')} AS id, {FIELDS}, source_hash, {NOW} AS ingested_at
FROM actions WHERE action = 'inserted'
UNION ALL SELECT id, {FIELDS}, source_hash, {NOW} FROM actions WHERE action = 'updated'
UNION ALL SELECT id, {FIELDS}, source_hash, {EARLIER} FROM stored
WHERE url NOT IN (SELECT url FROM actions WHERE action <> 'unchanged')""")

CLEANED = r"COALESCE(trim(regexp_replace(lower(description), '[^\p{L}\p{N}_\-./]+', ' ', 'g'), ' '), '')"
cte("jobs", ["norm"], f"""
SELECT *, {skill_list('cleaned')} AS skills FROM (SELECT ordinal AS id, {FIELDS}, {CLEANED} AS cleaned FROM norm)""")


def chunk_cte(name: str, source: str) -> None:
    """Passages by two list folds: merge short sentences, then pack."""
    cte(name + "_sentences", [source], rf"""
SELECT id, list_filter(string_split(regexp_replace({collapse("COALESCE(nullif(cleaned, ''), description)")}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS s
FROM {source} WHERE COALESCE(nullif(cleaned, ''), nullif(description, '')) IS NOT NULL""")
    cte(name + "_merged", [name + "_sentences"], f"""
SELECT id, CASE WHEN f.b = '' THEN f.m WHEN len(f.m) > 0 THEN f.m[1:len(f.m)-1] || [f.m[-1] || ' ' || f.b] ELSE [f.b] END AS e FROM (
SELECT id, list_reduce(list_transform(s, lambda x: {{'m': []::VARCHAR[], 'b': x}}),
  lambda a, x: CASE WHEN length(x.b) < {rules.MIN_SENTENCE_CHARS}
    THEN {{'m': a.m, 'b': CASE WHEN a.b = '' THEN x.b ELSE a.b || ' ' || x.b END}}
    ELSE {{'m': a.m || (CASE WHEN a.b = '' THEN [x.b] ELSE [a.b, x.b] END), 'b': ''}} END,
  {{'m': []::VARCHAR[], 'b': ''}}) AS f FROM {name}_sentences)""")
    cte(name + "_packed", [name + "_merged"], f"""
SELECT id, list_filter(f.c || CASE WHEN f.r = '' THEN []::VARCHAR[] ELSE [f.r] END, lambda x: length(x) >= {rules.MIN_CHUNK_CHARS}) AS c FROM (
SELECT id, list_reduce(list_transform(e, lambda x: {{'c': []::VARCHAR[], 'r': '', 'l': x}}),
  lambda a, x: CASE WHEN a.r = '' THEN {{'c': a.c, 'r': x.l, 'l': x.l}}
    WHEN length(a.r) + 1 + length(x.l) <= {rules.MAX_CHUNK_CHARS} THEN {{'c': a.c, 'r': a.r || ' ' || x.l, 'l': x.l}}
    ELSE {{'c': a.c || [a.r], 'r': a.l || ' ' || x.l, 'l': x.l}} END,
  {{'c': []::VARCHAR[], 'r': '', 'l': ''}}) AS f FROM {name}_merged)""")
    cte(name, [name + "_packed", source], f"""
SELECT id AS job_id, title, company, location, category, seniority, p.chunk_order, p.chunk_text, length(p.chunk_text)::INTEGER AS chunk_length
FROM (SELECT id, unnest(c) AS chunk_text, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_order FROM {name}_packed) p
JOIN {source} USING (id)""")


chunk_cte("chunks", "jobs")
cte("questions", [], f"""
SELECT item_id AS question_id, {strip(pick(["Which postings say: ", "What skills are needed: ", "", "What jobs mention "], 'item_id') + ' || text')} AS question,
  {pick(adapters.LANGS, 'item_id')} AS want_category, {pick([None, "Berlin", "new york"], 'item_id')} AS want_location
FROM benchmark""")


def weights(name: str, source: str, key: str, column: str) -> None:
    bucket = f"('0x' || md5(w)[1:6])::BIGINT % 256"
    cte(name, [source], f"""
SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS weight FROM (
SELECT {key}, {bucket} AS bucket, count(*) AS n FROM (SELECT {key}, unnest({words(column)}) AS w FROM {source}) GROUP BY ALL)""")


weights("question_weights", "questions", "question_id", "question")
weights("chunk_weights", "chunks", "job_id, chunk_order", "chunk_text")
cte("pairs", ["question_weights", "chunk_weights"], """
SELECT question_id, job_id, chunk_order, round(sum(q.weight * c.weight), 9) AS raw
FROM question_weights q JOIN chunk_weights c USING (bucket) GROUP BY ALL""")
cte("searched", ["pairs", "questions", "chunks"], f"""
SELECT *, {rnd('raw')} AS score, {rnd('overlap')} AS keyword_score FROM (
SELECT p.*, q.question, q.want_category, q.want_location, c.* EXCLUDE (job_id, chunk_order),
  len(list_intersect(list_distinct({words('q.question')}), list_distinct({words('c.chunk_text')})))
    / greatest(len(list_distinct({words('q.question')})), 1) AS overlap
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, job_id, chunk_order)::INTEGER AS rank FROM pairs) p
JOIN questions q USING (question_id) JOIN chunks c USING (job_id, chunk_order) WHERE rank <= {catalog.TOP_K * 4})""")
RERANK = f"""
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, rank)::INTEGER AS final_rank FROM (
SELECT *, {rnd('(0.8::DOUBLE * score + 0.2::DOUBLE * keyword_score)')} AS final_score FROM @)"""
cte("reranked", ["searched"], RERANK.replace("@", "searched"))
cte("kept", ["searched"], """
SELECT * FROM searched WHERE (want_category IS NULL OR want_category = lower(category))
  AND (want_location IS NULL OR lower(want_location) = lower(COALESCE(location, '')))""")
cte("kept_ranked", ["kept"], RERANK.replace("@", "kept"))
cte("hits", ["kept_ranked"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_rank)::INTEGER AS position
FROM (SELECT *, row_number() OVER (PARTITION BY question_id, job_id ORDER BY final_rank) AS n FROM kept_ranked) WHERE n = 1)
WHERE position <= {catalog.TOP_K}""")

cte("early", ["pairs", "questions", "chunks"], f"""
SELECT *, {rnd('raw')} AS score, {rnd('overlap')} AS keyword_score FROM (
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, job_id, chunk_order)::INTEGER AS rank FROM (
SELECT c.*, q.question_id, COALESCE(p.raw, 0) AS raw,
  len(list_intersect(list_distinct({words('q.question')}), list_distinct({words('c.chunk_text')})))
    / greatest(len(list_distinct({words('q.question')})), 1) AS overlap
FROM questions q JOIN chunks c ON (q.want_category IS NULL OR q.want_category = lower(COALESCE(c.category, '')))
  AND (q.want_location IS NULL OR lower(q.want_location) = lower(COALESCE(c.location, '')))
LEFT JOIN pairs p ON p.question_id = q.question_id AND p.job_id = c.job_id AND p.chunk_order = c.chunk_order))
WHERE rank <= {catalog.TOP_K * 4}""")
cte("early_ranked", ["early"], RERANK.replace("@", "early"))
cte("early_hits", ["early_ranked"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_rank)::INTEGER AS position
FROM (SELECT *, row_number() OVER (PARTITION BY question_id, job_id ORDER BY final_rank) AS n FROM early_ranked) WHERE n = 1)
WHERE position <= {catalog.TOP_K}""")

TERMS = r"regexp_extract_all(regexp_replace(regexp_replace(lower(chunk_text), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[a-zA-Z][a-zA-Z\-+.]+\b')"


def terms(group: str, source: str, order: str, n: int) -> str:
    stop = ", ".join(quote(w) for w in rules.TERM_STOPWORDS)
    return f"""
SELECT {group}, term, n, rank FROM (SELECT {group}, term, count(*) AS n,
  row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, min(({order}, spot)))::INTEGER AS rank
FROM (SELECT {group}, {order}, unnest({TERMS}) AS term, generate_subscripts({TERMS}, 1) AS spot FROM {source})
WHERE length(term) > 2 AND term NOT IN ({stop}) GROUP BY {group}, term) WHERE rank <= {n}"""


cte("question_kind", ["questions"], """
SELECT *, CASE WHEN q LIKE '%skill%' OR q LIKE '%common requirements%' OR q LIKE '%common qualifications%' THEN 'skills'
  WHEN q LIKE 'which%' OR q LIKE '%which jobs%' OR q LIKE '%what jobs%' THEN 'jobs' ELSE 'general' END AS question_type
FROM (SELECT *, lower(question) AS q FROM questions)""")
cte("hit_terms", ["hits"], terms("question_id", "hits", "position", 6))
cte("answers", ["question_kind", "hits", "hit_terms"], rf"""
SELECT question_id, question, question_type, CASE WHEN lines IS NULL THEN {quote(rules.NO_ANSWER)}
  WHEN question_type = 'skills' THEN COALESCE({quote(rules.TERMS_PREFIX)} || terms || '.' || chr(10), '') || {quote(rules.HEADER_EXAMPLES)} || chr(10) || lines
  WHEN question_type = 'jobs' THEN {quote(rules.HEADER_JOBS)} || chr(10) || lines ELSE {quote(rules.HEADER_GENERAL)} || chr(10) || lines END AS answer,
  'extractive' AS generation_mode, COALESCE(source_count, 0) AS source_count, COALESCE(job_count, 0) AS job_count
FROM question_kind LEFT JOIN (
  SELECT question_id, count(*) AS source_count, count(DISTINCT job_id) AS job_count,
    string_agg('- ' || COALESCE(title, 'None') || ' (' || COALESCE(location, 'None') || '): ' ||
      string_split(regexp_replace(chunk_text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))[1], chr(10) ORDER BY position) AS lines
  FROM hits GROUP BY question_id) USING (question_id)
LEFT JOIN (SELECT question_id, string_agg(term, ', ' ORDER BY rank) AS terms FROM hit_terms GROUP BY question_id) USING (question_id)""")
cte("answer_cases", ["answers"], f"""
SELECT *, {rnd("(len(matched) / greatest(len(expected), 1))", 3)} AS keyword_hit_rate FROM (
SELECT *, list_filter(expected, lambda k: contains(lower(answer), k)) AS matched FROM (
SELECT a.*, COALESCE(e.expected, []::VARCHAR[]) AS expected FROM answers a LEFT JOIN (
  SELECT question_id, list(w ORDER BY first_spot) AS expected FROM (SELECT question_id, w, min(spot) AS first_spot FROM (
    SELECT question_id, unnest({words('question')}) AS w, generate_subscripts({words('question')}, 1) AS spot FROM questions)
    WHERE length(w) >= 9 GROUP BY question_id, w) GROUP BY question_id) e USING (question_id)))""")

DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
cte("neighbours", [], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY raw DESC, candidate_id)::INTEGER AS rank FROM (
SELECT a.vec_id AS job_id, b.vec_id AS candidate_id, {DOT} AS raw FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 200""")
cte("scored", ["neighbours", "jobs"], """
SELECT n.*, list_sort(list_intersect(t.skills, c.skills)) AS shared, c.title, c.company, c.location, c.category, c.seniority, c.url,
  CASE WHEN len(t.skills) + len(c.skills) = 0 THEN 0.0 ELSE
    len(list_intersect(t.skills, c.skills)) / len(list_distinct(t.skills || c.skills)) END AS overlap,
  COALESCE(t.category, '') = COALESCE(c.category, '') AS same_category,
  COALESCE(t.seniority, '') = COALESCE(c.seniority, '') AS same_seniority
FROM neighbours n JOIN jobs t ON t.id = n.job_id JOIN jobs c ON c.id = n.candidate_id""")


def recommended(name: str, gates: str, limit: int) -> None:
    cte(name, ["scored"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, embedding_score DESC, len(shared) DESC,
  same_category DESC, same_seniority DESC, rank)::INTEGER AS position FROM (
SELECT *, {rnd('hybrid')} AS score, {rnd('raw')} AS embedding_score, {rnd('overlap')} AS skill_overlap_score FROM (
SELECT *, 0.7::DOUBLE * raw + 0.2::DOUBLE * overlap + 0.07::DOUBLE * same_category::INTEGER + 0.03::DOUBLE * same_seniority::INTEGER AS hybrid
FROM scored WHERE title IS NOT NULL AND {gates}))) WHERE position <= {limit}""")


recommended("top5", "TRUE", 5)
recommended("top10", "same_category AND len(shared) >= 1 AND raw >= 0.05", 10)
RECOMMENDED = """
SELECT candidate_id, job_id, score, embedding_score, skill_overlap_score, array_to_string(shared, ',') AS shared_skills,
  same_category, same_seniority, position, title, company, location, category, seniority, url FROM @"""
cte("recommendation_cases", ["top5", "jobs"], """
SELECT id AS job_id, title AS target_title, len(skills)::INTEGER AS target_skill_count,
  (SELECT count(*) FROM top5 r WHERE r.job_id = j.id) AS recommendation_count,
  (SELECT count(*) FROM top5 r WHERE r.job_id = j.id AND len(shared) > 0) AS shared_skill_recommendations
FROM jobs j WHERE len(skills) > 0 AND id IN (SELECT vec_id FROM embeddings)""")
cte("run_log", [], """
SELECT event_id AS id, event_type || '_stage' AS pipeline_name,
  CASE WHEN event_type = 'error' OR value > 100 THEN 'failed' ELSE 'success' END AS status,
  (props->>'$.k')::BIGINT AS output_rows, ts AS started_at, ts + to_microseconds(floor(value * 1000000)::BIGINT) AS finished_at
FROM events""")
cte("stages", ["norm"], """
SELECT ordinal AS id, ordinal IN (SELECT doc_id FROM labels) AS done, ordinal IN (SELECT vec_id FROM embeddings) AS embedded FROM norm""")

cte("ingest_counts", ["checked", "actions"], """
SELECT (SELECT count(*) FROM checked) AS input_rows, count(*) FILTER (action = 'inserted') AS inserted_rows,
  count(*) FILTER (action = 'updated') AS updated_rows, count(*) FILTER (action = 'unchanged') AS unchanged_rows,
  count(*) FILTER (action <> 'unchanged') AS changed_rows,
  (SELECT count(*) FROM checked WHERE reject_reason IS NOT NULL) AS skipped_rows,
  (SELECT count(*) FROM checked WHERE reject_reason = 'missing_url') AS missing_url,
  (SELECT count(*) FROM checked WHERE reject_reason = 'missing_title') AS missing_title,
  (SELECT count(*) FROM checked WHERE reject_reason = 'short_description') AS short_description,
  (SELECT count(*) FROM checked WHERE reject_reason IS NULL) - count(*) AS duplicate_rows
FROM actions""")
cte("state_jobs", ["state"], f"""
SELECT *, {skill_list('cleaned')} AS skills FROM (SELECT id, {FIELDS}, {CLEANED} AS cleaned FROM state)""")
chunk_cte("state_chunks", "state_jobs")
PROCESS = f"""
SELECT count(*) AS processed_jobs, count(*) FILTER (len(skills) = 0) AS jobs_without_skills,
  count(*) FILTER (cleaned = '') AS empty_cleaned_description, {rnd('avg(len(skills))', 3)} AS avg_skills_per_job FROM @"""
cte("process_counts", ["state_jobs"], PROCESS.replace("@", "state_jobs"))
cte("admission", [], f"""
SELECT key, list_reduce(list_transform(list({{'t': t, 'id': event_id}} ORDER BY t, event_id),
    lambda x: {{'h': []::BIGINT[], 'o': []::STRUCT(id BIGINT, ok BOOLEAN)[], 't': x.t, 'id': x.id}}),
  lambda a, x: CASE WHEN len(list_filter(a.h, lambda y: x.t - y <= {catalog.ADMIT_WINDOW * 1000000})) < {catalog.ADMIT_LIMIT}
    THEN {{'h': list_filter(a.h, lambda y: x.t - y <= {catalog.ADMIT_WINDOW * 1000000}) || [x.t], 'o': a.o || [{{'id': x.id, 'ok': TRUE}}], 't': x.t, 'id': x.id}}
    ELSE {{'h': a.h, 'o': a.o || [{{'id': x.id, 'ok': FALSE}}], 't': x.t, 'id': x.id}} END,
  {{'h': []::BIGINT[], 'o': []::STRUCT(id BIGINT, ok BOOLEAN)[], 't': 0::BIGINT, 'id': 0::BIGINT}}).o AS o
FROM (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id FROM events) GROUP BY key""")

DISPLAY = "id, title, company, location, category, seniority, date_posted, url"
FOUND = """(title ILIKE '%er%' OR description ILIKE '%er%' OR cleaned ILIKE '%er%') AND location ILIKE '%berlin%'
  AND category ILIKE '%e%' AND array_to_string(skills, ',') ILIKE '%sql%' AND array_to_string(skills, ',') ILIKE '%docker%'"""


def metric_rows(stage: str, source: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{m}' AS metric, {m}::DOUBLE AS value FROM {source}" for m in metrics)


INGEST_METRICS = [
    "input_rows", "inserted_rows", "updated_rows", "unchanged_rows", "changed_rows", "skipped_rows", "missing_url",
    "missing_title", "short_description", "duplicate_rows",
]


def oracle_sql() -> dict[str, str]:
    return {
        "dedup_first_by_key": build("""
SELECT url, ordinal, company_name, n_chars FROM (SELECT job_posting_url AS url, ordinal, company_name, length(description)::INTEGER AS n_chars,
  row_number() OVER (PARTITION BY job_posting_url ORDER BY ordinal) AS n FROM raw) WHERE n = 1""", "raw"),
        "vector_integrity": """
SELECT count(*) AS vector_count, count(DISTINCT vec_id) AS id_count, min(len(embedding))::INTEGER AS min_dimension,
  max(len(embedding))::INTEGER AS max_dimension,
  count(*) > 0 AND count(*) = count(DISTINCT vec_id) AND min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) > 0 AS is_valid
FROM embeddings""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
        "normalize_postings": build(
            "SELECT ordinal, title, company, location, category, description, date_posted, url FROM norm", "norm"),
        "normalize_seniority": build("SELECT ordinal, seniority FROM norm", "norm"),
        "classify_seniority": build("SELECT ordinal::VARCHAR AS job_id, seniority FROM classified", "classified"),
        "classify_category": build("SELECT ordinal::VARCHAR AS job_id, category, is_tech FROM classified", "classified"),
        "parse_listed_date": build("SELECT ordinal::VARCHAR AS job_id, date_posted FROM raw_clean", "raw_clean"),
        "clean_description": rf"""
SELECT doc_id, {CLEANED.replace('description', 'text')} AS cleaned FROM documents""",
        "extract_skills": build("SELECT id AS job_id, unnest(skills) AS skill FROM jobs", "jobs"),
        "content_hash": build("SELECT ordinal, source_hash FROM norm", "norm"),
        "skill_jaccard": build(f"""
SELECT job_id, candidate_id, array_to_string(shared, ',') AS shared_skills, {rnd('overlap')} AS jaccard FROM scored WHERE rank <= 5""", "scored"),
        "keyword_overlap": build(
            "SELECT question_id, job_id, chunk_order::BIGINT AS chunk_order, keyword_score FROM searched", "searched"),
        "split_sentences": rf"""
SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INTEGER AS position FROM (
SELECT doc_id, list_filter(string_split(regexp_replace({collapse('text')}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS s FROM documents)""",
        "chunk_documents": build("SELECT * FROM chunks", "chunks"),
        "question_type": build("SELECT question_id, question_type FROM question_kind", "question_kind"),
        "freshness": build(f"""
SELECT pipeline_name, g IS NOT NULL AS available, age_hours > 24 AS stale, age_hours FROM (
SELECT pipeline_name, g, {rnd("(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(g)) / 1000000 / 3600", 2)} AS age_hours FROM (
SELECT pipeline_name, max(finished_at) FILTER (status = 'success') AS g FROM run_log GROUP BY pipeline_name))""", "run_log"),
        "prompt_table": build(f"""
SELECT question_id, {quote(rules.PROMPT_HEAD)} || question || {quote(rules.PROMPT_CONTEXT)} || context || {quote(rules.PROMPT_TAIL)} AS prompt
FROM questions JOIN (SELECT question_id, string_agg('[Source ' || position || '] ' || chunk_text, chr(10) || chr(10) ORDER BY position) AS context
  FROM hits GROUP BY question_id) USING (question_id)""", "questions", "hits"),
        "decode_responses": f"""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 < 4 THEN {strip('text')} END AS answer, (conv_id + turn) % 5 < 4 AS is_known_shape
FROM conversations WHERE role = 'assistant'""",
        "validate_postings": build(
            "SELECT ordinal, reject_reason, reject_reason IS NULL AS is_valid FROM checked", "checked"),
        "search_postings": build(
            f"SELECT {DISPLAY} FROM jobs WHERE {FOUND} ORDER BY date_posted DESC NULLS FIRST, id LIMIT 20", "jobs"),
        "search_postings_indexed": build(
            f"SELECT {DISPLAY} FROM jobs WHERE {FOUND} ORDER BY date_posted DESC NULLS FIRST, id LIMIT 20", "jobs"),
        "keyword_matches": build(
            "SELECT id, title FROM jobs WHERE " + " OR ".join(f"{c} ILIKE '%ieux%tion%'" for c in ("title", "description", "cleaned")), "jobs"),
        "search_postings_page2": build(f"""
SELECT {DISPLAY} FROM jobs WHERE (title ILIKE '%a%e%' OR description ILIKE '%a%e%' OR cleaned ILIKE '%a%e%') AND seniority ILIKE '%senior%'
ORDER BY location ASC NULLS LAST, id LIMIT 25 OFFSET 25""", "jobs"),
        "search_postings_keyset": build(f"""
SELECT {DISPLAY} FROM jobs WHERE (title ILIKE '%a%e%' OR description ILIKE '%a%e%' OR cleaned ILIKE '%a%e%') AND seniority ILIKE '%senior%'
ORDER BY location ASC NULLS LAST, id LIMIT 25 OFFSET 25""", "jobs"),
        "search_total": build(f"SELECT count(*) AS total FROM jobs WHERE {FOUND}", "jobs"),
        "get_posting": build(
            f"SELECT {DISPLAY}, description, array_to_string(skills, ',') AS skills FROM jobs WHERE id = 42", "jobs"),
        "dirty_rows": build("""
SELECT 'process' AS stage, id FROM stages WHERE NOT done UNION ALL SELECT 'embed', id FROM stages WHERE done AND NOT embedded
UNION ALL SELECT 'chunk', id FROM stages WHERE done""", "stages"),
        "dirty_counts": build("""
SELECT stage, dirty, dirty > 0 AS needs_run FROM (SELECT 'process' AS stage, count(*) FILTER (NOT done) AS dirty FROM stages
UNION ALL SELECT 'embed', count(*) FILTER (done AND NOT embedded) FROM stages UNION ALL SELECT 'chunk', count(*) FILTER (done) FROM stages)""", "stages"),
        "upsert_actions": build("SELECT ordinal, url, id, action FROM actions", "actions"),
        "upsert_state": build(f"""
SELECT id, {FIELDS}, CASE WHEN TRUE THEN 'pending' END AS processing_status, source_hash, ingested_at FROM state""", "state"),
        "upsert_full_rebuild": build(f"""
SELECT COALESCE(s.id, n.id) AS id, COALESCE(s.url, n.url) AS url, 'pending' AS processing_status, NULL::VARCHAR AS cleaned_description,
  CASE WHEN i.url IS NULL THEN {EARLIER} ELSE {NOW} END AS ingested_at
FROM (SELECT url FROM stored UNION SELECT url FROM incoming) u LEFT JOIN stored s USING (url) LEFT JOIN state n USING (url)
LEFT JOIN incoming i USING (url)""", "stored", "incoming", "state"),
        "stamp_touched": build(
            f"SELECT id, CASE WHEN embedded THEN {NOW} END AS embedded_at FROM stages", "stages"),
        "knn_topk": build(f"SELECT job_id, candidate_id, {rnd('raw', 6)} AS score, rank FROM neighbours WHERE rank <= 10", "neighbours"),
        "knn_topk_blocked": build(f"SELECT job_id, candidate_id, {rnd('raw', 6)} AS score, rank FROM neighbours WHERE rank <= 10", "neighbours"),
        "knn_topk_cells": build(f"SELECT job_id, candidate_id, {rnd('raw', 6)} AS score, rank FROM neighbours WHERE rank <= 10", "neighbours"),
        "knn_ivf_recall": build("SELECT count(*) AS neighbours, TRUE AS reached FROM neighbours WHERE rank <= 10", "neighbours"),
        "retrieve_topk_prefiltered": build("""
SELECT question_id, position, job_id, chunk_order::BIGINT AS chunk_order, title, location, category, final_score FROM early_hits""", "early_hits"),
        "retrieve_topk": build(
            "SELECT question_id, rank, job_id, chunk_order::BIGINT AS chunk_order, title, score, keyword_score FROM searched", "searched"),
        "retrieve_topk_sparse": build(
            "SELECT question_id, rank, job_id, chunk_order::BIGINT AS chunk_order, title, score, keyword_score FROM searched", "searched"),
        "skills_per_posting": build("SELECT job_id, skills_text FROM skill_text", "skill_text"),
        "top_skills": build("""
SELECT skill, count(*) AS count FROM (SELECT unnest(skills) AS skill FROM jobs) GROUP BY skill ORDER BY count DESC, skill LIMIT 10""", "jobs"),
        "top_skills_filtered": build("""
SELECT skill, count(*) AS count FROM (SELECT unnest(skills) AS skill FROM jobs WHERE category ILIKE '%en%' AND seniority ILIKE '%senior%')
GROUP BY skill ORDER BY count DESC, skill LIMIT 50""", "jobs"),
        "ingest_summary": build("SELECT * FROM ingest_counts", "ingest_counts"),
        "process_summary": build(PROCESS.replace("@", "jobs"), "jobs"),
        "chunk_summary": build("SELECT count(*) AS chunk_count, count(DISTINCT job_id) AS job_count FROM chunks", "chunks"),
        "category_counts": build("SELECT category AS label, count(*) AS n FROM prepared GROUP BY category", "prepared"),
        "seniority_counts": build("""
SELECT COALESCE(seniority, 'None') AS label, count(*) AS n FROM prepared GROUP BY 1 ORDER BY n DESC, label LIMIT 10""", "prepared"),
        "top_terms": build(terms("category", "chunks", "job_id, chunk_order", 10), "chunks"),
        "eval_recommendations_cases": build("SELECT * FROM recommendation_cases", "recommendation_cases"),
        "eval_recommendations": build(f"""
SELECT count(*) AS evaluated_jobs, count(*) FILTER (recommendation_count > 0) AS jobs_with_recommendations,
  count(*) FILTER (shared_skill_recommendations > 0) AS jobs_with_shared_skills,
  {rnd('(sum(recommendation_count) / count(*))', 3)} AS avg_recommendations_per_job FROM recommendation_cases""", "recommendation_cases"),
        "eval_answers_cases": build("""
SELECT question_id, array_to_string(matched, ',') AS matched_keywords, keyword_hit_rate, length(answer)::INTEGER AS answer_length,
  source_count AS retrieved_chunk_count, job_count AS retrieved_job_count FROM answer_cases""", "answer_cases"),
        "eval_answers_summary": build(f"""
SELECT count(*) AS total_cases, count(*) FILTER (keyword_hit_rate > 0) AS passed_cases,
  {rnd('(sum(keyword_hit_rate) / count(*))', 3)} AS avg_keyword_hit_rate,
  {rnd('(sum(source_count) / count(*))', 3)} AS avg_retrieved_chunk_count,
  {rnd('(sum(job_count) / count(*))', 3)} AS avg_retrieved_job_count FROM answer_cases""", "answer_cases"),
        "latency_summary": f"""
SELECT endpoint, requests, errors, {rnd('mean')} AS mean_ms, {rnd('p50')} AS p50_ms, {rnd('p95')} AS p95_ms, {rnd('p99')} AS p99_ms FROM (
SELECT event_type AS endpoint, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS mean,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type)""",
        "rerank": build(
            "SELECT question_id, job_id, chunk_order::BIGINT AS chunk_order, final_score, final_rank FROM reranked", "reranked"),
        "dedup_per_job": build("""
SELECT question_id, job_id, chunk_order::BIGINT AS chunk_order, final_rank FROM (
SELECT *, row_number() OVER (PARTITION BY question_id, job_id ORDER BY final_rank) AS n FROM reranked) WHERE n <= 2""", "reranked"),
        "chunk_ids": build(
            "SELECT job_id, chunk_order, row_number() OVER (ORDER BY job_id, chunk_order) - 1 AS chunk_id FROM chunks", "chunks"),
        "latest_runs": build(f"""
SELECT *, {rnd('(epoch_us(finished_at) - epoch_us(started_at)) / 1000000', 3)} AS duration_seconds
FROM run_log ORDER BY started_at DESC, id DESC LIMIT 10""", "run_log"),
        "prepare_postings": build("SELECT * EXCLUDE (place) FROM prepared", "prepared"),
        "prepare_newest": build(f"SELECT * EXCLUDE (place) FROM prepared WHERE place <= {catalog.NEWEST_ROWS}", "prepared"),
        "union_buckets": build("""
SELECT url, ordinal, title, category, priority FROM (
SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, ordinal) AS n FROM (
  SELECT *, 0::INTEGER AS priority FROM usable WHERE category <> 'other'
  UNION ALL SELECT *, 1::INTEGER FROM usable WHERE category = 'other' AND is_tech)) WHERE n = 1""", "usable"),
        "recommend_topn": build(RECOMMENDED.replace("@", "top5"), "top5"),
        "recommend_filtered": build(RECOMMENDED.replace("@", "top10"), "top10"),
        "retrieve_topk_filtered": build("""
SELECT question_id, position, job_id, chunk_order::BIGINT AS chunk_order, title, location, category, final_score FROM hits""", "hits"),
        "rate_limit": build("SELECT key, o.id AS event_id, o.ok AS admitted FROM (SELECT key, unnest(o) AS o FROM admission)", "admission"),
        "incremental_equals_full": build(
            "SELECT job_id, chunk_order, chunk_length, md5(chunk_text) AS chunk_md5 FROM chunks", "chunks"),
        "process_postings": build(f"""
SELECT id, cleaned AS cleaned_description, array_to_string(skills, ',') AS skills, 'processed' AS processing_status, {EARLIER} AS last_processed_at FROM jobs""", "jobs"),
        "pipeline_summary": build(" UNION ALL ".join([
            metric_rows("ingest", "ingest_counts", INGEST_METRICS),
            metric_rows("process", "process_counts", ["processed_jobs", "jobs_without_skills", "empty_cleaned_description", "avg_skills_per_job"]),
            "SELECT 'embeddings', 'embedded_jobs', count(*)::DOUBLE FROM state",
            "SELECT 'chunk_index', 'chunk_count', count(*)::DOUBLE FROM state_chunks",
            "SELECT 'chunk_index', 'job_count', count(DISTINCT job_id)::DOUBLE FROM state_chunks",
        ]), "ingest_counts", "process_counts", "state", "state_chunks"),
        "answers_generated": build(f"""
SELECT question_id, question_type, CASE WHEN source_count > 0 THEN COALESCE(made, answer) ELSE answer END AS answer,
  CASE WHEN source_count > 0 AND made IS NOT NULL THEN 'llm' ELSE generation_mode END AS generation_mode, source_count, job_count
FROM answers LEFT JOIN (SELECT conv_id AS question_id, CASE WHEN (conv_id + turn) % 5 < 4 THEN nullif({strip('text')}, '') END AS made
  FROM conversations WHERE role = 'assistant' AND turn = 1) USING (question_id)""", "answers"),
        "extractive_answers": build("SELECT * FROM answers", "answers"),
        "embed_norms": build(f"""
SELECT id, {rnd('sqrt(sum(w * w))')} AS norm, count(w)::INTEGER AS filled_buckets FROM (
SELECT j.id, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM (SELECT id FROM jobs) j LEFT JOIN (
  SELECT id, ('0x' || md5(w)[1:6])::BIGINT % 256 AS bucket, count(*) AS n
  FROM (SELECT id, unnest({words('cleaned')}) AS w FROM jobs) GROUP BY ALL) USING (id)) GROUP BY id""", "jobs"),
    }
