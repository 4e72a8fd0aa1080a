"""The registered queries in DuckDB SQL, over the same Parquet tables.

Every statement starts from the raw tables; the derived frames of
``rolecall/fixtures.py`` are defined here a second time as CTEs. Pages are not
parsed again: what a page must yield is computed from the row it was made of.
"""

from __future__ import annotations

from rolecall import dims, fixtures as fx
from rolecall.functions.dates import MONTHS

SPLIT_DATE = "1998-04-01"
AS_OF = f"DATE '{fx.AS_OF}'"


def _str(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_str, values)) + "]"


def _pick(values, index: str) -> str:
    return f"({_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


_SKILLS = fx.skill_list()
_ROLE_SLUGS = [role.lower().replace(" ", "_") for role, _ in dims.role_skills()]
_WORD = r"\p{L}\p{N}_"

CTES: dict[str, str] = {}

CTES["nv"] = "SELECT count(*) AS n FROM embeddings"
CTES["base"] = f"""
SELECT o_orderkey AS id, c_name AS company, n_name AS location, o_custkey, o_totalprice, o_orderdate, c_nationkey,
       {_pick(_SKILLS, 'o_orderkey')} AS s1, {_pick(_SKILLS, 'o_orderkey * 7')} AS s2,
       {_pick(_SKILLS, 'o_orderkey * 13')} AS s3, {_pick(fx.JOB_TYPES, 'o_orderkey // 5')} AS job_type,
       {_pick(fx.TITLES, 'o_orderkey')} AS job_title
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
CTES["postings"] = f"""
SELECT id, job_title, company, location,
       CASE WHEN id % 4 = 0 THEN 'Not disclosed' ELSE 'INR ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS salary,
       CASE WHEN id % 37 = 0 THEN '' WHEN id % 41 = 0 THEN 'Not Available' ELSE s1 || ', ' || s2 || ', ' || s3 END AS skills_required,
       'https://jobs.example.com/' || id AS job_link, CAST(o_orderdate AS DATE) AS posted_date,
       CASE WHEN id % 17 <> 0 THEN CAST(o_custkey % 50 AS INTEGER) END AS applicants,
       {_pick(fx.SOURCES, 'id // 12')} AS source, {_pick(fx.LEVELS, 'id')} AS experience_level,
       lower(replace(job_title, ' ', '_')) AS role,
       CASE WHEN id % 29 = 0 THEN 'Not Available' WHEN id % 31 = 0 THEN ''
            ELSE 'We need ' || s1 || ', ' || s2 || ' and ' || s3 || '; ' || s1 || ' daily. Employment Type: ' || coalesce(job_type, 'Permanent')
       END AS job_description,
       job_type, CASE WHEN id % 29 <> 0 THEN embedding END AS embedding, {_pick(fx.POSTED, 'id')} AS posted_text
FROM base CROSS JOIN nv JOIN embeddings ON vec_id = id % n"""
CTES["people"] = f"""
SELECT c_custkey AS candidate_id, c_name, 
       CASE WHEN c_custkey % 10 = 0 THEN '' ELSE ' Nation_' || c_nationkey END AS pref_location,
       coalesce(nullif({_pick(fx.FORM_LEVELS, 'c_custkey')}, ''), CASE WHEN c_custkey % 2 = 0 THEN 'Fresher' ELSE 'Experienced' END) AS category,
       CASE WHEN c_custkey % 7 = 0 THEN [{_pick(_SKILLS, 'c_custkey')}, {_pick(_SKILLS, 'c_custkey * 3 + 1')}]
            ELSE [{_pick(_SKILLS, 'c_custkey')}, {_pick(_SKILLS, 'c_custkey * 3 + 1')}, {_pick(_SKILLS, 'c_custkey * 5 + 2')},
                  {_pick(_SKILLS, 'c_custkey * 11 + 3')}, {_pick(_SKILLS, 'c_custkey * 17 + 4')}] END AS listed,
       list_sort(list_distinct(listed)) AS skills,
       CASE WHEN c_custkey % 9 = 0 THEN [] ELSE [{_pick(_ROLE_SLUGS, 'c_custkey')}, {_pick(_ROLE_SLUGS, 'c_custkey * 3 + 1')},
            {_pick(_ROLE_SLUGS, 'c_custkey * 7 + 2')}] END AS roles,
       CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'text' END AS resume_text, embedding
FROM customer CROSS JOIN nv JOIN embeddings ON vec_id = c_custkey % n"""
# Customer skills in first-seen order, each once (the resume lists them so).
CTES["ordered_skills"] = """
SELECT candidate_id, list(s ORDER BY i) AS mine
FROM (SELECT candidate_id, s, min(i) AS i
      FROM (SELECT candidate_id, unnest(listed) AS s, generate_subscripts(listed, 1) AS i FROM people) GROUP BY ALL)
GROUP BY candidate_id"""
CTES["resumes"] = f"""
SELECT c_custkey AS candidate_id,
       lower(replace(c.c_name, '#', ' ')) || ' - profile' || chr(10) || 'user' || c_custkey || '@mail.example.com' || chr(10)
       || 'phone: 9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || chr(10) || replace({_pick([r.replace(chr(10), '~') for r in fx.ROLE_LINES], 'c_custkey')}, '~', chr(10))
       || chr(10) || 'skills: ' || array_to_string(mine, ', ') || chr(10) || 'work experience '
       || {_pick(MONTHS, 'c_custkey')} || ' ' || (c_custkey % 10 + 1990) || ' - ' || {_pick(MONTHS, 'c_custkey * 5 + 3')} || ' '
       || (c_custkey % 10 + 1990 + c_custkey % 4)
       || CASE c_custkey % 3 WHEN 0 THEN chr(10) || 'june 2001 - present' WHEN 1 THEN chr(10) || 'jan 2000 - feb 2001, acme' ELSE '' END
       || chr(10) || {_pick(fx.EDUCATION, 'c_custkey')} AS text
FROM customer c JOIN ordered_skills ON candidate_id = c_custkey"""
CTES["skill_dim"] = f"SELECT unnest({_list(_SKILLS)}) AS skill"
CTES["role_dim"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({_str(role)}, {i}, {_str(s)})" for i, (role, skills) in enumerate(dims.role_skills()) for s in skills
) + ") t(role, role_ord, skill)"

_BOUNDED = rf"'(^|[^{_WORD}])' || regexp_escape(skill) || '($|[^{_WORD}])'"
_IN_TEXT = f"CASE WHEN contains(body, skill) THEN regexp_matches(body, {_BOUNDED}) ELSE false END"
# Doubled separators let neighbouring repeats both match a pattern that consumes them.
_DOUBLE = rf"'([^{_WORD}])', '\1\1', 'g'"
_COUNT = (
    rf"len(regexp_extract_all(regexp_replace(body, {_DOUBLE}), '(^|[^{_WORD}])' || "
    rf"regexp_escape(regexp_replace(skill, {_DOUBLE})) || '($|[^{_WORD}])'))"
)
CTES["texts"] = "SELECT DISTINCT lower(job_description) AS body FROM postings"
CTES["text_skills"] = f"""
SELECT body, skill, {_COUNT} AS n FROM texts CROSS JOIN skill_dim WHERE {_IN_TEXT}"""
CTES["text_lists"] = """
SELECT body, list(skill ORDER BY skill) AS skills, list(skill ORDER BY n DESC, skill) AS by_freq,
       list(skill || '=' || n ORDER BY skill) AS counts FROM text_skills GROUP BY body"""
CTES["posting_skills"] = """
SELECT p.id, coalesce(skills, []) AS skills, coalesce(by_freq, []) AS by_freq, coalesce(counts, []) AS counts
FROM postings p LEFT JOIN text_lists ON body = lower(job_description)"""

_VALID = """
(skills_required IS NOT NULL AND skills_required <> '' AND lower(skills_required) <> 'not available'
 AND job_type IS NOT NULL AND job_type <> '' AND lower(job_type) <> 'not available'
 AND job_description IS NOT NULL AND job_description <> '' AND lower(job_description) <> 'not available'
 AND (applicants IS NULL OR applicants <> 0))"""

_LEVEL_CASE = "CASE WHEN lower(source) = 'linkedin' THEN CASE lower(experience_level) " + " ".join(
    f"WHEN {_str(label.lower())} THEN {_str(band)}" for label, band in dims.LEVEL_BANDS.items()
) + " ELSE experience_level END ELSE experience_level END"

CTES["fetched"] = """
SELECT c.candidate_id, p.id, row_number() OVER (PARTITION BY c.candidate_id ORDER BY p.posted_date DESC NULLS LAST, p.id) AS fetch_rank
FROM people c JOIN postings p
  ON trim(c.pref_location) <> '' AND lower(p.location) LIKE '%' || lower(trim(c.pref_location)) || '%'
 AND (CASE lower(c.category) WHEN 'fresher' THEN (p.experience_level LIKE '0-%' OR p.experience_level LIKE '1-%')
        WHEN 'experienced' THEN (p.experience_level NOT LIKE '0-%' AND p.experience_level NOT LIKE '1-%') ELSE true END)
 AND (len(c.roles) = 0 OR len(list_filter(c.roles, lambda r: lower(p.job_title) LIKE '%' || r || '%')) > 0)
QUALIFY fetch_rank <= 100"""

_BAND_MIN = r"""CASE WHEN regexp_matches(lv, '(\d+)-(\d+)|(\d+)\+') THEN
  CAST(regexp_extract(regexp_extract(lv, '(\d+)-(\d+)|(\d+)\+'), '\d+') AS INTEGER)
  WHEN level LIKE '%Fresher%' OR level LIKE '%Entry%' THEN 0 WHEN level LIKE '%Senior%' THEN 3 ELSE 0 END"""
_BAND_MAX = r"""CASE WHEN regexp_matches(lv, '(\d+)-(\d+)|(\d+)\+') THEN
  CASE WHEN regexp_extract(lv, '(\d+)-(\d+)|(\d+)\+') LIKE '%+' THEN 20
       ELSE CAST(regexp_extract(regexp_extract(lv, '(\d+)-(\d+)|(\d+)\+'), '-(\d+)', 1) AS INTEGER) END
  WHEN level LIKE '%Fresher%' OR level LIKE '%Entry%' THEN 2 ELSE 10 END"""
CTES["level_bands"] = f"""
SELECT level, {_BAND_MIN} AS lo, {_BAND_MAX} AS hi
FROM (SELECT DISTINCT experience_level AS level, replace(experience_level, ' Yrs', '') AS lv FROM postings)"""

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_COS = (
    f"{_DOT.format(a='p.embedding', b='c.embedding')} / (sqrt({_DOT.format(a='p.embedding', b='p.embedding')}) * "
    f"sqrt({_DOT.format(a='c.embedding', b='c.embedding')})) * 100"
)
CTES["scored"] = f"""
SELECT f.candidate_id, f.id, f.fetch_rank, p.source, {_COS} AS score,
       list_filter(s.by_freq, lambda x: list_contains(c.skills, x)) AS matched
FROM fetched f JOIN postings p ON p.id = f.id JOIN people c ON c.candidate_id = f.candidate_id
JOIN posting_skills s ON s.id = f.id WHERE p.embedding IS NOT NULL"""
CTES["in_source"] = """
SELECT *, row_number() OVER (PARTITION BY candidate_id, source ORDER BY score DESC, fetch_rank) AS rn,
       min(fetch_rank) OVER (PARTITION BY candidate_id, source) AS source_ord FROM scored"""
CTES["with_quota"] = """
SELECT i.*, CAST(ceil(40.0 / k) AS INTEGER) AS quota FROM in_source i
JOIN (SELECT candidate_id, count(DISTINCT source) AS k FROM scored GROUP BY 1) USING (candidate_id)"""
CTES["placed"] = """
SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END,
  CASE WHEN rn <= quota THEN source_ord END NULLS FIRST, CASE WHEN rn > quota THEN -score END NULLS FIRST, source_ord, rn) AS position
FROM with_quota"""
CTES["recommended"] = f"""
SELECT r.candidate_id, r.position, r.id, p.job_title, p.company, p.location, p.salary, p.skills_required, p.job_link,
       p.posted_date, p.applicants, p.source, p.experience_level, p.job_type, r.matched,
       CASE WHEN len(r.matched) > 0 THEN least(round_even(r.score, 2) + least(4 * len(r.matched), 20), 100.0)
            ELSE round_even(r.score, 2) END AS match_score,
       greatest(0, date_diff('day', p.posted_date, {AS_OF})) AS days_since_posted
FROM placed r JOIN postings p ON p.id = r.id WHERE r.position <= 40"""
_REC = ("nv", "base", "postings", "people", "skill_dim", "texts", "text_skills", "text_lists", "posting_skills",
        "fetched", "scored", "in_source", "with_quota", "placed", "recommended")
_POST = ("nv", "base", "postings")
_TEXTS = (*_POST, "skill_dim", "texts", "text_skills", "text_lists", "posting_skills")
_PEOPLE = ("nv", "people")
_RESUMES = ("nv", "people", "ordered_skills", "resumes")


def _sql(ctes, body: str) -> str:
    names = ", ".join(f"{name} AS ({CTES[name].strip()})" for name in ctes)
    return f"WITH {names} {body.strip()}" if ctes else body.strip()


SQL: dict[str, str] = {}

SQL["search_postings"] = _sql((*_POST, "people", "fetched"), """
SELECT f.candidate_id, f.fetch_rank, p.id, job_title, company, location, salary, skills_required, job_link,
       CAST(posted_date AS VARCHAR) AS posted_date, applicants, source, experience_level, job_description, job_type,
       coalesce(len(embedding), 0) AS embedding
FROM fetched f JOIN postings p ON p.id = f.id""")
SQL["recent_postings"] = _sql(_POST, f"""
SELECT id, CAST(posted_date AS VARCHAR) AS posted_date FROM postings WHERE posted_date >= {AS_OF} - 60""")
SQL["clean_invalid"] = _sql(_POST, f"SELECT id, skills_required, job_type, applicants FROM postings WHERE {_VALID}")
SQL["invalid_reason_counts"] = _sql(_POST, """
SELECT reason, count(*) AS rows FROM (
  SELECT CASE WHEN coalesce(skills_required, '') IN ('', 'Not Available') THEN 'skills_required'
              WHEN coalesce(job_type, '') IN ('', 'Not Available') THEN 'job_type'
              WHEN coalesce(job_description, '') IN ('', 'Not Available') THEN 'job_description'
              WHEN applicants = 0 THEN 'applicants' END AS reason FROM postings)
WHERE reason IS NOT NULL GROUP BY reason""")
SQL["normalise_levels"] = _sql(_POST, f"SELECT id, source, {_LEVEL_CASE} AS experience_level FROM postings")
SQL["normalise_levels_table"] = SQL["normalise_levels"]
SQL["renumber_ids"] = _sql(_POST, f"""
SELECT id AS old_id, new_id AS id, (new_id - 1) // 1000 + 1 AS batch
FROM (SELECT id, row_number() OVER (ORDER BY id) AS new_id FROM postings WHERE {_VALID})""")
SQL["next_id"] = _sql(_POST, f"SELECT count(*) AS rows, coalesce(max(id), 0) + 1 AS next_id FROM postings WHERE {_VALID}")
SQL["maintain"] = _sql(_POST, f"""
SELECT new_id AS id, job_link, experience_level, (new_id - 1) // 1000 + 1 AS batch FROM (
  SELECT row_number() OVER (ORDER BY id) AS new_id, job_link, {_LEVEL_CASE} AS experience_level FROM postings WHERE {_VALID})""")
SQL["append_ignore"] = _sql(_POST, f"""
, old AS (SELECT * FROM postings WHERE posted_date < DATE '{SPLIT_DATE}'),
fresh AS (SELECT * REPLACE (CASE WHEN id % 10 <> 0 THEN source END AS source) FROM postings WHERE posted_date >= DATE '{SPLIT_DATE}'),
firsts AS (SELECT * FROM fresh WHERE source IS NULL UNION ALL
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(job_title), lower(company), lower(source) ORDER BY id) AS rn
                              FROM fresh WHERE source IS NOT NULL) WHERE rn = 1)
SELECT id, job_title, company, source, location FROM old UNION ALL
SELECT id, job_title, company, source, location FROM firsts f WHERE NOT EXISTS (
  SELECT 1 FROM old o WHERE lower(o.job_title) = lower(f.job_title) AND lower(o.company) = lower(f.company) AND lower(o.source) = lower(f.source))
""").replace(") , old", "), old")
SQL["insert_then_maintain"] = _sql(_POST, f"""
, old AS (SELECT * FROM postings WHERE posted_date < DATE '{SPLIT_DATE}'),
firsts AS (SELECT * FROM postings WHERE posted_date >= DATE '{SPLIT_DATE}' AND id % 11 <> 0
  QUALIFY row_number() OVER (PARTITION BY lower(job_title), lower(company), lower(source) ORDER BY id) = 1),
fresh AS (SELECT * FROM firsts f WHERE NOT EXISTS (
  SELECT 1 FROM old o WHERE lower(o.job_title) = lower(f.job_title) AND lower(o.company) = lower(f.company) AND lower(o.source) = lower(f.source))),
both_parts AS (SELECT *, 1 AS b FROM old UNION ALL SELECT *, 0 AS b FROM fresh)
SELECT source, role, sum(b)::BIGINT AS rows_before, count(*) AS rows_after, count(*) FILTER (b = 0) AS inserted, 0 AS deleted,
  count(*) FILTER ({_VALID}) AS maintained, true AS dense, (SELECT count(*) FROM both_parts WHERE {_VALID}) AS n, true AS timed
FROM both_parts GROUP BY source, role""").replace(") , old", "), old")
SQL["embed_text"] = r"""
SELECT doc_id, 256 AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END AS norm FROM documents"""
SQL["run_report"] = _sql(_POST, f"""
SELECT source, role, count(*) AS rows_before, count(*) FILTER ({_VALID}) AS rows_after, 0 AS inserted,
       count(*) FILTER (NOT {_VALID}) AS deleted FROM postings GROUP BY source, role""")
_DAYS_BACK = "CASE posted_text " + " ".join(
    f"WHEN '{text}' THEN {days}" for text, days in zip(fx.POSTED, (0, 0, 0, 1, 3, 30, 14, 30, 0, 0, 0, 0))
) + " END"
SQL["parse_posted_date"] = _sql(_POST, f"""
SELECT id, posted_text, CAST({AS_OF} - CAST({_DAYS_BACK} AS INTEGER) AS VARCHAR) AS posted_date FROM postings""")
SQL["days_since"] = _sql(_POST, f"SELECT id, greatest(0, date_diff('day', posted_date, {AS_OF})) AS days FROM postings")
SQL["age_label"] = _sql(_POST, """
SELECT id, 'Posted ' || CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago'
       WHEN d < 14 THEN 'a week ago' WHEN d < 21 THEN '2 weeks ago' WHEN d < 28 THEN '3 weeks ago' ELSE 'a month ago' END AS label
FROM (SELECT id, greatest(0, date_diff('day', posted_date, DATE '2001-08-03')) AS d FROM postings)""")
SQL["parse_bands"] = _sql((*_POST, "level_bands"), """
SELECT id, lo AS min_years, hi AS max_years FROM postings JOIN level_bands ON experience_level IS NOT DISTINCT FROM level""")
SQL["band_overlap"] = _sql((*_POST, "level_bands"), """
SELECT id, level IS NOT NULL AND 0 <= hi AND 2 >= lo AS fresher, level IS NOT NULL AND 3 <= hi AND 20 >= lo AS experienced,
       level IS NOT NULL AND 0 <= hi AND 20 >= lo AS other
FROM postings JOIN level_bands ON experience_level IS NOT DISTINCT FROM level""")
_FLAGS = """
, flags AS (SELECT f.candidate_id, count(*) AS fetched, count(p.embedding) AS usable,
    bool_or(level IS NOT NULL AND CASE lower(category) WHEN 'fresher' THEN 0 <= hi AND 2 >= lo
            WHEN 'experienced' THEN 3 <= hi AND 20 >= lo ELSE 20 >= lo END) AS any_match
  FROM fetched f JOIN postings p ON p.id = f.id JOIN people c ON c.candidate_id = f.candidate_id
  JOIN level_bands ON p.experience_level IS NOT DISTINCT FROM level GROUP BY f.candidate_id)"""
_FLAG_CTES = (*_POST, "people", "fetched", "level_bands")
SQL["mismatch_flag"] = _sql(_FLAG_CTES, f"{_FLAGS} SELECT candidate_id, NOT any_match AS mismatch FROM flags").replace(") , flags", "), flags")
SQL["candidate_status"] = _sql(_FLAG_CTES, f"""{_FLAGS}
SELECT candidate_id, status, CASE status WHEN 'no_text' THEN 'Failed to extract data from resume'
  WHEN 'no_jobs' THEN 'No jobs found matching your criteria. Try broadening your search.'
  WHEN 'none_matched' THEN 'No jobs matched your resume.'
  WHEN 'mismatch' THEN 'Experience levels don''t match closely. Consider adjusting your experience level.' END AS message, fetched
FROM (SELECT c.candidate_id, coalesce(fetched, 0) AS fetched, CASE WHEN resume_text = '' THEN 'no_text'
        WHEN coalesce(fetched, 0) = 0 THEN 'no_jobs' WHEN usable = 0 THEN 'none_matched' WHEN NOT any_match THEN 'mismatch'
        ELSE 'ok' END AS status FROM people c LEFT JOIN flags f ON f.candidate_id = c.candidate_id)
""").replace(") , flags", "), flags")

SQL["extract_skills"] = _sql(("skill_dim",), f"""
, found AS (SELECT doc_id, list(skill ORDER BY skill) AS skills
  FROM (SELECT doc_id, lower(text) AS body FROM documents) CROSS JOIN skill_dim WHERE {_IN_TEXT} GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(skills, '|'), '') AS skills FROM documents LEFT JOIN found USING (doc_id)
""").replace(") , found", "), found")
SQL["extract_skills_join"] = SQL["extract_skills"]
SQL["skill_frequency"] = _sql(_TEXTS, """
SELECT id, array_to_string(counts, '|') AS counts, array_to_string(by_freq, '|') AS by_frequency FROM posting_skills""")
SQL["skills_joined"] = _sql(_TEXTS, """
SELECT id, CASE WHEN len(skills) > 0 THEN array_to_string(skills, ', ') ELSE 'Not Available' END AS skills_required FROM posting_skills""")
_PAIRED = """
FROM (SELECT p.id, p.applicants, list_filter(s.skills, lambda x: list_contains(c.skills, x)) AS shared,
             list_filter(s.by_freq, lambda x: list_contains(c.skills, x)) AS matched
      FROM postings p JOIN posting_skills s ON s.id = p.id JOIN people c ON c.c_name = p.company)"""
SQL["skill_overlap"] = _sql((*_TEXTS, "people"), f"""
SELECT id, array_to_string(shared, '|') AS shared, array_to_string(matched[1:2], '|') AS top,
       CASE WHEN len(matched) > 2 THEN '+' || (len(matched) - 2) || ' more' END AS more {_PAIRED}""")
SQL["skill_bonus"] = _sql((*_TEXTS, "people"), f"""
SELECT id, len(shared) AS matched, CASE WHEN len(shared) > 0 THEN least(base + least(4 * len(shared), 20), 100.0) ELSE base END AS match_score
FROM (SELECT *, CAST(coalesce(applicants, 0) * 3 - 45 AS DOUBLE) AS base {_PAIRED})""")

_SCORES = """
, scores AS (SELECT candidate_id, role, role_ord, count(*) AS matched,
    count(*) / any_value(required) * 100 * 0.7::DOUBLE + count(*) * 10 AS score
  FROM (SELECT candidate_id, unnest(mine) AS skill FROM mine) JOIN (SELECT DISTINCT role, role_ord, skill FROM role_dim) USING (skill)
  JOIN (SELECT role, count(*)::DOUBLE AS required FROM role_dim GROUP BY role) USING (role) GROUP BY ALL)"""
_BEST = """
, tops AS (SELECT candidate_id, list(lower(replace(role, ' ', '_')) ORDER BY score DESC, role_ord) AS found FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, role_ord) AS rn FROM scores) WHERE rn <= 3 GROUP BY candidate_id),
best AS (SELECT m.candidate_id, m.mine, coalesce(found, []) AS f,
    CASE WHEN len(f) >= 2 THEN f
         ELSE list_concat(f, list_filter(['software_engineer', 'full_stack_developer'], lambda r: NOT list_contains(f, r)))[1:3] END AS roles
  FROM mine m LEFT JOIN tops t ON t.candidate_id = m.candidate_id)"""
_FILLED = """
, mine AS (SELECT candidate_id, CASE WHEN len(skills) < 3
    THEN list_sort(list_distinct(list_concat(skills, ['python', 'java', 'javascript', 'sql', 'html', 'css']))) ELSE skills END AS mine FROM people)"""
_PLAIN = ", mine AS (SELECT candidate_id, skills AS mine FROM people)"


def _chain(ctes, *parts: str) -> str:
    return _sql(ctes, " ".join(p.strip() for p in parts)).replace(") , ", "), ")


SQL["best_roles"] = _chain((*_PEOPLE, "role_dim"), _FILLED, _SCORES, _BEST, """
SELECT candidate_id, array_to_string(mine, '|') AS skills, array_to_string(roles, '|') AS roles FROM best""")
SQL["best_roles_join"] = SQL["best_roles"]
SQL["role_scores"] = _chain((*_PEOPLE, "role_dim"), _PLAIN, _SCORES, """
SELECT candidate_id, role, matched, round(score, 6) AS score FROM scores""")

_EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+"
_PHONE = r"\+?[0-9]{10,12}|\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
_CONTACT = f"""coalesce(nullif(regexp_extract(lower(text), '{_EMAIL}'), ''), 'Not found') AS email,
       coalesce(nullif(regexp_extract(lower(text), '{_PHONE}'), ''), 'Not found') AS phone"""
SQL["contact_info"] = f"SELECT doc_id, {_CONTACT} FROM documents"
SQL["resume_contacts"] = _sql(_RESUMES, rf"""
SELECT candidate_id, trim(regexp_extract(split_part(text, chr(10), 1), '[\p{{L}}\p{{N}}_\s]+')) AS name, {_CONTACT} FROM resumes""")
_ROLE_FOUND = r"""list_sort(list_distinct(list_transform(regexp_extract_all(replace(text, chr(10), ' '),
  '([a-zA-Z\s-]*(?:developer|engineer|analyst|manager|scientist|architect|intern))\b', 1), lambda r: lower(trim(r)))))"""
SQL["role_phrases"] = _sql(_RESUMES, f"""
SELECT candidate_id, array_to_string(found, '|') AS roles, replace(array_to_string(found, '|'), ' ', '_') AS slugs
FROM (SELECT candidate_id, {_ROLE_FOUND} AS found FROM resumes)""")
_MON = "|".join(m if m == "may" else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
_RANGE = rf"(?:{_MON})\s+\d{{4}}\s*-\s*(?:present|current|(?:{_MON})\s+\d{{4}})"
_INDEX = "CAST(right({x}, 4) AS INTEGER) * 12 + list_position(" + _list([m[:3] for m in MONTHS]) + ", left({x}, 3))"
_SPANS = f"""
, ranges AS (SELECT candidate_id, unnest(found) AS r, generate_subscripts(found, 1) AS i FROM (
    SELECT candidate_id, regexp_extract_all(split_part(text, 'work experience', 2), '{_RANGE}') AS found FROM resumes)),
ends AS (SELECT candidate_id, i, trim(split_part(r, '-', 1)) AS a, trim(split_part(r, '-', 2)) AS b FROM ranges),
spans AS (SELECT candidate_id, i, a, b, CASE WHEN b IN ('present', 'current') THEN 2001 * 12 + 9 ELSE {_INDEX.format(x='b')} END
    - ({_INDEX.format(x='a')}) AS m FROM ends),
worked AS (SELECT candidate_id, sum(greatest(m, 0)) AS months, count(*) AS jobs, string_agg(a || '/' || b || '/' ||
    CASE WHEN floor(m / 12) > 0 THEN CAST(floor(m / 12) AS INTEGER) || ' years'
         WHEN ((m % 12) + 12) % 12 > 0 THEN (((m % 12) + 12) % 12) || ' months' ELSE '0 months' END, '|' ORDER BY i) AS details
  FROM spans GROUP BY candidate_id)"""
_WORKED = """months, round_even(months / 12, 2) AS years, CASE WHEN months / 12 <= 1 THEN 'Fresher' ELSE 'Experienced' END AS category"""
SQL["experience_years"] = _chain(_RESUMES, _SPANS, f"SELECT candidate_id, {_WORKED}, details FROM worked")
_EDU = ["b.tech:computer science", "bachelor of:arts", "m.sc:physics|ph.d:statistics", "master of:business administration", ""]
SQL["education"] = _sql(_RESUMES, f"SELECT candidate_id, {_pick(_EDU, 'candidate_id')} AS education FROM resumes")
_DEGREES = ["|".join(e.split(":")[0] for e in x.split("|") if e) for x in _EDU]
_READ_SKILLS = f"""bodies AS (SELECT candidate_id, regexp_replace(text, '\\s+$', '') AS body FROM resumes),
read_skills AS (SELECT candidate_id, list(skill ORDER BY skill) AS skills FROM bodies CROSS JOIN skill_dim WHERE {_IN_TEXT} GROUP BY candidate_id),
mine AS (SELECT candidate_id, CASE WHEN len(skills) < 3
    THEN list_sort(list_distinct(list_concat(skills, ['python', 'java', 'javascript', 'sql', 'html', 'css']))) ELSE skills END AS mine FROM read_skills)"""
SQL["profile"] = _chain(
    (*_RESUMES, "skill_dim", "role_dim"),
    _SPANS,
    f", {_READ_SKILLS}",
    _SCORES,
    _BEST,
    rf"""
SELECT r.candidate_id, trim(regexp_extract(split_part(text, chr(10), 1), '[\p{{L}}\p{{N}}_\s]+')) AS name, {_CONTACT},
       array_to_string({_ROLE_FOUND}, '|') AS roles, array_to_string(best.mine, '|') AS skills,
       round_even(months / 12, 2) AS years, jobs, {_pick(_DEGREES, 'r.candidate_id')} AS degrees,
       CASE WHEN months / 12 <= 1 THEN 'Fresher' ELSE 'Experienced' END AS category,
       array_to_string(best.roles, '|') AS best_roles, length(body) AS chars
FROM resumes r JOIN worked w ON w.candidate_id = r.candidate_id JOIN best ON best.candidate_id = r.candidate_id
JOIN bodies b ON b.candidate_id = r.candidate_id""",
)

_SHOWN_COUNT = "coalesce(applicants, 0) * 37"
SQL["applicant_count"] = _sql(_POST, f"SELECT id, {_SHOWN_COUNT} AS applicants FROM postings")
SQL["job_type"] = _sql(_POST, """
SELECT id, CASE WHEN job_description IN ('', 'Not Available') THEN 'Not Available' WHEN job_type IS NULL THEN 'Permanent'
  ELSE job_type END AS labelled,
  CASE WHEN job_type IN ('Full Time', 'Contract', 'Internship') THEN lower(job_type) ELSE 'Not Available' END AS named FROM postings""")

_H1 = r"regexp_replace(regexp_extract(body, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g')"
for _ref, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", chr(160)), ("&amp;", "&")):
    _H1 = f"replace({_H1}, '{_ref}', '{_char}')"
SQL["page_fields"] = rf"""
SELECT page_id, url AS job_link, trim({_H1}) AS job_title,
       'Not Available' AS company, 'Not Available' AS location, 'Not disclosed' AS salary, 0 AS applicants, 'Not Available' AS job_type,
       'Not Available' AS experience_level, CAST({AS_OF} AS VARCHAR) AS posted_date
FROM (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS body FROM pages)"""
_DETAIL_TEXT = "CASE WHEN id % 11 = 0 THEN 'Not Available' ELSE trim(job_description || 'Joinus') END"
_DETAIL = f"""
, detail AS (SELECT id AS page_id, job_link, role, job_title, CASE WHEN id % 5 = 0 THEN company || ' & Sons' ELSE company END AS company,
  CASE WHEN id % 11 = 0 THEN 'Not Available' ELSE location END AS location,
  CASE WHEN id % 11 = 0 THEN 'Not disclosed' ELSE salary END AS salary, {_SHOWN_COUNT} AS applicants,
  CASE WHEN id % 11 = 0 THEN 'Not Available' ELSE coalesce(job_type, '') END AS job_type,
  CASE WHEN id % 11 = 0 THEN 'Not Available' ELSE coalesce(experience_level, '') END AS experience_level,
  CAST({AS_OF} - CAST({_DAYS_BACK} AS INTEGER) AS VARCHAR) AS posted_date, {_DETAIL_TEXT} AS job_description, 'LinkedIn' AS source FROM {{posts}}),
bodies AS (SELECT DISTINCT lower(job_description) AS body FROM detail),
found AS (SELECT body, string_agg(skill, ', ' ORDER BY skill) AS skills FROM bodies CROSS JOIN skill_dim WHERE {_IN_TEXT} GROUP BY body)"""
SQL["posting_page_fields"] = _chain((*_POST, "skill_dim"), _DETAIL.replace("{posts}", "postings"), """
SELECT d.*, coalesce(skills, 'Not Available') AS skills_required FROM detail d LEFT JOIN found ON body = lower(job_description)""")
SQL["page_links"] = r"""
WITH bodies AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS body FROM pages),
links AS (SELECT page_id, unnest(regexp_extract_all(body, '(?i)<a\b[^>]*\shref\s*=\s*"([^"]*)"', 1)) AS url FROM bodies)
SELECT url, min(page_id) AS page_id FROM links WHERE url <> ''
  AND url NOT IN (SELECT '/' || list_extract(string_split(url, '/'), -1) FROM pages) GROUP BY url"""
_CARDS = f"""
, listed AS (SELECT *, id // {fx.LISTING_PAGE} AS page, row_number() OVER (PARTITION BY id // {fx.LISTING_PAGE}, role ORDER BY id) - 1 AS pos
  FROM {{posts}} WHERE source = 'Naukri'),
cards AS (SELECT id, job_link, role, page, pos, job_title, CASE WHEN id % 11 = 0 THEN 'Unknown' ELSE company END AS company, location,
  CASE WHEN id % 11 = 0 THEN 'Not Disclosed' ELSE salary END AS salary, coalesce(experience_level, 'Not Available') AS experience_level,
  CASE WHEN id % 7 = 0 THEN 'Not Available' ELSE role || ', sql' END AS skills_required,
  CAST({AS_OF} - CAST({_DAYS_BACK} AS INTEGER) AS VARCHAR) AS posted_date,
  CASE WHEN id % 3 = 0 THEN 'Not Available' ELSE trim(job_description) END AS job_description,
  CASE WHEN id % 3 = 0 OR job_description IN ('', 'Not Available') THEN 'Not Available' WHEN job_type IS NULL THEN 'Permanent'
       WHEN job_type = '' THEN 'Not Available' ELSE job_type END AS job_type,
  CASE WHEN id % 3 = 0 THEN 0 ELSE coalesce(applicants, 0) END AS applicants
  FROM listed WHERE id % 23 <> 0 AND id % 19 <> 0)"""
SQL["page_cards"] = _chain(_POST, _CARDS.replace("{posts}", "postings"), """
SELECT job_link, role, page, pos, job_title, company, location, salary, experience_level, skills_required, posted_date FROM cards""")
SQL["card_details"] = _chain(_POST, _CARDS.replace("{posts}", "postings"), "SELECT job_link, job_description, job_type, applicants FROM cards")
SQL["crawl_quota"] = _chain(_POST, _CARDS.replace("{posts}", "postings"), """
SELECT role, page + 1 AS page, pos, job_link FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY page, pos) AS rn FROM cards WHERE page + 1 <= 3) WHERE rn <= 30""")
SQL["ingest_pages"] = _chain(
    (*_POST, "skill_dim"),
    f", fresh AS (SELECT * FROM postings WHERE posted_date >= DATE '{SPLIT_DATE}'), old AS (SELECT * FROM postings WHERE posted_date < DATE '{SPLIT_DATE}')",
    _DETAIL.replace("{posts}", "fresh"),
    _CARDS.replace("{posts}", "fresh"),
    """
, batch AS (
  SELECT job_link, job_title, company, 'LinkedIn' AS source, location, applicants, job_type, coalesce(skills, 'Not Available') AS skills_required,
         0 AS kind, page_id AS a, 0 AS b FROM detail LEFT JOIN found ON body = lower(job_description)
  UNION ALL
  SELECT job_link, job_title, company, 'Naukri' AS source, location, applicants, job_type, skills_required, 1 AS kind,
         (SELECT min(id) FROM listed l WHERE l.page = c.page AND l.role = c.role) AS a, pos AS b FROM cards c),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(job_title), lower(company), source ORDER BY kind, a, b) AS rn FROM batch) WHERE rn = 1)
SELECT job_link, job_title, company, source, location, applicants, job_type, skills_required FROM firsts f WHERE NOT EXISTS (
  SELECT 1 FROM old o WHERE lower(o.job_title) = lower(f.job_title) AND lower(o.company) = lower(f.company) AND o.source = f.source)""",
)
SQL["upload_routing"] = """
SELECT doc_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM (
  SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'No file selected' WHEN doc_id % 4 >= 2 THEN 'Only PDF or DOCX files are allowed'
    WHEN n_chars * 1000 > 5 * 1024 * 1024 THEN 'File size should be less than 5MB' END AS reason FROM documents)"""
SQL["assemble_text"] = r"""
SELECT conv_id, regexp_replace(lower(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (text <> ''), '')), '^\s+|\s+$', '', 'g') AS text
FROM conversations GROUP BY conv_id"""

SQL["cosine_scores"] = _sql((*_POST, "people"), f"""
SELECT p.id, round({_COS}, 6) AS score FROM postings p JOIN people c ON c.c_name = p.company WHERE p.embedding IS NOT NULL""")
SQL["quota_rank"] = """
WITH nv AS (SELECT count(*) AS n FROM embeddings),
scored AS (SELECT c_nationkey AS nation, o_orderkey AS fetch_rank, CAST(label AS VARCHAR) AS source, floor(o_totalprice) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN nv JOIN embeddings ON vec_id = o_orderkey % n),
s AS (SELECT *, row_number() OVER (PARTITION BY nation, source ORDER BY score DESC, fetch_rank) AS rn,
  min(fetch_rank) OVER (PARTITION BY nation, source) AS source_ord FROM scored),
k AS (SELECT nation, CAST(ceil(40.0 / count(DISTINCT source)) AS INTEGER) AS quota FROM scored GROUP BY nation),
placed AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END,
  CASE WHEN rn <= quota THEN source_ord END NULLS FIRST, CASE WHEN rn > quota THEN -score END NULLS FIRST, source_ord, rn) AS position
  FROM s JOIN k USING (nation))
SELECT nation, position, fetch_rank, source, score FROM placed WHERE position <= 40"""
SQL["recommend"] = _sql(_REC, """
SELECT candidate_id, position, id, job_title, company, location, salary, skills_required, job_link,
       CAST(posted_date AS VARCHAR) AS posted_date, applicants, source, experience_level, job_type,
       round(match_score, 4) AS match_score, array_to_string(matched, '|') AS matched_skills, days_since_posted FROM recommended""")
# The same search and ranking for people whose level, roles and skills are read from their resumes.
_READ_PEOPLE = """
texted AS (SELECT * FROM mine WHERE candidate_id % 13 <> 0),
readers AS (SELECT p.candidate_id, p.pref_location, p.embedding, coalesce(t.mine, []) AS skills, coalesce(best.roles, []) AS roles,
    CASE WHEN t.candidate_id IS NULL THEN '' ELSE 'text' END AS resume_text,
    CASE p.candidate_id % 4 WHEN 0 THEN 'Fresher' WHEN 1 THEN 'Experienced'
      ELSE CASE WHEN t.candidate_id IS NULL THEN NULL WHEN months / 12 <= 1 THEN 'Fresher' ELSE 'Experienced' END END AS category
  FROM people p LEFT JOIN texted t ON t.candidate_id = p.candidate_id LEFT JOIN worked w ON w.candidate_id = t.candidate_id
  LEFT JOIN best ON best.candidate_id = t.candidate_id)"""
_READERS = ", ".join(
    f"{name} AS ({CTES[name].strip().replace('people c', 'readers c')})"
    for name in ("fetched", "scored", "in_source", "with_quota", "placed", "recommended")
)
SQL["resume_recommendations"] = _sql(
    (*_POST, "people", "ordered_skills", "resumes", "skill_dim", "role_dim", "level_bands", "texts", "text_skills", "text_lists", "posting_skills"),
    f"""{_SPANS.strip()}, {_READ_SKILLS}{_SCORES.strip()}{_BEST.strip()}, {_READ_PEOPLE}, {_READERS}{_FLAGS.replace('people c', 'readers c')}
SELECT s.candidate_id, status, CASE status WHEN 'no_text' THEN 'Failed to extract data from resume'
  WHEN 'no_jobs' THEN 'No jobs found matching your criteria. Try broadening your search.'
  WHEN 'none_matched' THEN 'No jobs matched your resume.'
  WHEN 'mismatch' THEN 'Experience levels don''t match closely. Consider adjusting your experience level.' END AS message, fetched,
  position, id, round(match_score, 4) AS match_score, array_to_string(matched, '|') AS matched_skills
FROM (SELECT c.candidate_id, coalesce(fetched, 0) AS fetched, CASE WHEN resume_text = '' THEN 'no_text'
        WHEN coalesce(fetched, 0) = 0 THEN 'no_jobs' WHEN usable = 0 THEN 'none_matched'
        WHEN coalesce(c.category, '') <> '' AND NOT any_match THEN 'mismatch' ELSE 'ok' END AS status
      FROM readers c LEFT JOIN flags f ON f.candidate_id = c.candidate_id) s
LEFT JOIN (SELECT * FROM recommended WHERE candidate_id IN (SELECT candidate_id FROM texted)) r ON r.candidate_id = s.candidate_id""",
).replace(") , ranges", "), ranges")
_PAGE = "CAST(ceil(place / 10.0) AS INTEGER) AS page"
SQL["views_all"] = _sql(_REC, f"""
SELECT candidate_id, place, {_PAGE}, position, id, job_title, coalesce(applicants, 0) AS applicants,
  'Posted ' || CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 14 THEN 'a week ago'
    WHEN d < 21 THEN '2 weeks ago' WHEN d < 28 THEN '3 weeks ago' ELSE 'a month ago' END AS age_label,
  printf('%.2f', match_score) AS score_label, len(matched) AS skills_count, array_to_string(matched[1:5], '|') AS skills_shown,
  CASE WHEN len(matched) > 5 THEN '+' || (len(matched) - 5) || ' more' END AS skills_more, lower(source) AS source_key
FROM (SELECT *, days_since_posted AS d, row_number() OVER (PARTITION BY candidate_id ORDER BY position) AS place FROM recommended)
WHERE place <= 20""")
SQL["views_recent"] = _sql(_REC, f"""
SELECT candidate_id, place, {_PAGE}, position, id, days_since_posted
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY days_since_posted, position) AS place FROM recommended)""")
SQL["views_high"] = _sql(_REC, f"""
SELECT candidate_id, place, {_PAGE}, position, id, round(match_score, 4) AS match_score
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY match_score DESC, position) AS place FROM recommended WHERE match_score >= 20)""")
SQL["views_source"] = _sql(_REC, f"""
SELECT candidate_id, place, {_PAGE}, position, id, source
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY position) AS place FROM recommended WHERE lower(source) = 'naukri')""")
SQL["paging"] = _sql(_REC, """
SELECT candidate_id, count(*) AS total, count(*) FILTER (match_score >= 20) AS visible, count(*) FILTER (match_score >= 20) = 0 AS none_found
FROM recommended GROUP BY candidate_id""")
SQL["source_list"] = _sql(_REC, """
SELECT candidate_id, lower(source) AS source_key, arg_min(source, position) AS source, min(position) AS first_position
FROM recommended GROUP BY candidate_id, lower(source)""")
SQL["stream_ingest"] = _sql(_POST, """
SELECT job_title, company, source, CASE WHEN source IS NULL THEN count(*) ELSE 1 END AS rows
FROM (SELECT job_title, company, CASE WHEN id % 10 <> 0 THEN source END AS source FROM postings) GROUP BY job_title, company, source""")

# Crawls ---------------------------------------------------------------------

_SIGHTINGS = f"""
, sightings AS (SELECT CASE WHEN id % 13 = 0 THEN '' WHEN id % 7 = 0 THEN 'https://jobs.example.com/' || (id - id % {5 * fx.LISTING_PAGE}) ELSE job_link END AS url,
    role, id // {fx.LISTING_PAGE} + 1 AS page, min(id) OVER (PARTITION BY id // {fx.LISTING_PAGE}, role) AS page_id,
    row_number() OVER (PARTITION BY id // {fx.LISTING_PAGE}, role ORDER BY id) - 1 AS pos FROM postings),
links0 AS (SELECT * FROM sightings WHERE url <> '' AND page <= 2 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1),
links1 AS (SELECT * FROM sightings WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1),
links AS (SELECT 0 AS batch_id, * FROM links0 UNION ALL SELECT 1, * FROM links1 WHERE url NOT IN (SELECT url FROM links0)),
ranked_links AS (SELECT *, row_number() OVER (PARTITION BY batch_id, role ORDER BY page, page_id, pos) AS place FROM links WHERE page <= 5),
followed AS (SELECT batch_id, url, role FROM ranked_links WHERE place <= 10)"""
SQL["crawl_frontier"] = _chain(_POST, _SIGHTINGS, """
SELECT batch_id, url, role, page, page_id, pos, url IN (SELECT url FROM followed f WHERE f.batch_id = l.batch_id) AS taken FROM links l""")
SQL["discover_and_ingest"] = _chain(
    (*_POST, "skill_dim"),
    _DETAIL.replace("{posts}", "postings"),
    _CARDS.replace("{posts}", "postings"),
    _SIGHTINGS,
    """
, quota_cards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY page, pos) AS rn FROM cards WHERE page + 1 <= 3) WHERE rn <= 30),
batch AS (
  SELECT batch_id, job_link, job_title, company, 'LinkedIn' AS source, f.role, applicants, coalesce(skills, 'Not Available') AS skills_required,
         0 AS kind, page_id AS a, 0 AS b FROM detail d JOIN followed f ON f.url = d.job_link LEFT JOIN found ON body = lower(job_description)
  UNION ALL
  SELECT 0 AS batch_id, job_link, job_title, company, 'Naukri' AS source, role, applicants, skills_required, 1 AS kind,
         (SELECT min(id) FROM listed l WHERE l.page = c.page AND l.role = c.role) AS a, pos AS b FROM quota_cards c),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY lower(job_title), lower(company), source ORDER BY batch_id, kind, a, b) = 1)
SELECT batch_id, row_number() OVER (ORDER BY batch_id, kind, a, b) AS id, job_link, job_title, company, source, role, applicants, skills_required
FROM firsts""",
)
SQL["stream_batches"] = _sql(_POST, f"""
, arrivals AS (SELECT id AS arrival, job_title, company, CASE WHEN id % 10 <> 0 THEN source END AS source,
    CASE WHEN posted_date < DATE '1994-01-01' THEN 0 WHEN posted_date < DATE '{SPLIT_DATE}' THEN 1 ELSE 2 END AS part FROM postings),
firsts AS (SELECT * FROM arrivals
  QUALIFY source IS NULL OR row_number() OVER (PARTITION BY lower(job_title), lower(company), lower(source) ORDER BY part, arrival) = 1)
SELECT greatest(part, 1) AS batch_id, row_number() OVER (ORDER BY part, arrival) AS id, arrival, job_title, company, source FROM firsts
""").replace(") , arrivals", "), arrivals")
SQL["read_source"] = _sql(_POST, """
SELECT id, CASE WHEN id % 10 <> 0 THEN source END AS source, CAST(posted_date AS VARCHAR) AS posted_date FROM postings
WHERE (id % 10 = 0 OR lower(source) = 'naukri') AND posted_date >= DATE '1996-01-01'""")
SQL["run_report_totals"] = _sql(_POST, f"""
, marked AS (SELECT *, {_VALID} AS stays, ({_LEVEL_CASE}) IS DISTINCT FROM experience_level AS changes FROM postings)
SELECT CASE WHEN grouping(source) = 0 AND grouping(role) = 0 THEN 'source and role' WHEN grouping(source) = 0 THEN 'source'
            WHEN grouping(role) = 0 THEN 'role' ELSE 'total' END AS scope, source, role,
       count(*) AS rows_before, count(*) FILTER (stays) AS rows_after, 0 AS inserted, count(*) FILTER (NOT stays) AS deleted,
       count(*) FILTER (stays AND changes) AS updated FROM marked GROUP BY CUBE (source, role)""").replace(") , marked", "), marked")
SQL["checked_postings"] = _sql(_POST, """
SELECT source, count(*) FILTER (id % 11 <> 0) AS accepted, count(*) FILTER (id % 11 = 0) AS refused FROM postings GROUP BY source""")
SQL["missing_ids"] = _sql(_POST, """
SELECT count(*) AS n, count(*) AS distinct_ids, count(*) FILTER (id % 10 <> 0) AS kept FROM postings""")
SQL["fetch_time"] = """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fetched FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

# Single requests, bands and models ------------------------------------------

SQL["recommend_one"] = SQL["recommend"] + " WHERE candidate_id = 7"
SQL["search_one"] = _sql((*_POST, "people", "fetched"), """
SELECT p.id, job_title, location, experience_level, CAST(posted_date AS VARCHAR) AS posted_date
FROM fetched f JOIN postings p ON p.id = f.id WHERE f.candidate_id = 7""")
SQL["band_join"] = """
WITH wanted AS (SELECT o_orderkey AS id, c_nationkey AS nation, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey % 40 END AS low,
    low + o_orderkey % 7 + CASE WHEN o_orderkey % 500 = 1 THEN 900 ELSE 0 END AS high FROM orders JOIN customer ON o_custkey = c_custkey),
offered AS (SELECT c_custkey AS customer, c_nationkey AS nation, c_custkey % 25 AS low, c_custkey % 25 + c_custkey % 4 - 1 AS high FROM customer)
SELECT customer, count(*) AS n, sum(id)::BIGINT AS orders FROM wanted w JOIN offered o
  ON w.nation = o.nation AND o.low <= o.high AND w.low <= o.high AND w.high >= o.low GROUP BY customer"""
SQL["stale_vectors"] = """
SELECT doc_id, 'hashed:256' AS embedding_model, doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 AS made FROM documents"""
