"""SQL that gives the rows of each query from the same tables, in the dialect of the checking engine."""

from __future__ import annotations

from casewright.operators.sections import EMPTY_SECTION
from casewright.plans.queries import PATTERNS, TRUNCATE_AT
from casewright.plans.views import FAILED_CASE, FILE_CASE, PATH_CASE, PLAN_CASE, REPLY_CASE

ORACLE_SQL: dict[str, str] = {}
STEP_LABELS = "('steps','test steps','steps and expected results','expected results','procedure','test procedure')"
HINTS = "step|action|expect|result|outcome|procedure|actual|pass|fail|criteria|description|verification|input|output"
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def strip(x: str) -> str:
    return STRIP.format(x)


def suggests(x: str) -> str:
    return rf"""(regexp_matches({x}, '(?i)\b(expected\s+(results?|behaviors?|outcomes?)|procedure|precondition|test\s+cases?|verification|actual\s+result|test\s+(objective|description|steps?)|given\s+when\s+then)\b')
      OR regexp_matches({x}, '(?i)\bsteps?\s*[:\d]') OR regexp_matches({x}, '(?m)^\s*(\d+|[a-z])[.)]\s+\S')
      OR regexp_matches({x}, '(?im)^(expected|steps?|procedure|action|result)s?\s*:') OR regexp_matches({x}, '(?i)\bTC[-_]\d')
      OR len(list_filter(string_split({x}, chr(10)), lambda y: contains(y, '|'))) >= 2)"""


CASE_ID = r"nullif(regexp_extract(title, '(?i)(?:^|[^A-Za-z0-9])(VZ_TC_[A-Za-z0-9_.-]+_\d+)(?:$|[^A-Za-z0-9])', 1), '')"
ACTION = f"CASE WHEN body <> '' AND {suggests('body')} THEN 'extract' WHEN body <> '' THEN 'skip' WHEN {CASE_ID} IS NOT NULL THEN 'placeholder' ELSE 'drop' END"

VIEWS: dict[str, str] = {
    "plan_lines": f"""SELECT doc_id, pos, {PLAN_CASE} AS line FROM (SELECT doc_id, CAST(p AS INT) - 1 AS pos, raw FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))""",
    "plan_docs": f"SELECT doc_id, {FILE_CASE} AS file_name, string_agg(line, chr(10) ORDER BY pos) AS doc_text FROM plan_lines GROUP BY doc_id",
    "headed": rf"""SELECT *, CASE WHEN level IS NOT NULL THEN trim(regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 2)) END AS title FROM (
        SELECT *, nullif(length(regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 1)), 0) AS level FROM plan_lines)""",
    "normed": r"""SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)^appendix\s+[a-z0-9]+\s*[.:]\s*', ''),
        '^\d+(\.\d+)*\.?\s*', ''), '(?i)^(chapter|section|part)\s+\d+[.:]\s*', ''), '\s+', ' ', 'g'))) AS norm FROM headed WHERE level IS NOT NULL""",
    "flagged": r"""SELECT doc_id, pos, level, title, norm IN ('table of contents','contents','toc','introduction','intro','revision history','revisions',
        'document revision history','change history','version history','document history','record of changes','list of figures','list of tables','appendix','appendices')
        OR starts_with(norm, 'toc ') OR regexp_matches(norm, '\btable of contents\b') OR regexp_matches(norm, '\b(revision|change|version)\s+history\b')
        OR regexp_matches(norm, '^appendix(\s+[a-z0-9]{1,8})?$') OR regexp_matches(norm, '^appendix(\s+[a-z0-9]{1,8})?\s*:')
        OR regexp_matches(title, '(?i)^appendix(\s+[a-z0-9]{1,8})?\s*:') AS boilerplate FROM normed""",
    # from a boilerplate heading to before the next heading of its level or above
    "hidden": """SELECT b.doc_id, b.pos AS first, coalesce(min(h.pos), 1000000000) AS stop, any_value(b.title) AS title FROM flagged b
        LEFT JOIN flagged h ON h.doc_id = b.doc_id AND h.pos > b.pos AND h.level <= b.level WHERE b.boilerplate GROUP BY b.doc_id, b.pos""",
    "opened": "SELECT * FROM hidden a WHERE NOT EXISTS (SELECT 1 FROM hidden o WHERE o.doc_id = a.doc_id AND o.first < a.first AND a.first < o.stop)",
    "shown": """SELECT l.*, EXISTS (SELECT 1 FROM opened o WHERE o.doc_id = l.doc_id AND l.pos >= o.first AND l.pos < o.stop) AS skipped FROM headed l""",
    "prep": r"""SELECT doc_id, pos, line, level, title, fallback FROM (
        SELECT *, NOT coalesce(max(CAST(NOT skipped AND trim(line) <> '' AS INT)) OVER (PARTITION BY doc_id), 0) = 1 AS fallback FROM shown)
        WHERE (NOT skipped OR fallback) AND NOT regexp_matches(replace(line, '|', ' '), '\S.*\.{4,}\s*\d+\s*$')""",
    "cut_auto": f"""SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN title = '' THEN '(preamble)' ELSE title END AS title, body FROM (
        SELECT doc_id, section_no, coalesce(max(CASE WHEN opens THEN title END), '') AS title, {strip("coalesce(string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM (
          SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM (
            SELECT *, coalesce(level = coalesce(min(level) OVER (PARTITION BY doc_id), 1), false) AS opens FROM prep)) GROUP BY doc_id, section_no)
        WHERE NOT (body = '' AND title IN ('', '(preamble)'))""",
    "cut_3": f"""SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN title = '' THEN '(preamble)' ELSE title END AS title, body FROM (
        SELECT doc_id, section_no, coalesce(max(CASE WHEN opens THEN title END), '') AS title, {strip("coalesce(string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM (
          SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM (
            SELECT *, coalesce(level = 3, false) AS opens FROM headed)) GROUP BY doc_id, section_no)
        WHERE NOT (body = '' AND title IN ('', '(preamble)'))""",
    "cut_p3": f"""SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN title = '' THEN '(preamble)' ELSE title END AS title, body FROM (
        SELECT doc_id, section_no, coalesce(max(CASE WHEN opens THEN title END), '') AS title, {strip("coalesce(string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM (
          SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM (
            SELECT *, coalesce(level = 3, false) AS opens FROM prep)) GROUP BY doc_id, section_no)
        WHERE NOT (body = '' AND title IN ('', '(preamble)'))""",
    "acted": f"SELECT *, {ACTION} AS action FROM cut_3",
    "t_lines": r"""SELECT * FROM (SELECT *, max(CASE WHEN opens THEN trim(regexp_replace(trim(line), '^#+', '')) END) OVER (PARTITION BY doc_id, section_no) AS head FROM (
          SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM (
            SELECT *, regexp_matches(line, '^## .+$') AS opens FROM plan_lines)) WHERE section_no > 0)
        WHERE regexp_matches(head, '\b([A-Z][A-Z0-9]*(_[A-Z0-9]+){1,})\s*$')""",
    "t_state": f"""SELECT *, coalesce(last_value(CASE kind WHEN 'pre' THEN 'preconditions' WHEN 'step' THEN 'body' WHEN 'row' THEN 'body' END IGNORE NULLS)
          OVER (PARTITION BY doc_id, section_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'description') AS state,
        count(*) FILTER (kind <> 'row') OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS run FROM (
          SELECT *, CASE WHEN s = '' OR opens THEN 'blank' WHEN label IN ('preconditions','precondition','applicability','prerequisites') THEN 'pre'
            WHEN label IN {STEP_LABELS} THEN 'step' WHEN contains(s, '|') AND length(s) > 2 THEN 'row' ELSE 'text' END AS kind
          FROM (SELECT *, trim(line) AS s, regexp_replace(lower(trim(line)), ':+$', '') AS label FROM t_lines))""",
    "t_runs": f"""SELECT doc_id, section_no, run, string_agg(s, chr(10) ORDER BY pos) AS txt FROM t_state WHERE kind = 'row' GROUP BY doc_id, section_no, run
        HAVING arg_min(state, pos) = 'body' OR len(list_filter(string_split(arg_min(s, pos), '|'), lambda c: regexp_matches(lower(c), '{HINTS}'))) > 0""",
    "t_rows": r"""SELECT s.doc_id, CAST(s.section_no AS INT) AS section_no, any_value(d.file_name) AS file_name, regexp_extract(any_value(s.head), '\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){1,})\s*$', 1) AS test_id,
        trim(regexp_replace(any_value(s.head), '\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){1,})\s*$', '')) AS test_name,
        coalesce(string_agg(CASE WHEN kind = 'text' AND state = 'description' THEN s END, chr(10) ORDER BY pos), '') AS description,
        coalesce(string_agg(CASE WHEN kind = 'text' AND state = 'preconditions' THEN s END, chr(10) ORDER BY pos), '') AS preconditions,
        coalesce(any_value(r.steps), '') AS steps_expected FROM t_state s JOIN plan_docs d ON d.doc_id = s.doc_id
        LEFT JOIN (SELECT doc_id, section_no, string_agg(txt, chr(10) || chr(10) ORDER BY run) AS steps FROM t_runs GROUP BY doc_id, section_no) r ON r.doc_id = s.doc_id AND r.section_no = s.section_no
        GROUP BY s.doc_id, s.section_no""",
    "raw_cases": "SELECT doc_id, section_no, file_name, test_id, test_name, description, preconditions, steps_expected AS procedure_steps, '' AS expected_results FROM t_rows",
    "merged": """SELECT doc_id, min(section_no) AS section_no, arg_min(file_name, section_no) AS file_name, any_value(test_id) AS test_id, arg_min(test_name, section_no) AS test_name,
        """
    + ", ".join(f"CASE WHEN count(*) > 1 THEN coalesce(string_agg(CASE WHEN trim({c}) <> '' THEN {c} END, chr(10) ORDER BY section_no), '') ELSE any_value({c}) END AS {c}" for c in ("description", "preconditions", "procedure_steps", "expected_results"))
    + """, count(*) AS run_rows FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY section_no) AS run FROM (
          SELECT *, CASE WHEN lag(test_id) OVER (PARTITION BY doc_id ORDER BY section_no) = test_id AND test_id <> '' THEN 0 ELSE 1 END AS starts FROM raw_cases)) GROUP BY doc_id, run""",
    "model_rows": f"""SELECT c.doc_id, section_no, file_name, 'S' || CAST(length(body) % 5 AS VARCHAR) AS test_id, {strip("string_split(body, chr(10))[1]")} AS test_name, CAST(length(body) AS VARCHAR) AS description, '' AS preconditions, '' AS procedure_steps, '' AS expected_results
        FROM cut_p3 c JOIN plan_docs d ON d.doc_id = c.doc_id WHERE {ACTION} = 'extract'
        UNION ALL SELECT c.doc_id, section_no, file_name, {CASE_ID}, trim(title), '{EMPTY_SECTION}', '', '', '' FROM cut_p3 c JOIN plan_docs d ON d.doc_id = c.doc_id WHERE {ACTION} = 'placeholder'""",
    "model_merged": """SELECT doc_id, min(section_no) AS section_no, arg_min(file_name, section_no) AS file_name, any_value(test_id) AS test_id, arg_min(test_name, section_no) AS test_name,
        """
    + ", ".join(f"CASE WHEN count(*) > 1 THEN coalesce(string_agg(CASE WHEN trim({c}) <> '' THEN {c} END, chr(10) ORDER BY section_no), '') ELSE any_value({c}) END AS {c}" for c in ("description", "preconditions", "procedure_steps", "expected_results"))
    + """, count(*) AS run_rows FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY section_no) AS run FROM (
          SELECT *, CASE WHEN lag(test_id) OVER (PARTITION BY doc_id ORDER BY section_no) = test_id AND test_id <> '' THEN 0 ELSE 1 END AS starts FROM model_rows)) GROUP BY doc_id, run""",
    "line_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS test_id, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS t,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem""",
    "line_merged": """SELECT l_orderkey, arg_min(l_linenumber, n) AS l_linenumber, arg_min(l_partkey, n) AS l_partkey, any_value(test_id) AS test_id, CASE WHEN count(*) > 1
        THEN coalesce(string_agg(CASE WHEN trim(t) <> '' THEN t END, chr(10) ORDER BY n), '') ELSE any_value(t) END AS t, count(*) AS run_rows FROM (
          SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM (
            SELECT *, CASE WHEN lag(test_id) OVER (PARTITION BY l_orderkey ORDER BY n) = test_id THEN 0 ELSE 1 END AS starts FROM line_rows)) GROUP BY l_orderkey, run""",
    "all_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS test_id, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS t,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem""",
    "all_merged": """SELECT arg_min(l_orderkey, n) AS l_orderkey, arg_min(l_linenumber, n) AS l_linenumber, arg_min(l_partkey, n) AS l_partkey, any_value(test_id) AS test_id, CASE WHEN count(*) > 1
        THEN coalesce(string_agg(CASE WHEN trim(t) <> '' THEN t END, chr(10) ORDER BY n), '') ELSE any_value(t) END AS t, count(*) AS run_rows FROM (
          SELECT *, sum(starts) OVER (ORDER BY n) AS run FROM (
            SELECT *, CASE WHEN lag(test_id) OVER (ORDER BY n) = test_id THEN 0 ELSE 1 END AS starts FROM all_rows)) GROUP BY run""",
    "matched": r"""SELECT d.doc_id, d.file_name, CASE WHEN EXISTS (SELECT 1 FROM plan_lines l WHERE l.doc_id = d.doc_id AND starts_with(l.line, '## ')
        AND regexp_matches(l.line, '\b([A-Z][A-Z0-9]*(_[A-Z0-9]+){1,})\s*$')) THEN 'Underscore-ID Test Plan' END AS template FROM plan_docs d""",
    "results": """SELECT m.doc_id, m.file_name, m.template, count(t.doc_id) AS n_rows,
        CASE WHEN m.doc_id % 4 = 3 THEN 'unsupported' WHEN any_value(m.template) IS NULL THEN 'no_template' END AS reason,
        CASE WHEN m.doc_id % 4 = 3 THEN 'Unsupported file type: .txt' WHEN any_value(m.template) IS NULL THEN 'No matching template' END AS detail
        FROM matched m LEFT JOIN t_rows t ON t.doc_id = m.doc_id GROUP BY m.doc_id, m.file_name, m.template""",
    "status": "SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN reason IS NOT NULL THEN 'failed' WHEN n_rows = 0 THEN 'not_written' ELSE 'written' END AS status FROM results",
    "replies": f"""SELECT conv_id AS doc_id, turn AS section_no, conv_id % 6 AS form, {REPLY_CASE} AS content, concat('conv_', CAST(conv_id AS VARCHAR), '.docx') AS file_name,
        concat('Section ', CAST(turn AS VARCHAR)) AS title, turn FROM conversations WHERE role = 'assistant'""",
    "reply_errors": """SELECT *, CASE form WHEN 2 THEN 'Model output was not valid JSON' WHEN 3 THEN 'JSON must contain a "test_cases" array.'
        WHEN 4 THEN '"test_cases" must be an array.' WHEN 5 THEN 'LLM returned empty content.' END AS error FROM replies""",
    "failing": f"SELECT event_id AS request_id, {FAILED_CASE} AS error FROM events",
    "paths": f"SELECT p_partkey, {PATH_CASE} AS path, replace(p_name, ' ', '_') AS stem, p_partkey % 4 AS k FROM part",
    "feed": """SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'progress' END ELSE 'progress' END AS type,
        concat('failed at ', CAST(event_id AS VARCHAR)) AS message FROM events""",
    "blocks": """SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, round(l_quantity, 2) AS top, round(l_discount, 2) AS lft, l_partkey * 8 + l_linenumber AS block_no,
        CASE WHEN l_linenumber % 4 = 3 THEN concat('id | flag', chr(10), CAST(l_partkey AS VARCHAR), ' | ', l_returnflag, chr(10))
          WHEN l_linenumber % 5 = 0 THEN NULL ELSE concat('part ', CAST(l_partkey AS VARCHAR)) END AS txt FROM lineitem""",
}
NEEDS = {name: [v for v in VIEWS if v != name and f" {v} " in f"{sql} ".replace(")", " ").replace("\n", " ").replace(";", " ")] for name, sql in VIEWS.items()}


def oracle(name: str, body: str) -> None:
    """Register ``body`` with the views that it reads, each after those it reads itself."""
    wanted: list[str] = []

    def want(v: str) -> None:
        for n in NEEDS[v]:
            want(n)
        if v not in wanted:
            wanted.append(v)

    spaced = f"{body} ".replace(")", " ").replace("\n", " ")
    for v in VIEWS:
        if f" {v} " in spaced:
            want(v)
    ORACLE_SQL[name] = ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + "\n" if wanted else "") + body


CASES = "file_name, test_id, test_name, description, preconditions, procedure_steps, expected_results"
NOTE = "'⚠ Duplicate test_id (non-contiguous): ' || test_id || chr(10) || chr(10)"
WARN = "'⚠ test_id ''' || test_id || ''' has non-contiguous duplicate rows — review required.'"

oracle("heading_parse", "SELECT doc_id, pos, CAST(level AS INT) AS level, title FROM headed WHERE level IS NOT NULL")
oracle("heading_normalize", "SELECT doc_id, pos, norm FROM normed")
oracle("boilerplate_flag", "SELECT doc_id, pos, boilerplate FROM flagged")
oracle("prep_lines", "SELECT doc_id, pos, line FROM prep")
oracle(
    "prep_text_meta",
    """SELECT d.doc_id, md5(coalesce(p.txt, '')) AS text_md5, CAST(length(d.doc_text) AS BIGINT) AS chars_before, CAST(length(coalesce(p.txt, '')) AS BIGINT) AS chars_after,
    coalesce(o.removed, '') AS removed, coalesce(f.fallback AND trim(d.doc_text, ' ' || chr(10)) <> '', false) AS fallback, o.removed IS NOT NULL AS stripped FROM plan_docs d
    LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS txt FROM prep GROUP BY doc_id) p ON p.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, NOT max(CAST(NOT skipped AND trim(line) <> '' AS INT)) = 1 AS fallback FROM shown GROUP BY doc_id) f ON f.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(title, ' ; ' ORDER BY first) AS removed FROM opened GROUP BY doc_id) o ON o.doc_id = d.doc_id""",
)
oracle("toc_lines", r"SELECT doc_id, pos FROM plan_lines WHERE regexp_matches(replace(line, '|', ' '), '\S.*\.{4,}\s*\d+\s*$')")
oracle("removed_titles", "SELECT doc_id, first AS pos, title FROM opened")
oracle("shallowest_level", "SELECT doc_id, CAST(min(level) AS INT) AS level FROM headed GROUP BY doc_id")
oracle("sections_by_heading", "SELECT doc_id, section_no, title, body FROM cut_auto")
oracle(
    "sections_by_pattern",
    f"""SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN title = '' THEN '(preamble)' ELSE title END AS title, body FROM (
    SELECT doc_id, section_no, coalesce(max(CASE WHEN opens THEN substr(trim(line), 1, 800) END), '') AS title, {strip("coalesce(string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM (
      SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM (
        SELECT *, {" OR ".join(f"regexp_matches(trim(line), '{p}')" for p in PATTERNS)} AS opens FROM plan_lines )) GROUP BY doc_id, section_no)
    WHERE NOT (body = '' AND title IN ('', '(preamble)'))""",
)
oracle("pattern_misses", "SELECT doc_id FROM plan_lines GROUP BY doc_id HAVING NOT bool_or(contains(line, 'VZ_TC_A_'))")
oracle("section_action", "SELECT doc_id, section_no, title, action FROM acted")
oracle(
    "section_plan",
    """SELECT doc_id, count(*) FILTER (action = 'extract') AS n_extract, count(*) FILTER (action = 'skip') AS n_skip, count(*) FILTER (action = 'placeholder') AS n_placeholder, count(*) FILTER (action = 'drop') AS n_drop,
    coalesce(string_agg(CASE WHEN action = 'skip' THEN title END, ' ; ' ORDER BY section_no), '') AS skipped, coalesce(string_agg(CASE WHEN action = 'placeholder' THEN title END, ' ; ' ORDER BY section_no), '') AS placed FROM acted GROUP BY doc_id""",
)
oracle("placeholder_rows", f"SELECT a.doc_id, section_no, file_name, {CASE_ID} AS test_id, trim(title) AS test_name, '{EMPTY_SECTION}' AS description, '' AS preconditions, '' AS procedure_steps, '' AS expected_results FROM acted a JOIN plan_docs d ON d.doc_id = a.doc_id WHERE action = 'placeholder'")
oracle("whole_document_mode", f"SELECT doc_id, 0 AS section_no, CAST(length(doc_text) AS BIGINT) AS n_chars, CASE WHEN {strip('doc_text')} = '' THEN 'drop' WHEN {suggests('doc_text')} THEN 'extract' ELSE 'skip' END AS action FROM plan_docs")
oracle("truncate_docs", f"SELECT doc_id, md5(CASE WHEN length(doc_text) > {TRUNCATE_AT} THEN substr(doc_text, 1, {TRUNCATE_AT}) || chr(10) || chr(10) || '[... truncated for model context ...]' ELSE doc_text END) AS text_md5, length(doc_text) > {TRUNCATE_AT} AS truncated, CAST(length(doc_text) AS BIGINT) AS n_chars FROM plan_docs")
oracle("ellipsis", "SELECT doc_id, CASE WHEN length(s) > 220 THEN substr(s, 1, 219) || '…' ELSE s END AS message FROM (SELECT doc_id, trim(replace(doc_text, chr(10), ' ')) AS s FROM plan_docs )")
oracle("template_match", "SELECT doc_id, template FROM matched")
oracle("template_unmatched", "SELECT doc_id, file_name, 'no_template' AS reason FROM matched WHERE template IS NULL")
oracle("template_rows", "SELECT * FROM t_rows")
oracle("merge_runs", f"SELECT doc_id, section_no, {CASES}, run_rows FROM merged")
oracle("merge_runs_lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, test_id, t AS description, t AS preconditions, t AS procedure_steps, t AS expected_results, run_rows FROM line_merged")
oracle("scattered_duplicates", f"SELECT l_orderkey, l_linenumber, l_partkey, test_id, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, test_id) > 1 THEN {NOTE} || t ELSE t END AS description FROM line_merged")
oracle("scattered_warnings", f"SELECT l_orderkey, test_id, count(*) AS n_rows, min(l_linenumber) AS first, {WARN} AS warning FROM line_merged GROUP BY l_orderkey, test_id HAVING count(*) > 1")
oracle("merge_runs_request", "SELECT 1 AS request, l_orderkey, l_linenumber, l_partkey, test_id, t AS description, t AS preconditions, t AS procedure_steps, t AS expected_results, run_rows FROM all_merged")
oracle("scattered_request", f"SELECT l_orderkey, l_linenumber, l_partkey, test_id, CASE WHEN count(*) OVER (PARTITION BY test_id) > 1 THEN {NOTE} || t ELSE t END AS description FROM all_merged")
oracle("scattered_warnings_request", f"SELECT test_id, count(*) AS n_rows, min(l_orderkey) AS first_order, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS first_line, {WARN} AS warning FROM all_merged GROUP BY test_id HAVING count(*) > 1")
oracle("file_results", "SELECT doc_id, file_name, template, n_rows, reason IS NULL AS ok, reason FROM results")
oracle("templates_used", "SELECT doc_id % 10 AS scope, string_agg(DISTINCT template, ' · ') AS templates FROM results WHERE template IS NOT NULL GROUP BY doc_id % 10")
oracle("batch_summary", "SELECT count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'not_written') AS not_written, count(*) FILTER (status = 'failed') AS failures FROM status")
oracle("document_status", "SELECT doc_id, status FROM status")
oracle("failure_log", "SELECT file_name AS file, 'extract' AS phase, reason, detail FROM status WHERE status = 'failed'")
oracle(
    "error_messages",
    f"""SELECT 0 AS kind, CAST(doc_id AS INT) AS doc_ord, 0 AS section_no, file_name || ': ' || detail AS message FROM results WHERE detail IS NOT NULL
    UNION ALL SELECT 0, CAST(doc_id AS INT), CAST(section_no AS INT) + 1, file_name || ': Section "' || title || '": ' || error FROM reply_errors WHERE error IS NOT NULL
    UNION ALL SELECT 1, CAST(doc_id AS INT), 0, {WARN} FROM merged WHERE test_id <> '' GROUP BY doc_id, test_id HAVING count(*) > 1""",
)
oracle(
    "build_requests",
    f"""SELECT c.doc_id, section_no, md5('Filename: ' || file_name || chr(10) || 'Section: ' || title || chr(10) || chr(10) || 'User hints about identifiers / section titles (from human): VZ_TC_*' || chr(10) || chr(10) || '--- Document text ---' || chr(10) || chr(10)
    || CASE WHEN length(body) > {TRUNCATE_AT} THEN substr(body, 1, {TRUNCATE_AT}) || chr(10) || chr(10) || '[... truncated for model context ...]' ELSE body END) AS content_md5, 'json_object' AS format, length(body) > {TRUNCATE_AT} AS truncated, CAST(length(body) AS BIGINT) AS doc_char_count
    FROM cut_auto c JOIN plan_docs d ON d.doc_id = c.doc_id WHERE body <> '' AND {suggests('body')}""",
)
oracle("assemble_stream", "SELECT conv_id AS request_id, string_agg('t' || CAST(turn AS VARCHAR), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
oracle("completion_content", f"SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE {strip('text')} END AS content, CASE WHEN turn % 5 = 4 THEN 'LLM returned no choices.' END AS error FROM conversations")
oracle("strip_fence", "SELECT doc_id, section_no, CASE WHEN starts_with(content, '```') THEN string_split(content, chr(10))[2] ELSE content END AS content FROM replies")
oracle(
    "parse_cases",
    """SELECT doc_id, section_no, 1 AS case_no, file_name, 'TC_' || CAST(doc_id AS VARCHAR) AS test_id, 'name ' || CAST(turn AS VARCHAR) AS test_name, 'd' AS description, '' AS preconditions, '' AS procedure_steps, '' AS expected_results FROM replies WHERE form = 0
    UNION ALL SELECT doc_id, section_no, 1, 'f.docx', 'TC_' || CAST(doc_id AS VARCHAR), '', '', '', '', '' FROM replies WHERE form = 1
    UNION ALL SELECT doc_id, section_no, 2, file_name, 'TC_X', '', '', '', 's', '' FROM replies WHERE form = 1""",
)
oracle("partial_failures", "SELECT doc_id, section_no, 'Section \"' || title || '\": ' || error AS message FROM reply_errors WHERE error IS NOT NULL")
oracle("retryable_requests", "SELECT request_id, coalesce(request_id % 7 IN (0, 2, 3, 5), false) AS retryable, coalesce(request_id % 7 IN (0, 2, 3, 4, 5), false) AS retryable_batch FROM failing")
oracle("resubmit_requests", "SELECT request_id FROM failing WHERE request_id % 7 IN (0, 2, 3, 5)")
oracle(
    "call_ledger",
    """SELECT conv_id, turn, CASE WHEN form > 1 THEN CAST(n AS VARCHAR) || ' ' || substr(said, 1, 20) END AS content,
    CASE form WHEN 0 THEN 'HTTP error 503: busy' WHEN 1 THEN 'HTTP error 400: refused' END AS error, CAST(CASE WHEN form = 0 THEN 6 ELSE 1 END AS INT) AS attempt
    FROM (SELECT conv_id, turn, coalesce(text, '') AS said, length(coalesce(text, '')) AS n, length(coalesce(text, '')) % 7 AS form FROM conversations)""",
)
oracle(
    "running_totals",
    """SELECT doc_id, section_no, n_rows, CAST(row_number() OVER w AS INT) AS section_index, CAST(sum(n_rows) OVER w AS BIGINT) AS cumulative_rows FROM (
    SELECT doc_id, section_no, CAST(CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n_rows FROM replies ) WINDOW w AS (PARTITION BY doc_id ORDER BY section_no ROWS UNBOUNDED PRECEDING)""",
)
oracle(
    "admission",
    """SELECT p_partkey, stem || CASE k WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PDF' ELSE '.txt' END AS file_name, CASE k WHEN 0 THEN '.docx' WHEN 3 THEN '.txt' ELSE '.pdf' END AS suffix,
    CASE WHEN k = 3 OR p_partkey * 65536 > 52428800 THEN 'bad' ELSE 'ok' END AS kind, CASE WHEN k = 3 THEN 'unsupported' WHEN p_partkey * 65536 > 52428800 THEN 'exception' END AS reason FROM paths""",
)
oracle("input_order", "SELECT scope, path, CAST(row_number() OVER (PARTITION BY scope ORDER BY path) AS INT) AS doc_ord FROM (SELECT DISTINCT p_partkey % 50 AS scope, path FROM paths )")
oracle("input_order_of_all", "SELECT path, row_number() OVER (ORDER BY path) AS doc_ord FROM (SELECT DISTINCT path FROM paths )")
oracle("output_names", "SELECT p_partkey, stem || '.xlsx' AS out_name, stem || '_' || CASE k WHEN 0 THEN 'docx' WHEN 3 THEN 'txt' ELSE 'pdf' END || '.xlsx' AS long_name FROM paths")
oracle("output_collisions", "SELECT * FROM (SELECT p_partkey, stem || '.xlsx' AS out_name, count(*) OVER (PARTITION BY stem) AS same_name FROM paths ) WHERE same_name > 1")
oracle("resume_anti_join", "SELECT p_partkey, stem || '.xlsx' || CAST(p_partkey AS VARCHAR) AS out_name FROM paths WHERE p_partkey % 3 <> 0")
oracle("safe_stem", "SELECT p_partkey, CASE WHEN k < 3 THEN rtrim(regexp_replace(stem, '[aeiou]', 'é_', 'g'), '._-') END AS stem FROM paths")
oracle("empty_texts", f"SELECT doc_id, file_name, 'empty_text' AS reason FROM plan_docs WHERE doc_id % 7 = 0 OR {strip('doc_text')} = ''")
oracle("table_to_pipe", "SELECT doc_id, CAST(block_no AS INT) AS block_no, rtrim(txt, chr(10)) AS pipe_text FROM blocks WHERE block_no % 4 = 3")
oracle(
    "page_assembly",
    f"""SELECT doc_id, {strip("string_agg(txt, chr(10) || chr(10) ORDER BY page)")} AS doc_text FROM (SELECT doc_id, page, string_agg(txt, chr(10) ORDER BY top, lft, block_no) AS txt FROM blocks WHERE txt IS NOT NULL GROUP BY doc_id, page) GROUP BY doc_id""",
)
oracle(
    "page_words",
    """WITH raw AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST((l_orderkey * 31 + l_partkey) % 500 AS DOUBLE) AS x0, CAST((l_orderkey * 7 + l_partkey * 13) % 720 AS DOUBLE) AS top,
      l_orderkey * 8 + l_linenumber AS no, l_partkey % 12 = 0 AS is_table, l_orderkey, l_partkey, l_returnflag, CASE WHEN l_suppkey % 7 <> 0 THEN 480.0 ELSE 1e9 END AS width, CASE WHEN l_suppkey % 7 <> 0 THEN 700.0 ELSE 1e9 END AS height
      FROM lineitem WHERE l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL),
    said AS (SELECT doc_id, page, x0, x0 + 20 AS x1, top, top + 8 AS bottom, no, 'w' || l_partkey AS text FROM raw WHERE NOT is_table AND l_orderkey % 9 <> 0),
    boxes AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, no) AS n, least(top, height) AS upper, least(top + l_orderkey % 60, height) AS low FROM raw WHERE is_table),
    gaps AS (SELECT doc_id, page, width, 2 * n - 2 AS place, upper AS til, coalesce(max(low) OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM boxes
      UNION ALL SELECT doc_id, page, max(width), 2 * max(n), max(height), max(low) FROM boxes GROUP BY doc_id, page),
    near AS (SELECT s.*, place, greatest(s.top, since) AS y FROM said s JOIN gaps g ON s.doc_id = g.doc_id AND s.page = g.page AND til > since + 1 AND s.bottom >= since AND s.top <= til AND s.x0 <= width AND s.x1 >= 0
      UNION ALL SELECT s.*, 0, s.top FROM said s ANTI JOIN boxes b ON s.doc_id = b.doc_id AND s.page = b.page),
    stepped AS (SELECT *, coalesce(y > lag(y) OVER w + 3, false) AS fresh FROM near WINDOW w AS (PARTITION BY doc_id, page, place ORDER BY y, x0, no)),
    lined AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page, place ORDER BY y, x0, no) AS line FROM stepped),
    lines AS (SELECT doc_id, page, place, line, string_agg(text, ' ' ORDER BY x0, no) AS line_text FROM lined GROUP BY ALL),
    parts AS (SELECT doc_id, page, place, string_agg(line_text, chr(10) ORDER BY line) AS part FROM lines GROUP BY ALL
      UNION ALL SELECT doc_id, page, 2 * n - 1, 'id | flag' || chr(10) || l_partkey || ' | ' || l_returnflag || chr(10) FROM boxes)
    SELECT doc_id, page, string_agg(part, chr(10) ORDER BY place) AS page_text FROM parts GROUP BY doc_id, page""",
)
oracle(
    "export_rows",
    'SELECT doc_id, section_no, file_name AS "File Name", test_id AS "Test ID", test_name AS "Test Name", description AS "Description", preconditions AS "Preconditions / Applicability", procedure_steps AS "Procedure / steps", expected_results AS "Expected results" FROM raw_cases',
)
oracle(
    "clustered_outputs",
    """SELECT regexp_replace(file_name, '[.][a-zA-Z]+$', '') || '_' || lower(regexp_extract(file_name, '[a-zA-Z]+$')) || '.xlsx' AS out_name, CAST(count(*) AS BIGINT) AS n_rows, count(*) AS n_read, min(section_no) AS first_no, max(section_no) AS last_no, true AS own
    FROM raw_cases GROUP BY doc_id, file_name""",
)
oracle("documents_with_rows", "SELECT doc_id, file_name FROM plan_docs WHERE doc_id IN (SELECT doc_id FROM t_rows )")
oracle("redact_headers", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'Bearer <redacted>' ELSE CASE WHEN event_id % 3 = 0 THEN 'Bearer ' ELSE 'Basic ' END || event_type END AS first, 'Bearer json' AS second FROM events")
oracle(
    "job_fold",
    """SELECT job_id, CASE WHEN err IS NOT NULL THEN 'failed' WHEN res IS NOT NULL THEN 'done' ELSE 'incomplete' END AS status, coalesce(err, CASE WHEN res IS NULL THEN 'Incomplete extraction stream (no final result)' END) AS message, CASE WHEN err IS NULL THEN res END AS result FROM (
    SELECT job_id, arg_min(message, seq) FILTER (type = 'error') AS err, max(seq) FILTER (type = 'result') AS res FROM feed GROUP BY job_id)""",
)
oracle(
    "job_progress",
    "SELECT user_id AS job_id, count(*) FILTER (event_type = 'view') AS sections_done, count(*) FILTER (event_type = 'click') AS sections_failed, count(*) FILTER (event_type = 'signup') AS retries, arg_max(event_id % 100, event_id) FILTER (event_type = 'view') AS cumulative_rows FROM events GROUP BY user_id",
)
FLAGGED = f"CASE WHEN test_id <> '' AND count(*) OVER (PARTITION BY doc_id, test_id) > 1 THEN {NOTE} ELSE '' END || description AS description"
oracle("pipeline_template", f"SELECT doc_id, section_no, file_name, test_id, test_name, {FLAGGED}, preconditions, procedure_steps, expected_results, run_rows FROM merged")
oracle("pipeline_sections", f"SELECT doc_id, section_no, file_name, test_id, test_name, {FLAGGED}, preconditions, procedure_steps, expected_results, run_rows FROM model_merged")
oracle(
    "file_results_by_section",
    f"""SELECT d.doc_id, d.file_name, 'LLM (offline)' AS template, coalesce(r.n, 0) AS n_rows, CAST(0 AS BIGINT) AS n_errors, true AS ok, CAST(length(coalesce(p.txt, '')) AS BIGINT) AS doc_chars, coalesce(o.removed, '') AS removed,
    coalesce(f.fallback AND trim(d.doc_text, ' ' || chr(10)) <> '', false) AS prep_fallback, coalesce(c.calls, 0) AS section_calls, coalesce(c.placed, 0) AS placeholders, coalesce(c.truncated, false) AS truncated FROM plan_docs d
    LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS txt FROM prep GROUP BY doc_id) p ON p.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, NOT max(CAST(NOT skipped AND trim(line) <> '' AS INT)) = 1 AS fallback FROM shown GROUP BY doc_id) f ON f.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(title, ' ; ' ORDER BY first) AS removed FROM opened GROUP BY doc_id) o ON o.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM model_rows GROUP BY doc_id) r ON r.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (a = 'extract') AS calls, count(*) FILTER (a = 'placeholder') AS placed, bool_or(a = 'extract' AND length(body) > {TRUNCATE_AT}) AS truncated
      FROM (SELECT *, {ACTION} AS a FROM cut_p3 ) GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
)
