"""DuckDB twins of ``bindings.py`` as named CTE fragments for oracle SQL."""
from __future__ import annotations

from . import duck as D
from .bindings import FILE_ORDER, PAIR_FILE_OF_TYPE


def _case(col: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {D.q(k)} THEN {D.q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    tail = f" ELSE {D.q(default)}" if default is not None else ""
    return f"CASE {col} {whens}{tail} END"


FILE_EXPR = _case("a.p_type", PAIR_FILE_OF_TYPE, "related")
ORDER_EXPR = _case("file", FILE_ORDER)

CTES = {
    "terms": f"terms AS (SELECT DISTINCT {D.strip('p_name')} AS term FROM part)",
    "vocabulary": f"""vocabulary AS (SELECT term FROM terms UNION SELECT unnest({D.term_tokens('term')}) FROM terms)""",
    "candidates": f"""candidates AS (SELECT DISTINCT v.term AS w1, e.w2 FROM (
          SELECT w2, unnest(list_distinct(CASE WHEN len(toks) >= 2 THEN flatten(list_transform(range(1, len(toks)),
            lambda ln: list_transform(range(1, len(toks) - ln + 2), lambda st: array_to_string(toks[st:st + ln - 1], ' '))))
            ELSE [] END)) AS k
          FROM (SELECT DISTINCT term AS w2, {D.term_tokens('term')} AS toks FROM terms)) e
        JOIN (SELECT DISTINCT term, array_to_string({D.term_tokens('term')}, ' ') AS k FROM vocabulary) v ON v.k = e.k
        WHERE v.term <> e.w2)""",
    "pair_lines": f"""pair_lines AS (
        SELECT file, {ORDER_EXPR} AS file_order, line_no, value FROM (
          SELECT {FILE_EXPR} AS file, a.p_partkey AS line_no, a.p_name || ',' || b.p_name AS value
          FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_brand = a.p_brand))""",
    "list_lines": f"""list_lines AS (
        SELECT 'hyper' AS file, {FILE_ORDER['hyper']} AS file_order, a.p_partkey AS line_no,
               a.p_name || ':' || concat_ws(', ', s1.p_name, s2.p_name, s3.p_name) AS value
        FROM (SELECT * FROM part WHERE p_type = 'LARGE') a
        LEFT JOIN (SELECT * FROM part WHERE p_type = 'SMALL') s1 ON s1.p_partkey = a.p_partkey + 1
        LEFT JOIN (SELECT * FROM part WHERE p_type = 'SMALL') s2 ON s2.p_partkey = a.p_partkey + 2
        LEFT JOIN (SELECT * FROM part WHERE p_type = 'SMALL') s3 ON s3.p_partkey = a.p_partkey + 3)""",
    "pair_rows": f"""pair_rows AS (
        SELECT {D.clean_phrase('parts[1]')} AS w1, {D.clean_phrase('parts[2]')} AS w2, file AS kind,
               file_order * 1000000000000 + line_no * 1000 AS seq
        FROM (SELECT *, string_split({D.strip('value', ' ' + chr(10))}, ',') AS parts FROM pair_lines)
        WHERE len(parts) = 2)""",
    "list_rows": f"""list_rows AS (
        SELECT w1, {D.clean_phrase('item')} AS w2, kind, file_order * 1000000000000 + line_no * 1000 + item_no AS seq
        FROM (
          SELECT {D.clean_phrase('parts[1]')} AS w1, file AS kind, file_order, line_no,
                 unnest(items) AS item, unnest(range(len(items))) AS item_no
          FROM (SELECT *, string_split({D.strip('parts[2]', ' ')}, ',') AS items
                FROM (SELECT *, string_split({D.strip('value', ' ' + chr(10))}, ':') AS parts FROM list_lines)
                WHERE len(parts) = 2 AND parts[2] <> '')))""",
    "rel_rows": "rel_rows AS (SELECT w1, w2, kind, seq FROM pair_rows UNION ALL SELECT w1, w2, kind, seq FROM list_rows)",
    "relations": "relations AS (SELECT DISTINCT w1, w2, kind FROM rel_rows)",
    "golden": """golden AS (
        SELECT arg_min(w1, seq) AS w1, arg_min(w2, seq) AS w2, min(seq) AS seq
        FROM rel_rows GROUP BY least(w1, w2), greatest(w1, w2))""",
    "term_part": f"term_part AS (SELECT p_partkey, {D.strip('p_name')} AS term FROM part)",
    "term_documents": """term_documents AS (
        SELECT p.term, d.doc_id, d.text, d.source FROM documents d JOIN term_part p ON d.doc_id = p.p_partkey)""",
    "term_turns": """term_turns AS (
        SELECT p.term, c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN term_part p ON c.conv_id = p.p_partkey)""",
    "term_pages": """term_pages AS (
        SELECT p.term, g.page_id, g.html FROM pages g JOIN term_part p ON g.page_id = p.p_partkey)""",
    "definition_lines": f"""definition_lines AS (
        SELECT b.item_id AS line_no, p.term || ':' || {D.replace_all('b.text', '[' + chr(13) + chr(10) + ']+', ' ')} AS value
        FROM benchmark b JOIN term_part p ON b.item_id = p.p_partkey)""",
    "definitions": """definitions AS (
        SELECT term, arg_max(definition, line_no) AS definition FROM (
          SELECT line_no, regexp_extract(value, '^(.*):([^:]*)$', 1) AS term,
                 regexp_extract(value, '^(.*):([^:]*)$', 2) AS definition
          FROM definition_lines WHERE value LIKE '%:%') GROUP BY term)""",
}

DEPS = {
    "vocabulary": ["terms"],
    "candidates": ["vocabulary", "terms"],
    "pair_rows": ["pair_lines"],
    "list_rows": ["list_lines"],
    "rel_rows": ["pair_rows", "list_rows"],
    "relations": ["rel_rows"],
    "golden": ["rel_rows"],
    "term_documents": ["term_part"],
    "term_turns": ["term_part"],
    "term_pages": ["term_part"],
    "definition_lines": ["term_part"],
    "definitions": ["definition_lines"],
}


def with_(*names: str, extra: list[str] | None = None) -> str:
    """A WITH clause holding the named CTEs and their dependencies, in order."""
    order: list[str] = []

    def add(n):
        for dep in DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTES[n] for n in order] + (extra or [])
    return "WITH " + ",\n".join(parts) + "\n"
