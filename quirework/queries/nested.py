"""Problem 6: manifests as flat tables."""

from __future__ import annotations

from quirework.operators import nested
from quirework.session import table

QUERIES = {
    "p6_found": lambda spark, d: nested.manifest_rows(table(spark, d, "manifests")),
    "p6_canvases": lambda spark, d: nested.canvases(table(spark, d, "manifests")),
    "p6_labels": lambda spark, d: nested.labels(table(spark, d, "manifests")),
    "p6_bodies": lambda spark, d: nested.bodies(table(spark, d, "manifests")),
    "p6_refused": lambda spark, d: nested.refused(table(spark, d, "manifests")),
}


def _string(value: str) -> str:
    return f"CASE WHEN json_type({value}) = 'VARCHAR' THEN nullif({value} ->> '$', '') END"


def _id(value: str) -> str:
    own, other = f"({value} -> '$.id')", f"""({value} -> '$."@id"')"""
    return f"coalesce({_string(own)}, {_string(other)})"


def _elements(array: str, name: str, place: str) -> str:
    """A lateral table of the elements of a JSON array and their places; none of other values."""
    return f"LATERAL (SELECT n::INT AS {place}, json_extract({array}, '$[' || n || ']') AS {name} FROM (SELECT unnest(CASE WHEN json_type({array}) = 'ARRAY' THEN range(json_array_length({array})::BIGINT) ELSE [] END) AS n))"


_KIND = """coalesce({0} ->> '$.type', {0} ->> '$."@type"', 'Image')"""
_CANVAS = f"""WITH m0 AS (SELECT DISTINCT raw_id, manifest FROM manifests WHERE json_valid(manifest)),
 m1 AS (SELECT raw_id, CASE WHEN json_type(manifest) = 'VARCHAR' THEN manifest::JSON ->> '$' ELSE manifest END AS j FROM m0),
 m2 AS (SELECT raw_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN json_extract(j, '$[0]') ELSE j::JSON END AS o FROM m1 WHERE json_valid(j)),
 c AS (SELECT raw_id, canvas_index, c FROM m2, {_elements("(o -> '$.items')", 'c', 'canvas_index')} WHERE json_type(o) = 'OBJECT'),
 canvas AS (SELECT raw_id, canvas_index, {_id('c')} AS val FROM c),
 l AS (SELECT raw_id, canvas_index, c -> '$.label' AS l FROM c),
 k AS (SELECT raw_id, canvas_index, lang, json_extract(l, '$."' || lang || '"') AS v FROM (SELECT *, unnest(json_keys(l)) AS lang FROM l WHERE json_type(l) = 'OBJECT') UNION ALL SELECT raw_id, canvas_index, '', l FROM l WHERE json_type(l) <> 'OBJECT'),
 label AS (SELECT raw_id, canvas_index, lang, 0 AS item_index, {_string('v')} AS val FROM k UNION ALL SELECT raw_id, canvas_index, lang, item_index, {_string('x')} FROM k, {_elements('v', 'x', 'item_index')}),
 a AS (SELECT raw_id, canvas_index, page_index, item_index, a -> '$.body' AS b FROM c, {_elements("(c -> '$.items')", 'p', 'page_index')}, {_elements("(p -> '$.items')", 'a', 'item_index')}),
 w AS (SELECT *, CASE WHEN json_type(b) = 'ARRAY' THEN b WHEN json_type(b) = 'OBJECT' AND {_KIND.format('b')} = 'Choice' AND json_type(b -> '$.items') = 'ARRAY' THEN b -> '$.items' ELSE json_array(b) END AS bs FROM a WHERE b IS NOT NULL),
 body AS (SELECT raw_id, canvas_index, page_index, item_index, alt_index, coalesce({_string('x')}, CASE WHEN json_type(x) = 'OBJECT' AND {_KIND.format('x')} = 'Image' THEN {_id('x')} END) AS val FROM w, {_elements('bs', 'x', 'alt_index')})"""

ORACLE = {
    "p6_refused": """WITH g0 AS (SELECT DISTINCT manifest FROM manifests WHERE json_valid(manifest)), g1 AS (SELECT manifest, CASE WHEN json_type(manifest) = 'VARCHAR' THEN manifest::JSON ->> '$' ELSE manifest END AS j FROM g0),
 g2 AS (SELECT manifest, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN json_extract(j, '$[0]') ELSE j::JSON END AS o FROM g1 WHERE json_valid(j)),
 g AS (SELECT manifest FROM g2 WHERE json_type(o) = 'OBJECT' AND json_type(o -> '$.items') = 'ARRAY')
 SELECT raw_id, CASE WHEN manifest IS NULL OR regexp_full_match(manifest, '[ \\t\\r\\n]*') THEN 'empty' WHEN NOT json_valid(manifest) THEN 'unreadable' ELSE 'no manifest' END AS reason, count(*) AS records
 FROM manifests ANTI JOIN g USING (manifest) GROUP BY ALL""",
    "p6_canvases": f"{_CANVAS} SELECT DISTINCT raw_id, canvas_index, val AS canvas_id FROM canvas WHERE val IS NOT NULL",
    "p6_labels": f"{_CANVAS} SELECT DISTINCT raw_id, canvas_index, lang, item_index, val AS label FROM label WHERE val IS NOT NULL",
    "p6_bodies": f"{_CANVAS} SELECT DISTINCT raw_id, canvas_index, page_index, item_index, alt_index, val AS body_id FROM body WHERE val IS NOT NULL",
    "p6_found": f"""{_CANVAS} SELECT DISTINCT * FROM (SELECT raw_id, canvas_index, 'canvas' AS kind, -1 AS page_index, -1 AS item_index, -1 AS alt_index, '' AS lang, val FROM canvas
 UNION ALL SELECT raw_id, canvas_index, 'label', -1, item_index, -1, lang, val FROM label UNION ALL SELECT raw_id, canvas_index, 'body', page_index, item_index, alt_index, '', val FROM body) WHERE val IS NOT NULL""",
}
