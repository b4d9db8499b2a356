"""Deeply nested manifests as flat tables that keep the place of their parents.

All JSON is read as VARIANT and walked by nested transform calls, which attach the keys and places of the ancestors;
flatten joins the arrays and one inline for each table emits the rows. No row is exploded on the way; the rows that come out
are shuffled once, to drop what repeated records give again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE = "~ end of record ~"
BLANK = r"[ \t\r\n]*"


def _parsed(text: str) -> str:
    """[text, mark] as a variant: the parser stops after one value, so the mark shows that nothing followed text."""
    return f"try_parse_json(concat('[', {text}, ',\"{WHOLE}\"]'))"


def _list(value: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', 'array<variant>')"


def _text(value: str) -> str:
    """A JSON string that isn't empty, else null; numbers and objects are no strings."""
    return f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN nullif(try_variant_get({value}, '$', 'string'), '') END"


def _own_id(value: str) -> str:
    def under(key: str) -> str:
        return _text(f"try_variant_get({value}, '$[\"{key}\"]', 'variant')")

    return f"coalesce({under('id')}, {under('@id')})"


def _kind(value: str) -> str:
    return f"coalesce(try_variant_get({value}, '$.type', 'string'), try_variant_get({value}, '$[\"@type\"]', 'string'))"


def _each(array: str, item: str, place: str, body: str) -> str:
    return f"transform(coalesce({array}, array()), ({item}, {place}) -> {body})"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for value, which is so worked out once; a column named on the way would be worked out at each use."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _items(json: str) -> str:
    """The items of the manifest that a record holds; null if it holds none."""
    inner = f"try_variant_get({_parsed('s')}, '$[0][0]', 'string')"
    string = f"CASE WHEN {json} RLIKE r'^{BLANK}\"' THEN try_variant_get({_parsed(json)}, '$[0]', 'string') ELSE {json} END"
    listed = f"CASE WHEN s RLIKE r'^{BLANK}\\[{BLANK}\"' THEN concat('[', {inner}, ']') ELSE s END"
    whole = f"size(v) = 2 AND try_variant_get(v[1], '$', 'string') = '{WHOLE}'"
    alone = f"CASE WHEN size({_list('v[0]')}) = 1 THEN {_list('v[0]', '$[0].items')} END"
    found = f"CASE WHEN {whole} THEN coalesce({_list('v[0]', '$.items')}, {alone}) END"
    return _let("s", string, _let("t", listed, _let("v", _list(_parsed("t")), found)))


def manifest_objects(records: DataFrame, json: str = "manifest") -> DataFrame:
    """Adds the variant `items` of each record that is one whole manifest object with a list of items.

    The object may stand alone in a list, be written as a JSON string, or both. Where an object names a key twice the last
    value counts. Null, blank, broken and truncated JSON, text after the object, other values and objects over the size
    of a variant (128 MB) give no row; refused() lists them. Other columns stay as they are.
    """
    return _lenient(records).withColumn("items", F.expr(_items(f"`{json}`"))).where("items IS NOT NULL")


def _lenient(records: DataFrame) -> DataFrame:
    """records, in a session that reads objects with repeated keys: the setting holds for all JSON of the session from here on."""
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return records


def refused(records: DataFrame, key: str = "raw_id", json: str = "manifest") -> DataFrame:
    """(key, reason, records): the records that hold no manifest, counted by key: "empty", "unreadable" (not one whole JSON value) or "no manifest"."""
    text = f"`{json}`"
    whole = _let("v", _list(_parsed(text)), f"size(v) = 2 AND try_variant_get(v[1], '$', 'string') = '{WHOLE}'")
    reason = f"CASE WHEN {text} IS NULL OR {text} RLIKE r'^{BLANK}\z' THEN 'empty' WHEN NOT coalesce({whole}, false) THEN 'unreadable' WHEN {_items(text)} IS NULL THEN 'no manifest' END"
    return _lenient(records).select(key, F.expr(reason).alias("reason")).where("reason IS NOT NULL").groupBy(key, "reason").agg(F.count("*").alias("records"))


CANVAS = "struct(i AS canvas_index, 'canvas' AS kind, -1 AS page_index, -1 AS item_index, -1 AS alt_index, '' AS lang, {} AS val)"
LABEL = "struct(i AS canvas_index, 'label' AS kind, -1 AS page_index, {} AS item_index, -1 AS alt_index, p.k AS lang, {} AS val)"
BODY = "struct(i AS canvas_index, 'body' AS kind, g AS page_index, n AS item_index, {} AS alt_index, '' AS lang, {} AS val)"


def _canvases() -> str:
    return _each("items", "c", "i", f"array({CANVAS.format(_own_id('c'))})")


def _labels() -> str:
    label = "try_variant_get(c, '$.label', 'variant')"
    as_map = f"try_variant_get({label}, '$', 'map<string,variant>')"
    pairs = f"coalesce(transform(map_entries({as_map}), e -> struct(e.key AS k, e.value AS v)), array(struct('' AS k, {label} AS v)))"
    one = f"coalesce(transform({_list('p.v')}, (x, m) -> {LABEL.format('m', _text('x'))}), array({LABEL.format('0', _text('p.v'))}))"
    return _each("items", "c", "i", f"flatten(transform({pairs}, p -> {one}))")


def _bodies() -> str:
    value = f"coalesce({_text('b')}, CASE WHEN coalesce({_kind('b')}, 'Image') = 'Image' THEN {_own_id('b')} END)"
    body = "try_variant_get(a, '$.body', 'variant')"
    choice = f"CASE WHEN {_kind(body)} = 'Choice' THEN {_list('a', '$.body.items')} END"
    bodies = f"coalesce({_list('a', '$.body')}, {choice}, array({body}))"
    annotation = f"transform({bodies}, (b, t) -> {BODY.format('t', value)})"
    page = f"flatten({_each(_list('q', '$.items'), 'a', 'n', annotation)})"
    return _each("items", "c", "i", f"flatten({_each(_list('c', '$.items'), 'q', 'g', page)})")


def _rows(records: DataFrame, key: str, json: str, arrays: list[str]) -> DataFrame:
    flat = "concat(" + ", ".join(f"flatten({a})" for a in arrays) + ")"
    rows = _let("items", _items(f"`{json}`"), f"filter({flat}, r -> r.val IS NOT NULL)")
    return _lenient(records).select(key, F.inline(F.expr(rows))).distinct()


def canvases(records: DataFrame, key: str = "raw_id", json: str = "manifest") -> DataFrame:
    """(key, canvas_index, canvas_id): the canvases that have an id of their own."""
    return _rows(records, key, json, [_canvases()]).select(key, "canvas_index", F.col("val").alias("canvas_id"))


def labels(records: DataFrame, key: str = "raw_id", json: str = "manifest") -> DataFrame:
    """(key, canvas_index, lang, item_index, label): every string of the canvases' labels."""
    return _rows(records, key, json, [_labels()]).select(key, "canvas_index", "lang", "item_index", F.col("val").alias("label"))


def bodies(records: DataFrame, key: str = "raw_id", json: str = "manifest") -> DataFrame:
    """(key, canvas_index, page_index, item_index, alt_index, body_id): every image body of the canvases' annotations."""
    return _rows(records, key, json, [_bodies()]).select(key, "canvas_index", "page_index", "item_index", "alt_index", F.col("val").alias("body_id"))


def manifest_rows(records: DataFrame, key: str = "raw_id", json: str = "manifest") -> DataFrame:
    """The rows of all three tables in one form (key, canvas_index, kind, page_index, item_index, alt_index, lang, val), in one pass."""
    return _rows(records, key, json, [_canvases(), _labels(), _bodies()])
