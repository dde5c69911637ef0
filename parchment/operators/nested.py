"""Nested JSON records to flat tables in one pass of tagged emission."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAGS = ("node", "case", "condition", "exception", "diagnostic", "unreadable")
_SCHEMA = "raw_id long, item_kind string, item_key string, parent_key string, ordinal int, depth int, payload string"
#: Python objects that one Arrow batch may become.
_BATCH = 2_000


def _listed(x: object) -> list:
    """An array, a bare object standing for an array of one, or nothing."""
    return [] if x is None else [y for y in x if isinstance(y, dict)] if isinstance(x, list) else [x] if isinstance(x, dict) else []


def _text(x: object) -> str:
    """A key part as text; lone surrogates, which no string column can hold, become '?'."""
    return "" if x is None else x.encode("utf-8", "replace").decode() if isinstance(x, str) else json.dumps(x)


_SKIPPED = ("children", "operands", "condition", "exceptions", "diagnostics", "expected")
_BLANK = re.compile(r"[ \t\n\r]*").match
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity").match


def _read_deep(text: str) -> object:
    """What ``json.loads`` gives, for nesting of any depth: containers wait on a list of their own instead of the call stack."""
    bad = ValueError("not JSON")
    open_: list[tuple[object, str | None]] = []
    i, value, done = _BLANK(text).end(), None, False
    here: object = None
    key: str | None = None
    fresh = False  # just after an opening bracket
    while True:
        i = _BLANK(text, i).end()
        c = text[i : i + 1]
        if fresh and c and c in "]}" or done:
            # close what is open, or go on after a comma
            if done:
                if here is None:
                    if i != len(text):
                        raise bad
                    return value
                here.append(value) if isinstance(here, list) else here.__setitem__(key, value)
            if c == ("]" if isinstance(here, list) else "}"):
                value, i, done, fresh = here, i + 1, True, False
                here, key = open_.pop()
                continue
            if not done or c != ",":
                raise bad
            i, done = _BLANK(text, i + 1).end(), False
            c = text[i : i + 1]
        fresh = False
        if isinstance(here, dict):
            if c != '"':
                raise bad
            key, i = scanstring(text, i + 1)
            i = _BLANK(text, i).end()
            if text[i : i + 1] != ":":
                raise bad
            i = _BLANK(text, i + 1).end()
            c = text[i : i + 1]
        if c and c in "[{":
            open_.append((here, key))
            here, key, i, fresh = [] if c == "[" else {}, None, i + 1, True
        elif c == '"':
            value, i = scanstring(text, i + 1)
            done = True
        elif (m := _SCALAR(text, i)) is not None:
            value, i, done = json.loads(m.group()), m.end(), True
        else:
            raise bad


def _write_deep(x: object) -> str:
    """What ``json.dumps(x, sort_keys=True)`` gives, for nesting of any depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, x)]
    while todo:
        ready, v = todo.pop()
        if ready:
            out.append(v)
        elif isinstance(v, dict):
            parts = [[*([(True, ", ")] if n else []), (True, json.dumps(k) + ": "), (False, v[k])] for n, k in enumerate(sorted(v))]
            todo += [(True, "}"), *[y for p in reversed(parts) for y in reversed(p)], (True, "{")]
        elif isinstance(v, list):
            parts = [[(True, ", "), (False, y)] if n else [(False, y)] for n, y in enumerate(v)]
            todo += [(True, "]"), *[y for p in reversed(parts) for y in reversed(p)], (True, "[")]
        else:
            out.append(json.dumps(v))
    return "".join(out)


def _flat(x: dict) -> str:
    own = {k: v for k, v in x.items() if k not in _SKIPPED}
    try:
        return json.dumps(own, sort_keys=True)
    except RecursionError:
        return _write_deep(own)


def read_payload(text: str) -> tuple[bool, object]:
    """(readable, value): byte order marks cut, JSON text within JSON strings read in turn."""
    value: object = text
    first = True
    while isinstance(value, str):
        body = value.lstrip("\ufeff \t\r\n")
        try:
            try:
                value = json.loads(body)
            except RecursionError:
                value = _read_deep(body)
        except ValueError:
            return not first, None
        first = False
    return True, value


def visit(text: str) -> Iterator[tuple[str, str, str, int, int, str]]:
    """Depth-first, with its own stack: (tag, key, parent key, ordinal, depth, payload) of every item."""
    ok, value = read_payload(text)
    if not ok:
        yield "unreadable", "", "", 0, 0, ""
        return
    if isinstance(value, dict) and isinstance(value.get("root"), dict):
        stack = [(value["root"], "", 0, 0)]
        while stack:
            node, parent, ordinal, depth = stack.pop()
            key = _text(node.get("node_id"))
            yield "node", key, parent, ordinal, depth, _flat(node)
            stack += [(c, key, i, depth + 1) for i, c in reversed([*enumerate(_listed(node.get("children")))])]
        return
    if isinstance(value, dict):
        value = value["conditions"] if "conditions" in value else value if "name" in value or "expected" in value else None
    cases = _listed(value)
    for n, case in enumerate(cases):
        name = _text(case.get("name"))
        yield "case", name, "", n, 0, _flat(case)
        expected = case.get("expected") if isinstance(case.get("expected"), dict) else {}

        def spanned(item: dict, name: str = name) -> str:
            span = item.get("span") if isinstance(item.get("span"), dict) else {}
            return f"{name}/{_text(span.get('start'))}-{_text(span.get('end'))}"

        stack = [(c, name, i, 1) for i, c in reversed([*enumerate(_listed(expected.get("condition")))])]
        while stack:
            item, parent, ordinal, depth = stack.pop()
            key = spanned(item)
            yield "condition", key, parent, ordinal, depth, _flat(item)
            stack += [(c, key, i, depth + 1) for i, c in reversed([*enumerate(_listed(item.get("operands")))])]
        for tag in ("exception", "diagnostic"):
            for i, item in enumerate(_listed(expected.get(f"{tag}s"))):
                yield tag, spanned(item), name, i, 1, _flat(item)


def emit_items(records: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """Long form of every item of every payload: raw_id, item_kind (the table's tag), item_key,
    parent_key, ordinal, depth, payload (the item's own fields as JSON).

    Null payloads give nothing; an unreadable one gives one 'unreadable' row; valid JSON of
    another shape gives nothing. Damage inside a wrapped JSON string, which is itself valid
    JSON, gives nothing. Records received twice give their items once (records are reduced
    to distinct (id, payload) first). A payload of any depth is read, walked and written
    without recursion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("raw_id", pa.int64()), *[(n, pa.string()) for n in ("item_kind", "item_key", "parent_key")], ("ordinal", pa.int32()), ("depth", pa.int32()), ("payload", pa.string())])
        for b in batches:
            for at in range(0, b.num_rows, _BATCH):
                part = b.slice(at, _BATCH)
                cols: list[list] = [[] for _ in range(7)]
                for rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for row in visit(text):
                        for c, v in zip(cols, (rid, *row)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    one = records.select(F.col(id_col).alias("raw_id"), F.col(payload_col).alias("payload")).where("payload is not null").dropDuplicates(["raw_id", "payload"])
    return one.mapInArrow(run, _SCHEMA)


def item_tables(items: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables, typed, each row with its key and its parent's."""
    head = ["raw_id", "item_key", "parent_key", "ordinal", "depth"]
    got = lambda path, kind="string": F.try_variant_get(F.try_parse_json("payload"), path, kind)
    fields = {
        "node": {"type": ("$.type", "string"), "locator": ("$.locator", "string"), "label": ("$.label", "string"), "span_start": ("$.span.start", "int"), "span_end": ("$.span.end", "int")},
        "case": {"source": ("$.source", "string")},
        "condition": {"type": ("$.type", "string"), "subject_property": ("$.subject_property", "string"), "operator": ("$.operator", "string"), "threshold": ("$.threshold.value", "double"), "unit": ("$.threshold.unit", "string")},
        "exception": {"type": ("$.type", "string"), "section": ("$.section", "string")},
        "diagnostic": {"code": ("$.code", "string"), "severity": ("$.severity", "string")},
        "unreadable": {},
    }
    return {tag: items.where(F.col("item_kind") == tag).select(*head, *[got(*p).alias(n) for n, p in cols.items()]) for tag, cols in fields.items()}


def write_tables(items: DataFrame, path: str) -> None:
    """Write the long form once, partitioned by tag; each table is read back from its folder."""
    items.write.mode("overwrite").partitionBy("item_kind").parquet(path)
