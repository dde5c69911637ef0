"""DuckDB SQL of the text queries that SQL can state."""

from __future__ import annotations

from .normal import LINE_ENDS, LOOK_ALIKES, WIDTHLESS, rules


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A pattern of any of the characters, as code points."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(set(chars))) + "]"


_SINGLE = {a: b for a, b in rules().items() if len(a) == 1 and a not in WIDTHLESS and a not in LINE_ENDS and a not in "\t\x0b\x0c"}
_ONE = {a: b for a, b in _SINGLE.items() if len(b) == 1 and (not a.isalpha() or ord(a) >= 0xFF00)}
_MORE = {a: b for a, b in _SINGLE.items() if len(b) > 1 and 0xFB00 <= ord(a) < 0xFB07}
_LOOKS = _class("".join(LOOK_ALIKES))


def consistent(c: str) -> str:
    """A text in a form that equal-looking texts share; words wholly in another script are mapped, too, on all sides alike."""
    out = f"regexp_replace({c}, {_text(_class(''.join(WIDTHLESS)))}, '', 'g')"
    out = f"translate({out}, {_text(''.join(_ONE))}, {_text(''.join(_ONE.values()))})"
    for a, b in _MORE.items():
        out = f"replace({out}, {_text(a)}, {_text(b)})"
    return f"nfc_normalize(translate({out}, {_text(''.join(LOOK_ALIKES))}, {_text(''.join(LOOK_ALIKES.values()))}))"


def _p1() -> str:
    odd = _class("".join({*_ONE, *_MORE, *WIDTHLESS, "\t", "\x0b", "\x0c", "\r", "\x85", " ", " "}))
    mixed = f"\\p{{Latin}}[\\p{{L}}\\p{{M}}]*{_LOOKS}|{_LOOKS}[\\p{{L}}\\p{{M}}]*\\p{{Latin}}"
    case = f"regexp_matches(text, {_text(odd)}) OR nfc_normalize(text) <> text OR regexp_matches(text, {_text(mixed)})"
    return f"""SELECT DISTINCT 'evidence' AS table_name, evidence_id AS row_key FROM evidence WHERE {case}
    UNION ALL SELECT DISTINCT 'searchable_text_entry', CAST(entry_id AS VARCHAR) FROM searchable_text_entry WHERE {case}"""


#: Each evidence_id once; its lines by number with their form, null without a letter.
_LINES = f"""own AS (SELECT evidence_id AS doc, source_id AS source, min(CAST(extracted_at AS DATE)) AS day, any_value(text) AS text FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1, 2),
    cut AS (SELECT doc, source, day, string_split(text, chr(10)) AS parts FROM own),
    line AS (SELECT doc, source, day, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS raw FROM cut),
    form AS (SELECT doc, source, day, line_no, raw, CASE WHEN regexp_matches({consistent("raw")}, '\\p{{L}}') THEN lower(regexp_replace({consistent("raw")}, '[\\p{{Nd}}\\s\\p{{Z}}]+', '', 'g')) END AS f FROM line)"""


_FOUND = """total AS (SELECT source, count(*) AS total FROM own GROUP BY 1),
    often AS (SELECT source, f, count(DISTINCT doc) AS n FROM form WHERE f IS NOT NULL GROUP BY 1, 2),
    found AS (SELECT doc, line_no FROM form JOIN often ON form.source IS NOT DISTINCT FROM often.source AND form.f = often.f JOIN total ON form.source IS NOT DISTINCT FROM total.source WHERE n >= 5 AND n >= total * 0.04 - 1e-9)"""


def _p2_clusters() -> str:
    return f"""WITH {_LINES}, whole AS (SELECT own.doc, own.source, own.day, CASE WHEN own.text IS NULL THEN 'null' ELSE string_agg(coalesce(f, chr(1)), chr(2) ORDER BY line_no) END AS all_lines FROM own LEFT JOIN form ON own.doc = form.doc GROUP BY own.doc, own.source, own.day, own.text),
    cluster AS (SELECT source, all_lines, min(doc) AS doc, count(*) AS copies, min(day) AS day FROM whole GROUP BY 1, 2),
    total AS (SELECT source, count(*) AS total FROM cluster GROUP BY 1),
    often AS (SELECT c.source, f, count(*) AS clusters, sum(copies) AS docs, min(c.day) AS lo, max(c.day) AS hi FROM cluster c JOIN (SELECT DISTINCT doc, f FROM form WHERE f IS NOT NULL) x ON c.doc = x.doc GROUP BY 1, 2)
    SELECT form.doc, CAST(form.line_no AS INTEGER) AS line_no, CAST(docs AS BIGINT) AS docs, clusters, total FROM form JOIN often ON form.source IS NOT DISTINCT FROM often.source AND form.f = often.f JOIN total ON form.source IS NOT DISTINCT FROM total.source WHERE clusters >= 5 AND clusters >= total * 0.04 - 1e-9 AND lo <> hi"""


def _p9() -> str:
    words = f"regexp_extract_all(lower({consistent('text')}), '[\\p{{L}}\\p{{N}}]+')"
    part = lambda k, t: f"(SELECT DISTINCT {k}, array_to_string(w[i : i + 11], ' ') AS x FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {k}, {words} AS w FROM {t} WHERE text IS NOT NULL)))"
    return f"SELECT DISTINCT doc_id, item_id FROM {part('doc_id', 'documents')} d JOIN {part('item_id', 'eval_item')} i ON d.x = i.x"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1(), "p2_found": f"WITH {_LINES}, {_FOUND} SELECT doc AS evidence_id, CAST(line_no AS INTEGER) AS line_no FROM found",
        "p2_clean": f"WITH {_LINES}, {_FOUND}, kept AS (SELECT form.doc, string_agg(raw, chr(10) ORDER BY form.line_no) AS text FROM form ANTI JOIN found ON form.doc = found.doc AND form.line_no = found.line_no GROUP BY 1) SELECT e.evidence_id, CASE WHEN e.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM evidence e LEFT JOIN kept ON e.evidence_id = kept.doc",
        "p2_clusters": _p2_clusters(), "p9_found": _p9(),
    }
