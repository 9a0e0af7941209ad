"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

import re

from .licenses import PHRASES, TEMPLATES
from .secrets import ACCESS, ASSIGN, BASE, HEX, KINDS, MORE, SCOPE_BREAK, SECRET, WEAK, WHO


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DOCS = "docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents)"
_WORD_GAP = r"'[\x20\x09-\x0D]+'"


def _spans_sql(name: str, pattern: str, rank: int, kind: str, least: int = 0, text: str = "text", skip: int = 0, core: bool = False, sound: str = "true") -> str:
    """A table of a pattern's matches: rn, st, rank, kind, en; pieces and matches alternate.

    The first ``skip`` characters of a match are context before it; with ``core`` it ends with its first group; ``sound`` is a test of the match ``w``.
    """
    p = _quoted(pattern)
    value = f"regexp_extract_all({text}, {p}, {1 if core else 2 if least else 0})"
    end = "length(v[i])" if core else "length(m[i])"
    return f"""{name} AS (SELECT rn, s.st AS st, {rank} AS rank, '{kind}' AS kind, s.en AS en FROM (
  SELECT rn, unnest(list_transform(m, lambda x, i: {{'st': list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)::BIGINT + {skip},
    'en': list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)::BIGINT + {end}, 'size': length(v[i]), 'w': m[i]}})) AS s
  FROM (SELECT rn, string_split_regex({text}, {p}) AS g, regexp_extract_all({text}, {p}, 0) AS m, {value} AS v FROM docs WHERE regexp_matches({text}, {p})))
  WHERE s.size >= {least} AND {sound.replace('w.', 's.w')})"""


#: ``MORE`` without looking around: a prefix is matched and skipped, names that another name turns into
#: something else have one letter changed in the text before, and a run's letters are tested afterwards.
_ID_TEXT = "regexp_replace(text, '(?i)(secret_)a(ccess_?key)', '\\10\\2', 'g')"
_VALUE_TEXT = "regexp_replace(regexp_replace(text, '(?i)(secret_)a(ccess_?key)', '\\11\\2', 'g'), '(?i)(access_)k(ey)', '\\10\\2', 'g')"
_MORE_SQL = {
    "prefixed_id": dict(pattern=r"""(?i)[a-z0-9]_(?:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", text=_ID_TEXT, skip=2),
    "prefixed_value": dict(pattern=r"""(?i)[a-z0-9]_(?:pass|pwd|pw|key|1ccess_?key|credential|auth|private_?key|client_?secret)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", text=_VALUE_TEXT, skip=2),
    "short_value": dict(pattern=r"""((?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{6,11})(?:[^A-Za-z0-9+/_.=-]|$)""", core=True),
    "random": dict(pattern=r"[A-Za-z0-9+/_=-]{20,}", sound="regexp_matches(w., '[a-z]') AND regexp_matches(w., '[A-Z]') AND regexp_matches(w., '[0-9]')"),
}


def _secrets(reach: int = 200) -> str:
    kinds = {"assign": (ASSIGN, 12), "access": (ACCESS, 0), "hex": (HEX, 0), **{k: (p, 0) for k, p in WEAK.items()}}
    tables = [_spans_sql(f"s_{k}", p, KINDS.index(k), k, least) for k, (p, least) in kinds.items()]
    tables += [_spans_sql(f"s_{k}", rank=KINDS.index(k), kind=k, **how) for k, how in _MORE_SQL.items()]
    strong = " UNION ALL ".join(f"FROM s_{k}" for k in BASE)
    weak = " UNION ALL ".join(f"FROM s_{k}" for k in WEAK)
    more = " UNION ALL ".join(f"FROM s_{k}" for k in MORE if k != "random")
    listed = lambda kinds: ", ".join(map(_quoted, kinds))
    # RE2's (?i) also folds the long s and the kelvin sign, which are no letters of a pattern here.
    docs = _DOCS.replace("coalesce(text, '')", "translate(coalesce(text, ''), '\u017f\u212a', '??')")
    return f"""WITH {docs}, {', '.join(tables)}, {_spans_sql('breaks', SCOPE_BREAK, 9, 'break')},
base AS ({strong}), named AS (FROM base UNION ALL {weak}),
fresh AS (SELECT * FROM ({more}) m WHERE NOT EXISTS (SELECT 1 FROM named p WHERE p.rn = m.rn AND p.kind <> 'endpoint' AND p.st <= m.st AND m.en <= p.en)),
told AS (FROM named UNION ALL FROM fresh),
every AS (FROM told UNION ALL SELECT * FROM s_random r WHERE NOT EXISTS (SELECT 1 FROM told p WHERE p.rn = r.rn AND p.st < r.en AND r.st < p.en)),
parts AS (SELECT p.*, (SELECT count(*) FROM breaks b WHERE b.rn = p.rn AND b.en <= p.st) AS scope,
  CASE WHEN kind IN ({listed(WHO)}) THEN 'who' WHEN kind IN ({listed(SECRET)}) THEN 'secret' ELSE 'where' END AS role FROM every p),
met AS (SELECT w.rn, w.st, w.rank, w.kind, w.en, w.role, max((n.role = 'who')::INT) AS who, max((n.role = 'secret')::INT) AS secret
  FROM parts w JOIN parts n ON n.rn = w.rn AND n.scope = w.scope AND n.role <> 'where' AND n.role <> w.role AND n.st - {reach} < w.en AND w.st < n.en + {reach}
  WHERE w.kind NOT IN ({listed(BASE)}) GROUP BY ALL),
linked AS (SELECT rn, st, rank, kind, en FROM met WHERE CASE role WHEN 'who' THEN secret = 1 WHEN 'secret' THEN who = 1 ELSE who = 1 AND secret = 1 END),
b AS (SELECT rn, count_if(kind = 'assign')::BIGINT AS n_assign, count_if(kind = 'access')::BIGINT AS n_access, count_if(kind = 'hex')::BIGINT AS n_hex,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) AS listed FROM base GROUP BY rn),
a AS (SELECT rn, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) AS listed FROM (FROM base UNION ALL FROM linked) GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans
FROM docs LEFT JOIN b USING (rn) LEFT JOIN a USING (rn)"""


def template_regex(template: str) -> str:
    """The regular expression over words with a space before each that accepts what a template accepts."""
    out = []
    for mark in re.findall(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\]()|{}]+", template):
        if mark in ("[[", "(("):
            out.append("(?:")
        elif mark == "]]":
            out.append(")?")
        elif mark == "))":
            out.append(")")
        elif mark == "|":
            out.append("|")
        elif mark.startswith("{{"):
            out.append(f"(?: [^ ]+){{0,{mark[2:-2]}}}")
        else:
            out.append(f" {mark}")
    return "".join(out) + " "


def _licenses() -> str:
    own = ", ".join(f"CASE WHEN regexp_matches(joined, {_quoted(template_regex(t))}) THEN '{label}' END" for label, t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = " || ".join(
        f"list_filter(range(0, len(words)), lambda i: {' AND '.join(f'words[i + {k + 1}] = {_quoted(w)}' for k, w in enumerate(p.split()))})" for p, _ in PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(joined, ' {p} ') THEN '{label}' END" for p, label in PHRASES)
    return f"""WITH {_DOCS}, w AS (SELECT rn, doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM docs),
j AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined, {places} AS places FROM w),
l AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM j)
SELECT doc_id, len(words) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || own)), ',') AS labels, (CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM l"""


def _substrings(window: int = 35) -> str:
    return f"""WITH {_DOCS}, w AS (SELECT rn, doc_id, list_filter(string_split_regex(text, {_WORD_GAP}), lambda x: x <> '') AS words FROM docs),
starts AS (SELECT rn, unnest(range(1, len(words) - {window - 2})) AS i, words FROM w WHERE len(words) >= {window}),
hashed AS (SELECT rn, i, md5(array_to_string(words[i:i + {window - 1}], ' ')) AS k FROM starts),
again AS (SELECT k FROM hashed GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rn, unnest(range(i, i + {window})) AS i FROM hashed WHERE k IN (FROM again)),
cut AS (SELECT rn, list(i) AS places FROM gone GROUP BY rn)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256 FROM w LEFT JOIN cut USING (rn)"""


def _jaccard(k: int = 5, threshold: float = 0.8) -> str:
    return f"""WITH RECURSIVE {_DOCS}, texts AS (SELECT text, min(doc_id) AS least_id, count(*) AS n_copies, row_number() OVER () AS tid FROM docs GROUP BY text),
w AS (SELECT tid, list_filter(string_split_regex(text, {_WORD_GAP}), lambda x: x <> '') AS words FROM texts),
sh AS (SELECT DISTINCT tid, array_to_string(words[i:i + {k - 1}], ' ') AS s FROM (SELECT tid, words, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT tid, count(*) AS n FROM sh GROUP BY tid),
both_ AS (SELECT a.tid AS a, b.tid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.tid < b.tid GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.tid = a JOIN n y ON y.tid = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT tid AS a, tid AS b FROM texts UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
class AS (SELECT r.a AS tid, min(t.least_id) AS class_id FROM reach r JOIN texts t ON t.tid = r.b GROUP BY r.a),
deg AS (SELECT a AS tid, count(*) AS n_links FROM sym GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM docs JOIN texts USING (text) JOIN class USING (tid) LEFT JOIN deg USING (tid)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secrets(), "op5_license_scan": _licenses(), "op6_substrings": _substrings(), "op8_jaccard_join": _jaccard()}
