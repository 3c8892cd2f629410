"""DuckDB SQL for the queries that SQL can say over whole tables: exact definitions, without the operators' methods."""

from __future__ import annotations

from . import licenses, pii

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(rx: str) -> str:
    return f"regexp_extract_all({_LOW.format('text')}, '{rx}')"


_ALNUM, _SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_words(_ALNUM)}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_words(_ALNUM)} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_words(_SOLID)}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_ FROM reach GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY 1) USING (doc_id)"""


# ------------------------------------------------------------ personal data

#: The base kinds by their plain patterns; of the added kinds what RE2 can say, with one character before a match in group 1.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "ssn": "[0-9-]+", "secret": r"(?i)(?:^|[^A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key)[ \t]*[=:][ \t]*\"[^\"\s]{8,200}\"",
}
_LED = ("iban", "secret")
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_DIGITS}) - k) % 2 = 1 THEN CAST({_DIGITS}[k] AS INT) * 2 - CASE WHEN CAST({_DIGITS}[k] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({_DIGITS}[k] AS INT) END for k in range(1, length({_DIGITS}) + 1)]) % 10 = 0"
_TURNED = "replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4]"
_MOD97 = f"list_reduce(list_prepend(0, [CASE WHEN regexp_matches(({_TURNED})[k], '[0-9]') THEN CAST(({_TURNED})[k] AS INT) ELSE 100 + ascii(({_TURNED})[k]) - 55 END for k in range(1, length({_TURNED}) + 1)]), lambda a, x: CASE WHEN x < 100 THEN (a * 10 + x) % 97 ELSE (a * 100 + x - 100) % 97 END) = 1"
_VALID = {
    "email": "TRUE", "ip": "list_max([CAST(p AS DOUBLE) for p in string_split(v, '.')]) <= 255", "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"NOT regexp_matches(substr(text, CAST(e AS BIGINT) + 1, 1), '[A-Za-z0-9]') AND {_MOD97}", "ssn": "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", "secret": "TRUE",
}


def _kind(place: int, kind: str, score: float, near: str) -> str:
    rx = _PLAIN[kind].replace("'", "''")
    led = "CASE WHEN regexp_matches(m[i], '^[A-Za-z0-9]') THEN 0 ELSE 1 END" if kind in _LED else "0"
    found = f"""SELECT r, text, coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) + {led} AS s, coalesce(list_sum([length(x) for x in g[1:i]]), 0) + list_sum([length(x) for x in m[1:i]]) AS e,
      m[i][{led} + 1:] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, text, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g FROM d))"""
    around = f"lower(substr(text, CAST(greatest(s - {pii.NEAR}, 0) AS BIGINT) + 1, CAST(least(s, {pii.NEAR}) AS BIGINT)) || ' ' || substr(text, CAST(e AS BIGINT) + 1, {pii.NEAR}))"
    enough = "TRUE" if kind in pii.BASE else f"{score} + CASE WHEN regexp_matches({around}, '(?:^|[^a-z])(?:{near})') THEN {pii.BOOST} ELSE 0 END >= {pii.MIN_SCORE}"
    return f"SELECT r, {place} AS place, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({found}) WHERE {_VALID[kind]} AND {enough}"


_SPANS = " UNION ALL ".join(_kind(i, kind, score, near) for i, (kind, _, _, score, near) in enumerate(pii.KINDS))
_SAID = "kind || ':' || s || ':' || e"
OP10 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents), found AS ({_SPANS}),
one AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)}, string_agg({_SAID}, ',' ORDER BY place, s) FILTER (WHERE place < {len(pii.BASE)}) AS base, string_agg({_SAID}, ',' ORDER BY place, s) AS spans FROM found GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN one USING (r)"""


# ------------------------------------------------------------ licences


def op2() -> str:
    rows, idf = licenses.weights(licenses.TEMPLATES)
    values = ", ".join(f"('{t}', '{n}', {w!r}::DOUBLE)" for t, n, w in rows)
    idfs = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items())
    spdx = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SPDX.items())
    cue, unknown = licenses.CUE, licenses.unknown_idf(licenses.TEMPLATES)
    cued = lambda parts: f"list_filter(list_transform({parts}, lambda p: trim(p, ' ')), lambda p: regexp_matches(p, '{cue}'))"
    paragraphs = cued(f"list_transform(string_split_regex(regexp_replace(text, '{licenses.MARKS}', '', 'g'), '\\n\\s*\\n'), lambda p: regexp_replace(p, '\\s+', ' ', 'g'))")
    sentences = cued("flatten(list_transform(pars, lambda p: string_split(regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))))")
    return f"""
WITH d AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), CAST(floor(doc_id / 512) AS BIGINT), CAST(floor(doc_id / 64) AS BIGINT), doc_id || '.txt') AS path FROM documents),
t(term, template, weight) AS (VALUES {values}), i(term, idf) AS (VALUES {idfs}), x(id, license) AS (VALUES {spdx}),
c AS (SELECT doc_id, path, text, {paragraphs} AS pars FROM d WHERE regexp_matches(text, '{cue}')),
p AS (SELECT DISTINCT doc_id, path, 'file' AS method, text AS passage FROM c UNION SELECT doc_id, path, 'header', unnest(list_concat({cued("string_split(text, chr(10))")}, pars, {sentences})) FROM c),
k AS (SELECT *, row_number() OVER () AS key FROM p),
w AS (SELECT key, term, n * coalesce(idf, {unknown!r}) AS q FROM (SELECT key, term, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(lower(passage), '{licenses.TERM}')) AS term FROM k) GROUP BY 1, 2) LEFT JOIN i USING (term)),
cosine AS (SELECT key, split_part(template, '/', 1) AS license, round(dot / norm, 9) AS score FROM (SELECT key, template, sum(q * weight) AS dot FROM w JOIN t USING (term) GROUP BY 1, 2) JOIN (SELECT key, sqrt(sum(q * q)) AS norm FROM w GROUP BY 1) USING (key)),
strong AS (SELECT doc_id, path, method, passage, license, score FROM cosine JOIN k USING (key) WHERE score >= CASE method WHEN 'file' THEN {licenses.FILE_CUTOFF} ELSE {licenses.CUTOFF} END
  UNION ALL SELECT doc_id, path, 'header', s, x.license, 1.0 FROM (SELECT doc_id, path, unnest(regexp_extract_all(text, '{licenses.SPDX_MARK}')) AS s FROM d) JOIN x ON x.id = lower(regexp_extract(s, '{licenses.SPDX_MARK}', 2))),
own AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, method, license, passage) = 1),
f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM strong WHERE method = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) = 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM d),
above AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS ancestor FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM dirs)),
inherited AS (SELECT a.dir, f.license, f.score, a.ancestor FROM above a JOIN f ON f.dir = a.ancestor QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY depth DESC) = 1)
SELECT d.doc_id, d.path, coalesce(o.license, h.license) AS license, CASE WHEN o.license IS NOT NULL THEN o.method WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
  coalesce(o.score, h.score) AS score, CASE WHEN o.license IS NOT NULL THEN o.passage ELSE h.ancestor END AS evidence
FROM d LEFT JOIN own o ON o.doc_id = d.doc_id AND o.path = d.path LEFT JOIN inherited h ON h.dir = regexp_replace(d.path, '/?[^/]*$', '')"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2(), "op5_benchmark_decontamination": OP5, "op8_ngram_jaccard_join": OP8, "op10_pii": OP10}
