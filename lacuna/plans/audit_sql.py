"""The audit as DuckDB SQL, step by step, as the second implementation that the queries are held against.

It shares the fixed values (patterns, terms, the checklist) with the engine and none of its logic. RE2 knows no looking
around, so what stands before a match is taken from its place. chain(source) gives the steps over a table canon
(doc_id, t); each step is a table that a query can select from.
"""

from __future__ import annotations

from lacuna.functions import headings as H
from lacuna.functions import triggers as G
from lacuna.functions import verdicts as V
from lacuna.operators import profile as P
from lacuna.plans.pack import STARTER, Field
from lacuna.plans.planted import planted_sql, quoted

FEATURES = ("has_animals", *P.SIGNS, "has_drug_treatment")
_NUMBER = V.NUMBER
#: The ways to state a dimension with the test for a cell line's name taken out of the pattern: group 3 of the first holds it.
_COUNT = rf"({_NUMBER}(?:{V._POWER})?)\s*(?:\s([A-Za-z0-9./-]+))?\s*(?:cells?|passages?|copies)\b"


def re2(pattern: str) -> str:
    """A Java pattern's flags and quoting for RE2."""
    flags = "".join(f for f in "im" if pattern.startswith("(?") and f in pattern[2 : pattern.index(")")]) if pattern.startswith("(?") and pattern[2] in "imUd" else ""
    body = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?") and pattern[2] in "imUd" else pattern
    while r"\Q" in body:
        before, _, rest = body.partition(r"\Q")
        literal, _, after = rest.partition(r"\E")
        body = before + "".join(c if c.isalnum() or c == " " else "\\" + c for c in literal) + after
    return (f"(?{flags})" if flags else "") + body


def _split(pattern: str) -> tuple[str, str]:
    return (pattern[2 : pattern.index(")")], pattern[pattern.index(")") + 1 :]) if pattern.startswith("(?") and pattern[2] in "im" else ("", pattern)


def first(t: str, pattern: str) -> str:
    """Place of the first match, or null."""
    flags, body = _split(pattern)
    return f"CASE WHEN regexp_matches({t}, {quoted(pattern)}) THEN length(regexp_extract({t}, {quoted(f'(?s{flags})' + chr(92) + 'A(.*?)(?:' + body + ')')}, 1)) END"


def spans(t: str, pattern: str) -> str:
    """list of {s, e, m} of all matches; pattern: SQL."""
    m, p = f"regexp_extract_all({t}, {pattern})", f"regexp_split_to_array({t}, {pattern})"
    before = f"list_sum(list_transform(list_slice({p}, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': CAST({before} AS BIGINT), 'e': CAST({before} AS BIGINT) + length({m}[i]), 'm': {m}[i]}})"


def values(rows, names: str) -> str:
    show = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names}))"


def _window() -> list[str]:
    opens = ", ".join(f"{first('t', re2(H.alone(w)))} AS o{i}" for i, w in enumerate(H.OPENING))
    stops = ", ".join(f"{first('t', re2(H.alone(w)))} AS c{i}" for i, w in enumerate(H.CLOSING))
    end = lambda i: f"coalesce(least({', '.join(f'CASE WHEN c{k} > o{i} THEN c{k} END' for k in range(len(H.CLOSING)))}), length(t))"
    wide = lambda i: f"WHEN {end(i)} - o{i} >= {H.LEAST_WIDTH} THEN"
    some = range(len(H.OPENING))
    return [
        f"marks AS MATERIALIZED (SELECT doc_id, t, {opens}, {stops} FROM canon)",
        f"methods AS MATERIALIZED (SELECT doc_id, t, CASE {' '.join(f'{wide(i)} o{i}' for i in some)} ELSE 0 END AS m_start, CASE {' '.join(f'{wide(i)} {end(i)}' for i in some)} ELSE length(t) END AS m_end FROM marks)",
    ]


def _profile() -> list[str]:
    ci = lambda p: "(?i)" + p
    found = lambda p: f"CASE WHEN regexp_matches(x, {quoted(ci(p))}) THEN {{'s': {first('x', ci(p))}, 'e': {first('x', ci(p))} + length(regexp_extract(x, {quoted(ci(p))}))}} END"
    of = lambda signs: f"coalesce({', '.join(map(found, signs))})"
    bare = lambda p, test: f"list_transform(list_filter({spans('x', quoted(ci(p)))}, lambda h: {test}), lambda h: {{'s': h.s, 'e': h.e}})[1]"
    subject = f"NOT regexp_matches(substr(x, greatest(h.s - {P.AROUND}, 0) + 1, h.e + {P.AROUND} - greatest(h.s - {P.AROUND}, 0)), {quoted(ci(P.NOT_SUBJECTS))})"
    dosed = f"NOT regexp_matches(substr(x, h.e + 1, {P.AFTER}), {quoted(ci(P.REAGENTS))})"
    hits = [f"coalesce({', '.join(bare(p, subject) for p in P.ANIMALS)}) AS has_animals", *(f"{of(signs)} AS {name}" for name, signs in P.SIGNS.items()), f"coalesce({', '.join(map(found, P.DOSING))}, {bare(P.TREATED, dosed)}) AS has_drug_treatment", f"{of(P.BENCH_WORK)} AS bench"]
    return [
        f"scan AS (SELECT *, CASE WHEN m_end - m_start < {P.LEAST_SCAN} THEN 0 ELSE m_start END AS base, CASE WHEN m_end - m_start < {P.LEAST_SCAN} THEN t ELSE substr(t, m_start + 1, m_end - m_start) END AS x FROM methods)",
        f"hits AS MATERIALIZED (SELECT doc_id, t, m_start, m_end, base, {', '.join(hits)} FROM scan)",
        f"profiles AS MATERIALIZED (SELECT *, coalesce({', '.join(FEATURES)}, bench) AS has_wet_lab FROM hits)",
        "features AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, base + {f}.s AS s, base + {f}.e AS e FROM profiles WHERE {f} IS NOT NULL" for f in (*FEATURES, "has_wet_lab")) + ")",
    ]


def _sections() -> list[str]:
    line = r"^(?:\d+(?:\.\d+)*\.?\s+)?([A-Z][A-Za-z0-9 ,\-/]{2,60})$"
    clean = f"NOT regexp_matches(trim(l), {quoted(re2(H.FURNITURE))}) AND " + " AND ".join(f"NOT regexp_matches(title, {quoted(re2(p))})" for p in H.NOT_TITLES)
    words = [(c, w, rf"(?i)\b{w}") for c, ws in H.CATEGORIES.items() for w in ws]
    return [
        "ls AS (SELECT doc_id, m_start, m_end, i, a[i] AS l, coalesce(list_sum(list_transform(list_slice(a, 1, i - 1), lambda z: length(z) + 1)), 0) AS s FROM (SELECT *, string_split(substr(t, m_start + 1, m_end - m_start), chr(10)) AS a FROM methods), unnest(range(1, len(a) + 1)) AS u(i))",
        f"hs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, trim(regexp_extract(l, {quoted(line)}, 1)) AS title FROM ls WHERE regexp_matches(l, {quoted(line)}))",
        "blanks AS (SELECT h.doc_id, h.idx, NOT bool_or(trim(ls.l) <> '') AS joined FROM hs h JOIN hs g ON h.doc_id = g.doc_id AND h.idx = g.idx + 1 LEFT JOIN ls ON ls.doc_id = h.doc_id AND ls.i > g.i AND ls.i < h.i GROUP BY h.doc_id, h.idx)",
        "al AS (SELECT doc_id, i, a[i] AS l, coalesce(list_sum(list_transform(list_slice(a, 1, i - 1), lambda z: length(z) + 1)), 0) AS s FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM canon), unnest(range(1, len(a) + 1)) AS u(i) WHERE length(a[i]) < 200)",
        "ag AS (SELECT doc_id, key, s - lag(s) OVER (PARTITION BY doc_id, key ORDER BY s) AS gap FROM (SELECT doc_id, s, regexp_replace(trim(l), '\\d+', '#', 'g') AS key FROM al) WHERE key <> '')",
        "running AS (SELECT doc_id, key FROM ag GROUP BY doc_id, key HAVING count(*) >= 3 AND avg(gap) > 0 AND stddev_pop(gap) <= 0.35 * avg(gap))",
        f"ts AS (SELECT hs.*, coalesce(b.joined, true) AS joined FROM hs LEFT JOIN blanks b ON hs.doc_id = b.doc_id AND hs.idx = b.idx WHERE {clean} AND NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = hs.doc_id AND r.key = regexp_replace(title, '\\d+', '#', 'g')))",
        "os AS (SELECT *, CASE WHEN joined AND coalesce(lag(idx) OVER w = idx - 1, false) THEN 0 ELSE 1 END AS opens FROM ts WINDOW w AS (PARTITION BY doc_id ORDER BY idx))",
        "isl AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS island FROM os)",
        "merged AS (SELECT doc_id, island, string_agg(title, ' ' ORDER BY idx) AS header, min(s) AS a, max(s + length(l)) AS b, any_value(m_start) AS m_start, any_value(m_end) AS m_end FROM isl GROUP BY doc_id, island)",
        "subs AS MATERIALIZED (SELECT doc_id, CAST(island AS BIGINT) AS sub_idx, header, CAST(m_start + b AS BIGINT) AS s, CAST(coalesce(m_start + lead(a) OVER (PARTITION BY doc_id ORDER BY island), m_end) AS BIGINT) AS e FROM merged)",
        f"words AS {values(words, 'category, word, rx')}",
        "shits AS MATERIALIZED (SELECT doc_id, sub_idx, header, category, count(*) AS n FROM subs, words WHERE regexp_matches(header, rx) GROUP BY ALL)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY n DESC, sub_idx) AS r, count(*) OVER (PARTITION BY doc_id, category) AS k FROM shits)",
        "sizes AS (SELECT c.doc_id, count(sub_idx) AS size, any_value(header) AS sole FROM canon c LEFT JOIN subs USING (doc_id) GROUP BY c.doc_id)",
        "cats AS (SELECT DISTINCT category FROM fields)",
        "nodes AS MATERIALIZED (SELECT z.doc_id, cats.category, CASE WHEN size = 1 THEN 0 WHEN size > 1 THEN r.sub_idx END AS node, CASE WHEN size = 1 THEN sole WHEN size > 1 THEN r.header END AS title, CASE WHEN size = 0 THEN 'node:no-subsections' WHEN size = 1 THEN 'node:only-one' WHEN r.k IS NULL THEN 'node:det-none' WHEN r.k = 1 THEN 'node:det-unique' ELSE 'node:det-first-of-' || r.k END AS how FROM sizes z CROSS JOIN cats LEFT JOIN ranked r ON r.doc_id = z.doc_id AND r.category = cats.category AND r.r = 1)",
    ]


def fields_cte(pack: tuple[Field, ...]) -> list[str]:
    rows = [(i, f.field_id, f.type, f.dimension, f.low, f.high, f.canonical_unit, f.sensitivity, f.field_id.split(".")[0]) for i, f in enumerate(pack)]
    gates = [(f.field_id, x, k) for f in pack for k, xs in (("all", f.all_of), ("any", f.any_of)) for x in xs]
    parts = "SELECT field_id, unnest(string_split(replace(field_id, '_', '.'), '.')) AS part FROM fields"
    return [
        f"fields AS {values(rows, 'ord, field_id, type, dimension, lo, hi, unit, sensitivity, category')}",
        f"keywords AS (SELECT field_id, unnest(CASE WHEN part = 'cellline' THEN ['cell line', 'cell lines'] ELSE [part] END) AS kw, CASE WHEN part = 'cellline' THEN 1 ELSE 2 END AS weight FROM ({parts}))",
        f"gates AS {values(gates, 'field_id, feature, kind')}",
    ]


def applicable_cte(documents: str = "canon") -> str:
    return f"applies AS MATERIALIZED (SELECT c.doc_id, f.* FROM {documents} c CROSS JOIN fields f WHERE NOT EXISTS (SELECT 1 FROM gates g WHERE g.field_id = f.field_id AND g.kind = 'all' AND NOT EXISTS (SELECT 1 FROM features x WHERE x.doc_id = c.doc_id AND x.feature = g.feature)) AND (NOT EXISTS (SELECT 1 FROM gates g WHERE g.field_id = f.field_id AND g.kind = 'any') OR EXISTS (SELECT 1 FROM gates g JOIN features x ON x.feature = g.feature WHERE g.field_id = f.field_id AND g.kind = 'any' AND x.doc_id = c.doc_id)))"


def sentence_cte(source: str) -> list[str]:
    """sents (doc_id, scope, header, sent_idx, st, s, e) of source (doc_id, scope, header, base, body)."""
    cut = r"regexp_replace(body, '([.!?])(\s+)([A-Z(])', '\1' || chr(30) || '\2' || chr(30) || '\3', 'g')"
    at = "base + coalesce(list_sum(list_transform(list_slice(a, 1, 2 * i), lambda z: length(z))), 0)"
    return [
        f"cutup AS (SELECT doc_id, scope, header, base, string_split({cut}, chr(30)) AS a FROM {source})",
        f"sents AS MATERIALIZED (SELECT doc_id, scope, header, i AS sent_idx, a[2 * i + 1] AS st, CAST({at} AS BIGINT) AS s, CAST({at} + length(a[2 * i + 1]) AS BIGINT) AS e FROM cutup, unnest(range(0, (len(a) + 1) // 2)) AS u(i))",
    ]


def typed_cte(source: str) -> list[str]:
    """typed (x, field_id, verdict, code, value) of source (x, field_id): distinct texts with fields."""
    evidence = [(f, ("(?i)" if ci else "") + p) for f, ps in V.EVIDENCE.items() for p, ci in ps]
    surface = [(f.field_id, i, v, "(?i)" + p) for f in STARTER for i, v in enumerate(f.enum_values) if v not in V.SENTINELS for p in (rf"\b{v.replace('_', ' ')}\b", *V.SURFACE.get(v, ()))]
    flags = lambda d: "" if d == "concentration" else "(?i)"
    way = lambda d, b, n, a: _COUNT if d == "count" and not b else f"{b}({n}){a}"
    ways = [(d, k, flags(d) + way(d, *w), w[0] and "(?i)^" + w[0]) for d, ws in V.STATED.items() for k, w in enumerate(ws)]
    ranges = [(d, "(?i)" + form.replace("{low}", _NUMBER) + "(?:" + (f"{w[0]}({w[1]}){w[2]}" if d != "count" or w[0] else rf"({_NUMBER}(?:{V._POWER})?)\s*(?:\s[A-Za-z0-9./-]+)?\s*(?:cells?|passages?|copies)\b") + ")") for d, ws in V.STATED.items() for w in ws for form in V._RANGE_FORMS]
    add = [(d, u, x) for (d, u), x in V.TO_UNIT.items()]
    only = [(d, "(?i)" + p) for d, p in V._UNIT_ONLY.items()]
    number = r"CASE WHEN regexp_matches(tok, '[×xX✕]') THEN TRY_CAST(replace(regexp_extract(tok, '^(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) * pow(10, TRY_CAST(regexp_extract(tok, '10\s*\^?\s*(\d+)$', 1) AS DOUBLE)) ELSE TRY_CAST(replace(tok, ',', '') AS DOUBLE) END"
    low, high = number.replace("tok", "lows[i]"), number.replace("tok", "highs[i]")
    return [
        f"evidence AS {values(evidence, 'field_id, rx')}",
        f"surface AS {values(surface, 'field_id, ord, value, rx')}",
        f"ways AS {values(ways, 'dimension, way, rx, lead')}",
        f"ranges AS {values(ranges, 'dimension, rx')}",
        f"adds AS {values(add, 'dimension, unit, plus')}",
        f"onlys AS {values(only, 'dimension, rx')}",
        f"asked AS MATERIALIZED (SELECT DISTINCT x, field_id FROM {source} WHERE x IS NOT NULL)",
        "xs AS (SELECT DISTINCT x, dimension FROM asked JOIN fields USING (field_id) WHERE type = 'quantity')",
        f"raws AS (SELECT x, dimension, rx, lead, unnest({spans('x', 'rx')}) AS h FROM xs JOIN ways USING (dimension) WHERE regexp_matches(x, rx))",
        "toks AS (SELECT x, dimension, regexp_extract(h.m, rx, 1) AS tok, CASE WHEN lead = '' AND dimension = 'count' THEN regexp_extract(h.m, rx, 2) ELSE '' END AS name, h.s + CASE WHEN lead = '' THEN 0 ELSE length(regexp_extract(h.m, lead)) END AS spot FROM raws)",
        rf"nums AS MATERIALIZED (SELECT x, dimension, {number} AS n FROM toks WHERE NOT regexp_matches(substr(x, 1, spot), '\p{{L}}[\p{{L}}\p{{N}}-]*$') AND (name = '' OR (regexp_matches(name, '\d') AND regexp_matches(name, '[A-Za-z]'))))",
        f"ranged AS (SELECT DISTINCT x, dimension FROM (SELECT x, dimension, regexp_extract_all(x, rx, 1) AS lows, regexp_extract_all(x, rx, 2) AS highs FROM xs JOIN ranges USING (dimension) WHERE regexp_matches(x, rx)), unnest(range(1, len(lows) + 1)) AS u(i) WHERE {low} < {high})",
        "quants AS (SELECT a.x, a.field_id, f.dimension, EXISTS (SELECT 1 FROM ranged r WHERE r.x = a.x AND r.dimension = f.dimension) AS is_range, EXISTS (SELECT 1 FROM nums n WHERE n.x = a.x AND n.dimension = f.dimension) AS stated, EXISTS (SELECT 1 FROM onlys o WHERE o.dimension = f.dimension AND regexp_matches(a.x, o.rx)) AS unit_only, f.lo IS NULL OR NOT EXISTS (SELECT 1 FROM adds d WHERE d.dimension = f.dimension AND d.unit = f.unit) OR NOT EXISTS (SELECT 1 FROM nums n WHERE n.x = a.x AND n.dimension = f.dimension) OR EXISTS (SELECT 1 FROM nums n JOIN adds d ON d.dimension = n.dimension AND d.unit = f.unit WHERE n.x = a.x AND n.dimension = f.dimension AND n.n + d.plus BETWEEN f.lo AND f.hi) AS plausible FROM asked a JOIN fields f USING (field_id) WHERE f.type = 'quantity')",
        rf"qcodes AS (SELECT x, field_id, CASE WHEN is_range THEN 'GAP_RANGE_NOT_POINT' WHEN (stated OR unit_only) AND plausible THEN 'OK' WHEN stated OR unit_only THEN 'GAP_OUT_OF_RANGE' WHEN dimension = 'relative_centrifugal_force' AND regexp_matches(x, '(?i){_NUMBER}\s*rpm\b') THEN 'GAP_DIMENSION_MISMATCH' WHEN dimension <> 'fraction' AND regexp_matches(x, '{_NUMBER}\s*%') THEN 'GAP_DIMENSION_MISMATCH' ELSE 'GAP_ABSENT' END AS code FROM quants)",
        "enums AS (SELECT a.x, a.field_id, arg_min(s.value, s.ord) AS value FROM asked a JOIN surface s USING (field_id) WHERE regexp_matches(a.x, s.rx) GROUP BY a.x, a.field_id)",
        "shown AS (SELECT DISTINCT a.x, a.field_id FROM asked a JOIN evidence v USING (field_id) WHERE regexp_matches(a.x, v.rx))",
        r"codes AS (SELECT a.x, a.field_id, v.value, CASE f.type WHEN 'quantity' THEN q.code WHEN 'enum' THEN CASE WHEN v.value IS NULL THEN 'GAP_ABSENT' ELSE 'OK' END WHEN 'sequence' THEN CASE WHEN regexp_matches(a.x, '\b[ACGTUacgtu]{12,}\b') THEN 'OK' ELSE 'GAP_ABSENT' END ELSE CASE WHEN s.x IS NOT NULL OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.field_id = a.field_id) THEN 'OK' ELSE 'GAP_ABSENT' END END AS c FROM asked a JOIN fields f USING (field_id) LEFT JOIN qcodes q USING (x, field_id) LEFT JOIN enums v ON f.type = 'enum' AND v.x = a.x AND v.field_id = a.field_id LEFT JOIN shown s ON s.x = a.x AND s.field_id = a.field_id)",
        "typed AS MATERIALIZED (SELECT x, field_id, CASE c WHEN 'OK' THEN 'FIELD_OK' WHEN 'GAP_ABSENT' THEN 'FIELD_ABSENT' ELSE 'FIELD_UNRESOLVED' END AS verdict, nullif(c, 'OK') AS code, value FROM codes)",
    ]


def trigger_cte() -> list[str]:
    """governed (x, field_id, code, low, high, text, family) of asked (x, field_id)."""
    lex = G.STARTER_LEXICON
    fills = [(family, t, x) for family in G.LIST_FILLS for t, xs in lex.fills(family).items() for x in xs]
    codes = [(k, v) for k, v in G._CODES.items()]
    families = " UNION ALL ".join(f"SELECT x, '{k}' AS family, unnest({spans('x', quoted(re2(p)))}) AS h FROM texts WHERE regexp_matches(x, {quoted(re2(p))})" for k, p in lex.patterns.items())
    targets = []
    for f in STARTER:
        out = []
        if f.dimension in V.STATED:
            d = f.dimension
            ways = "|".join(_COUNT if d == "count" and not b else f"{b}{n}{a}" for b, n, a in V.STATED[d]) + (f"|{V._UNIT_ONLY[d]}" if d in V._UNIT_ONLY else "")
            out.append(("" if d == "concentration" else "(?i)") + ways)
        if ws := H.CATEGORIES.get(f.field_id.split(".")[0]):
            out.append(r"(?i)\b(?:" + "|".join(sorted(ws, key=len, reverse=True)) + ")")
        out += [rf"(?i)\b{p}" for p in f.field_id.replace("_", ".").split(".") if len(p) >= 4]
        targets += [(f.field_id, i, p, "(?s" + _split(p)[0] + r")\A(.*?)(?:" + _split(p)[1] + ")") for i, p in enumerate(out)]
    return [
        f"fills AS {values(fills, 'family, term, slot')}",
        f"gapof AS {values(codes, 'family, code')}",
        f"targets AS {values(targets, 'field_id, ord, rx, before')}",
        "texts AS (SELECT DISTINCT x FROM asked)",
        f"trigs AS MATERIALIZED (SELECT x, family, h.s AS s, h.e AS e, h.m AS m FROM ({families}))",
        f"ends AS MATERIALIZED (SELECT x, unnest({spans('x', quoted(re2(G.CLAUSE_END)))}) AS h FROM texts)",
        "places AS (SELECT a.x, a.field_id, arg_min(length(regexp_extract(a.x, t.before, 1)), t.ord) AS spot FROM asked a JOIN targets t USING (field_id) WHERE regexp_matches(a.x, t.rx) GROUP BY a.x, a.field_id)",
        f"fit AS (SELECT a.x, a.field_id, g.family, g.s, g.e, g.m FROM asked a JOIN fields f USING (field_id) JOIN trigs g USING (x) WHERE g.family = 'deferred_display' OR (g.family = 'deferred_reference' AND f.type IN ({', '.join(map(quoted, G.REFERENCE_FILLS))})) OR EXISTS (SELECT 1 FROM fills z WHERE z.family = g.family AND z.term = lower(g.m) AND (z.slot = '*' OR z.slot = f.dimension OR z.slot = f.type)))",
        "scoped AS (SELECT fit.*, p.spot, coalesce((SELECT max(h.e) FROM ends WHERE ends.x = fit.x AND h.e <= fit.s), 0) AS low, coalesce((SELECT min(h.s) FROM ends WHERE ends.x = fit.x AND h.s > fit.s), length(fit.x)) AS high FROM fit LEFT JOIN places p ON p.x = fit.x AND p.field_id = fit.field_id)",
        "inside AS (SELECT *, spot IS NULL OR (low <= spot AND spot < high) AS is_in, bool_or(family LIKE 'deferred%') OVER w AS defers, bool_or(spot IS NULL OR (low <= spot AND spot < high)) OVER w AS any_in FROM scoped WINDOW w AS (PARTITION BY x, field_id))",
        "governed AS MATERIALIZED (SELECT x, field_id, code, low, high, m AS text, family FROM (SELECT *, row_number() OVER (PARTITION BY x, field_id ORDER BY s, e, m, family) AS r FROM inside WHERE is_in OR (NOT any_in AND defers)) JOIN gapof USING (family) WHERE r = 1)",
    ]


def _candidates() -> list[str]:
    lex = G.STARTER_LEXICON
    vague = " UNION ALL ".join(f"SELECT DISTINCT st, '{k}' AS family, lower(unnest(regexp_extract_all(st, {quoted(re2(lex.patterns[k]))}))) AS term FROM usents" for k in G.LIST_FILLS)
    own = [(f.field_id, family, t) for f in STARTER for family in G.LIST_FILLS for t, xs in lex.fills(family).items() if xs != G.ANY and {f.dimension, f.type} & set(xs)]
    evidence = [(f, ("(?i)" if ci else "") + p) for f, ps in V.EVIDENCE.items() for p, ci in ps]
    return [
        "usents AS MATERIALIZED (SELECT DISTINCT st, regexp_replace(st, '^\\s+|\\s+$', '', 'g') AS body, length(regexp_extract(st, '^\\s*')) AS lead FROM sents)",
        "scores AS MATERIALIZED (SELECT u.st, k.field_id, sum(weight) AS score FROM usents u JOIN keywords k ON contains(lower(u.st), k.kw) GROUP BY u.st, k.field_id)",
        f"shown0 AS {values(evidence, 'field_id, rx')}",
        "fit0 AS MATERIALIZED (SELECT c.st, c.field_id, c.score, (f.field_id NOT IN (SELECT field_id FROM shown0) OR EXISTS (SELECT 1 FROM shown0 v WHERE v.field_id = c.field_id AND regexp_matches(c.st, v.rx))) AND (f.type <> 'quantity' OR regexp_matches(c.st, '\\d')) AS usable FROM scores c JOIN fields f USING (field_id))",
        f"vague AS ({vague})",
        f"own AS {values(own, 'field_id, family, term')}",
        "slots AS MATERIALIZED (SELECT DISTINCT st, field_id FROM vague JOIN own USING (family, term))",
        "subcats AS (SELECT DISTINCT doc_id, sub_idx, category FROM shits)",
        "tiers AS (SELECT s.doc_id, c.field_id, 1 AS tier, -c.score AS k, s.* EXCLUDE (doc_id) FROM sents s JOIN fit0 c ON c.st = s.st AND usable JOIN fields f USING (field_id) JOIN subcats q ON q.doc_id = s.doc_id AND q.sub_idx = s.scope AND q.category = f.category WHERE s.scope >= 0 UNION ALL SELECT s.doc_id, c.field_id, 2, -c.score, s.* EXCLUDE (doc_id) FROM sents s JOIN fit0 c ON c.st = s.st AND usable WHERE s.scope = -1 UNION ALL SELECT s.doc_id, v.field_id, 3, 0, s.* EXCLUDE (doc_id) FROM sents s JOIN slots v USING (st) WHERE s.scope = -1)",
        "obs AS MATERIALIZED (SELECT doc_id, field_id, CASE tier WHEN 1 THEN 'section:' || header WHEN 2 THEN 'keyword:fallback-whole-methods' ELSE 'trigger:fills-slot' END AS detector, body AS x, s, e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY tier, k, scope, sent_idx) AS r FROM tiers) JOIN usents USING (st) WHERE r = 1)",
        "levels AS (SELECT s.doc_id, c.field_id, c.score, s.sent_idx, s.s + u.lead AS a, u.body, CASE WHEN s.scope = n.node THEN 0 WHEN s.scope = -1 THEN 1 WHEN s.scope = -2 THEN 2 END AS level FROM sents s JOIN scores c USING (st) JOIN usents u USING (st) JOIN fields f USING (field_id) JOIN nodes n ON n.doc_id = s.doc_id AND n.category = f.category WHERE u.body <> '')",
        "bests AS (SELECT doc_id, field_id, 2 * level AS spot, a, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY level, -score, sent_idx) AS r FROM levels WHERE level IS NOT NULL) WHERE r = 1)",
        "heads AS MATERIALIZED (SELECT doc_id, scope, a, body FROM (SELECT s.doc_id, s.scope, s.s + u.lead AS a, u.body, row_number() OVER (PARTITION BY s.doc_id, s.scope ORDER BY sent_idx) AS r FROM sents s JOIN usents u USING (st) WHERE length(u.body) >= 10 AND regexp_matches(u.body, '[A-Za-z]{3,}')) WHERE r = 1)",
        "rungs AS (SELECT * FROM bests UNION ALL SELECT n.doc_id, f.field_id, CASE WHEN h.scope = n.node THEN 1 WHEN h.scope = -1 THEN 3 ELSE 5 END, h.a, h.body FROM nodes n JOIN fields f USING (category) JOIN heads h ON h.doc_id = n.doc_id AND (h.scope = n.node OR h.scope < 0))",
        "anchors AS MATERIALIZED (SELECT r.doc_id, r.field_id, r.spot, r.a, r.body, 'anchor:' || n.how || CASE WHEN r.spot % 2 = 0 THEN ':kw:' ELSE ':head:' END || CASE r.spot // 2 WHEN 0 THEN substr(n.title, 1, 34) WHEN 1 THEN 'methods' ELSE 'document' END AS detector FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY spot) AS k FROM rungs) r JOIN fields f USING (field_id) JOIN nodes n ON n.doc_id = r.doc_id AND n.category = f.category WHERE r.k = 1)",
    ]


def _findings() -> list[str]:
    return [
        "judged AS (SELECT p.doc_id, p.ord, p.field_id, p.sensitivity, o.x AS raw, o.detector, o.s, o.e, g.low, g.high, g.text, g.family, coalesce(g.code, t.code, CASE WHEN o.x IS NULL THEN 'GAP_ABSENT' END) AS code, o.x IS NOT NULL AS seen FROM applies p LEFT JOIN obs o USING (doc_id, field_id) LEFT JOIN typed t ON t.x = o.x AND t.field_id = p.field_id LEFT JOIN governed g ON g.x = o.x AND g.field_id = p.field_id)",
        "placed AS (SELECT j.*, a.a, a.body, a.detector AS anchor_detector, coalesce(j.s + j.low < j.s + j.high AND j.s + j.high <= j.e, false) AS narrow FROM judged j LEFT JOIN anchors a ON a.doc_id = j.doc_id AND a.field_id = j.field_id AND NOT j.seen WHERE j.code IS NOT NULL AND (j.seen OR a.a IS NOT NULL))",
        "found AS MATERIALIZED (SELECT doc_id, ord, field_id, sensitivity, raw, detector, anchor_detector, body, code, text, family, CASE WHEN code = 'GAP_ABSENT' THEN 'FIELD_ABSENT' ELSE 'FIELD_UNRESOLVED' END AS verdict, CAST(CASE WHEN narrow THEN s + low WHEN seen THEN s ELSE a END AS BIGINT) AS s, CAST(CASE WHEN narrow THEN s + high WHEN seen THEN e ELSE a + length(body) END AS BIGINT) AS e, CASE WHEN narrow THEN substr(raw, CAST(low + 1 AS BIGINT), CAST(high - low AS BIGINT)) END AS phrase FROM placed)",
    ]


_SCOPES = "scopes AS (SELECT s.doc_id, s.sub_idx AS scope, s.header, s.s AS base, substr(m.t, s.s + 1, s.e - s.s) AS body FROM subs s JOIN methods m USING (doc_id) UNION ALL SELECT doc_id, -1, 'methods', m_start, substr(t, m_start + 1, m_end - m_start) FROM methods UNION ALL SELECT doc_id, -2, 'document', 0, t FROM methods)"
_TIDY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_STEPS = {"profile": [*_window(), *_profile()], "sections": _sections(), "applicable": [applicable_cte()], "sentences": [_SCOPES, *sentence_cte("scopes")], "candidates": _candidates(), "verdicts": [*typed_cte("(SELECT x, field_id FROM obs)"), *trigger_cte()], "findings": _findings()}
DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents"


def chain(upto: str | None, select: str, more: tuple[str, ...] = (), source: str | None = None) -> str:
    """SELECT over the steps up to the named one (None: canon, fields, keywords and gates alone), on the planted documents or a source (doc_id, text)."""
    names = list(_STEPS)
    steps = [c for n in names[: names.index(upto) + 1 if upto else 0] for c in _STEPS[n]]
    base = [f"canon AS MATERIALIZED (SELECT doc_id, {_TIDY} AS t FROM ({source or planted_sql()}) WHERE text IS NOT NULL)", *fields_cte(STARTER)]
    return f"WITH {', '.join([*base, *steps, *more])} {select}"
