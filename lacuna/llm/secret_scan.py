"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's regex a Boolean trigram query is derived: which trigrams (of the lower-cased text) any match must hold.
The index keeps, for the trigrams that queries name, the texts that hold them. Postings are intersected and united as
the query says, and the rule's regex verifies the candidate texts only. A rule without a mandatory trigram scans all.
Rows are known to the index by a 64-bit hash of all their columns, so copies of a text under other ids have keys, and so
tasks, of their own; a clash of hashes adds a candidate, no more.

Cases: null texts count as empty and hold no secret; overlapping spans of several kinds are all reported, ordered by
start, then kind; repeated rows are all returned; an empty table gives an empty result; other columns are ignored by the
scan and kept by the redaction, where null texts stay null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import IGNORECASE, _constants as K, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import bind, sums_before
from lacuna.llm.common import fresh


@dataclass(frozen=True)
class Rule:
    """Matches of pattern are dropped if group (0: all of it) has under least code points. any_case: ASCII letters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: What may follow the first line of a key: all up to the END line, or, where the next dashes aren't one, headers and base64 lines (\\n may stand for a line's end).
_TO_END = r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_HEADERS = r"(?:[ \t]*+[\r\n]++[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+"
_BASE64 = r"(?:(?:[ \t\r\n]|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)++(?:[ \t]*+[\r\n]++[ \t]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?![^\r\n]))?+"
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_TO_END}|{_HEADERS}{_BASE64})?+"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]++:[A-Za-z0-9._~%!$&*+-]{3,}+@"),
)
RULES = BASE_RULES + MORE_RULES

# A query: None (no condition), a trigram, or ("and" | "or", queries).
_MOST = 32


def _join(op: str, parts) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not None]
    elif any(p is None for p in parts):
        return None
    else:  # what another alternative implies adds nothing
        needs = {p: trigrams_of(p) for p in parts if isinstance(p, str) or (p[0] == "and" and all(isinstance(q, str) for q in p[1]))}
        parts = [p for p in parts if p not in needs or not any(needs[q] < needs[p] for q in needs)]
    return None if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else None


def _node(op, value) -> tuple[set[str] | None, object]:
    """(all strings the node can match, lower-cased, if few; the query of any match)."""
    if op is K.LITERAL:
        return {chr(value).lower()}, None
    if op is K.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is K.LITERAL:
                chars.add(chr(x).lower())
            elif kind is K.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is K.SUBPATTERN:
        return _sequence(value[-1])
    if op is K.BRANCH:
        found = [_sequence(b) for b in value[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= _MOST:
            return set().union(*(s for s, _ in found)), None
        return None, _join("or", [_of_strings(s) if s is not None else q for s, q in found])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and high <= 1:
            return strings | ({""} if low == 0 else set()), None
        if strings is not None and low == high and len(strings) ** low <= _MOST:
            return {s for s in reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""})}, None
        return None, None if low == 0 else query if strings is None else _of_strings(strings)
    return ({""}, None) if op is K.AT else (None, None)


def _sequence(nodes) -> tuple[set[str] | None, object]:
    run, queries, exact = {""}, [], True
    for op, value in nodes:
        strings, query = _node(op, value)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        queries += [_of_strings(run), query if strings is None else _of_strings(strings)]
        run, exact = {""}, False
    return (run, None) if exact else (None, _join("and", [*queries, _of_strings(run)]))


def trigram_query(pattern: str, any_case: bool = False) -> object:
    """The Boolean query, over trigrams of the lower-cased text, that every match of the pattern fulfils; None: no condition."""
    strings, query = _sequence(_parser.parse(pattern, IGNORECASE if any_case else 0))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


#: Trigrams whose bits share one long.
_BITS = 62


def wanted_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams_of(trigram_query(r.pattern, r.any_case)) for r in rules)))


def _holds(query: object, places: dict[str, int]) -> Column:
    """Whether the posting bits w0 .. of a key fulfil the query."""
    needs = [0] * (len(places) // _BITS + 1)
    parts = []
    for q in [query] if isinstance(query, str) or query[0] == "or" else query[1]:
        if isinstance(q, str):
            needs[places[q] // _BITS] |= 1 << places[q] % _BITS
        else:
            parts.append(reduce(lambda a, b: a | b, (_holds(x, places) for x in q[1])) if q[0] == "or" else _holds(q, places))
    parts += [F.col(f"w{i}").bitwiseAND(F.lit(n)) == n for i, n in enumerate(needs) if n]
    return reduce(lambda a, b: a & b, parts)


def build_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key_col: str = "key", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name, a trigram as its place among wanted_trigrams."""
    wanted = wanted_trigrams(rules)
    # Step by step, so that the text is lower-cased once and the search for trigrams, as sums of bits, is compiled code.
    low = texts.select(F.col(key_col).alias("key"), F.lower(F.col(text_col)).alias("low"))
    bit = lambda i, t: F.when(F.contains("low", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0))
    words = [reduce(lambda a, b: a + b, (bit(i, t) for i, t in enumerate(wanted[at : at + _BITS])), F.lit(0).cast("long")) for at in range(0, len(wanted), _BITS)]
    held = low.select("key", F.array(*words).cast("array<bigint>").alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.lit(len(wanted) - 1)), lambda i: F.getbit(F.get("words", F.floor(i / _BITS).cast("int")), i % _BITS) == 1) if wanted else F.array().cast("array<int>")
    return held.select("key", F.explode(places).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, mask: bit i is set if the text fulfils the query of rule i.

    The posting lists of all trigrams are intersected and united at once: each posting sets its trigram's bit at its key,
    by partial sums, so the list of a frequent trigram is never gathered.
    """
    places = {t: i for i, t in enumerate(wanted_trigrams(rules))}
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("trigram") / _BITS) == w, F.expr(f"shiftleft(1L, cast(trigram % {_BITS} as int))")).otherwise(F.lit(0)))
    held = index.groupBy("key").agg(*(bit(w).alias(f"w{w}") for w in range(len(places) // _BITS + 1)))
    bits = [F.when(_holds(q, places), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules) if (q := trigram_query(r.pattern, r.any_case)) is not None]
    mask = reduce(lambda a, b: a + b, bits) if bits else F.lit(0)
    return held.select("key", mask.cast("long").alias("mask")).where("mask > 0")


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in code points: lengths of what lies between matches and of the matches, summed up."""
    if rule.pattern.endswith("+") and rule.group == 0 and rule.least:
        # A run that is too short starts no longer match, so the least length can stand in the pattern.
        body = rule.pattern[:-1]
        fixed = len(body) - len(body[body.rindex("[") :])
        rule = Rule(rule.kind, f"{body}{{{rule.least - fixed},}}", rule.any_case)
    rx = F.lit(rule.java)
    whole, between = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rule.java, -1)
    rows = F.zip_with(whole, F.slice(between, F.lit(1), F.size(whole)), lambda m, s: F.struct(F.length(s).alias("gap"), F.length(m).alias("size")))
    if rule.group:
        rows = F.zip_with(rows, F.regexp_extract_all(text, rx, F.lit(rule.group)), lambda r, g: F.struct(r["gap"].alias("gap"), r["size"].alias("size"), F.length(g).alias("part")))
    else:
        rows = F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["size"].alias("size"), r["size"].alias("part")))
    before = lambda v: sums_before(F.transform(v, lambda r: r["gap"] + r["size"]))
    span = lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["size"]).alias("end"), r["part"].alias("part"))
    spans = bind(rows, lambda v: F.zip_with(v, before(v), span))
    none = F.array().cast("array<struct<start:int,end:int,part:int>>")
    return F.when(text.rlike(rule.java), F.filter(spans, lambda s: s["part"] >= rule.least)).otherwise(none)


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _with_spans(docs: DataFrame, text_col: str, out: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with out: array<struct<start, rank, end>> of all rules' matches, by start, then rule."""
    key, mask, other = (fresh(docs, n) for n in ("lacuna_key", "lacuna_mask", "lacuna_other"))
    keyed = docs.withColumn(key, F.xxhash64(*(F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema)))
    index = build_index(keyed.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), rules)
    found = candidates(index, rules).select(F.col("key").alias(other), F.col("mask").alias(mask))
    joined = keyed.join(found, F.col(key) == F.col(other), "left")
    text, empty = F.coalesce(F.col(text_col), F.lit("")), F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        ranked = _ranked(matches(text, rule), i)
        scan = trigram_query(rule.pattern, rule.any_case) is None
        parts.append(ranked if scan else F.when(F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, ranked).otherwise(empty))
    return joined.withColumn(out, F.array_sort(F.concat(*parts))).drop(key, mask, other)


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end>> by start, then kind as listed."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.transform("found", lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return _with_spans(source, "text", "found", rules).select("doc_id", spans.alias("spans"))


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]", length_col: str = "n_chars") -> DataFrame:
    """docs with each stretch of secrets in the text replaced by mark; length_col, if docs has it, follows the new text."""
    found = fresh(docs, "lacuna_found")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]  # runs on from the span before
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    clean = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = _with_spans(docs, text_col, found, rules).withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text)).drop(found)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(text.isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*(f"`{c}`" for c in docs.columns))


def secret_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found, base = scan_documents(docs), [r.kind for r in BASE_RULES]
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
