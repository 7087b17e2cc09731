"""The whole audit: documents against a checklist, a candidate and a verdict for each applicable field, gaps with a place.

Sentences are split within each subsection, the methods window and the document, and scored for all fields in one
projection; only sentences that bear on a field are shuffled, as spans, once, and are reduced on the map side. The text is
shuffled once, to meet its subsections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import triggers as G
from lacuna.functions import verdicts as V
from lacuna.functions.headings import CATEGORIES, category_hits
from lacuna.functions.rules import rule_frame, trigger_by, verdict_by
from lacuna.functions.text import SENTENCE_BREAK, finding_id, sentences, strip, substantive
from lacuna.operators.calls import Budget, Factory, Retry
from lacuna.operators.copies import once_a_text
from lacuna.operators.model import choose_nodes
from lacuna.operators.profile import study_profiles
from lacuna.operators.retrieve import applicable, holds_keyword, keyword_score
from lacuna.operators.sections import listed, node_of, subsections
from lacuna.plans.pack import STARTER, VERSION, Field, pack_frame
from lacuna.sources.shared import written

METHODS, DOCUMENT = -1, -2
_OF_DOCUMENT = ("text_sha", "features", "nodes")
#: What is kept of a title in an anchor's detector; the keyword score in the methods from which no model is asked.
TITLE_WIDTH, CONFIDENT = 34, 2


#: Why a candidate, or the lack of one, is a gap, where no trigger says so.
REASONS = {
    "GAP_ABSENT": "nothing states the field",
    "GAP_RANGE_NOT_POINT": "a range stands where one value is needed",
    "GAP_OUT_OF_RANGE": "every stated value is outside the plausible range",
    "GAP_DIMENSION_MISMATCH": "a value of another dimension is stated",
    "GAP_UNPARSEABLE": "the field's type or dimension can't be read",
}


def _category(f: Field) -> str:
    return f.field_id.split(".")[0]


def scopes(profiled: DataFrame, pack: tuple[Field, ...], once: bool = False) -> DataFrame:
    """doc_id, text_sha, features, scope, header, start, end, scope_text, nodes, cats: subsections, the methods window and the document of each text.

    nodes: struct, for each category of the checklist, of the subsection where its fields should stand. cats: the
    checklist's categories that the header has a word of. once: with twice, whether the methods window is the whole document,
    whose row then stands for both.
    """
    subs = subsections(profiled).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sub_idx", "header", "start", "end"))).alias("subs"))
    docs = profiled.select("doc_id", "text_sha", "features", "canonical_text", "m_start", "m_end").join(subs, "doc_id", "left")
    none = F.array().cast("array<struct<sub_idx:int,header:string,start:int,end:int>>")
    docs = docs.withColumn("subs", F.coalesce("subs", none))
    docs = docs.withColumn("nodes", F.struct(*(node_of(F.col("subs"), c).alias(c) for c in sorted({_category(f) for f in pack}))))
    part = lambda i, name, a, b: F.struct(F.lit(i).alias("sub_idx"), F.lit(name).alias("header"), a.alias("start"), b.alias("end"))
    methods, document = part(METHODS, "methods", F.col("m_start"), F.col("m_end")), part(DOCUMENT, "document", F.lit(0), F.length("canonical_text"))
    same = F.lit(once) & (F.col("m_start") == 0) & (F.col("m_end") == F.length("canonical_text"))
    every = F.concat("subs", F.when(same, F.array(methods)).otherwise(F.array(methods, document)))
    more = ["twice"] if once else []
    docs = docs.where("canonical_text is not null").withColumn("twice", same)
    rows = docs.select("doc_id", "text_sha", "features", "canonical_text", "nodes", F.explode(every).alias("s"), *more)
    body = F.substring(F.col("canonical_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    named = F.array_compact(F.array(*(F.when(category_hits(F.col("s.header"), c) > 0, F.lit(c)) for c in sorted({_category(f) for f in pack} & set(CATEGORIES)))))
    return rows.select("doc_id", "text_sha", "features", F.col("s.sub_idx").alias("scope"), "s.header", "s.start", "s.end", body.alias("scope_text"), "nodes", F.when(F.col("s.sub_idx") >= 0, named).alias("cats"), *((F.col("twice") & (F.col("s.sub_idx") == METHODS)).alias("twice") for _ in more))


def _first_good(text: Column) -> Column:
    """The number of a text's first substantive sentence, -1 without one; mostly it is 0, which the first sentence alone tells."""
    good = lambda p: substantive(strip(p))
    return F.when(good(F.split(text, SENTENCE_BREAK, 2)[0]), 0).otherwise(F.array_position(F.transform(F.split(text, SENTENCE_BREAK, -1), good), True) - 1)


def _bearing(profiled: DataFrame, pack: tuple[Field, ...], lexicon: G.Lexicon = G.STARTER_LEXICON) -> DataFrame:
    """doc_id, field_id (null: the heads of scopes), obs, anchor, head: the least option of each kind; and what the document carries."""
    parts = scopes(profiled, pack, once=True)
    rows = sentences(parts.withColumn("first_good", _first_good(F.col("scope_text"))), "scope_text", F.col("start")).drop("scope_text", "start", "end")
    inner, whole, of_document = F.col("scope") >= 0, F.col("scope") == METHODS, (F.col("scope") == DOCUMENT) | F.col("twice")
    rows = rows.withColumn("low", F.lower("sentence")).withColumn("vague", F.when(whole, G.vague_terms(F.col("sentence"), lexicon)))
    # a sentence without any keyword and vague term bears on no field, whatever the fields are
    keyed = holds_keyword(F.col("low"), pack)
    rows = rows.withColumn("scores", F.when(keyed, F.array(*(keyword_score(F.col("low"), f) for f in pack))))
    option = lambda name, scope, score, tier, level: F.struct(F.lit(name).cast("string").alias("field_id"), scope.alias("scope"), score.alias("score"), tier.cast("int").alias("tier"), level.cast("int").alias("level"))
    options, none = [], F.lit(None)
    for i, f in enumerate(pack):
        node, score = F.col(f"nodes.{_category(f)}"), F.coalesce(F.col("scores")[i], F.lit(0))
        usable = (score > 0) & V.relevant(F.col("sentence"), f.field_id)
        if f.type == "quantity":
            usable = usable & F.col("sentence").rlike(r"(?U)\d")
        belongs = F.array_contains("cats", _category(f))
        tier = F.when(inner & belongs & usable, 1).when(whole & usable, 2).when(whole & G.names_slot(F.col("vague"), f, lexicon), 3)
        level = F.when(F.col("scope") == node["sub_idx"], 0).when(whole, 1).when(F.col("scope") == DOCUMENT, 2)
        level = F.when((score > 0) & F.col("sentence").rlike(r"(?U)\S"), level)
        options.append(option(f.field_id, F.col("scope"), score, tier, level))
    bears = F.filter(F.array(*options), lambda x: x["tier"].isNotNull() | x["level"].isNotNull())
    # a head is its scope's first substantive sentence; a row of each document, its first sentence's, carries what holds for the document
    heads, carries = F.col("sent_idx") == F.col("first_good"), of_document & (F.col("sent_idx") == 0)
    head = lambda scope: option(None, scope, F.lit(0), none, none)
    empty = F.array().cast("array<struct<field_id:string,scope:int,score:int,tier:int,level:int>>")
    listed = lambda when, xs: F.when(when, xs).otherwise(empty)
    found = F.concat(listed(F.col("scores").isNotNull() | (F.size("vague") > 0), bears), listed(heads & (F.col("scope") != DOCUMENT), F.array(head(F.col("scope")))), listed(of_document & heads | carries, F.array(head(F.lit(DOCUMENT)))))
    flat = rows.withColumn("x", F.explode(found)).drop("vague", "scores", "low", "cats")
    # after the explosion, so that only sentences that count are stripped
    lead = F.length(F.regexp_extract("sentence", r"(?U)^\s*", 0))
    flat = flat.withColumn("body", strip(F.col("sentence"))).withColumn("a_start", F.col("sent_start") + lead).withColumn("good", substantive(F.col("body")))
    flat = flat.select("*", *(F.when(carries & F.col("x.field_id").isNull() & (F.col("x.scope") == DOCUMENT), F.col(c)).alias(f"doc_{c}") for c in _OF_DOCUMENT)).drop(*_OF_DOCUMENT, "sentence", "first_good")
    # what the third tier scores doesn't count: its sentences come in document order
    scored = F.when(F.col("x.tier") == 3, 0).otherwise(-F.col("x.score"))
    obs = F.struct(F.col("x.tier").alias("tier"), scored.alias("s"), "scope", "sent_idx", "sent_start", "sent_end", "header", F.col("body").alias("raw_text"))
    anchor = F.struct(F.col("x.level").alias("level"), (-F.col("x.score")).alias("s"), "sent_idx", F.col("a_start").alias("start"), F.col("body").alias("text"))
    first = F.struct("sent_idx", F.col("a_start").alias("start"), F.col("body").alias("text"))
    # a head's key is its scope; the others' is null
    keyed = flat.withColumn("head_of", F.when(F.col("x.field_id").isNull(), F.col("x.scope")))
    # where the methods are the whole document, what stands in them stands in the document
    level_in = {"in_methods": F.col("x.level") == 1, "in_document": (F.col("x.level") == 2) | F.col("twice") & (F.col("x.level") == 1)}
    return keyed.groupBy("doc_id", F.col("x.field_id").alias("field_id"), "head_of").agg(
        F.min(F.when(F.col("x.tier").isNotNull(), obs)).alias("obs"), F.min(F.when(F.col("x.level").isNotNull(), anchor)).alias("anchor"), *(F.min(F.when(at, anchor)).alias(c) for c, at in level_in.items()), F.min(F.when(F.col("x.field_id").isNull() & F.col("good"), first)).alias("head"),
        *(F.first(f"doc_{c}", ignorenulls=True).alias(c) for c in _OF_DOCUMENT))


def candidates(profiled: DataFrame, pack: tuple[Field, ...] = STARTER) -> DataFrame:
    """doc_id, field_id, detector, raw_text, start, end: the sentence that bears most on each field.

    From the subsections of the field's category, else the methods window, else a sentence there whose vague wording stands
    for the field; within a tier the best keyword score, then document order. Applicability isn't asked for.
    """
    return _observed(_bearing(profiled, pack)).where("field_id is not null and obs is not null").select("doc_id", "field_id", "detector", F.col("obs.raw_text").alias("raw_text"), F.col("obs.sent_start").alias("start"), F.col("obs.sent_end").alias("end"))


def _observed(bearing: DataFrame) -> DataFrame:
    how = F.when(F.col("obs.tier") == 1, F.concat(F.lit("section:"), F.col("obs.header"))).when(F.col("obs.tier") == 2, F.lit("keyword:fallback-whole-methods")).when(F.col("obs.tier") == 3, F.lit("trigger:fills-slot"))
    return bearing.withColumn("detector", how)


def _judged(profiled: DataFrame, pack: tuple[Field, ...], lexicon: G.Lexicon, more: tuple[str, ...] = ()) -> DataFrame:
    """The applicable fields of each document that are absent or unresolved, with their candidate and what an anchor can be made of.

    more: further columns of _bearing to carry.
    """
    bearing = _observed(_bearing(profiled, pack, lexicon))
    kept = ("obs", "anchor", "detector", *more)
    option_of = F.when(F.col("field_id").isNotNull(), F.struct("field_id", F.struct(*kept)))
    head_at = F.when(F.col("field_id").isNull(), F.struct("head_of", "head"))
    # at most one entry for each field and each scope of the document
    whole = bearing.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(option_of)).alias("options"), F.map_from_entries(F.collect_list(head_at)).alias("heads"), *(F.first(c, ignorenulls=True).alias(c) for c in _OF_DOCUMENT))
    spark = profiled.sparkSession
    rows = applicable(whole, pack_frame(spark, pack).join(rule_frame(spark, pack, lexicon), "field_id"), ("sensitivity", "rule", "options", "heads", "text_sha", "nodes"))
    option_here = F.try_element_at("options", F.col("field_id"))
    rows = rows.withColumns({c: option_here[c] for c in kept}).drop("options")
    own_node = F.create_map(*(x for c in sorted({_category(f) for f in pack}) for x in (F.lit(c), F.col(f"nodes.{c}"))))
    rows = rows.withColumn("node", F.element_at(own_node, F.col("rule.category"))).withColumn("raw", F.col("obs.raw_text"))
    rows = rows.withColumn("spans", G.trigger_spans(F.col("raw"), lexicon))
    # Out of a generator, as a filter on plain columns is pushed into the join above, which then judges each row twice; and
    # with all that is carried, as Spark may drop columns that a row has beside a generator whose input has pruned structs.
    judged = {"trigger": trigger_by(F.col("raw"), F.col("rule"), F.col("spans")), "typed": verdict_by(F.col("raw"), F.col("rule"), pack)}
    carried = F.struct(*(c for c in rows.columns if c not in ("rule", "spans", "nodes")), *(x.alias(c) for c, x in judged.items()))
    rows = rows.select(F.explode(F.array(carried)).alias("x")).select("x.*")
    rows = rows.withColumn("verdict", F.when(F.col("trigger").isNotNull(), F.lit("FIELD_UNRESOLVED")).otherwise(F.col("typed.verdict"))).withColumn("code", F.coalesce("trigger.code", "typed.code"))
    rows = rows.where(F.col("verdict").isin("FIELD_ABSENT", "FIELD_UNRESOLVED"))
    head_of = lambda scope: F.try_element_at("heads", scope)
    return rows.withColumns({"node_head": head_of(F.col("node.sub_idx")), "methods_head": head_of(F.lit(METHODS)), "document_head": head_of(F.lit(DOCUMENT))}).drop("heads", "typed")


def _place(keywords: list[tuple[Column, Column]], heads: list[tuple[int, Column]]) -> Column:
    """The first rung that has a sentence: struct<at (even: by keywords, odd: a head; from the node up), start, text>."""
    option = lambda at, hit: F.when(hit.isNotNull(), F.struct(at.alias("at"), hit["start"].alias("start"), hit["text"].alias("text")))
    return F.array_min(F.array_compact(F.array(*(option(at, hit) for at, hit in keywords), *(option(F.lit(at), hit) for at, hit in heads))))


def _anchored(place: Column, title: Column, how: Column) -> Column:
    """What an anchor was found by."""
    name = F.element_at(F.array(F.substring(title, 1, TITLE_WIDTH), F.lit("methods"), F.lit("document")), (F.floor(place["at"] / 2) + 1).cast("int"))
    return F.concat(F.lit("anchor:"), how, F.when(place["at"] % 2 == 0, F.lit(":kw:")).otherwise(F.lit(":head:")), name)


def _told(rows: DataFrame) -> DataFrame:
    """The findings of judged rows with place and anchored, but for their ids; those without a candidate and a place are dropped."""
    rows = rows.withColumn("place", F.when(F.col("obs").isNull(), F.col("place"))).where("obs is not null or place is not null")
    begin, end = F.col("obs.sent_start") + F.col("trigger.low"), F.col("obs.sent_start") + F.col("trigger.high")
    narrowed = F.coalesce((begin < end) & (end <= F.col("obs.sent_end")), F.lit(False))
    rows = rows.withColumn("start", F.when(narrowed, begin).otherwise(F.coalesce("obs.sent_start", "place.start")))
    rows = rows.withColumn("end", F.when(narrowed, end).otherwise(F.coalesce("obs.sent_end", F.col("place.start") + F.length("place.text"))))
    reason = F.when(F.col("trigger").isNotNull(), F.concat(F.lit("'"), F.col("trigger.text"), F.lit("' ("), F.col("trigger.family"), F.lit(") occupies the "), F.col("field_id"), F.lit(" slot without supplying a value"))).otherwise(F.element_at(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair)), F.col("code")))
    phrase = F.when(narrowed, F.substring("raw", F.col("trigger.low") + 1, F.col("trigger.high") - F.col("trigger.low")))
    detail = F.create_map(F.lit("detector"), F.col("detector"), F.lit("anchor_text"), F.col("place.text"), F.lit("anchor_detector"), F.when(F.col("place").isNotNull(), F.col("anchored")))
    return rows.select("doc_id", "field_ordinal", "field_id", "code", "start", "end", "text_sha", "verdict", F.col("raw").alias("raw_text"), "sensitivity", F.map_filter(detail, lambda k, v: v.isNotNull()).alias("detail"), reason.alias("reason"), phrase.alias("phrase"))


def _identified(rows: DataFrame) -> DataFrame:
    """Findings with their ids, which name the document besides its text."""
    name = finding_id(F.col("doc_id"), F.col("text_sha"), F.col("start"), F.col("end"), F.col("field_id"), F.col("code"))
    return rows.select("doc_id", "field_ordinal", name.alias("finding_id"), *rows.columns[2:])


def findings(docs: DataFrame, pack: tuple[Field, ...] = STARTER, lexicon: G.Lexicon = G.STARTER_LEXICON, make: Factory | None = None, path: str | None = None, budget: Budget | None = None, retry: Retry = Retry()) -> DataFrame:
    """The gaps of each document, one at most a field: doc_id, field_ordinal, finding_id, field_id, code, start, end, text_sha, verdict, raw_text, sensitivity, detail, reason, phrase (null unless the span is a trigger's clause).

    docs: doc_id (unique, not null), canonical_text, text_sha. A field without a candidate is absent and anchored at the
    sentence where a reader should look: the field's subsection, the methods window, the document, in each the best keyword
    score, else the first substantive sentence; without any the finding is dropped. Null and empty texts have no findings.
    Equal texts are audited once, and what is found is written before it is given to each of their documents.

    make: a model's client may choose the subsection. It never changes a code, only where absent fields are anchored, and
    isn't asked where the methods window has a sentence of the score CONFIDENT or more. Verdicts are written first; the
    questions of the fields that are left are answered within the budget and are in the cache (at path) before anchors
    are taken from them, so that no lost executor and no second use of the result asks again.
    """
    texts, each = once_a_text(docs)
    profiled = study_profiles(texts)
    if make is not None:
        return _identified(each(written(_told(_with_model(profiled, pack, lexicon, make, path, budget, retry)), "found")))
    place = _place([(2 * F.col("anchor.level"), F.col("anchor"))], [(1, F.col("node_head")), (3, F.col("methods_head")), (5, F.col("document_head"))])
    rows = _judged(profiled, pack, lexicon).withColumn("place", place)
    return _identified(each(written(_told(rows.withColumn("anchored", _anchored(F.col("place"), F.col("node.title"), F.col("node.how")))), "found")))


def _with_model(profiled: DataFrame, pack: tuple[Field, ...], lexicon: G.Lexicon, make: Factory, path: str | None, budget: Budget | None, retry: Retry) -> DataFrame:
    """Judged rows with place and anchored, subsections chosen by a model."""
    rows = written(_judged(profiled, pack, lexicon, ("in_methods", "in_document")), "judged")
    sure = F.coalesce(-F.col("in_methods.s") >= CONFIDENT, F.lit(False))
    unsure = rows.where(F.col("obs").isNull() & ~sure).select("doc_id", "field_id")
    subs = subsections(profiled)
    chosen = written(choose_nodes(listed(profiled, subs), pack, make, path=path, budget=budget, retry=retry, wanted=unsure), "chosen")
    own = _of_subsection(profiled, subs, chosen.where("node is not null"), pack)
    rows = rows.join(chosen.withColumnRenamed("node", "picked").withColumnRenamed("how", "picked_how"), ["doc_id", "field_id"], "left").join(own, ["doc_id", "field_id"], "left")
    rung = lambda i: F.lit(i)
    place = _place([(rung(0), F.col("own_keyword")), (rung(2), F.col("in_methods")), (rung(4), F.col("in_document"))], [(1, F.col("own_head")), (3, F.col("methods_head")), (5, F.col("document_head"))])
    at_once = F.struct(rung(2).alias("at"), F.col("in_methods.start").alias("start"), F.col("in_methods.text").alias("text"))
    rows = rows.withColumn("place", F.when(sure, at_once).otherwise(place))
    spared = F.concat(F.lit("anchor:det-confident(score="), (-F.col("in_methods.s")).cast("string"), F.lit("):no-model-call"))
    return rows.withColumn("anchored", F.when(sure, spared).otherwise(_anchored(F.col("place"), F.col("own_title"), F.col("picked_how"))))


def _of_subsection(profiled: DataFrame, subs: DataFrame, chosen: DataFrame, pack: tuple[Field, ...]) -> DataFrame:
    """doc_id, field_id, own_title, own_keyword, own_head: in the subsection chosen for a field, the sentence of the best keyword score and the first substantive one. Only these subsections are split."""
    asked = chosen.groupBy("doc_id", F.col("node").alias("sub_idx")).agg(F.collect_set("field_id").alias("asked"))
    text = F.substring("canonical_text", F.col("start") + 1, F.col("end") - F.col("start"))
    parts = profiled.select("doc_id", "canonical_text").join(subs.join(asked, ["doc_id", "sub_idx"]), "doc_id").select("doc_id", "header", "start", "asked", text.alias("part"))
    lines = sentences(parts, "part", F.col("start"))
    body, low = strip(F.col("sentence")), F.lower("sentence")
    hit = F.struct("sent_idx", (F.col("sent_start") + F.length(F.regexp_extract("sentence", r"(?U)^\s*", 0))).alias("start"), body.alias("text"))
    scores = F.map_from_entries(F.array(*(F.struct(F.lit(f.field_id), keyword_score(low, f)) for f in pack)))
    flat = lines.where(F.length(body) > 0).select("doc_id", "header", hit.alias("hit"), substantive(body).alias("good"), scores.alias("scores"), F.explode("asked").alias("field_id"))
    score = F.element_at("scores", F.col("field_id"))
    keyword = F.struct((-score).alias("s"), F.col("hit.sent_idx").alias("i"), F.col("hit.start").alias("start"), F.col("hit.text").alias("text"))
    # a text without a sentence has no row here and is looked for further up
    return flat.groupBy("doc_id", "field_id").agg(F.first("header").alias("own_title"), F.min(F.when(score > 0, keyword)).alias("own_keyword"), F.min(F.when(F.col("good"), F.col("hit"))).alias("own_head"))


def reports(docs: DataFrame, pack: tuple[Field, ...] = STARTER, lexicon: G.Lexicon = G.STARTER_LEXICON, version: str = VERSION, **model) -> DataFrame:
    """A row for each document: doc_id, text_sha, field_pack_version, features, evidence and its findings, in the checklist's order. model: make, path, budget and retry of findings()."""
    columns = ["finding_id", "field_id", "code", "start", "end", "verdict", "raw_text", "sensitivity", "detail"]
    found = findings(docs, pack, lexicon, **model)
    told = F.map_concat(F.create_map(F.lit("reason"), F.col("reason"), F.lit("phrase"), F.col("phrase")), F.col("detail"))
    found = found.withColumn("detail", F.map_filter(told, lambda k, v: v.isNotNull())).groupBy("doc_id").agg(F.collect_list(F.struct("field_ordinal", F.struct(*columns).alias("f"))).alias("found"))
    in_order = F.array_sort("found", lambda a, b: a["field_ordinal"] - b["field_ordinal"])
    nested = found.select("doc_id", F.transform(in_order, lambda x: x["f"]).alias("findings"))
    texts, each = once_a_text(docs)
    profiled = each(study_profiles(texts).select("doc_id", "text_sha", "features", "evidence"))
    return profiled.join(nested, "doc_id", "left").select("doc_id", "text_sha", F.lit(version).alias("field_pack_version"), "features", "evidence", F.coalesce("findings", F.array().cast(nested.schema["findings"].dataType)).alias("findings"))


# The codes that each verdict can have; the other verdicts are no findings.
LEGAL = {
    "FIELD_ABSENT": ("GAP_ABSENT",),
    "FIELD_UNRESOLVED": ("GAP_VAGUE", "GAP_UNPARSEABLE", "GAP_DIMENSION_MISMATCH", "GAP_OUT_OF_RANGE", "GAP_RANGE_NOT_POINT", "GAP_DEFERRED_TO_REF", "GAP_DEFERRED_TO_DISPLAY"),
}


def illegal(found: DataFrame) -> DataFrame:
    """The findings whose code doesn't go with their verdict (nulls included) or whose span isn't a forward one."""
    fits = reduce(lambda a, b: a | b, ((F.col("verdict") == v) & F.col("code").isin(*codes) for v, codes in LEGAL.items()))
    return found.where(~F.coalesce(fits & (F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False)))


def document_counts(found: DataFrame, pack_rows: DataFrame) -> DataFrame:
    """doc_id, applicable, findings, absent, unresolved of each document that has an applicable field. pack_rows: as of applicable()."""
    due = pack_rows.groupBy("doc_id").agg(F.count("*").alias("applicable"))
    gaps = found.groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if(F.col("verdict") == "FIELD_ABSENT").alias("absent"), F.count_if(F.col("verdict") == "FIELD_UNRESOLVED").alias("unresolved"))
    return due.join(gaps, "doc_id", "left").fillna(0, ["findings", "absent", "unresolved"])


def verdict_counts(found: DataFrame, pack_rows: DataFrame) -> DataFrame:
    """document_counts with ok, the rest of the applicable fields.

    Absent fields without an anchor have no finding and count as ok; only texts without a substantive sentence have such.
    """
    return document_counts(found, pack_rows).withColumn("ok", F.col("applicable") - F.col("findings"))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The text of a span; null unless it is a forward one inside the text."""
    return F.when((start >= 0) & (end > start) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def acceptance(found: DataFrame, docs: DataFrame, pack: tuple[Field, ...] = STARTER) -> DataFrame:
    """One row of checks that every set of findings must pass: legal, located, within, known, identified, explained, once_a_field; and findings."""
    ids = F.array(*(F.lit(f.field_id) for f in pack))
    rows = found.join(docs.select("doc_id", F.length("canonical_text").alias("n_text")), "doc_id", "left")
    once = Window.partitionBy("doc_id", "field_id")
    rows = rows.withColumn("of_field", F.count("*").over(once))
    legal = reduce(lambda a, b: a | b, ((F.col("verdict") == v) & F.col("code").isin(*codes) for v, codes in LEGAL.items()))
    name = finding_id(F.col("doc_id"), F.col("text_sha"), F.col("start"), F.col("end"), F.col("field_id"), F.col("code"))
    has = lambda key: F.map_contains_key("detail", key)
    checks = {"legal": legal, "located": (F.col("start") >= 0) & (F.col("end") > F.col("start")), "within": F.col("end") <= F.col("n_text"), "known": F.array_contains(ids, F.col("field_id")), "identified": F.col("finding_id") == name, "explained": F.col("reason").isNotNull() & (has("detector") | has("anchor_detector")), "once_a_field": F.col("of_field") == 1}
    return rows.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(n) for n, c in checks.items()), F.count("*").alias("findings"))


def configurations(runs: DataFrame) -> DataFrame:
    """One row: the distinct versions and models that reports were made with, sorted. runs: field_pack_version, model."""
    return runs.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("field_pack_version", "model")))


def scoping_misses(profiled: DataFrame, absent: DataFrame, pack: tuple[Field, ...] = STARTER) -> DataFrame:
    """doc_id, field_id, sentence, start: absent fields that some sentence of the methods window has keywords (and for quantities a digit) of.

    absent: doc_id, field_id. The best sentence by score, the first on ties.
    """
    window = F.substring(F.col("canonical_text"), F.col("m_start") + 1, F.col("m_end") - F.col("m_start"))
    rows = sentences(profiled.select("doc_id", "m_start", window.alias("window")), "window", F.col("m_start")).withColumns({"low": F.lower("sentence"), "digit": F.col("sentence").rlike(r"(?U)\d")})
    hits = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), (F.when(F.col("digit"), keyword_score(F.col("low"), f)).otherwise(0) if f.type == "quantity" else keyword_score(F.col("low"), f)).alias("score")) for f in pack))
    flat = rows.select("doc_id", "sent_idx", "sent_start", "sentence", F.explode(F.when(holds_keyword(F.col("low"), pack), F.filter(hits, lambda x: x["score"] > 0))).alias("x"))
    best = flat.groupBy("doc_id", "x.field_id").agg(F.min(F.struct((-F.col("x.score")).alias("s"), "sent_idx", "sentence", "sent_start")).alias("b"))
    return absent.select("doc_id", "field_id").join(best, ["doc_id", "field_id"]).select("doc_id", "field_id", strip(F.col("b.sentence")).alias("sentence"), F.col("b.sent_start").alias("start"))
