"""An optional model that chooses among a document's subsections. It gives back a number; code decides all else.

The client is any object with complete(prompt, max_tokens=...) -> str, made on each worker by a factory, so that nothing but
the factory is sent. Without a factory the choice is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.headings import CATEGORIES, category_hits
from lacuna.functions.text import strip
from lacuna.operators import cache
from lacuna.operators.calls import Budget, Client, Factory, Retry, ask_once  # noqa: F401
from lacuna.operators.copies import once_a_list
from lacuna.plans.pack import Field
from lacuna.sources.shared import new_path, written

#: Options in a prompt and characters of a snippet, at most; tokens of an answer.
MOST_OPTIONS, SNIPPET, ANSWER_TOKENS = 24, 160, 512
# The prompt's frame, whose bytes are the cache's keys.
PROMPT = """The detail below is NOT stated anywhere in this methods section. Say where a reader would have expected to find it.

{field}

Parts of the methods section:
0. the methods section as a whole -- choose this if no part below is clearly the right place
{parts}

Reply with the number only."""


def describe(f: Field) -> str:
    """What the checklist says of a field, a line for each entry that it has (fixed format)."""
    cited = ", ".join(f"{dict(p).get('guideline', '?')} item {dict(p).get('item', '?')}" for p in f.provenance)
    entries = {
        "Detail": f.field_id.replace(".", " ").replace("_", " "),
        "Field id": f.field_id,
        "Kind": f.type,
        "Quantity of": f.dimension and f.dimension + (f", normally reported in {f.canonical_unit}" if f.canonical_unit else ""),
        "Expected one of": ", ".join(f.enum_values),
        "Required by": cited,
        "Note": " ".join(f.description.split()),
    }
    return "\n".join(f"{k}: {v}" for k, v in entries.items() if v)


def snippet(body: Column) -> Column:
    """The body's first words, on one line, cut after a word."""
    flat = strip(F.regexp_replace(body, r"(?U)\s+", " "))
    cut = F.substring(flat, 1, SNIPPET)
    return F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"), F.lit(" ...")))


def parts_block(options: Column) -> Column:
    """The options' lines of a prompt, the same for all fields of a document; options: array<struct<title, body>>, of which the first MOST_OPTIONS are offered."""

    def line(x: Column, i: Column) -> Column:
        begins = F.transform(F.array(snippet(x["body"])), lambda s: F.when(F.length(s) > 0, F.concat(F.lit("\n   "), s)).otherwise(""))[0]
        return F.concat((i + 1).cast("string"), F.lit(". "), x["title"], begins)

    return F.array_join(F.transform(F.slice(options, 1, MOST_OPTIONS), line), "\n")


def _frame(f: Field) -> list[str]:
    return PROMPT.format(field=describe(f), parts="\0").split("\0")


def prompt(f: Field, options: Column) -> Column:
    """The question for one field."""
    head, tail = _frame(f)
    return F.concat(F.lit(head), parts_block(options), F.lit(tail))


def prompts(pack: tuple[Field, ...], field_id: Column, block: Column) -> Column:
    """The question for the row's own field, around its document's options."""
    heads = F.create_map(*(F.lit(x) for f in pack for x in (f.field_id, _frame(f)[0])))
    return F.concat(F.element_at(heads, field_id), block, F.lit(_frame(pack[0])[1]))


def parse_index(response: Column, n: Column) -> Column:
    """From the first integer in the response: -1 for 0 (the whole section), i - 1 for 1 to n, else null."""
    value = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?U)(\d+)", 1).try_cast("decimal(38,0)")
    return F.when(value == 0, F.lit(-1)).when((value >= 1) & (value <= n), (value - 1).cast("int"))


def ask(requests: DataFrame, make: Factory, old: DataFrame | None = None, max_tokens: int = ANSWER_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(requests with response and hit, the new entries key, response). requests: prompt and other columns.

    Known prompts cost nothing, and equal ones one call. A call that fails gives no response and no entry.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", cache.cache_key(F.col("prompt"), F.lit(max_tokens)))
    old = spark.createDataFrame([], cache.SCHEMA) if old is None else old
    missing = keyed.select("key", "prompt").dropDuplicates(["key"]).join(old, "key", "anti")

    def calls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for part in parts:
            responses = []
            for text in part["prompt"]:
                try:
                    responses.append(client.complete(text, max_tokens=max_tokens))
                except Exception:  # the deterministic choice stands in
                    responses.append(None)
            yield pd.DataFrame({"key": part["key"], "response": pd.Series(responses, dtype=object)})

    # Written out by the caller (cache.save) before it is used twice; else calls are repeated when partitions are lost.
    new = missing.mapInPandas(calls, cache.SCHEMA).where("response is not null")
    known = cache.upsert(old, new)
    return cache.lookup(keyed, known).drop("key"), new


def ranked_nodes(titles: Column, category: str) -> Column:
    """array<struct<n, i>>: places of the titles that hold a word of the category, by falling number of words, then place."""
    if category not in CATEGORIES:
        return F.array().cast("array<struct<n:int,i:int>>")
    return F.array_sort(F.filter(F.transform(titles, lambda t, i: F.struct((-category_hits(t, category)).alias("n"), i.alias("i"))), lambda x: x["n"] < 0))


def choose_nodes(subs: DataFrame, pack: tuple[Field, ...], make: Factory | None = None, old: DataFrame | None = None, path: str | None = None, budget: Budget | None = None, retry: Retry = Retry(), wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, field_id, node (place among the document's subsections; null: none is better than the whole), how.

    subs: doc_id and titles, bodies (arrays, in document order). wanted: doc_id, field_id of the rows to choose for (all
    without it). Fewer than two subsections, or one with the category's words, are no choice and cost no call; else the
    model decides if there is one, and its answer falls back to the first ranked subsection where it fails, can't be read
    or is refused for the budget. Answers are in the cache (at path; old holds further entries) before they are used, so
    nothing that is computed again asks again. Without wanted, documents whose questions are equal are worked on once.
    """
    size = F.size("titles")
    listed, each = subs.select("doc_id", "titles", "bodies"), None
    if make is not None:
        listed = listed.withColumn("block", parts_block(F.arrays_zip(F.col("titles").alias("title"), F.col("bodies").alias("body"))))
        if wanted is None:
            listed, each = once_a_list(listed)
    of_field = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), ranked_nodes(F.col("titles"), f.field_id.split(".")[0]).alias("ranked")) for f in pack))
    if wanted is not None:
        mine = wanted.groupBy("doc_id").agg(F.collect_set("field_id").alias("_mine"))
        listed = listed.join(mine, "doc_id")
        of_field = F.filter(of_field, lambda x: F.array_contains("_mine", x["field_id"]))
    rows = listed.withColumn("x", F.explode(of_field)).select("doc_id", "titles", *(["block"] if make is not None else []), "x.*")
    n, best = F.size("ranked"), F.try_element_at("ranked", F.lit(1))["i"]
    plain = F.when(size == 0, F.lit("node:no-subsections")).when(size == 1, F.lit("node:only-one")).when(n == 1, F.lit("node:det-unique"))
    node = F.when(size == 1, F.lit(0)).otherwise(best)
    if make is None:
        how = F.coalesce(plain, F.when(n > 1, F.concat(F.lit("node:det-first-of-"), n.cast("string"))), F.lit("node:det-none"))
        return rows.select("doc_id", "field_id", node.alias("node"), how.alias("how"))
    offered = F.least(size, F.lit(MOST_OPTIONS))
    open_rows = rows.where(plain.isNull()).select("doc_id", "field_id", "ranked", offered.alias("offered"), prompts(pack, F.col("field_id"), F.col("block")).alias("prompt"))
    if old is not None:
        path = path or new_path(subs.sparkSession, "responses")
        cache.save(old.select("key", "response"), path)
    answered = ask_once(open_rows, make, path, ANSWER_TOKENS, budget, retry)[0]
    index = parse_index(F.col("response"), F.col("offered"))
    how = F.when(F.col("response").isNull(), F.when(n > 0, F.lit("node:model-error-fellback")).otherwise(F.lit("node:model-error"))).when(index.isNull(), F.lit("node:model-unparsed"))
    how = how.when(index < 0, F.lit("node:model-whole-section")).otherwise(F.concat(F.lit("node:model-"), (index + 1).cast("string"), F.lit("of"), F.col("offered").cast("string")))
    chosen = answered.select("doc_id", "field_id", F.when(index.isNull(), best).when(index >= 0, index).alias("node"), how.alias("how"))
    told = rows.where(plain.isNotNull()).select("doc_id", "field_id", node.alias("node"), plain.alias("how")).unionByName(chosen)
    return told if each is None else each(written(told, "told"))


def usage(calls: DataFrame, budget: int = 100_000, estimate: int = 500, warn_at: float = 0.75, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """One row: calls, input_tokens, output_tokens, total, share of the budget, warned, refused (another call of the estimated size would pass the budget), cost (null without prices a million tokens)."""
    sums = calls.agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))
    total = F.col("input_tokens") + F.col("output_tokens")
    cost = F.lit(None).cast("double") if price_in is None or price_out is None else F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out
    return sums.select("*", total.alias("total"), (total / budget).alias("share"), (total >= warn_at * budget).alias("warned"), (total + estimate > budget).alias("refused"), cost.alias("cost"))


#: Words that say nothing of a field.
_COMMON = "with from that this were which field value used using must should their there than then have been does each such also into when will note candidate designation equivalent provide given".split()


def word_overlap(wanted: Column, titles: Column) -> Column:
    """Place of the title that shares most words of four letters or more with a text, the first on ties; null without titles. A floor for real models."""
    words = lambda c: F.array_except(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)), F.array(*map(F.lit, _COMMON)))
    scored = F.transform(titles, lambda t, i: F.struct((-F.size(F.array_intersect(words(wanted), words(t)))).alias("n"), i.alias("i")))
    return F.array_min(scored)["i"]
