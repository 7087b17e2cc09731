"""Document fingerprints by winnowing, in DataFrame functions alone.

All overlapping k-grams of code points are hashed; of each window of w hashes the least one is chosen, the rightmost
among equals, and a hash chosen by several windows is kept once, with its position. Any common passage of at least
w + k - 1 code points thus shares a fingerprint, and none shorter than k does.

A hash and its position share one long, hash above and position (counted down) below, so that the least long of a window
is the least hash and, among equals, the rightmost. Window minima come by growing reach: minima over 4, then 16 ..
hashes each take one pass, so w is a power of two.

Cases: null texts count as empty; an empty text has no prints and is alike (1.0) to an empty one only; a text shorter
than k is its own one gram, and fewer than w grams make one window; equal texts have equal prints; texts over 2**27 - 1
code points are an error; ids may be of any type that can be ordered; ties and repeated rows are ordered by a hash of the
text; null ids come last; an empty table gives an empty result; other columns are not carried.

A gram's hash is made from the gram alone, as sliding one hash along a text isn't possible in parallel array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import WindowSpec

GRAM, WINDOW = 8, 16
_POSITION_BITS = 27
_LAST = (1 << _POSITION_BITS) - 1
#: Ranges of ids that neighbours are found in for each shuffle partition, and in all at most (their bounds are one row that is broadcast).
RANGES_EACH, MAX_RANGES = 4, 1 << 16


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of longs, in text order: (hash << 27) + (2**27 - 1 - position)."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    # A search goes on at the second half of a surrogate pair too, which starts no gram.
    grams = F.when(F.length(text) > _LAST, F.raise_error(F.lit(f"a text of over {_LAST} code points"))).when(F.length(text) > gram, F.regexp_extract_all(text, F.lit(f"(?s)(?=(\\P{{Cs}}.{{{gram - 1}}}))"), F.lit(1))).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    least = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 64 - 36), _POSITION_BITS) + (F.lit(_LAST) - i))
    reach, shift = window, 1
    while reach > 1:
        ways = 4 if reach % 4 == 0 else 2
        least = bind(least, _spread(shift, ways))
        reach, shift = reach // ways, shift * ways
    full = F.greatest(F.length(text) - (gram + window - 2), F.lit(1))
    return F.array_distinct(F.slice(least, F.lit(1), full))


def _spread(shift: int, ways: int) -> Callable[[Column], Column]:
    """Each element with those shift, 2 shift .. places on: the least of them; none beyond the end."""
    return lambda v: F.transform(v, lambda x, i: F.least(x, *(F.get(v, i + F.lit(k * shift)) for k in range(1, ways))))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: F.shiftright(p, _POSITION_BITS)))


def positions(prints: Column) -> Column:
    return F.transform(prints, lambda p: F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST)))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two hash sets; 1.0 for two empty ones."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions (parallel arrays) of the prints of each text."""
    prints = docs.select(F.col(id_col).alias("doc_id"), winnow(F.coalesce(F.col(text_col), F.lit("")), gram, window).alias("prints"))
    return prints.select("doc_id", F.transform("prints", lambda p: F.shiftright(p, _POSITION_BITS)).alias("hashes"), positions(F.col("prints")).alias("positions"))


def range_bounds(source: DataFrame, ranges: int) -> DataFrame:
    """One row: bounds, sorted, that cut the values of o into about equal ranges; from quantiles, or where values aren't numbers from the 20 a range that come first by hash."""
    kind = source.schema["o"].dataType
    if isinstance(kind, NumericType):
        cuts = source.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"))
    else:
        some = source.select("o").where("o is not null").orderBy(F.xxhash64("o")).limit(20 * ranges)
        listed = some.agg(F.array_sort(F.collect_list("o")).alias("q"))
        step = F.greatest(F.floor(F.size("q") / ranges).cast("int"), F.lit(1))
        cuts = listed.select(F.filter(F.transform("q", lambda x, i: F.when(i % step == step - 1, x)), lambda x: x.isNotNull()).alias("q"))
    cuts = cuts.select(F.array_sort(F.array_distinct(F.coalesce("q", F.array().cast(f"array<{kind.simpleString()}>")))).alias("bounds"))
    # Read once: quantiles may come out otherwise when they are computed again, and all uses must agree.
    return source.sparkSession.createDataFrame([tuple(cuts.first())], cuts.schema)


def below(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds, 2 * MAX_RANGES - 1 at most, are less than value, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(MAX_RANGES.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def in_ranges(docs: DataFrame, order_col: str, text_col: str) -> tuple[DataFrame, WindowSpec]:
    """(o, text, r, h, copy; a window) for the next row in descending order, the first row's after the last.

    Rows are cut into ranges of the order, each sorted on its own; the first row of a range is copied to the end of the
    range before it, so no window spans the table. Range bounds are quantiles, so a range's size follows the data.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(order_col).alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = min(MAX_RANGES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = F.array_size("bounds")
    place = last - below(F.col("bounds"), F.col("o"))
    source = source.crossJoin(F.broadcast(range_bounds(source, ranges)))
    # 0: the highest ids; one more range for null ids.
    placed = source.withColumn("r", F.when(F.col("o").isNull(), last + 1).otherwise(place)).withColumn("h", F.xxhash64("text")).drop("bounds")
    heads = placed.select("o", "r", "h").groupBy("r").agg(F.max(F.struct("o", "h")).alias("head"))
    turn = Window.orderBy("r")  # one row a range
    heads = heads.select("r", F.col("head.o").alias("o"), F.col("head.h").alias("h"), F.lag("r").over(turn).alias("before"), F.max("r").over(Window.partitionBy()).alias("end"))
    heads = heads.select("r", "o", "h", F.coalesce("before", "end").alias("goes")).withColumnsRenamed({"r": "hr", "o": "ho", "h": "hh"})
    copies = placed.join(F.broadcast(heads), F.col("o").eqNullSafe(F.col("ho")) & (F.col("h") == F.col("hh")) & (F.col("r") == F.col("hr"))).select("o", "text", F.col("goes").alias("r"), "h", F.lit(True).alias("copy"))
    rows = placed.select("o", "text", "r", "h", F.lit(False).alias("copy")).union(copies)
    ahead = Window.partitionBy("r").orderBy("copy", F.col("o").desc(), F.col("h").desc())
    return rows, ahead


def edited_likeness_query(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_prints."""
    rows, ahead = in_ranges(docs, "doc_id", "text")
    place = ["o", "r", "h", "copy"]
    pairs = rows.withColumn("next_text", F.coalesce(F.lead("text").over(ahead), F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    swap = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - swap).cast("int")), F.substring("next_text", F.lit(1), swap))
    texts = pairs.select(*place, "n_chars", "text", edited.alias("edited"))
    prints = texts.select(*place, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("text"), gram, window).alias("own"), winnow(F.col("edited"), gram, window).alias("changed"))
    # Rows still lie and are sorted as the first window had them, so the second needs no exchange and no sort.
    three = prints.withColumns({f"{c}_hashes": hashes(F.col(c)) for c in ("own", "changed")})
    three = three.withColumn("after_hashes", F.lead("own_hashes").over(ahead)).where(~F.col("copy")).withColumnRenamed("o", "doc_id")
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda p: F.hex(p)), ",").cast("binary"), 256)
    return three.select(
        "doc_id", "n_chars", "edited_sha256", digest("own").alias("fingerprint"), digest("changed").alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("changed_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("after_hashes")).alias("near_next"), F.size("own").cast("long").alias("n_prints"),
    )
