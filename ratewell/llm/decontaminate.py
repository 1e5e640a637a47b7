"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers (also as words), names (capitalised words inside a sentence) and units are replaced by
typed placeholders, everything else is lower-cased words.  A number with its sign, decimals and thousands is one placeholder,
and so are up to ``NAMES`` words of one name.  Items and documents give every window of ``WIDTH`` template words, so
any run of ``WIDTH`` they share meets one.  Windows are hashes of word codes and join as such; words are looked up again
only for the places that met.  Along each copy (item and shift of the places) a slot
value of the item must always stand for the same value in the document; copies with contradicting slots are no copies.

Windows of fewer than ``LITERALS`` words that are no placeholders (dense ones) say little as templates: they join by
the hash of their own words, values included, so a run of numbers counts where the document has the same numbers.

A document leaks an item when its windows cover half of the item's template, or 15 words of it, or half of the
windows that join as templates, if these are at least ``PLAIN`` (a dense item with other values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import bounded_broadcast, cut, texts

#: Words in a window; words that are one name when they follow each other.
WIDTH, NAMES = 6, 4
#: Words in a window that must be no placeholders to join as a template; windows a run needs to count by itself.
LITERALS, RUN = 3, 10
#: Least windows that join as templates for their share alone to tell an item.
PLAIN = 3
#: Words taken as units of measure, time or money.
UNITS = ("kg", "km", "cm", "mm", "mg", "ml", "lb", "lbs", "oz", "mph", "kmh", "kwh", "kw", "ghz", "mhz", "gb", "mb", "usd", "eur",
         "gbp", "percent", "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "foot", "feet", "yard", "yards",
         "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "ounce", "ounces", "liter", "liters", "litre",
         "litres", "gallon", "gallons", "pint", "pints", "cup", "cups", "acre", "acres", "hectare", "hectares", "degree", "degrees",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "dollar", "dollars", "euro", "euros", "cent", "cents", "pound", "pounds", "rupee", "rupees", "yen")
#: Words taken as numbers.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
                "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
                "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen")


#: A word that starts with a letter; a name; a number with sign, decimals, thousands and the letters that follow; any
#: other word.  Possessive, so long texts need no stack; frequent characters first in each class.
_W = r"[a-z0-9\p{L}\p{M}\p{N}]"
_NAME = rf"\x01{_W}++(?:-{_W}++)*+"
TOKEN = rf"[a-z\p{{L}}\p{{M}}]{_W}*+|{_NAME}(?: {_NAME}){{0,{NAMES - 1}}}+|(?:(?<!{_W})[-+])?(?:(?<!{_W})\.)?(?<!{_W})[0-9]++(?:[.,][0-9]++)*+{_W}*+|{_W}++"


def raw_words(text: Column) -> Column:
    """Lower-cased words in order; names carry a leading U+0001, numbers may have a leading sign or point."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\x01\u2212", " -")
    marked = F.regexp_replace(clean, r" (?<=[a-z\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})", " \x01")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def kind(word: Column) -> Column:
    """0 for a plain word, 1 for a name, 2 for a number, 3 for a unit.

    Signs, point and digits are the characters from ``+`` to ``9`` that a word can start with; letters come behind.
    """
    return (F.when(word < ":", F.when(word >= "+", 2).when(word.startswith("\x01"), 1).otherwise(0))
            .when(word.isin(*UNITS, *NUMBER_WORDS), F.when(word.isin(*UNITS), 3).otherwise(2)).otherwise(0))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, pos, hash, dense): every window of the words of ``total`` words, as numbers only.

    Each word is hashed once; in templates the kind of a placeholder stands for its hash.
    """
    words = rows.where(F.size("words") >= WIDTH).select(*keys, F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("own"), kind(w).alias("kind"))).alias("codes"))
    own = words.select(*keys, F.transform("codes", lambda c: c["own"]).alias("own"),
                       F.transform("codes", lambda c: F.when(c["kind"] == 0, c["own"]).otherwise(c["kind"].cast("long"))).alias("form"),
                       F.transform("codes", lambda c: F.when(c["kind"] == 0, 0).otherwise(1)).alias("hole"))

    def at(column: str, i: Column) -> list[Column]:
        return [F.get(F.col(column), i + k) for k in range(WIDTH)]

    def window(i: Column) -> Column:
        holes = at("hole", i)
        dense = sum(holes[1:], holes[0]) > WIDTH - LITERALS
        return F.struct((i + 1).alias("pos"), F.when(dense, F.xxhash64(F.lit(True), *at("own", i))).otherwise(F.xxhash64(*at("form", i))).alias("hash"), dense.alias("dense"))

    every = F.transform(F.sequence(F.lit(0), F.size("own") - WIDTH), window)
    return own.select(*keys, F.size("own").alias("total"), F.explode(every).alias("w")).select(*keys, "total", "w.pos", "w.hash", "w.dense")


def _slots(words: str, pos: Column) -> Column:
    """Values of the placeholders in the window from ``pos`` on."""
    return F.filter(F.slice(words, pos, F.lit(WIDTH)), lambda w: kind(w) > 0)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item it holds: ``doc_id``, ``item_id``, ``windows``, ``coverage``, ``slots``.

    ``windows`` counts the item's places met, ``coverage`` is their share of the item, or of its places that join as
    templates if that is more (0 to 1), ``slots`` the values put into its placeholders.  Null and empty texts hold nothing; items of fewer than ``WIDTH`` template
    words are too short to tell.  Rows with one ``doc_id`` are one document, repeated items one item; rows without
    id are left out.  Either table may be empty.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    lower = items.select("item_id", F.lower("text").alias("text"))  # for copies whose capitals are gone
    worded = items.unionAll(lower).distinct().select("item_id", raw_words(F.col("text")).alias("words")).distinct().withColumn("version", F.xxhash64("words"))
    index = _windows(worded, "item_id", "version").withColumnRenamed("pos", "item_pos")
    plain = F.when(~F.col("dense"), F.col("item_pos"))
    sizes = index.groupBy("item_id", "total").agg(F.count_distinct(plain).alias("n_plain"))
    index = index.join(sizes, ["item_id", "total"])
    docs = texts(docs).where("doc_id is not null").withColumn("copy", F.xxhash64("text"))
    split = docs.select("doc_id", "copy", raw_words(F.col("text")).alias("words"))
    met = cut(_windows(split, "doc_id", "copy").drop("total", "dense").join(bounded_broadcast(index), "hash")
              .select("doc_id", "copy", "pos", "item_id", "version", "item_pos", "total", "n_plain", "dense"))
    # the words of the places that met; each text is looked through once, whatever it holds
    places = met.groupBy("doc_id", "copy").agg(F.collect_set("pos").alias("places"))
    few = docs.join(bounded_broadcast(met.select("doc_id", "copy").distinct()), ["doc_id", "copy"], "left_semi")
    found = few.dropDuplicates(["doc_id", "copy"]).join(places, ["doc_id", "copy"]).select("doc_id", "copy", "places", raw_words(F.col("text")).alias("words"))
    values = found.select("doc_id", "copy", F.explode(F.transform("places", lambda i: F.struct(i.alias("pos"), _slots("words", i).alias("slots")))).alias("p")).select("doc_id", "copy", "p.*")
    used = met.select("item_id", "version", "item_pos").distinct()
    item_values = used.join(worded, ["item_id", "version"]).select("item_id", "version", "item_pos", _slots("words", F.col("item_pos")).alias("item_slots"))
    met = met.join(values, ["doc_id", "copy", "pos"]).join(bounded_broadcast(item_values), ["item_id", "version", "item_pos"])
    pairs = F.when((F.size("slots") > 0) & (F.size("item_slots") > 0), F.arrays_zip("item_slots", "slots"))
    copies = (met.groupBy("doc_id", "copy", "item_id", "total", "n_plain", (F.col("pos") - F.col("item_pos")).alias("shift"))
              .agg(F.collect_set("item_pos").alias("places"), F.collect_set(plain).alias("plain"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("filled")))
    consistent = F.size(F.array_distinct(F.transform("filled", lambda p: p["item_slots"]))) == F.size("filled")
    found = (copies.where(consistent).groupBy("doc_id", "item_id", "total", "n_plain")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("windows"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("plain")))).alias("plain"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("filled")))).cast("long").alias("slots")))
    coverage = F.greatest(F.col("windows") / (F.col("total") - (WIDTH - 1)), F.when(F.col("n_plain") >= PLAIN, F.col("plain") / F.col("n_plain")))
    best = F.max(F.struct("coverage", "windows", "slots")).alias("best")  # texts of one item that differ in length
    return (found.withColumn("coverage", coverage).where((F.col("coverage") >= 0.5) | (F.col("windows") >= RUN))
            .groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.windows", "best.coverage", "best.slots"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows without ``doc_id`` stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")
