"""Benchmark decontamination on templates.

A text becomes a sequence of template words: numbers, units after numbers and names give way to
typed placeholders, every other word is lower-cased. Windows of template words of the documents
meet those of the benchmark in a hash join; each meeting fixes how an item would lie in the document.
There the two are compared word by word, and the values behind the placeholders must map onto each
other one to one: a question asked anew with other numbers keeps its template and changes its
values consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.sources.sinks import stage

#: Share of an item's template words that must agree, and agreeing plain words that make values free.
SHARE, PLAIN = 0.8, 5
#: Benchmark windows, and candidate places, that are sent to every task; more are met by a join.
SENT = 200_000
#: Marks of the typed placeholders (private characters), and of the ends of the values they keep.
NUMBER, UNIT, NAME, NAME_END, NUMBER_END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: A name: a capital behind a blank that neither a line nor a sentence starts before.
NAME_PATTERN = r"\p{Lu}(?<=[^.!?:\s][ \t]\p{Lu})[\p{L}\p{N}]*"
NUMBER_PATTERN = r"\d(?:[\d.,]*\d)?(?![\p{L}\p{N}]*\ue003)"
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters",
    "metre", "metres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound",
    "pounds", "ton", "tons", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec",
    "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "mph",
    "kmh", "degrees", "celsius", "kelvin", "volt", "volts", "watt", "watts", "joule", "joules", "newton", "newtons",
]
UNIT_PATTERN = rf"\s*({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
BETWEEN = r"[^\p{L}\p{N}\ue000-\ue002]+"
MARKED = r"[\ue000-\ue002][^\ue003\ue004]*[\ue003\ue004]|[\p{L}\p{N}]+"


def _template(text: Column) -> Column:
    """Template words of a text, by passes over the text as a whole."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_PATTERN, f" {NAME} ")
    numbers = F.regexp_replace(text, NUMBER_PATTERN, f" {NUMBER} ")
    units = F.regexp_replace(numbers, f"(?i)({NUMBER} ){UNIT_PATTERN}", f"$1{UNIT} ")
    text = F.when(text.rlike(r"\d"), units).otherwise(text)
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _words(text: Column) -> Column:
    """The same words, with the value behind each placeholder."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_PATTERN, f" {NAME}$0{NAME_END} ")
    text = F.regexp_replace(text, NUMBER_PATTERN, f" {NUMBER}$0{NUMBER_END} ")
    text = F.regexp_replace(text, f"(?i)({NUMBER_END} ){UNIT_PATTERN}", f"$1{UNIT}$2{NAME_END} ")
    return F.regexp_extract_all(F.lower(text), F.lit(MARKED), F.lit(0))


def _kind(word: Column) -> Column:
    mark = F.substring(word, 1, 1)
    return F.when(mark.isin(NUMBER, UNIT, NAME), mark).otherwise(word)


def _run(n: Column) -> Column:
    """Agreeing words in a row that an item of ``n`` words has wherever its others are (1 to 4)."""
    need = F.ceil(n * SHARE)
    return F.ceil(need / (n - need + 1)).cast("int")


def _windows(hashes: str, size: int) -> Column:
    """Place and hash of each window of ``size`` template words, from the words' hashes."""
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    rest = lambda i: [F.get(hashes, i + k) for k in range(1, size)]
    return F.transform(firsts, lambda h, i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), h, *rest(i)).alias("h")))


def _hashes(template: Column) -> Column:
    return F.transform(template, lambda w: F.xxhash64(w))


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.where("item_id IS NOT NULL").select(
        "item_id", _words(F.col("text")).alias("item_words"), _template(F.col("text")).alias("item")
    )
    return rows.where(F.size("item") > 0).distinct()


def _agreement(found: DataFrame) -> DataFrame:
    """Compares ``words``, a text's from word ``first`` on, with ``item_words`` at ``start``."""
    place = F.col("start") - F.col("first")
    at = lambda p: F.when(p + place >= 0, F.get("words", p + place))
    places = F.sequence(F.lit(0), F.size("item_words") - 1)
    same = F.filter(places, lambda p: F.coalesce(_kind(at(p)) == _kind(F.get("item_words", p)), F.lit(False)))
    found = found.withColumn("same", same)
    slots = F.filter("same", lambda p: _kind(F.get("item_words", p)).isin(NUMBER, UNIT, NAME))
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(
        F.get("item_words", p).alias("asked"), at(p).alias("found")
    )))
    found = found.withColumn("slots", F.size(slots)).withColumn("pairs", pairs)
    side = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda x: x[name])))
    changed = F.size(F.filter("pairs", lambda x: x["asked"] != x["found"]))
    return found.select(
        "doc_id", "item_id", "start", F.size("same").alias("n_same"), F.size("item_words").alias("n_words"),
        changed.alias("n_changed"),
        ((side("asked") == F.size("pairs")) & (side("found") == F.size("pairs"))).alias("consistent"),
        ((F.size("same") - F.col("slots") >= PLAIN) | (changed == 0)).alias("enough"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n_same, n_words, n_changed`` of each benchmark item in each document.

    An item is in a document if, at some place (``start``, in words), a share of ``SHARE`` of its
    template words agree and the values of the agreeing placeholders map one to one; with fewer
    than ``PLAIN`` agreeing plain words the values must be equal. ``n_changed`` counts the values that
    differ. Of several places the one with the most agreeing words counts, then the first.

    Every place of that kind is met: of an item's words so many agree that some run of them (``_run``)
    does, and windows of that length are taken at every word of a document. Null and empty texts, and
    items without words, meet nothing; null ids are left out; repeated rows give the same pairs once;
    other columns are ignored; no documents or no items give no rows. The benchmark's windows go to
    every task only if they are few.
    """
    items = stage(_items(benchmark))
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", _hashes(_template(F.col("text"))).alias("doc"))
    sizes = sorted(r["size"] for r in items.select(_run(F.size("item")).alias("size")).distinct().collect())
    if not sizes:
        rows, sizes = rows.limit(0), [1]
    asked = None
    for size in sizes:
        mine = items.where(_run(F.size("item")) == size)
        mine = mine.select("item_id", _hashes(F.col("item")).alias("item"))
        mine = mine.select("item_id", F.size("item").alias("n"), F.explode(_windows("item", size)).alias("w"))
        asked = mine if asked is None else asked.union(mine)
    asked = stage(asked.select("item_id", "n", F.col("w.at").alias("item_at"), "w.h").distinct())
    if asked.count() <= SENT:
        asked = F.broadcast(asked)
    held = rows.select("doc_id", F.explode(F.concat(*[_windows("doc", size) for size in sizes])).alias("w"))
    held = held.select("doc_id", F.col("w.at").alias("at"), "w.h")
    met = held.join(asked, "h").select("doc_id", "item_id", "n", (F.col("at") - F.col("item_at")).alias("start"))
    met = stage(met.distinct())
    places = met.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "start")).alias("places"))
    if met.count() <= SENT:
        places = F.broadcast(places)
    # Only documents that met an item are read word by word, and only what lies at its places goes on.
    suspects = docs.join(places, "doc_id").select("doc_id", "places", _words(F.col("text")).alias("words"))
    cut = F.transform("places", lambda p: F.struct(
        p["item_id"].alias("item_id"), p["start"].alias("start"), F.greatest(p["start"], F.lit(0)).alias("first"),
        F.slice("words", F.greatest(p["start"], F.lit(0)) + 1, p["n"]).alias("words"),
    ))
    suspects = suspects.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*")
    found = _agreement(suspects.join(items.drop("item"), "item_id"))
    found = found.where((F.col("n_same") >= SHARE * F.col("n_words")) & F.col("consistent") & F.col("enough"))
    best = F.max(F.struct("n_same", (-F.col("start")).alias("back"), "n_words", (-F.col("n_changed")).alias("kept")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.n_same", "b.n_words", (-F.col("b.kept")).alias("n_changed")
    )
