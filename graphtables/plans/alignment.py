"""How alike names, descriptions and properties are, and which known property a new one means, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations, words for an identifier, and words that say little.
ABBREVIATIONS = {"dept": "department", "dpt": "department", "stu": "student", "stud": "student", "addr": "address", "loc": "location", "desc": "description", "dob": "birth", "yob": "birth", "tel": "telephone", "phone": "telephone", "mob": "mobile", "amt": "amount", "yrs": "years"}
IDENTIFIERS = "id ids identifier nr no num number nbr key code ref reference".split()
STOP = "a an the of for and or to in on at is are was were be been this that these those each every per with which what who has have had by as from its it".split()
#: Weights of names, columns, descriptions and samples, and the least score that aligns.
WEIGHTS = (0.35, 0.30, 0.20, 0.15)
LEAST = 0.5


def cut_words(c: Column) -> Column:
    """Lower-case words of a name or text, cut at case changes (`studentID` is student, id) and non-alphanumerics."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(F.regexp_replace(cut, r"[^a-zA-Z0-9]+", " ")), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(STOP))


def words(c: Column) -> Column:
    """Words with abbreviations written out."""
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.transform(cut_words(c), lambda t: F.coalesce(F.try_element_at(known, t), t))


def name_words(c: Column) -> Column:
    """As `words`; all words for an identifier are one."""
    return F.transform(words(c), lambda t: F.when(t.isin(IDENTIFIERS), "identifier").otherwise(t))


def snake(c: Column) -> Column:
    """An identifier in snake case; acronyms are words: `HTTPServer` is http_server."""
    cut = F.regexp_replace(F.regexp_replace(c.cast("string"), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(F.lower(F.regexp_replace(cut, r"[^a-zA-Z0-9]+", "_")), r"^_+|_+$", "")


def without_table(c: Column, table: Column) -> Column:
    """A name in snake case without the words of its table in front, unless nothing would be left."""
    own, drop = words(c), words(table)
    first = F.array_position(F.transform(own, lambda t: ~F.array_contains(drop, t)), True)
    return F.when(first > 0, F.array_join(F.slice(own, first.cast("int"), F.size(own)), "_")).otherwise(snake(c))


def _matches(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (F.startswith(a, b) | F.startswith(b, a)))


def similarity_of_words(a: Column, b: Column) -> Column:
    """Each word of a takes the first word of b that is left and equal, or begins alike with three letters at least; the
    share of words taken in the shorter side, to four digits; 0 if a side is empty."""

    def take(state: Column, t: Column) -> Column:
        left = state["left"]
        at = F.array_position(F.transform(left, lambda u: _matches(t, u)), True).cast("int")
        rest = F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0))), F.slice(left, at + 1, F.size(left)))
        return F.when(at > 0, F.struct(rest.alias("left"), (state["hits"] + 1).alias("hits"))).otherwise(state)

    hits = F.aggregate(a, F.struct(b.alias("left"), F.lit(0).alias("hits")), take, lambda s: s["hits"])
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter > 0, F.round(F.least(F.lit(1.0), hits / shorter), 4)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; an empty side is like nothing."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _prepared(properties: DataFrame, mark: str) -> DataFrame:
    none = F.array().cast("array<string>")
    columns, samples = F.coalesce("columns", none), F.coalesce("samples", none)
    out = properties.select(
        "item",
        F.col("name").alias(f"{mark}name"),
        F.col("place").alias(f"{mark}place"),
        name_words(F.col("name")).alias(f"{mark}own"),
        F.transform(columns, name_words).alias(f"{mark}columns"),
        words(F.col("description")).alias(f"{mark}words"),
        samples.alias(f"{mark}samples"),
    )
    tagged = lambda tag, array: F.transform(array, lambda t: F.concat(F.lit(tag), F.left(t, F.lit(3))))
    return out.withColumn(f"{mark}blocks", F.array_distinct(F.concat(tagged("n", F.col(f"{mark}own")), tagged("c", F.flatten(f"{mark}columns")))))


def scored_pairs(new: DataFrame, known: DataFrame) -> DataFrame:
    """item, name, known, place, score of every pair of properties of an item that can reach half of the weights.

    Both: item, name, place, columns, description, samples. Words that match begin with the same three letters, and a pair
    without a matching word in its names or its columns scores 0.35 at most, so pairs are formed within such blocks."""
    a, b = _prepared(new, "a_"), _prepared(known, "b_")
    pairs = a.select("item", "a_name", F.explode("a_blocks").alias("block")).join(b.select("item", "b_name", F.explode("b_blocks").alias("block")), ["item", "block"]).select("item", "a_name", "b_name").distinct()
    both = pairs.join(a, ["item", "a_name"]).join(b, ["item", "b_name"])
    column = F.array_max(F.transform("a_columns", lambda x: F.array_max(F.transform("b_columns", lambda y: similarity_of_words(x, y)))))
    parts = (similarity_of_words(F.col("a_own"), F.col("b_own")), F.coalesce(column, F.lit(0.0)), F.round(overlap(F.col("a_words"), F.col("b_words")), 4), overlap(F.col("a_samples"), F.col("b_samples")))
    score = sum((F.lit(w) * p for w, p in zip(WEIGHTS, parts)), F.lit(0.0))
    return both.select("item", F.col("a_name").alias("name"), F.col("b_name").alias("known"), F.col("b_place").alias("place"), F.round(score, 4).alias("score"))


def property_alignment(new: DataFrame, known: DataFrame) -> DataFrame:
    """item, name, aligned, score: the known property that each new one means, else null; names of an item are different.

    A name that is known already, in any case, stays as it is known; a new property marked `role` (all its columns are
    foreign keys) is never aligned by score. Of equal scores the known property at the least place wins."""
    taken = known.select("item", F.lower("name").alias("_low"), F.col("name").alias("_same"))
    best = scored_pairs(new, known).where(F.col("score") >= LEAST).groupBy("item", "name").agg(F.min_by(F.struct("known", "score"), F.struct(-F.col("score"), "place")).alias("best"))
    out = new.select("item", "name", "role").withColumn("_low", F.lower("name")).join(taken, ["item", "_low"], "left").join(best, ["item", "name"], "left")
    by_score = F.when(~F.coalesce("role", F.lit(False)), F.col("best"))
    return out.select("item", "name", F.coalesce("_same", by_score["known"]).alias("aligned"), F.when(F.col("_same").isNull(), by_score["score"]).alias("score"))
