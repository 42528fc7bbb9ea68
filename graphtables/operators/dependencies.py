"""What columns mean and how tables depend on each other, for many tables at once in long form (see `items`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import jaccard, name_tokens, number, plain_integer, stripped, value
from ..sources.shared import saved
from .items import column_types

KINDS = ("primary_key", "foreign_key")
#: Bits of a word in a set of columns, and how many columns of all items are handed to every task.
BITS, FEW = 63, 100_000


def canonical(c: Column) -> Column:
    """A value as it is compared across tables: `4`, `4.0` and ` +4 ` are one, other texts are stripped; missing is null."""

    def other(v: Column) -> Column:
        n = number(v)
        whole = F.regexp_extract(v, r"^[+]?(-?)0*(\d+)$", 0) != ""
        digits = F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
        round_ = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 9e15)
        return F.when(whole, digits).when(round_, n.cast("long").cast("string")).when(n.isNotNull(), n.cast("string")).otherwise(v)

    # the long expression stays out of the code that all plain integers run through
    return F.when(plain_integer(c), c.cast("string")).otherwise(F.get(F.transform(F.array(stripped(value(c))), other), F.lit(0)))


def inclusions(found: DataFrame, least_share: float = 1.0) -> DataFrame:
    """item, table, column, different, to_table, to_column, to_different, shared, unique: column pairs of an item where at
    least this share of the different values of one column occur in the other; 1 means an inclusion dependency.

    One shuffle of different values: every value is grouped into the set of columns that hold it, a bit for each column in
    as many words of 63 bits as the item with most columns needs, so that it is added up on the map side; equal sets are
    counted, and only those are taken apart again, so a set of m columns costs m * m rows once, not once for every value.
    Columns without a value include nothing. `unique` says that no value of the referenced column occurs twice."""
    # a row a column: all columns of an item in one array, and how many cells with a value each has
    counts = saved(found.groupBy("item", "table", "column").agg(F.count(value(F.col("value"))).alias("n")).where("n > 0"), "inclusions-columns")
    names = counts.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("table", "column"))).alias("names"))
    places = names.select("item", F.posexplode("names").alias("at", "name")).select("item", "name.table", "name.column", "at")
    words = 1 + (places.agg(F.max("at")).first()[0] or 0) // BITS
    rows = found.join(F.broadcast(places) if counts.count() <= FEW else places, ["item", "table", "column"])
    rows = rows.select("item", "at", canonical(F.col("value")).alias("v")).where("v IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % BITS)
    masks = [F.bit_or(F.when((F.col("at") / BITS).cast("int") == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    held = [f"w{w}" for w in range(words)]
    sets = rows.groupBy("item", "v").agg(*masks).groupBy("item", *held).agg(F.count("*").alias("n"))
    words_of = F.array(*held)
    inside = lambda name, at: F.getbit(F.element_at(words_of, (at / BITS).cast("int") + 1), at % BITS) == 1
    sets = saved(sets.join(names, "item").select("item", "n", F.filter("names", inside).alias("columns")), "inclusions-sets")
    each = sets.select("item", "n", "columns", F.explode("columns").alias("a"))
    sizes = each.groupBy("item", "a").agg(F.sum("n").alias("different")).select("item", F.col("a.table").alias("table"), F.col("a.column").alias("column"), "different")
    sizes = sizes.join(counts, ["item", "table", "column"]).select("item", "table", "column", "different", (F.col("n") == F.col("different")).alias("unique"))
    shared = each.select("item", "n", "a", F.explode("columns").alias("b")).where("a <> b").groupBy("item", "a", "b").agg(F.sum("n").alias("shared"))
    pairs = shared.select("item", F.col("a.table").alias("table"), F.col("a.column").alias("column"), F.col("b.table").alias("to_table"), F.col("b.column").alias("to_column"), "shared")
    to = sizes.toDF("item", "to_table", "to_column", "to_different", "unique")
    out = pairs.join(sizes.drop("unique"), ["item", "table", "column"]).join(to, ["item", "to_table", "to_column"])
    return out.where(F.col("shared") >= F.col("different") * least_share).select("item", "table", "column", "different", "to_table", "to_column", "to_different", "shared", "unique")


def likely_references(candidates: DataFrame) -> DataFrame:
    """item, table, column, to_table, to_column: for each column the unique column of another table that includes it and
    is named most like it; of equally named ones the smallest, then the first by name. A column whose name shares no
    word with any such column refers to none."""
    words = lambda table, column: F.array_union(name_tokens(F.col(table)), name_tokens(F.col(column)))
    alike = jaccard(name_tokens(F.col("column")), words("to_table", "to_column"))
    first = F.min_by(F.struct("to_table", "to_column"), F.struct(-F.col("alike"), "to_different", "to_table", "to_column"))
    scored = candidates.where(F.col("unique") & (F.col("table") != F.col("to_table"))).withColumn("alike", alike).where("alike > 0")
    return scored.groupBy("item", "table", "column").agg(first.alias("to")).select("item", "table", "column", "to.*")


def understood(found: DataFrame, proposed: DataFrame | None = None, samples: int = 3, seed: int = 42) -> DataFrame:
    """item, table, column, place, description, semantic_type, identifier_kind, type, n, nulls, samples: every column of
    every table exactly once, whatever was proposed.

    proposed: item, table, column, description, semantic_type, identifier_kind, names in any case; a column that it lacks,
    or leaves blank, is `categorical` without a kind, of two proposals for a column the one with the longer description
    counts, and columns that the table does not have are dropped. samples: different values by a seeded hash."""
    columns = found.groupBy("item", "table", "column").agg(F.min("place").alias("place"))
    drawn = found.select("item", "table", "column", value(F.col("value")).alias("v")).where("v IS NOT NULL")
    digest = F.md5(F.concat_ws(":", F.lit(seed), "table", "column", "v").cast("binary"))
    order = Window.partitionBy("item", "table", "column").orderBy(digest, F.col("v"))
    # the least hashes of 64 parts of a column's values are of 64 different values, so those beyond the last of the first
    # ones are no samples; only the others are told apart and ranked, a few for each column
    lead = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    marked = drawn.withColumn("_lead", lead)
    parts = marked.groupBy("item", "table", "column", F.pmod(F.xxhash64("v"), F.lit(max(64, 4 * samples))).alias("_part")).agg(F.min("_lead").alias("_lead"))
    most = parts.groupBy("item", "table", "column").agg(F.sort_array(F.collect_list("_lead")).alias("_leads")).select("item", "table", "column", F.coalesce(F.try_element_at("_leads", F.lit(samples)), F.lit(2**63 - 1)).alias("_most"))
    most = saved(most, "samples-bounds")
    drawn = marked.join(F.broadcast(most) if most.count() <= FEW else most, ["item", "table", "column"]).where("_lead <= _most").select("item", "table", "column", "v").distinct()
    drawn = drawn.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= samples)
    values = drawn.groupBy("item", "table", "column").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]).alias("samples"))
    out = columns.join(column_types(found), ["item", "table", "column"]).join(values, ["item", "table", "column"], "left")
    if proposed is None:
        out = out.select("*", *(F.lit(None).cast("string").alias(c) for c in ("description", "semantic_type", "identifier_kind")))
    else:
        words = F.struct(*(F.trim(c).alias(c) for c in ("description", "semantic_type", "identifier_kind")))
        best = proposed.groupBy("item", F.lower("table").alias("_table"), F.lower("column").alias("_column")).agg(F.max_by(words, F.struct(F.length("description"), words)).alias("p"))
        out = out.withColumns({"_table": F.lower("table"), "_column": F.lower("column")}).join(best, ["item", "_table", "_column"], "left").select(*out.columns, "p.*")
    kind = F.lower("identifier_kind")
    return out.select(
        "item",
        "table",
        "column",
        "place",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(value(F.col("semantic_type")), F.lit("categorical")).alias("semantic_type"),
        F.when(kind.isin(*KINDS), kind).otherwise("").alias("identifier_kind"),
        "type",
        "n",
        "nulls",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def checked_references(declared: DataFrame, columns: DataFrame) -> DataFrame:
    """item, table, column, to_table, to_column, problem: declared references in the tables' own spelling; problem is null
    where all three names exist, else it says which one does not (column, to_table or to_column).

    declared: item, table, column, to_table, to_column; columns: item, table, column of all tables."""
    known = columns.select("item", F.lower("table").alias("_t"), F.lower("column").alias("_c"), F.col("table").alias("_table"), F.col("column").alias("_column")).distinct()
    tables = known.groupBy("item", "_t").agg(F.min("_table").alias("_known"))
    d = declared.withColumns({"t": F.lower("table"), "c": F.lower("column"), "u": F.lower("to_table"), "k": F.lower("to_column")})
    d = d.join(known.toDF("item", "t", "c", "own_table", "own"), ["item", "t", "c"], "left").join(tables.toDF("item", "u", "far_table"), ["item", "u"], "left")
    d = d.join(known.toDF("item", "u", "k", "far", "far_column"), ["item", "u", "k"], "left")
    problem = F.when(F.col("own").isNull(), "column").when(F.col("far_table").isNull(), "to_table").when(F.col("far_column").isNull(), "to_column")
    spelt = lambda own, given: F.coalesce(F.col(own), F.col(given)).alias(given)
    return d.select("item", spelt("own_table", "table"), spelt("own", "column"), spelt("far_table", "to_table"), spelt("far_column", "to_column"), problem.alias("problem"))


def target_kinds(references: DataFrame, meanings: DataFrame, clusters: DataFrame) -> DataFrame:
    """item, table, column, to_table, to_column, kind of what a reference points at: primary_key, foreign_key, descriptive or
    unknown. A target that its table's rows do not identify is still a primary key where it is part of the key of the
    first cluster that has it. meanings: as `understood`; clusters: item, table, cluster (ordered by `place`), column, keyed."""
    low = lambda df, *names: df.withColumns({f"_{n}": F.lower(n) for n in names})
    known = low(meanings, "table", "column").select("item", F.col("_table").alias("_to_table"), F.col("_column").alias("_to_column"), F.col("identifier_kind").alias("own"))
    first = low(clusters, "table", "column").groupBy("item", F.col("_table").alias("_to_table"), F.col("_column").alias("_to_column")).agg(F.min_by("keyed", "place").alias("keyed"))
    out = low(references, "to_table", "to_column").join(known, ["item", "_to_table", "_to_column"], "left").join(first, ["item", "_to_table", "_to_column"], "left")
    kind = F.when(F.col("own").isNull(), "unknown").when(F.col("own").isin(*KINDS), F.col("own")).when(F.col("keyed"), "primary_key").otherwise("descriptive")
    return out.select("item", "table", "column", "to_table", "to_column", kind.alias("kind"))
