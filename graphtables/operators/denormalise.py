"""Denormalised tables from column sources: each relation and each far entity is joined once, however many columns use it.

A source is `entity.T.a`, `source.T.a` or `target.T.a` (a field of the row's own entity, or of its edge's ends),
`relation.R.a` (a field of an edge) or `relation.R.target.T.a` / `relation.R.source.T.a` (a field of the entity at the
edge's far end). Of a relation that the table does not expand, an entity shows its first edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """A parsed column source; `relation` edges lead to an entity if `direction` is set."""

    prefix: str
    field: str
    kind: str | None = None
    relation: str | None = None
    direction: str | None = None


def parsed(text: str) -> Source:
    parts = text.split(".")
    if parts[0] in ("entity", "source", "target") and len(parts) == 3:
        return Source(parts[0], parts[2], kind=parts[1])
    if parts[0] == "relation" and len(parts) == 3:
        return Source("relation", parts[2], relation=parts[1])
    if parts[0] == "relation" and len(parts) == 5 and parts[2] in ("source", "target"):
        return Source("relation", parts[4], kind=parts[3], relation=parts[1], direction=parts[2])
    raise ValueError(f"unknown column source {text}")


def first_edges(edges: DataFrame, near: str, far: str, fields: list[str], order: str) -> DataFrame:
    """One edge for each entity at `near`, the first by `order`: _at, _far and the fields."""
    return edges.groupBy(F.col(near).alias("_at")).agg(F.min_by(F.struct(F.col(far).alias("_far"), *fields), F.struct(order, far)).alias("_e")).select("_at", "_e.*")


def entity_table(entities: dict[str, DataFrame], relations: dict[str, DataFrame], base: str, columns: dict[str, str], expand: str | None = None, order: str = "place", types: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each entity of the base type, or for each of its outgoing edges of the expanded relation (one row with
    nulls without any). entities: id and fields; relations: src, dst, fields and the `order` of their edges; types: the
    types at a relation's two ends, needed where ids of different types may be equal."""
    return _compiled(entities, relations, entities[base].withColumnRenamed("id", "_id"), base, columns, expand, order, types or {})


def relation_table(entities: dict[str, DataFrame], relations: dict[str, DataFrame], base: str, columns: dict[str, str], order: str = "place", types: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each edge of the base relation; `source.*`, `target.*` and `entity.*` (its source) come from its ends."""
    edges = relations[base]
    rows = edges.select(F.col("src").alias("_id"), F.col("dst").alias("_dst"), F.struct(*[c for c in edges.columns if c not in ("src", "dst")] or [F.lit(None).alias("_none")]).alias("_edge"))
    return _compiled(entities, relations, rows, None, columns, base, order, types or {})


def _compiled(entities, relations, rows, base, columns, expand, order, types) -> DataFrame:
    sources = {name: parsed(text) for name, text in columns.items()}
    for s in sources.values():
        if s.relation and s.relation not in relations:
            raise ValueError(f"unknown relation {s.relation}")
        if s.kind and s.kind not in entities and s.direction:
            raise ValueError(f"unknown type {s.kind}")
    known = set(rows.columns)
    own = base or types.get(expand, (None,))[0]
    if base and expand:
        edges = relations[expand]
        held = F.struct(*[c for c in edges.columns if c not in ("src", "dst")] or [F.lit(None).alias("_none")])
        rows = rows.join(edges.select(F.col("src").alias("_id"), F.col("dst").alias("_dst"), held.alias("_edge")), "_id", "left")
    out = {}

    def looked_up(rows: DataFrame, at: str, kind: str, fields: set[str], prefix: str) -> DataFrame:
        """The fields of a type joined once at a column of ids; an id of another type gives nulls."""
        have = set(entities[kind].columns)
        return rows.join(entities[kind].select(F.col("id").alias(at), *(F.col(f).alias(f"{prefix}{f}") for f in sorted(fields & have) if f != "id")), at, "left")

    def shown(kind: str, field: str, at: str, prefix: str):
        if field == "id":
            return F.col(at)
        return F.col(f"{prefix}{field}") if field in entities[kind].columns else F.lit(None).cast("string")

    # fields of the row's own entity, and of the ends of its edge
    for prefix, at in (("source", "_id"), ("entity", "_id"), ("target", "_dst")):
        of = {n: s for n, s in sources.items() if s.prefix == prefix}
        for kind in sorted({s.kind for s in of.values()}):
            mine = {n: s for n, s in of.items() if s.kind == kind}
            if prefix == "target" and not expand:
                out |= {n: F.lit(None).cast("string") for n in mine}
                continue
            if base is not None and prefix != "target":  # the entity is at hand
                out |= {n: F.col("_id") if s.field == "id" else F.col(s.field) if s.field in known else F.lit(None).cast("string") for n, s in mine.items()}
                continue
            tag = f"_{prefix}_{kind}_"
            rows = looked_up(rows, at, kind, {s.field for s in mine.values()}, tag)
            out |= {n: shown(kind, s.field, at, tag) for n, s in mine.items()}
    # relations: the row's own edge, or the first one of its entity
    for relation in sorted({s.relation for s in sources.values() if s.relation}):
        mine = {n: s for n, s in sources.items() if s.relation == relation}
        edges = relations[relation]
        plain = {n: s for n, s in mine.items() if s.direction is None}
        if relation == expand:
            for n, s in plain.items():
                out[n] = F.col(f"_edge.{s.field}") if s.field in edges.columns and s.field not in ("src", "dst") else F.lit(None).cast("string")
            for direction, at in (("target", "_dst"), ("source", "_id")):
                for kind in sorted({s.kind for s in mine.values() if s.direction == direction}):
                    fields = {n: s for n, s in mine.items() if s.direction == direction and s.kind == kind}
                    tag = f"_{relation}_{direction}_{kind}_"
                    rows = looked_up(rows.withColumn(f"{tag}at", F.when(F.col("_dst").isNotNull(), F.col(at))), f"{tag}at", kind, {s.field for s in fields.values()}, tag)
                    out |= {n: shown(kind, s.field, f"{tag}at", tag) for n, s in fields.items()}
            continue
        props = sorted({s.field for s in plain.values() if s.field in edges.columns and s.field not in ("src", "dst")})
        asked = {s.direction for s in mine.values()}
        # a field of the edge itself is looked for from both ends, but for an end of another type
        both = {d for d, kind in zip(("target", "source"), types.get(relation, (own, own))) if kind == own} if plain else set()
        for direction, near, far in (("target", "src", "dst"), ("source", "dst", "src")):
            if direction in asked | both:
                tag = f"_{relation}_{direction}_"
                first = first_edges(edges, near, far, props if direction in both else [], order)
                rows = rows.join(first.select(F.col("_at").alias("_id"), F.col("_far").alias(f"{tag}far"), *(F.col(p).alias(f"{tag}{p}") for p in (props if direction in both else []))), "_id", "left")
                for kind in sorted({s.kind for s in mine.values() if s.direction == direction}):
                    fields = {n: s for n, s in mine.items() if s.direction == direction and s.kind == kind}
                    rows = looked_up(rows, f"{tag}far", kind, {s.field for s in fields.values()}, f"{tag}{kind}_")
                    out |= {n: shown(kind, s.field, f"{tag}far", f"{tag}{kind}_") for n, s in fields.items()}
        for n, s in plain.items():  # as a source first, else as a target
            if s.field not in props or not both:
                out[n] = F.lit(None).cast("string")
                continue
            there, here = (F.col(f"_{relation}_{d}_{s.field}") if d in both else None for d in ("target", "source"))
            found = F.col(f"_{relation}_target_far").isNotNull() if there is not None else None
            out[n] = here if there is None else there if here is None else F.when(found, there).otherwise(here)
    return rows.select(*(out[n].alias(n) for n in columns))
