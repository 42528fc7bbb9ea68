"""From raw tables to a property graph: declared or guessed clusters, their validation, and the build.

A proposal names clusters (entities within a table), their keys, and relations between clusters of one table. The
functions here check and complete proposals on the driver, where they are a few names; all rows stay in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import identifier
from ..operators.edges import anchored, same_table_edges
from ..operators.entities import Cluster, fragments, rekeyed, resolved
from ..operators.keys import repaired_key
from .graph import Edge, PropertyGraph


@dataclass(frozen=True)
class Proposal:
    """A cluster of one table: its class, key and further columns."""

    table: str
    name: str
    entity: str
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    table: str
    source: str
    target: str
    label: str
    columns: tuple[str, ...] = ()


@dataclass
class Schema:
    clusters: list[Proposal] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)
    references: list[tuple[str, str, str, str]] = field(default_factory=list)  # table, column, referenced table and column


def coverage(table: str, header: Sequence[str], clusters: Sequence[Proposal], relations: Sequence[Relation] = ()) -> list[str]:
    """Columns that no cluster or relation takes, that two take, or that the table lacks; names match in any case."""
    known, taken = {c.lower() for c in header}, {}
    for part in [*(c for c in clusters if c.table == table), *(r for r in relations if r.table == table)]:
        for c in {x.lower() for x in part.columns}:
            taken.setdefault(c, []).append(part)
    keyed = {c.lower() for p in clusters if p.table == table for c in p.key}
    issues = [f"{table}: unknown column {c}" for c in sorted((set(taken) | keyed) - known)]
    issues += [f"{table}: column {c} is taken {len(p)} times" for c, p in sorted(taken.items()) if len(p) > 1]
    return issues + [f"{table}: column {c} is in no cluster" for c in sorted(known - set(taken) - keyed)]


def checked(schema: Schema, headers: dict[str, Sequence[str]]) -> Schema:
    """A schema whose relations run between two different clusters of their own table, with labels that are unique
    for each pair of classes; what is dropped or renamed is listed in `issues`."""
    out = Schema(list(schema.clusters), references=sound_references(schema.references, headers) if headers else list(schema.references))
    place = {(c.table, c.name): c for c in schema.clusters}
    if len(place) < len(schema.clusters):
        raise ValueError("two clusters of a table share a name")
    for table, header in headers.items():
        out.issues += coverage(table, header, schema.clusters, schema.relations)
    seen, labels = set(), {}
    for r in schema.relations:
        a, b = place.get((r.table, r.source)), place.get((r.table, r.target))
        if not a or not b or a == b or r.label.lower() in ("", "none"):
            out.issues.append(f"{r.table}: relation {r.label} from {r.source} to {r.target} is dropped")
            continue
        if (key := (r.table, r.source, r.target, r.label.lower())) in seen:
            continue
        seen.add(key)
        ends, label, n = (a.entity, b.entity), r.label, 1
        while labels.setdefault(label.lower(), ends) != ends:
            tries = (f"{r.label}_{b.entity}", f"{r.label}_{a.entity}_{b.entity}")
            label, n = (tries[n - 1] if n <= 2 else f"{tries[1]}_{n}"), n + 1
        if label != r.label:
            out.issues.append(f"{r.table}: relation {r.label} is renamed {label}")
        out.relations.append(replace(r, label=label))
    return out


def guessed(table: str, rows: DataFrame, sample: float = 1.0) -> Schema:
    """A proposal from names and counts: a column that ends in id, key, no, code or ref starts a cluster of those
    that share its first word; the first of them is the row's own, related to each other one."""
    marks = re.compile(r"^(.*?)[_ ]?(id|key|no|code|ref|number)$", re.I)
    stems = {c: m[1].lower() or table for c in rows.columns if (m := marks.match(c))}
    first = next(iter(stems), None)
    clusters = []
    for key, stem in stems.items():
        short = stem.split("_")[-1]
        own = [c for c in rows.columns if c not in stems and c.lower().startswith(stem)]
        if key == first:
            own += [c for c in rows.columns if c not in stems and not any(c.lower().startswith(s) for s in stems.values())]
        clusters.append(Proposal(table, short, short.capitalize(), (key,), tuple(dict.fromkeys(own))))
    relations = [Relation(table, clusters[0].name, c.name, f"has_{c.name}") for c in clusters[1:]] if clusters else []
    return Schema(clusters, relations)


def secondary_key(cluster: Proposal, schema: Schema, tables: dict[str, DataFrame]) -> tuple[str, str, str] | None:
    """The referenced table, its column and its key, where a cluster's key is a foreign key to a column that is a key
    of another cluster but not the one of the class: its rows are named by a secondary key."""
    if len(cluster.key) != 1:
        return None
    own = next((c for c in schema.clusters if c.entity == cluster.entity), cluster)
    for table, column, to, referenced in schema.references:
        if table != cluster.table or column.lower() != cluster.key[0].lower():
            continue
        keyed = any(c.table == to and referenced.lower() in (k.lower() for k in c.key) for c in schema.clusters)
        known = {c.lower(): c for c in tables[to].columns} if to in tables else {}
        if to == table or not keyed or len(own.key) != 1 or own.key[0].lower() == referenced.lower() or not {own.key[0].lower(), referenced.lower()} <= set(known):
            return None
        return to, known[referenced.lower()], known[own.key[0].lower()]
    return None


def built(tables: dict[str, DataFrame], order: dict[str, str], schema: Schema, repair: bool = True) -> PropertyGraph:
    """Entities of all clusters resolved by class, and an edge for each row that names both ends of a relation.

    order: for each table a column that places its rows, for the first value present. A key that its columns
    contradict is repaired first, and edges then use the repaired keys. A cluster keyed by a foreign key to a secondary
    key of its class gets the primary keys, in entities and in edges."""
    keys, secondary = {}, {}
    for c in schema.clusters:
        rows = tables[c.table]
        properties = [x for x in c.columns if x not in c.key]
        secondary[(c.table, c.name)] = secondary_key(c, schema, tables)
        keys[(c.table, c.name)] = repaired_key(rows.select(*c.key, *properties), list(c.key), properties) if repair and properties else list(c.key)

    def with_primary_keys(found: DataFrame, cluster: Proposal, on: str) -> DataFrame:
        to = secondary[(cluster.table, cluster.name)]
        return rekeyed(found, tables[to[0]], to[1], to[2], order[to[0]], on) if to else found

    parts: dict[str, list[DataFrame]] = {}
    for k, c in enumerate(schema.clusters):
        cluster = Cluster(c.table, c.name, keys[(c.table, c.name)], {x.lower(): [x] for x in (*c.key, *c.columns)})
        found = fragments(tables[c.table], cluster, F.col(order[c.table]), (list(tables).index(c.table), k))
        parts.setdefault(c.entity, []).append(with_primary_keys(found, c, "id"))
    nodes = {entity: resolved(found) for entity, found in parts.items()}
    place, edges = {(c.table, c.name): c for c in schema.clusters}, {}
    for r in schema.relations:
        a, b = place[(r.table, r.source)], place[(r.table, r.target)]
        rows = same_table_edges(tables[r.table], keys[(r.table, r.source)], keys[(r.table, r.target)], {c.lower(): c for c in r.columns})
        rows = with_primary_keys(with_primary_keys(rows, a, "src"), b, "dst").distinct()
        rows = edges[r.label].rows.unionByName(rows, allowMissingColumns=True).distinct() if r.label in edges else rows
        edges[r.label] = Edge(rows, a.entity, b.entity)
    return PropertyGraph(nodes, {n: Edge(anchored(e.rows, nodes[e.source], nodes[e.target]), e.source, e.target) for n, e in edges.items()})


def key_kind(table: str, column: str, keys: dict[str, Sequence[str]], references: Sequence[tuple[str, str, str, str]]) -> str:
    """What a column is: primary_key, foreign_key, descriptive, or unknown where the table has no declared key.

    references: (table, column, referenced table, referenced column)."""
    low = column.lower()
    if low in (k.lower() for k in keys.get(table, ())):
        return "primary_key"
    if any(t == table and c.lower() == low for t, c, _, _ in references):
        return "foreign_key"
    return "descriptive" if table in keys else "unknown"


def sound_references(references: Sequence[tuple[str, str, str, str]], headers: dict[str, Sequence[str]]) -> list[tuple[str, str, str, str]]:
    """References whose tables and columns exist, in the tables' own spelling."""
    tables, out = {t.lower(): t for t in headers}, []
    for table, column, to, key in references:
        a, b = tables.get(table.lower()), tables.get(to.lower())
        if a and b and column.lower() in map(str.lower, headers[a]) and key.lower() in map(str.lower, headers[b]):
            out.append((a, column, b, key))
    return out


@dataclass
class EntityClass:
    """A class merged from clusters: its key, and for each property the table.column names that it comes from."""

    name: str
    key: tuple[str, ...]
    properties: dict[str, list[str]] = field(default_factory=dict)


def merged_classes(clusters: Sequence[Proposal]) -> dict[str, EntityClass]:
    """Clusters of one entity name (in any case) become a class; the first sets its key, and properties are united by name."""
    out: dict[str, EntityClass] = {}
    for c in clusters:
        own = out.setdefault(c.entity.lower(), EntityClass(c.entity, c.key))
        for column in (*c.key, *c.columns):
            sources = own.properties.setdefault(column.lower(), [])
            if (source := f"{c.table}.{column}") not in sources:
                sources.append(source)
    return {c.name: c for c in out.values()}


def row_identity(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with the rendered id of a key."""
    return rows.withColumn("id", identifier([F.col(c) for c in key]))
