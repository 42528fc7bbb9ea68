"""Classes put together from clusters by create and merge decisions, and the checks that a graph schema must pass.

These are a few names on the driver; rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from .schema import Proposal, Relation


@dataclass(frozen=True)
class Property:
    """A property of a class, and the table.column names that it comes from."""

    name: str
    sources: tuple[str, ...] = ()
    description: str = ""
    semantic_type: str = ""
    samples: tuple = ()


@dataclass(frozen=True)
class EntityClass:
    name: str
    key: tuple[str, ...]
    properties: tuple[Property, ...] = ()
    clusters: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Decision:
    """What becomes of a cluster: `create` a class, or `merge` into one; names maps its columns to property names."""

    action: str = "create"
    target: str = ""
    entity: str = ""
    names: dict[str, str] = field(default_factory=dict)


def united(known: Sequence[Property], new: Sequence[Property]) -> tuple[Property, ...]:
    """Properties of both, those with equal names (in any case) in one: sources in order, once each, the first description and
    type that says something, and the longer list of samples."""
    out = {p.name.lower(): p for p in known}
    for p in new:
        old = out.get(p.name.lower())
        if old is None:
            out[p.name.lower()] = p
            continue
        samples = p.samples if len(p.samples) > len(old.samples) else old.samples
        out[p.name.lower()] = replace(old, sources=tuple(dict.fromkeys((*old.sources, *p.sources))), description=old.description.strip() or p.description, semantic_type=old.semantic_type or p.semantic_type, samples=samples)
    return tuple(out.values())


def decided(clusters: Sequence[Proposal], decisions: dict[tuple[str, str], Decision], details: dict[str, Property] | None = None) -> tuple[list[EntityClass], dict[tuple[str, str], str], list[str]]:
    """Classes, the class of every cluster, and what had to be changed about the decisions.

    A merge into a class that does not exist (yet), and an action of another name, creates a class; a class that is created
    twice is merged, and keeps its first key. details: what is known of `table.column`."""
    classes: dict[str, EntityClass] = {}
    of: dict[tuple[str, str], str] = {}
    issues = []
    for c in clusters:
        d = decisions.get((c.table, c.name), Decision())
        name, action = (d.entity or c.entity).strip(), d.action.strip().lower()
        if action not in ("create", "merge"):
            issues.append(f"{c.table}.{c.name}: {d.action} is no action, a class is created")
            action = "create"
        target = d.target.strip().lower() if action == "merge" else name.lower()
        if action == "merge" and target not in classes:
            issues.append(f"{c.table}.{c.name}: there is no class {d.target} to merge into, {name} is created")
            target = name.lower()
        elif action == "create" and target in classes:
            issues.append(f"{c.table}.{c.name}: class {name} exists and takes the cluster in")
        own = []
        for column in dict.fromkeys((*c.key, *c.columns)):
            known = (details or {}).get(f"{c.table}.{column}", Property(column))
            own.append(replace(known, name=d.names.get(column, column), sources=(f"{c.table}.{column}",)))
        old = classes.get(target) or EntityClass(name, tuple(d.names.get(k, k) for k in c.key))
        classes[target] = replace(old, properties=united(old.properties, own), clusters=(*old.clusters, (c.table, c.name)))
        of[(c.table, c.name)] = classes[target].name
    return list(classes.values()), of, issues


def unmapped(clusters: Sequence[Proposal], classes: Sequence[EntityClass], of: dict[tuple[str, str], str]) -> list[str]:
    """Clusters without a class, or whose class does not list them."""
    known = {c.name: c for c in classes}
    out = []
    for c in clusters:
        place = (c.table, c.name)
        if place not in of or of[place] not in known:
            out.append(f"{c.table}.{c.name} has no class")
        elif place not in known[of[place]].clusters:
            out.append(f"{of[place]} does not list {c.table}.{c.name}")
    return out


def resolved_property(entity: EntityClass, prop: Property, profiles: dict[str, Property]) -> Property:
    """The property with description, type and samples from the profiles of its source columns.

    Profiles are asked in order of how much their column is like the property's name (equal, then one within the other), then
    whether the table's name is part of it, then by table and column; the first that says something counts, and of samples
    the first longest three. Without any, the property's own words, else where it comes from, `categorical`, its samples."""
    tables = {t for t, _ in entity.clusters}
    name = prop.name.lower()

    def closeness(source: str) -> tuple:
        table, column = source.lower().split(".", 1)
        like = 2 if column == name else 1 if name in column or column in name else 0
        return -like, -(table in name), table, column

    sources = sorted((s for s in prop.sources if s in profiles and s.split(".", 1)[0] in tables), key=closeness)
    found = [profiles[s] for s in sources]
    first = lambda values, default: next((v for v in (" ".join(x.split()) for x in values) if v), default)
    columns = ", ".join(s.split(".", 1)[1] for s in prop.sources)
    samples = max((p.samples[:3] for p in found), key=len, default=()) or prop.samples[:3]
    return replace(
        prop,
        description=first([p.description for p in found] + [prop.description], f"Derived from: {columns}." if columns else "Canonical entity property."),
        semantic_type=first([p.semantic_type for p in found], "categorical"),
        samples=samples,
    )


def sound_columns(relation: Relation, declared: dict[str, Sequence[str]]) -> tuple[tuple[str, ...], list[str]]:
    """The relation's columns that are declared for its table and depend on no cluster but its two ends, each once, and why
    the others are not. declared: column -> clusters that it depends on; names match in any case and are spelt as declared."""
    known, kept, issues = {c.lower(): c for c in declared}, [], []
    for c in relation.columns:
        own = known.get(c.lower())
        if own is None:
            issues.append(f"{relation.table}: {c} is no relation property")
        elif not set(declared[own]) <= {relation.source, relation.target}:
            issues.append(f"{relation.table}: {own} of {relation.label} depends on {', '.join(sorted(set(declared[own]) - {relation.source, relation.target}))}")
        elif own not in kept:
            kept.append(own)
    return tuple(kept), issues


def reassigned(clusters: Sequence[Proposal], declared: dict[str, Sequence[str]], table: str) -> tuple[list[Proposal], dict[str, Sequence[str]]]:
    """Clusters of a table with every key among their columns, and the relation properties that depend on two clusters or
    more; one that depends on a single cluster becomes a column of that cluster, one that depends on none is dropped."""
    out = {(c.table, c.name): replace(c, columns=tuple(dict.fromkeys((*c.key, *c.columns)))) for c in clusters}
    kept = {}
    for column, depends in declared.items():
        ends = list(dict.fromkeys(depends))
        if len(ends) > 1:
            kept[column] = tuple(ends)
        elif ends and (table, ends[0]) in out:
            c = out[(table, ends[0])]
            out[(table, ends[0])] = replace(c, columns=tuple(dict.fromkeys((*c.columns, column))))
    return list(out.values()), kept


def first_relations(relations: Sequence[tuple[Relation, str]]) -> list[tuple[Relation, str]]:
    """Relations with their cardinality, the first of those with equal ends, label and cardinality, whatever their table."""
    out: dict[tuple, tuple[Relation, str]] = {}
    for r, cardinality in relations:
        out.setdefault((r.source, r.target, r.label.strip().lower(), cardinality.strip().lower()), (r, cardinality))
    return list(out.values())


def invariants(classes: Sequence[EntityClass], edges: Sequence[tuple[str, str, str, Sequence[str]]]) -> list[str]:
    """What a schema violates: unnamed classes, repeated properties, edges (source, label, target, properties) to unknown classes."""
    twice = lambda names: len({n.lower() for n in names}) < len(names)
    out = ["a class has no name"] * any(not c.name.strip() for c in classes)
    out += [f"{c.name} repeats a property" for c in classes if twice([p.name for p in c.properties])]
    known = {c.name for c in classes}
    for source, label, target, properties in edges:
        out += [f"{label} refers to the unknown class {x}" for x in (source, target) if x not in known]
        out += [f"{label} repeats a property"] * twice(list(properties))
    return out
