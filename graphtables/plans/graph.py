"""Property graphs as DataFrames, and graph patterns as joins that Catalyst plans.

A pattern binds a variable by its identity, column `<var>_id`. Properties are joined only where a pattern asks for
them or filters on them: edges carry both ends' ids, so anonymous nodes in the middle of a path cost no join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import parts

Rows = DataFrame | Callable[[], DataFrame]


class Nodes(Mapping[str, DataFrame]):
    """Node tables by label; one that is given as a function is opened when a pattern first needs it."""

    def __init__(self, given: Mapping[str, Rows]):
        self.given: dict[str, Rows] = dict(given)

    def __getitem__(self, label: str) -> DataFrame:
        rows = self.given[label]
        if not isinstance(rows, DataFrame) and callable(rows):
            rows = self.given[label] = rows()
        return rows

    def __iter__(self) -> Iterator[str]:
        return iter(self.given)

    def __len__(self) -> int:
        return len(self.given)


ENDS = ("src", "dst", "edge_id")


@dataclass(frozen=True)
class Edge:
    """src, dst and properties between two labels; with a column edge_id, patterns can tell parallel edges apart."""

    given: Rows
    source: str
    target: str

    @cached_property
    def rows(self) -> DataFrame:
        return self.given if isinstance(self.given, DataFrame) else self.given()


@dataclass(frozen=True)
class PropertyGraph:
    nodes: Mapping[str, Rows]  # id and properties
    edges: dict[str, Edge]

    def __post_init__(self) -> None:
        object.__setattr__(self, "nodes", Nodes(self.nodes))

    def match(self, var: str, label: str, props: tuple[str, ...] = (), unique_edges: bool = False, **equal: Any) -> Match:
        """A pattern that begins at a node; with unique_edges no edge is walked twice by the relationship variables of one type."""
        rows = self.node(var, label, props, equal, alone=True)
        return Match(self, rows, {var: rows.columns}, {}, unique_edges)

    def node(self, var: str, label: str, props: tuple[str, ...], equal: dict[str, Any], alone: bool = False) -> DataFrame | None:
        """The bound node table, or None where identity alone is asked for."""
        if not (props or equal or alone):
            return None
        rows = self.nodes[label]
        for name, wanted in equal.items():
            rows = rows.where(F.col(name) == F.lit(wanted))
        return rows.select(F.col("id").alias(f"{var}_id"), *(F.col(p).alias(f"{var}_{p}") for p in props if p != "id"))

    def described(self, samples: int = 0) -> list[str]:
        """A line for each label and relationship with its properties and their types, and some values of each if asked for."""

        def shown(rows: DataFrame) -> str:
            props = [(c, kind) for c, kind in rows.dtypes if c not in ENDS]
            if not samples or not props:
                return ", ".join(f"{c} {kind}" for c, kind in props)
            first = rows.select(*(c for c, _ in props)).limit(samples).collect()
            return ", ".join(f"{c} {kind} ({', '.join(str(r[c]) for r in first if r[c] is not None)})" for c, kind in props)

        lines = [f"({label} {{{shown(df)}}})" for label, df in self.nodes.items()]
        return lines + [f"({e.source})-[{name} {{{shown(e.rows)}}}]->({e.target})" for name, e in self.edges.items()]

    def counted(self) -> DataFrame:
        """kind, name, n of every label and every relationship, those without instances too."""
        tables = [("node", n, df) for n, df in self.nodes.items()] + [("edge", n, e.rows) for n, e in self.edges.items()]
        return reduce(DataFrame.union, (df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n") for kind, name, df in tables))

    def absent(self, labels: Sequence[str], relationships: Sequence[str]) -> DataFrame:
        """kind, name of labels and relationships that patterns use and the graph does not have, or has no instance of."""
        wanted = [("node", n) for n in labels] + [("edge", n) for n in relationships]
        have = [(kind, name) for kind, name in wanted if name in (self.nodes if kind == "node" else self.edges)]
        used = PropertyGraph({n: self.nodes[n] for kind, n in have if kind == "node"}, {n: self.edges[n] for kind, n in have if kind == "edge"})
        spark = next(iter(self.nodes.values())).sparkSession
        asked = spark.createDataFrame(wanted, "kind string, name string")
        return asked.join(used.counted().where("n > 0"), ["kind", "name"], "left_anti") if have else asked

    def anchors(self, label: str, path: Sequence[tuple[str, bool]], field: str | None = None) -> DataFrame:
        """Different (id, anchor): where a path of relationships, each with or against its direction, leads from a label.

        An anchor is the identity reached, or the value of its property `field`; a null value is none. The path is walked
        from its end, so what is told apart at each step is the nodes of that step, and the label's own only once."""
        at = label
        for name, forward in path:
            at = self.edges[name].target if forward else self.edges[name].source
        own = self.nodes[label].select("id")
        reach = None if field is None else self.nodes[at].select("id", F.col(field).alias("anchor")).where("anchor IS NOT NULL").distinct()
        for name, forward in reversed(path):
            near, far = ("src", "dst") if forward else ("dst", "src")
            step = self.edges[name].rows.select(F.col(near).alias("id"), F.col(far).alias("anchor"))
            if reach is not None:
                step = step.withColumnRenamed("anchor", "to").join(reach.withColumnRenamed("id", "to"), "to").select("id", "anchor")
            reach = step.distinct()
        if reach is None:
            return own.select("id", F.col("id").alias("anchor"))
        return reach.join(own, "id", "left_semi").select(F.col("id").cast(own.schema["id"].dataType).alias("id"), "anchor")

    def problems(self, name: str, source: str | None = None, target: str | None = None, props: tuple[str, ...] = ()) -> list[str]:
        """What is wrong with an edge pattern against the catalog: unknown names, or a wrong direction."""
        if name not in self.edges:
            return [f"unknown relationship {name}"]
        e, out = self.edges[name], [f"unknown label {x}" for x in (source, target) if x and x not in self.nodes]
        if (source and source != e.source) or (target and target != e.target):
            turned = (source, target) == (e.target, e.source)
            out.append(f"{name} runs from {e.source} to {e.target}" + (": turn it round" if turned else ""))
        return out + [f"{name} has no property {p}" for p in props if p not in e.rows.columns]

    def node_problems(self, label: str, props: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> list[str]:
        """What is wrong with a node pattern: an unknown label, unknown properties, and text predicates (prefixes, regular
        expressions) on properties that are no text."""
        if label not in self.nodes:
            return [f"unknown label {label}"]
        kinds = dict(self.nodes[label].dtypes)
        out = [f"{label} has no property {p}" for p in dict.fromkeys((*props, *texts)) if p not in kinds]
        return out + [f"{label}.{p} is {kinds[p]}, no text" for p in texts if kinds.get(p, "string") != "string"]


class Match:
    """A table of bindings; every step returns a new one.

    `columns` holds the columns of each variable, `types` the type of each relationship variable."""

    def __init__(self, graph: PropertyGraph, rows: DataFrame, columns: dict[str, list[str]] | None = None, types: dict[str, str] | None = None, unique_edges: bool = False):
        self.graph, self.rows, self.types, self.unique_edges = graph, rows, types or {}, unique_edges
        self.columns = columns if columns is not None else {c[:-3]: [x for x in rows.columns if x.startswith(c[:-2])] for c in rows.columns if c.endswith("_id")}

    def _with(self, rows: DataFrame, columns: dict[str, list[str]] | None = None, types: dict[str, str] | None = None) -> Match:
        return Match(self.graph, rows, self.columns if columns is None else columns, self.types if types is None else types, self.unique_edges)

    def out(self, var: str, name: str, to: str, props: tuple[str, ...] = (), edge: tuple[str, ...] = (), rel: str | None = None, **equal: Any) -> Match:
        """Along a relationship. `edge` are properties to bring along, under the relationship variable `rel`, else its type."""
        return self._step(var, name, to, props, edge, rel, equal, "src", "dst", self.graph.edges[name].target)

    def into(self, var: str, name: str, to: str, props: tuple[str, ...] = (), edge: tuple[str, ...] = (), rel: str | None = None, **equal: Any) -> Match:
        """Against a relationship's direction."""
        return self._step(var, name, to, props, edge, rel, equal, "dst", "src", self.graph.edges[name].source)

    def _step(self, var, name, to, props, edge, rel, equal, near, far, label) -> Match:
        found = self.graph.edges[name].rows
        if (rel or name) in self.columns and (rel or edge):
            raise ValueError(f"{rel or name} is bound already: give this relationship a variable of its own")
        identified = self.unique_edges or (rel and "edge_id" in found.columns)
        if self.unique_edges and "edge_id" not in found.columns:
            raise ValueError(f"edges of {name} have no edge_id to tell them apart")
        rel = rel or (f"{name}{len(self.types)}" if self.unique_edges and not edge else name)
        own = [F.col("edge_id").alias(f"{rel}_id")] if identified else []
        edges = found.select(F.col(near).alias(f"{var}_id"), F.col(far).alias(f"{to}_id"), *own, *(F.col(p).alias(f"{rel}_{p}") for p in edge))
        known = [f"{var}_id", *([f"{to}_id"] if f"{to}_id" in self.rows.columns else [])]  # a variable bound twice closes a cycle
        rows = self.rows.join(edges, known)
        if self.unique_edges:
            for other in (r for r, kind in self.types.items() if kind == name):
                rows = rows.where(F.col(f"{rel}_id") != F.col(f"{other}_id"))
        columns = dict(self.columns)
        if identified or edge:
            columns[rel] = [*([f"{rel}_id"] if identified else []), *(f"{rel}_{p}" for p in edge)]
        nodes = self.graph.node(to, label, props, equal)
        bound = [f"{to}_id"] if nodes is None else nodes.columns
        columns[to] = [*columns.get(to, []), *(c for c in bound if c not in columns.get(to, []))]
        return self._with(rows if nodes is None else rows.join(nodes, f"{to}_id"), columns, self.types | ({rel: name} if identified else {}))

    def where(self, condition: Column | str) -> Match:
        return self._with(self.rows.where(condition))

    def join(self, other: Match) -> Match:
        """Two patterns that share variables."""
        shared = [f"{v}_id" for v in self.columns if v in other.columns and f"{v}_id" in self.rows.columns and f"{v}_id" in other.rows.columns]
        if not shared:
            raise ValueError("the patterns share no variable; bind one, or cross join a single row yourself")
        held = [c for c in other.rows.columns if c in self.rows.columns and c not in shared]
        rows = self.rows.join(other.rows.drop(*held), shared)
        if self.unique_edges or other.unique_edges:
            for a, b in ((a, b) for a, kind in self.types.items() for b, other_kind in other.types.items() if kind == other_kind and a != b):
                rows = rows.where(F.col(f"{a}_id") != F.col(f"{b}_id"))
        columns = {v: list(dict.fromkeys([*self.columns.get(v, []), *other.columns.get(v, [])])) for v in [*self.columns, *other.columns]}
        return Match(self.graph, rows, columns, self.types | other.types, self.unique_edges or other.unique_edges)

    def having(self, other: Match, *on: str) -> Match:
        """Bindings for which the other pattern holds: `on` are shared variables, or columns that both have."""
        return self._filtered(other, on, "left_semi")

    def without(self, other: Match, *on: str) -> Match:
        """Bindings for which the other pattern does not hold; a null never matches."""
        return self._filtered(other, on, "left_anti")

    def _filtered(self, other: Match, on: tuple[str, ...], how: str) -> Match:
        keys = [f"{v}_id" if v in self.columns and f"{v}_id" in self.rows.columns else v for v in on]
        if not keys or any(k not in m.rows.columns for k in keys for m in (self, other)):
            raise ValueError(f"both patterns must bind {', '.join(on) or 'a variable'}")
        return self._with(self.rows.join(other.rows.select(*keys).distinct() if len(keys) > 1 else other.rows.select(*keys), keys, how))

    def dealt(self, var: str, rows: int) -> Match:
        """Bindings dealt by a variable's identity, in a number of parts that Spark keeps, for a step from it that gives about
        so many rows; a frontier that follows and holds the variable is told apart in the same parts."""
        return self._with(self.rows.repartition(parts(self.rows.sparkSession, rows), f"{var}_id"))

    def frontier(self, *vars: str) -> Match:
        """Different bindings of the variables alone: sound where nothing later counts paths."""
        columns = {v: self.columns[v] for v in vars}
        return self._with(self.rows.select(*dict.fromkeys(c for v in vars for c in columns[v])).distinct(), columns, {r: k for r, k in self.types.items() if r in vars})


def winners(scored: DataFrame, score: str, within: tuple[str, ...] = ()) -> DataFrame:
    """All rows with the greatest score, ties included; rows without a score never win.

    The greatest score is one aggregate that comes back in a join, so no task sees all groups."""
    best = scored.groupBy(*within).agg(F.max(score).alias("_best"))
    out = scored.join(best, list(within)) if within else scored.crossJoin(F.broadcast(best))  # one row
    return out.where(F.col(score) == F.col("_best")).drop("_best")


def numbered(rows: DataFrame, within: tuple[str, ...], order: tuple[Column, ...], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("place") <= k)
