"""Problem 5: deeply nested records as flat, linked tables, by shared inlining.

First the schema graph is analysed: which element stands under which, and how often. Elements that repeat, that stand
under several parents, or that contain themselves get a table of their own; all others are inlined as fields of the
nearest one that has. Every row carries the key of its parent row. Text that holds an encoded object is part of the graph.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut

ROOT = "$"
#: Elements whose member names are data: each member is a row with `key` and `value`.
MAPS = ("object_counts", "minimum_relations")
ROW_SCHEMA = "tab string, row_id long, parent_tab string, parent_id long, parent_ord long, ord long, fields map<string,string>"


def parse(text: str | None) -> dict | None:
    """The object a record holds, None for anything else. Constants outside of JSON make it none."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _no_constant(name: str) -> None:
    raise ValueError(name)


def unfold(value: object) -> object:
    """A string that encodes an object or a list (once or more), decoded; anything else as it is."""
    while isinstance(value, str):
        body = value.strip()
        if not (body[:1] in ("{", "[") or body[:2] in ('"{', '"[')):
            return value
        try:
            value = json.loads(body, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return value
    return value


#: Types of single values, as bits: a leaf that has several is text.
BOOLEAN, WHOLE, NUMBER, TEXT = 1, 2, 4, 8


def _kind(value: object) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return WHOLE if -(2**63) <= value < 2**63 else TEXT
    return NUMBER if isinstance(value, float) else TEXT


def _edges(record: dict, maps: tuple[str, ...], found: dict[tuple[str, str], list[int]]) -> None:
    """Adds what a record tells to found: (parent, element) -> [repeats, holds members or elements, types of its values]."""
    stack: list[tuple[str, object]] = [(ROOT, record)]
    while stack:
        tag, value = stack.pop()
        for name, child in value.items():  # type: ignore[union-attr]
            child = unfold(child)
            many = isinstance(child, list) or name in maps and isinstance(child, dict)
            complex_ = isinstance(child, (dict, list))
            seen = found.setdefault((tag, name), [0, 0, 0])
            seen[0] |= many
            seen[1] |= complex_
            if not complex_:
                seen[2] |= _kind(child)
            if name in maps and isinstance(child, dict):
                for value in child.values():
                    seen[2] |= _kind(value)
                continue
            # Lists in lists are levels of one element.
            parts = [child]
            while parts:
                part = unfold(parts.pop())
                if isinstance(part, list):
                    parts += part
                elif isinstance(part, dict):
                    stack.append((name, part))
                elif many:
                    seen[2] |= _kind(part)


def _graph(column: str, maps: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str], list[int]] = {}
        for frame in frames:
            for text in frame[column]:
                record = parse(text)
                if record is not None:
                    _edges(record, maps, found)
        yield pd.DataFrame([(a, b, bool(m), bool(c), t) for (a, b), (m, c, t) in found.items()], columns=["parent", "element", "many", "complex", "types"])

    return run


def schema_graph(records: DataFrame, column: str, maps: tuple[str, ...] = MAPS) -> DataFrame:
    """(parent, element, many, complex, types): the edges of the schema graph of all records, gathered in one pass; each
    task sends only its distinct edges."""
    edges = records.select(column).mapInPandas(_graph(column, maps), "parent string, element string, many boolean, complex boolean, types int")
    return edges.groupBy("parent", "element").agg(F.max("many").alias("many"), F.max("complex").alias("complex"), F.bit_or("types").alias("types"))


@dataclass(frozen=True)
class Layout:
    """Elements with a table of their own; all others are inlined."""

    tables: frozenset[str]
    maps: tuple[str, ...] = MAPS


def layout(graph: DataFrame, maps: tuple[str, ...] = MAPS, always: tuple[str, ...] = (), most: int = 100_000) -> Layout:
    """Decides by the graph; the elements in `always` are tables even if none repeats. The graph is read to the driver, as it has a row for each edge of the schema and not of the data. A graph of more than
    `most` edges is refused: then member names are data, and belong in `maps`."""
    edges = graph.limit(most + 1).collect()
    if len(edges) > most:
        raise ValueError(f"more than {most} edges: some element's member names are data; name it in maps")
    parents: dict[str, set[str]] = {}
    below: dict[str, set[str]] = {}
    tables = {ROOT, *always}
    for e in edges:
        below.setdefault(e.parent, set()).add(e.element)
        if e.complex:
            parents.setdefault(e.element, set()).add(e.parent)
        if e.many:
            tables.add(e.element)
    tables |= {t for t, p in parents.items() if len(p) > 1}
    for start in parents:  # recursive: an element that can be reached from itself
        seen, todo = set(), list(below.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += below.get(x, ())
        if start in seen:
            tables.add(start)
    return Layout(frozenset(tables), maps)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def rows_of(record: dict, plan: Layout, wanted: frozenset[str] | None = None) -> list[tuple]:
    """(tab, row_id, parent_tab, parent_id, parent_ord, ord, fields) of a record. Row numbers start at 0 with the record
    itself; ord is the index in the list, 0 for a single one; null elements have no row but keep their index."""
    out: list[tuple] = []
    count = 0
    tables, maps = plan.tables, plan.maps

    def add(tab: str, parent: tuple[str, int, int] | None, order: int, value: object) -> None:
        nonlocal count
        key, count = count, count + 1
        fields: dict[str, str | None] = {}
        own = (tab, key, order)
        if wanted is None or tab in wanted:
            out.append((tab, key, *(parent or (None, None, None)), order, fields))
        if isinstance(value, dict):
            inline(value, "", own, fields)
        else:
            fields["value"] = _text(value)

    def inline(value: dict, prefix: str, own: tuple[str, int, int], fields: dict) -> None:
        for name, child in value.items():
            child = unfold(child)
            if name in maps and isinstance(child, dict):
                for k, v in child.items():
                    add(name, own, 0, {"key": k, "value": v})
            elif name in tables or isinstance(child, list):
                for i, element in enumerate(child if isinstance(child, list) else [child]):
                    element = unfold(element)
                    if element is not None:
                        add(name, own, i, element)
            elif isinstance(child, dict):
                inline(child, f"{prefix}{name}.", own, fields)
            else:
                fields[prefix + name] = _text(child)

    add(ROOT, None, 0, record)
    return out


def _flatten(key: str, column: str, plan: Layout, wanted: frozenset[str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [key, *(c.strip().split()[0] for c in ROW_SCHEMA.replace("map<string,string>", "map").split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text in zip(frame[key], frame[column]):
                record = parse(text)
                if record is not None:
                    out += [(name, *row) for row in rows_of(record, plan, wanted)]
            made = pd.DataFrame(out, columns=names)
            for c in ("parent_id", "parent_ord"):
                made[c] = made[c].astype("Int64")
            yield made

    return run


def flatten(records: DataFrame, key: str, column: str, plan: Layout, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(key, tab, row_id, parent_tab, parent_id, parent_ord, ord, fields): all rows of all tables; (key, row_id) is the
    key of a row and (key, parent_id) refers to its parent. Records that are no JSON object have no row. `wanted` keeps
    only some tables, with the same keys. A record delivered twice is one record."""
    kind = records.schema[key].dataType.simpleString()
    once = records.select(key, column).where(F.col(key).isNotNull()).dropDuplicates([key])
    return once.mapInPandas(_flatten(key, column, plan, None if wanted is None else frozenset(wanted)), f"{key} {kind}, {ROW_SCHEMA}")


def columns_of(graph: DataFrame, plan: Layout) -> dict[str, dict[str, str]]:
    """The columns of each table with their types, by the graph: the leaves of an element and of those inlined in it, by their
    path. Leaves of one type have it; whole and other numbers together are doubles; anything else is text."""
    below: dict[str, list] = {}
    for e in graph.orderBy("parent", "element").collect():
        below.setdefault(e.parent, []).append(e)
    named = lambda t: {BOOLEAN: "boolean", WHOLE: "bigint", NUMBER: "double", WHOLE | NUMBER: "double"}.get(t, "string")
    out: dict[str, dict[str, str]] = {}

    def leaves(element: str, prefix: str, found: dict[str, str]) -> None:
        for e in below.get(element, ()):
            path = f"{prefix}{e.element}"
            if e.element in plan.tables:
                continue
            if e.complex:
                leaves(e.element, f"{path}.", found)
            if e.types or not e.complex:
                found[path] = named(e.types)

    for tab in sorted(plan.tables):
        own: dict[str, str] = {}
        types = 0
        for edges in below.values():
            for e in edges:
                types |= e.types if e.element == tab else 0
        if tab in plan.maps:
            own |= {"key": "string"}
        if types:
            own["value"] = named(types)
        leaves(tab, "", own)
        out[tab] = own
    return out


def flat_tables(records: DataFrame, key: str, column: str, maps: tuple[str, ...] = MAPS, always: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The flat tables of nested records by name, `$` for the records themselves: (key, row_id, parent_tab, parent_id, ord)
    and a typed column for each leaf, dots in its path as underscores. (key, row_id) is the key of a row over all tables,
    (key, parent_id) refers to the parent's row in parent_tab. Null where a record hasn't the leaf."""
    graph = cut(schema_graph(records, column, maps))
    plan = layout(graph, maps, always)
    flat = cut(flatten(records, key, column, plan))
    made = {}
    for tab, columns in columns_of(graph, plan).items():
        names: dict[str, str] = {}
        for path in columns:
            name = path.replace(".", "_")
            while name in (key, "row_id", "parent_tab", "parent_id", "ord") or name in names.values():
                name += "_"
            names[path] = name
        leaves = [F.col("fields")[path].try_cast(kind).alias(names[path]) for path, kind in columns.items()]
        made[tab] = flat.where(F.col("tab") == tab).select(key, "row_id", "parent_tab", "parent_id", "ord", *leaves)
    return made


#: Tables of a world and of its expectations.
WORLD_TABLES = ("objects", "tags", "relations", "object_counts", "minimum_relations")


def world_children(records: DataFrame) -> DataFrame:
    """(run_id, child, pos, sub, label): one row for each object, tag, relation, expected count and minimum relation of
    records(run_id, record), wherever in the record and in whatever encoding they stand."""
    flat = flatten(records, "run_id", "record", layout(schema_graph(records, "record"), always=WORLD_TABLES), WORLD_TABLES)
    field = F.col("fields")
    amount = F.coalesce(field["value"], field["count"], field["minimum"], field["min"], field["n"], field["expected"])
    kind = F.coalesce(field["key"], field["object_type"], field["relation_type"], field["type"], field["kind"], field["name"])
    counts = F.col("tab").isin("object_counts", "minimum_relations")
    zero = F.lit(0).cast("long")
    child = F.create_map(*[F.lit(x) for pair in (("objects", "object"), ("tags", "tag"), ("relations", "relation"), ("object_counts", "object_count"), ("minimum_relations", "minimum_relation")) for x in pair])[F.col("tab")]
    rows = flat.where((F.col("tab") != "tags") | (F.col("parent_tab") == "objects"))
    return rows.select(
        "run_id",
        child.alias("child"),
        F.when(counts, zero).when(F.col("tab") == "tags", F.col("parent_ord")).otherwise(F.col("ord")).alias("pos"),
        F.when(counts, amount.try_cast("double").cast("long")).when(F.col("tab") == "tags", F.col("ord")).otherwise(zero).alias("sub"),
        F.when(counts, kind).when(F.col("tab") == "objects", field["id"]).when(F.col("tab") == "tags", field["value"])
        .otherwise(F.concat(F.coalesce(field["source"], F.lit("")), F.lit(">"), F.coalesce(field["target"], F.lit("")))).alias("label"),
    )
