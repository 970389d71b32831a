"""Payload filters: one tree of conditions, five ways to write it, compiled to a Spark column.

A condition on a field that is missing, null or of another type is false, but for ``ne``, ``nin``, ``is_null`` and a
negation; with ``compat=True`` a missing number counts as 0 in ``gte`` and ``lte``, as older clients expect. Strings
compare without regard to case. The empty AND, OR and NOT are true. Compiled filters compare plain columns of the table
where they exist, in their own type, so that they reach the scan, and paths of a variant column ``payload`` elsewhere.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import geo


class FilterError(ValueError):
    """A filter that can't be read."""


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    kind: str  # and, or, not, least
    parts: tuple[Any, ...]
    least: int = 0


OPERATORS = frozenset("eq ne gt gte lt lte in nin contains starts_with ends_with is_null is_not_null range all count is_empty geo_radius geo_box geo_polygon datetime".split())


def all_of(*parts) -> Group:
    return Group("and", parts)


def any_of(*parts) -> Group:
    return Group("or", parts)


def none_of(*parts) -> Group:
    return Group("not", parts)


def at_least(n: int, *parts) -> Group:
    return Group("least", parts, n)


class Fields:
    """Resolves dotted names to typed columns of one DataFrame."""

    def __init__(self, df: DataFrame, payload: str = "payload"):
        self.kinds = {c.lower(): (c, kind) for c, kind in df.dtypes}
        self.payload = payload if self.kinds.get(payload.lower(), ("", ""))[1] == "variant" else None

    def kind(self, name: str) -> str | None:
        return self.kinds.get(name.lower(), (None, None))[1]

    def get(self, name: str, kind: str) -> Column:
        """The field as ``kind``, null where it is missing or of another type."""
        head, _, rest = name.partition(".")
        if not rest and (known := self.kinds.get(head.lower())) and known[1] != "variant":
            column, have = F.col(f"`{known[0]}`"), known[1]
            if have == kind or have.startswith("array"):
                return column
            numeric = have in ("tinyint", "smallint", "int", "bigint", "float", "double") or have.startswith("decimal")
            if kind == "timestamp" and have.startswith(("timestamp", "date")):
                return column.cast("timestamp")
            if kind == "double" and numeric:
                return column.cast("double")
            return F.lit(None).cast(kind)
        if (known := self.kinds.get(head.lower())) and known[1].startswith("struct"):
            return F.col(name).try_cast(kind)
        if (known := self.kinds.get(head.lower())) and known[1] == "variant" and rest:
            return self._path(known[0], rest, kind)
        if self.payload:
            return self._path(self.payload, name, kind)
        return F.lit(None).cast(kind)

    @staticmethod
    def _path(column: str, path: str, kind: str) -> Column:
        at = "$" + "".join(f"['{p}']" for p in path.replace("'", "").split("."))
        value = F.try_variant_get(column, at, kind)
        # A variant string of digits isn't a number, nor the other way round.
        type_of = F.schema_of_variant(F.try_variant_get(column, at, "variant"))
        texts = {"string": type_of == "STRING", "double": ~type_of.isin("STRING", "BOOLEAN") & ~type_of.startswith("ARRAY"), "boolean": type_of == "BOOLEAN"}
        return F.when(texts[kind], value) if kind in texts else value

    def own(self, name: str) -> Column:
        """A plain column as it is."""
        return F.col(f"`{self.kinds[name.lower()][0]}`")

    def missing(self, name: str) -> Column:
        head, _, rest = name.partition(".")
        known = self.kinds.get(head.lower())
        if known and known[1] != "variant":
            return F.col(name if rest else f"`{known[0]}`").isNull()
        column, path = (known[0], rest) if known else (self.payload, name)
        if not column:
            return F.lit(True)
        at = "$" + "".join(f"['{p}']" for p in path.replace("'", "").split("."))
        found = F.try_variant_get(column, at, "variant")
        return found.isNull() | F.is_variant_null(found)

    def is_array(self, name: str) -> bool:
        return (self.kind(name) or "").startswith("array")


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_FLIPPED = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _compare(fields: Fields, name: str, op: str, value: float) -> Column:
    """A comparison with a number; with an integer column in whole numbers, so that it is exact and the scan can use it."""
    if fields.kind(name) in _INTEGERS and math.isfinite(value):
        if not float(value).is_integer():
            value = math.floor(value) if op in ("gt", "lte") else math.ceil(value)
        value = int(value)
        if abs(value) >= 1 << 63:
            return fields.own(name).isNotNull() & F.lit((value < 0) == (op in ("gt", "gte")))
        return getattr(fields.own(name), _FLIPPED[op])(F.lit(value))
    return getattr(fields.get(name, "double"), _FLIPPED[op])(F.lit(float(value)))


def _any_case(column: Column, values: Sequence[str]) -> Column:
    """Whether a text is one of the values but for case. Bounds in plain comparisons, which the scan can use, come first."""
    lowered = sorted({v.lower() for v in values})
    test = F.lower(column).isin(*lowered) if len(lowered) > 1 else F.lower(column) == lowered[0]
    if not all(v.isascii() for v in lowered):
        return test
    # Of all that is lower-cased to an ASCII text, the capitals come first and the Kelvin sign last.
    low, high = min(v.upper() for v in lowered), max(v.replace("k", "\u212a") for v in lowered)
    return (column >= low) & (column <= high) & test


def _one_of(fields: Fields, name: str, values: Sequence[Any]) -> Column:
    """Whether the field equals one of the values; null may stand for false."""
    if fields.is_array(name):
        texts = [str(v).lower() for v in values if v is not None]
        found = F.exists(fields.get(name, "string"), lambda x: F.lower(x.cast("string")).isin(*texts)) if texts else F.lit(False)
        return found | fields.missing(name) if None in values else found
    tests = []
    for v in values:
        if v is not None and not isinstance(v, (bool, int, float, str)):
            raise FilterError(f"can't compare {name} with {type(v).__name__}")
    if None in values:
        tests.append(fields.missing(name))
    if flags := {v for v in values if isinstance(v, bool)}:
        tests.append(fields.get(name, "boolean").isin(*flags))
    if numbers := sorted({v for v in values if _number(v)}):
        if fields.kind(name) in _INTEGERS:
            whole = [int(v) for v in numbers if math.isfinite(v) and float(v).is_integer() and abs(v) < 1 << 63]
            tests.append(fields.own(name).isin(*whole) if whole else F.lit(False))
        else:
            tests.append(fields.get(name, "double").isin(*map(float, numbers)))
    if texts := [v for v in values if isinstance(v, str)]:
        tests.append(_any_case(fields.get(name, "string"), texts))
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if len(tests) != 1 else tests[0]


def _condition(fields: Fields, c: Condition, compat: bool) -> Column:
    """The condition as a column that may be null for false."""
    name, op, value = c.field, c.op, c.value
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op}")
    if op == "eq":
        return _one_of(fields, name, [value])
    if op == "ne":
        return ~_truth(_one_of(fields, name, [value]))
    if op in ("in", "nin"):
        if not isinstance(value, Sequence) or isinstance(value, str):
            raise FilterError(f"{op} takes a list")
        found = _one_of(fields, name, value)
        return found if op == "in" else ~_truth(found)
    if op in ("gt", "gte", "lt", "lte"):
        kept = compat and op in ("gte", "lte")
        if not _number(value):
            return F.lit(kept)
        test = _compare(fields, name, op, value)
        return F.coalesce(test, F.lit(True)) if kept else test
    if op == "range":
        low, high = value
        if not (_number(low) and _number(high)):
            return F.lit(False)
        return _compare(fields, name, "gte", low) & _compare(fields, name, "lte", high)
    if op in ("contains", "starts_with", "ends_with"):
        if fields.is_array(name):
            return _one_of(fields, name, [value])
        text = F.lower(fields.get(name, "string"))
        return {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}[op](str(value).lower())
    if op == "is_null":
        return fields.missing(name)
    if op == "is_not_null":
        return ~fields.missing(name)
    if op == "all":
        return reduce(lambda a, b: a & b, (_one_of(fields, name, [v]) for v in value), F.lit(True))
    if op == "count":
        return all_counts(F.size(fields.get(name, "string")), value) if fields.is_array(name) else F.lit(False)
    if op == "is_empty":
        return fields.missing(name) | (F.size(fields.get(name, "string")) == 0 if fields.is_array(name) else _truth(fields.get(name, "string") == ""))
    if op == "datetime":
        stamp = fields.get(name, "timestamp")
        tests = [{"gt": stamp > v, "gte": stamp >= v, "lt": stamp < v, "lte": stamp <= v}[k] for k, v in ((k, F.lit(v).cast("timestamp")) for k, v in value.items())]
        return reduce(lambda a, b: a & b, tests, F.lit(True))
    lat, lon = fields.get(f"{name}.lat", "double"), fields.get(f"{name}.lon", "double")
    if op == "geo_radius":
        return geo.haversine_km(lat, lon, value["lat"], value["lon"]) <= value["km"]
    if op == "geo_box":
        return geo.in_box(lat, lon, value["top"], value["left"], value["bottom"], value["right"])
    return geo.in_polygon(lat, lon, value["exterior"], value.get("holes", ()))


def all_counts(size: Column, bounds: Mapping[str, float]) -> Column:
    tests = [{"gt": size > v, "gte": size >= v, "lt": size < v, "lte": size <= v, "eq": size == v}[k] for k, v in bounds.items()]
    return _truth(reduce(lambda a, b: a & b, tests, F.lit(True)))


def compile_filter(df: DataFrame, tree: Condition | Group | None, compat: bool = False, total: bool = False) -> Column:
    """The tree as a boolean column for a filter; None is true.

    It may be null where it is false, as a filter takes null for false: only so do comparisons reach the scan. With
    ``total`` it is never null.
    """
    fields = Fields(df)

    def walk(node, exact: bool) -> Column:
        """``exact``: within a negation or a count, where null isn't false."""
        if node is None:
            return F.lit(True)
        if isinstance(node, Condition):
            found = _condition(fields, node, compat)
            return _truth(found) if exact else found
        parts = [walk(p, exact or node.kind not in ("and", "or")) for p in node.parts]
        if not parts:
            return F.lit(True)
        if node.kind == "and":
            return reduce(lambda a, b: a & b, parts)
        if node.kind == "or":
            return reduce(lambda a, b: a | b, parts)
        if node.kind == "not":
            return ~reduce(lambda a, b: a | b, parts)
        return reduce(lambda a, b: a + b, (p.cast("int") for p in parts)) >= node.least

    return walk(tree, total)


def from_json(text: str | Mapping) -> Condition | Group:
    """The native form: {"type", "field", "condition": {"operator", "value"}, "filters"}."""
    node = json.loads(text) if isinstance(text, str) else text
    kind = node.get("type")
    if kind in ("and", "or", "not"):
        return Group(kind, tuple(from_json(f) for f in node.get("filters", ())))
    if kind not in (None, "field") or "field" not in node:
        raise FilterError(f"not a filter: {node}")
    condition = node.get("condition", {})
    op = condition.get("operator", condition.get("op", "eq"))
    value = condition.get("value")
    if op == "range" and value is None:
        value = (condition.get("min"), condition.get("max"))
    return Condition(node["field"], op, value)


_BOUNDS = {"gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte"}
_MONGO = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$in": "in", "$nin": "nin", "$contains": "contains", "$startsWith": "starts_with", "$endsWith": "ends_with", "$all": "all"}


def _bounds(field: str, value: Mapping) -> list[Condition]:
    if any(isinstance(v, str) for v in value.values()):
        return [Condition(field, "datetime", dict(value))]
    return [Condition(field, _BOUNDS[k], v) for k, v in value.items()]


def from_clauses(node: Mapping) -> Condition | Group:
    """The clause form: must, should, must_not, min_should_match; conditions {"key", "match" | "range" | "text" | ...}; nested groups."""
    if "key" in node:
        field, out = node["key"], []
        for name, value in node.items():
            if name == "match":
                if "value" in value:
                    out.append(Condition(field, "eq", value["value"]))
                if "any" in value:
                    out.append(Condition(field, "in", list(value["any"])))
                if "except" in value:
                    out.append(Condition(field, "nin", list(value["except"])))
                if "text" in value:
                    out.append(Condition(field, "contains", value["text"]))
            elif name == "range":
                out += _bounds(field, value)
            elif name == "text":
                out += [Condition(field, {"contains": "contains", "prefix": "starts_with", "suffix": "ends_with"}[k], v) for k, v in value.items()]
            elif name == "values_count":
                out.append(Condition(field, "count", dict(value)))
            elif name in ("is_null", "is_empty", "exists"):
                op = {"is_null": "is_null", "is_empty": "is_empty", "exists": "is_not_null"}[name]
                test = Condition(field, op)
                out.append(test if value else none_of(test))
            elif name == "geo_radius":
                center = value["center"]
                out.append(Condition(field, "geo_radius", {"lat": center["lat"], "lon": center["lon"], "km": value["radius"] / 1000}))
            elif name == "geo_bounding_box":
                top, bottom = value["top_left"], value["bottom_right"]
                out.append(Condition(field, "geo_box", {"top": top["lat"], "left": top["lon"], "bottom": bottom["lat"], "right": bottom["lon"]}))
            elif name == "geo_polygon":
                out.append(Condition(field, "geo_polygon", {"exterior": [(p["lat"], p["lon"]) for p in value["exterior"]["points"]]}))
        return out[0] if len(out) == 1 else all_of(*out)
    parts: list[Any] = [from_clauses(c) for c in node.get("must", ())]
    if node.get("should"):
        options = [from_clauses(c) for c in node["should"]]
        parts.append(at_least(node["min_should_match"], *options) if "min_should_match" in node else any_of(*options))
    if node.get("must_not"):
        parts.append(none_of(*[from_clauses(c) for c in node["must_not"]]))
    if "nested" in node:
        inner = node["nested"]
        parts.append(_under(inner["key"], from_clauses(inner["filter"])))
    return all_of(*parts)


def _under(prefix: str, node):
    if isinstance(node, Condition):
        return Condition(f"{prefix}.{node.field}", node.op, node.value)
    return Group(node.kind, tuple(_under(prefix, p) for p in node.parts), node.least)


def from_mapping(node: Mapping) -> Condition | Group:
    """The document form: {field: value}, {field: {"$gte": 1, "$lt": 5}}, $and, $or, $not, and the clauses of ``from_clauses``."""
    parts: list[Any] = []
    clauses = {k: v for k, v in node.items() if k in ("must", "should", "must_not", "min_should_match", "key", "match", "range", "nested")}
    if clauses:
        parts.append(from_clauses(clauses))
    for name, value in node.items():
        if name in clauses:
            continue
        if name in ("$and", "$or"):
            parts.append(Group(name[1:], tuple(from_mapping(v) for v in value)))
        elif name == "$not":
            parts.append(none_of(from_mapping(value)))
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op == "$exists":
                    parts.append(Condition(name, "is_not_null" if operand else "is_null"))
                elif op in _MONGO:
                    parts.append(Condition(name, _MONGO[op], operand))
                else:
                    raise FilterError(f"unknown operator {op}")
        else:
            parts.append(Condition(name, "eq", value))
    return parts[0] if len(parts) == 1 else all_of(*parts)


def from_message(node: Mapping) -> Condition | Group:
    """The remote-call form: must, should, must_not lists of {"field": {"key", "match" | "range" | "values"}} or {"filter": ...}."""
    def one(part: Mapping):
        if "filter" in part:
            return from_message(part["filter"])
        field = part["field"]
        out: list[Any] = []
        if "match" in field:
            out.append(Condition(field["key"], "eq", field["match"]))
        if "range" in field:
            out += [Condition(field["key"], k, v) for k, v in field["range"].items() if v is not None]
        if "values" in field:
            out.append(Condition(field["key"], "in", list(field["values"])))
        return all_of(*out)

    parts = [one(p) for p in node.get("must", ())]
    if node.get("should"):
        parts.append(any_of(*[one(p) for p in node["should"]]))
    if node.get("must_not"):
        parts.append(none_of(*[one(p) for p in node["must_not"]]))
    return all_of(*parts)


def fields_of(node: Condition | Group | None) -> list[Condition]:
    """All conditions of a tree."""
    if node is None:
        return []
    return [node] if isinstance(node, Condition) else [c for p in node.parts for c in fields_of(p)]


def validate(node: Condition | Group | None) -> None:
    """Raise ``FilterError`` for unknown operators, empty field names and lists that are none."""
    for c in fields_of(node):
        if not c.field:
            raise FilterError("a condition without a field")
        if c.op not in OPERATORS:
            raise FilterError(f"unknown operator {c.op}")
        if c.op in ("in", "nin", "all") and (isinstance(c.value, str) or not isinstance(c.value, Sequence)):
            raise FilterError(f"{c.op} takes a list")
        if c.op == "range" and (not isinstance(c.value, Sequence) or len(c.value) != 2):
            raise FilterError("range takes two bounds")
