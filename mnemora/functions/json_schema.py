"""JSON Schema, compiled into one expression over a VARIANT column: all faults of a record, each with its path.

`faults(schema, value)` gives an array of "path: keyword" texts in the order of paths; an empty array is a record that conforms. The
compiler knows the keywords that record schemas of a store use (draft 2020-12) and refuses a schema with any other, or with a
reference to itself, so that no rule is silently left out. The record is parsed once and each value below it is read once, with its
type: a place is the variable of a lambda, so the rules of a place share its value and nothing above it is computed again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions.text import instant

_NOTES = {"$schema", "$id", "$defs", "title", "description", "$comment", "default", "examples"}
_TYPES = {"object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}
NONE = "cast(array() as array<string>)"


@dataclass(frozen=True)
class _At:
    """A place in a record: its variant and the variant's type, both computed, and the text that names it in faults."""

    value: Column
    kind: Column
    shown: Column

    def held(self, key: str) -> Column:
        """The variant below a key; null where there is no such key."""
        return F.try_variant_get(self.value, f"$['{key}']", "variant")

    def as_(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def is_(self, kind: str) -> Column:
        if kind == "integer":
            n = self.as_("double")
            return self.is_("number") & (n == F.floor(n))
        return F.coalesce(self.kind.rlike(_TYPES[kind]), F.lit(False))

    def keys(self) -> Column:
        return F.map_keys(self.as_("map<string,variant>"))


def _bound(value: Column, shown: Column, found: Callable[[_At], Column]) -> Column:
    """What is found at the place of a value, which is computed once however often the rules read it."""
    held = F.transform(F.array(value), lambda v: F.struct(v.alias("value"), F.schema_of_variant(v).alias("kind")))
    return F.get(F.transform(held, lambda x: found(_At(x["value"], x["kind"], shown))), F.lit(0))


def _none() -> Column:
    return F.expr(NONE)


def _fault(at: _At, keyword: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.array(F.concat(at.shown, F.lit(f": {keyword}")))).otherwise(_none())


def _equals(at: _At, value) -> Column:
    if isinstance(value, bool):
        return at.is_("boolean") & (at.as_("boolean") == F.lit(value))
    if value is None:
        return at.is_("null")
    if isinstance(value, (int, float)):
        return at.is_("number") & (at.as_("double") == F.lit(float(value)))
    if isinstance(value, str):
        return at.is_("string") & (at.as_("string") == F.lit(value))
    raise ValueError(f"not a scalar: {value!r}")


def _has_path(key: str) -> bool:
    return "'" not in key and "\\" not in key


def _path_key(key: str) -> str:
    if not _has_path(key):
        raise ValueError(f"cannot be read by path: {key!r}")
    return key


class _Compiler:
    def __init__(self, schema):
        self.whole, self.open = schema, ()

    def resolve(self, reference: str):
        if not reference.startswith("#/"):
            raise ValueError(f"not a reference into the schema: {reference}")
        found = self.whole
        for part in reference[2:].split("/"):
            found = found[part.replace("~1", "/").replace("~0", "~")]
        return found

    def node(self, schema, at: _At) -> Column:
        """The faults of the value at a place that is there."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return _fault(at, "false", F.lit(True))
        unknown = set(schema) - _NOTES - {k for k in schema if hasattr(self, f"rule_{k.replace('$', '')}")} - {"then", "else"}
        if unknown:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")
        parts = [getattr(self, f"rule_{k.replace('$', '')}")(schema, at) for k in schema if k not in _NOTES and k not in ("then", "else")]
        return F.concat(*parts) if parts else _none()

    def holds(self, schema, at: _At) -> Column:
        return F.size(self.node(schema, at)) == 0

    def rule_ref(self, s, at):
        if s["$ref"] in self.open:
            raise ValueError(f"a schema that refers to itself: {s['$ref']}")
        self.open = (*self.open, s["$ref"])
        out = self.node(self.resolve(s["$ref"]), at)
        self.open = self.open[:-1]
        return out

    def rule_type(self, s, at):
        kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
        ok = F.lit(False)
        for k in kinds:
            ok = ok | at.is_(k)
        return _fault(at, "type", ~ok)

    def rule_const(self, s, at):
        return _fault(at, "const", ~F.coalesce(_equals(at, s["const"]), F.lit(False)))

    def rule_enum(self, s, at):
        ok = F.lit(False)
        for value in s["enum"]:
            ok = ok | F.coalesce(_equals(at, value), F.lit(False))
        return _fault(at, "enum", ~ok)

    def _of(self, s, at, keyword: str, kind: str, bad) -> Column:
        """A rule for values of one type only."""
        return F.when(at.is_(kind), _fault(at, keyword, bad(s[keyword]))).otherwise(_none())

    def rule_pattern(self, s, at):
        # (?d): $ also stands before a last line feed, and before no other line break
        return self._of(s, at, "pattern", "string", lambda p: ~at.as_("string").rlike(f"(?d){p}"))

    def rule_minLength(self, s, at):
        return self._of(s, at, "minLength", "string", lambda n: F.length(at.as_("string")) < n)

    def rule_maxLength(self, s, at):
        return self._of(s, at, "maxLength", "string", lambda n: F.length(at.as_("string")) > n)

    def rule_minimum(self, s, at):
        return self._of(s, at, "minimum", "number", lambda n: at.as_("double") < n)

    def rule_maximum(self, s, at):
        return self._of(s, at, "maximum", "number", lambda n: at.as_("double") > n)

    def rule_format(self, s, at):
        good = {"date-time": lambda x: instant(x).isNotNull(), "date": lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()}.get(s["format"])
        return _none() if good is None else self._of(s, at, "format", "string", lambda _: ~F.coalesce(good(at.as_("string")), F.lit(False)))

    def rule_required(self, s, at):
        by_path = [k for k in s["required"] if _has_path(k)]
        missing = [F.when(at.held(k).isNull(), F.lit(k)) for k in by_path]
        named = F.array_compact(F.array(*missing)) if missing else _none()
        if rest := [k for k in s["required"] if not _has_path(k)]:
            named = F.concat(named, F.array_except(F.array(*map(F.lit, rest)), at.keys()))
        return F.when(at.is_("object"), F.transform(named, lambda k: F.concat(at.shown, F.lit(": required "), k))).otherwise(_none())

    def rule_minProperties(self, s, at):
        return self._of(s, at, "minProperties", "object", lambda n: F.size(at.keys()) < n)

    def rule_properties(self, s, at):
        def of(k: str, sub) -> Column:
            shown = F.concat(at.shown, F.lit(f".{k}"))
            return _bound(at.held(_path_key(k)), shown, lambda x: F.when(x.value.isNotNull(), self.node(sub, x)).otherwise(_none()))

        parts = [of(k, sub) for k, sub in s["properties"].items() if sub is not True and sub != {}]
        return F.when(at.is_("object"), F.concat(*parts) if parts else _none()).otherwise(_none())

    def rule_additionalProperties(self, s, at):
        sub, known = s["additionalProperties"], list(s.get("properties", {}))
        if sub is True:
            return _none()
        rest = F.array_sort(F.array_except(at.keys(), F.array(*map(F.lit, known)) if known else _none()))
        if sub is False:
            return F.when(at.is_("object"), F.transform(rest, lambda k: F.concat(at.shown, F.lit(": additionalProperties "), k))).otherwise(_none())
        held = at.as_("map<string,variant>")
        each = F.transform(rest, lambda k: _bound(F.element_at(held, k), F.concat(at.shown, F.lit("."), k), lambda x: self.node(sub, x)))
        return F.when(at.is_("object"), F.flatten(each)).otherwise(_none())

    def rule_items(self, s, at):
        each = F.transform(at.as_("array<variant>"), lambda x, i: _bound(x, F.concat(at.shown, F.lit("."), i.cast("string")), lambda one: self.node(s["items"], one)))
        return F.when(at.is_("array"), F.flatten(each)).otherwise(_none())

    def rule_minItems(self, s, at):
        return self._of(s, at, "minItems", "array", lambda n: F.size(at.as_("array<variant>")) < n)

    def rule_maxItems(self, s, at):
        return self._of(s, at, "maxItems", "array", lambda n: F.size(at.as_("array<variant>")) > n)

    def rule_uniqueItems(self, s, at):
        if not s["uniqueItems"]:
            return _none()
        said = F.transform(at.as_("array<variant>"), lambda x: F.to_json(x))  # keys of a variant are in order
        return self._of(s, at, "uniqueItems", "array", lambda _: F.size(F.array_distinct(said)) < F.size(said))

    def rule_allOf(self, s, at):
        return F.concat(*[self.node(sub, at) for sub in s["allOf"]])

    def rule_anyOf(self, s, at):
        ok = F.lit(False)
        for sub in s["anyOf"]:
            ok = ok | self.holds(sub, at)
        return _fault(at, "anyOf", ~ok)

    def rule_oneOf(self, s, at):
        n = F.lit(0)
        for sub in s["oneOf"]:
            n = n + self.holds(sub, at).cast("int")
        return _fault(at, "oneOf", n != 1)

    def rule_not(self, s, at):
        return _fault(at, "not", self.holds(s["not"], at))

    def rule_if(self, s, at):
        then, other = (self.node(s[k], at) if k in s else _none() for k in ("then", "else"))
        return F.when(self.holds(s["if"], at), then).otherwise(other)


def faults(schema: dict | bool | str, value: Column) -> Column:
    """All faults of a VARIANT value, sorted and each once; null where the value is null."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    return _bound(value, F.lit("$"), lambda at: F.when(at.value.isNotNull(), F.array_sort(F.array_distinct(_Compiler(schema).node(schema, at)))))


def json_faults(schema: dict | bool | str, text: Column) -> Column:
    """All faults of a JSON text; a text that is no JSON has the one fault of the whole."""
    return F.coalesce(faults(schema, F.try_parse_json(text)), F.array(F.lit("$: json")))
