"""Rules in JSON that emit tags, compiled to columns.

A rule has conditions (table, column, op, value, logic, refer, group) and a tag template. Each rule
becomes one expression of type array<string> over a row that holds singular objects (structs,
null if absent) and plural ones (arrays of structs), so all rules run over all rows in one pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Objects = Mapping[str, Column]


def _double(x: Column) -> Column:
    return x.cast("string").try_cast("double")


def _equal(actual: Column, expected: Column) -> Column:
    """As numbers if both are, else as texts."""
    return F.coalesce(_double(actual) == _double(expected), actual.cast("string") == expected.cast("string"), F.lit(False))


def check(actual: Column, op: str, expected, is_text: bool | None = None) -> Column:
    """One comparison, never null. expected: a literal, a list (for in) or a Column; is_text: whether the column holds text, for in, which doesn't convert."""
    if expected is None and op in ("==", "!="):
        return actual.isNull() if op == "==" else actual.isNotNull()
    if op == "in":
        items = expected if isinstance(expected, list) else [expected]
        texts, others = [x for x in items if isinstance(x, str)], [x for x in items if x is not None and not isinstance(x, str)]
        as_text = actual.cast("string").isin(*texts) if texts and is_text is not False else F.lit(False)
        as_number = _double(actual).isin(*[float(x) for x in others]) if others and not is_text else F.lit(False)
        return F.coalesce(as_text | as_number, F.lit(False))
    other = expected if isinstance(expected, Column) else F.lit(expected)
    if op == "contains":
        return F.coalesce(F.contains(actual.cast("string"), other.cast("string")), F.lit(False))
    if op in ("==", "!="):
        same = _equal(actual, other)
        return actual.isNotNull() & (same if op == "==" else ~same)
    ordered: dict[str, Callable] = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
    if op in ordered:
        return F.coalesce(ordered[op](_double(actual), _double(other)), F.lit(False))
    return F.lit(False)


def _fold(results: Sequence[tuple[str, Column]]) -> Column:
    """From left to right, without precedence."""
    return reduce(lambda a, b: a | b[1] if b[0] == "OR" else a & b[1], results[1:], results[0][1])


class _Scope:
    """What conditions and templates can see: objects by table name, and the types of their text columns."""

    def __init__(self, objects: Objects, texts: frozenset[str]):
        self.objects, self.texts = objects, texts

    def value(self, table: str, column: str) -> Column | None:
        return self.objects[table][column] if table in self.objects else None

    def test(self, cond: dict) -> Column:
        table = cond.get("table", "")
        if table not in self.objects:
            return F.lit(False)
        expected = cond.get("value")
        if isinstance(expected, dict) and {"table", "column"} <= set(expected):
            expected = self.value(expected["table"], expected["column"])
        ok = check(self.value(table, cond["column"]), cond.get("op", "=="), expected, cond["column"] in self.texts)
        return ok & self.objects[table].isNotNull()

    def results(self, conditions: Sequence[dict]) -> tuple[Column, dict[str, Column]]:
        """Whether the conditions hold, and the values they name (null where the naming condition fails)."""
        tests = [(c.get("logic", "AND"), self.test(c)) for c in conditions]
        refers: dict[str, Column] = {}
        for cond, (_, ok) in zip(conditions, tests, strict=True):
            if cond.get("refer") and cond.get("table") in self.objects:
                value = F.when(ok, self.value(cond["table"], cond["column"]).cast("string"))
                refers[cond["refer"]] = F.coalesce(value, refers[cond["refer"]]) if cond["refer"] in refers else value
        return _fold(tests), refers


def render(template: str, refers: Mapping[str, Column]) -> Column:
    """{name} is replaced with the value of that name, or with nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else F.coalesce(refers[p], F.lit("")) if p in refers else F.lit("") for i, p in enumerate(parts)]
    return F.concat(*pieces)


def compile_rule(config: dict, singular: Objects, plural: Objects, texts: Sequence[str] = ()) -> Column:
    """The rule's tags for a row. Raises on configurations that can't be compiled."""
    conditions, template = config.get("conditions") or [], config.get("tag_template") or ""
    none = F.array().cast("array<string>")
    if not conditions or not template:
        return none
    known = frozenset(texts)
    alone = [c for c in conditions if c.get("table") not in plural]
    rows = [c for c in conditions if c.get("table") in plural]
    ok, refers = _Scope(singular, known).results(alone) if alone else (F.lit(True), {})

    def meeting(table: str, own: list[dict]) -> Column:
        """The rows of a plural object that meet the conditions."""
        return F.filter(plural[table], lambda x: _Scope({**singular, table: x}, known).results(own)[0])

    def rendered(table: str, own: list[dict]) -> Column:
        """A tag for each of them."""
        return F.transform(meeting(table, own), lambda x: render(template, {**refers, **_Scope({**singular, table: x}, known).results(own)[1]}))

    tables = list(dict.fromkeys(c["table"] for c in rows))
    if not rows:
        tags = F.array(render(template, refers))
    elif any(c.get("group") is not None for c in rows):
        # each group takes the first row that meets it
        for table in tables:
            own = [c for c in rows if c["table"] == table]
            for group in dict.fromkeys(c.get("group", 0) for c in own):
                mine = [c for c in own if c.get("group", 0) == group]
                first = F.get(meeting(table, mine), F.lit(0))
                refers = {**refers, **_Scope({**singular, table: first}, known).results(mine)[1]}
                ok = ok & first.isNotNull()
        tags = F.array(render(template, refers))
    else:
        parts = []
        for table in tables:
            mine = [c for c in rows if c["table"] == table]
            parts.append(rendered(table, mine))
        tags = F.concat(*[F.coalesce(p, none) for p in parts])
    return F.when(ok, F.filter(tags, lambda x: x != "")).otherwise(none)


def run_rules(rows: DataFrame, rules: Sequence[dict], singular: Objects, plural: Objects, texts: Sequence[str] = ()) -> DataFrame:
    """rows with `tags`: those of all enabled rules, in order of (priority, id). rules: id, priority, enabled, config (JSON text or dict). A rule that can't be compiled is skipped."""
    tags = []
    for rule in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (r.get("priority", 0), r["id"])):
        try:
            config = json.loads(rule["config"]) if isinstance(rule["config"], str) else rule["config"]
            tags.append(compile_rule(config, singular, plural, texts))
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return rows.withColumn("tags", F.concat(*tags) if tags else F.array().cast("array<string>"))
