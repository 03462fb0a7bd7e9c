"""Staging rules: constraints and conditional rules as violations, counted in one scan, with bounded samples.

Nulls here are SQL nulls; markers count as nulls only in not-null rules and in the guards of a column's constraints. Blanks are
trimmed as U+0020 only, literals as any white space. A column's unique rule and the identity rule count every member of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import patterns
from veritab.functions.text import all_of, any_of, length, trim_text
from veritab.operators.validate import registered
from veritab.sources.contracts import check_predicate, conditional_rules, csv_options


@dataclass
class Rule:
    id: str
    name: str
    severity: str
    violation: Column | None
    keys: list[str] | None = None


def _options(contract: dict) -> tuple[bool, bool, list[str]]:
    o = csv_options(contract)
    return o["trimValues"], o["caseSensitive"], o["nullValues"]


def normal(c: Column, trim: bool, cased: bool) -> Column:
    c = F.trim(c.cast("string")) if trim else c.cast("string")
    return c if cased else F.lower(c)


def literal(s, trim: bool, cased: bool) -> str:
    s = trim_text(str(s)) if trim else str(s)
    return s if cased else s.lower()


def predicate(node: dict, contract: dict) -> Column:
    """A predicate tree as a condition that is never null: a leaf with a null operand is false."""
    trim, cased, _ = _options(contract)
    declared = contract["schema"]["columns"]
    if "all" in node:
        return all_of(predicate(x, contract) for x in node["all"])
    if "any" in node:
        return any_of(predicate(x, contract) for x in node["any"])
    for name in (node["column"], node.get("otherColumn", node["column"])):
        if name not in declared:
            raise ValueError(f'predicate references undeclared column "{name}"')
    c = F.col(f"`{node['column']}`").cast("string")
    n, op = normal(c, trim, cased), node["operator"]
    value = lambda v: literal(v, trim, cased)
    if op in ("isNull", "notNull"):
        return c.isNull() if op == "isNull" else c.isNotNull()
    if op in ("equalsColumn", "notEqualsColumn"):
        other = F.col(f"`{node['otherColumn']}`").cast("string")
        same = n == normal(other, trim, cased)
        holds, guard = (same if op == "equalsColumn" else ~same), c.isNotNull() & other.isNotNull()
    else:
        holds = {
            "equals": lambda: n == value(node["value"]), "notEquals": lambda: n != value(node["value"]), "in": lambda: n.isin([value(v) for v in node["values"]]),
            "notIn": lambda: ~n.isin([value(v) for v in node["values"]]), "isBlank": lambda: F.trim(c) == "", "notBlank": lambda: F.trim(c) != "",
        }[op]()
        guard = c.isNotNull()
    return guard & F.coalesce(holds, F.lit(False))


def is_null(c: Column, contract: dict) -> Column:
    trim, cased, markers = _options(contract)
    return c.isNull() | F.coalesce(normal(c, trim, cased).isin([literal(m, trim, cased) for m in markers]), F.lit(False))


def rules_of(contract: dict) -> list[Rule]:
    """Column rules in declared order, then identity, then conditional rules. Patterns and registered checks run here too; only the SQL text leaves them out."""
    trim, cased, _ = _options(contract)
    target = contract.get("sqlServer") or {}
    for column in [*target.get("rowLocator", []), *([target["scope"]["column"]] if target.get("scope") else [])]:
        if column not in contract["schema"]["columns"]:
            raise ValueError(f'sqlServer references undeclared column "{column}"')
    out = []
    for name, definition in contract["schema"]["columns"].items():
        want = definition.get("constraints") or {}
        c = F.col(f"`{name}`").cast("string")
        empty = is_null(c, contract)
        add = lambda kind, said, v=None, keys=None: out.append(Rule(f"{name}.{kind}", said, "error", v, keys))  # noqa: E731, B023
        if want.get("notNull"):
            add("not-null", f"{name} must not be null", empty)
        if want.get("minLength") is not None:
            add("min-length", f"{name} must have at least {want['minLength']} characters", ~empty & (length(c) < want["minLength"]))
        if want.get("maxLength") is not None:
            add("max-length", f"{name} must have at most {want['maxLength']} characters", ~empty & (length(c) > want["maxLength"]))
        if want.get("allowedValues"):
            add("allowed-values", f"{name} must be an allowed value", ~empty & ~normal(c, trim, cased).isin([literal(v, trim, cased) for v in want["allowedValues"]]))
        if want.get("matches"):
            add("matches", f"{name} must match {want['matches']}", ~empty & ~(F.trim(c) if trim else c).rlike(patterns.to_java(want["matches"], not cased)))
        for own, parameter in (want.get("checks") or {}).items():
            check = registered(own)
            if check is None:
                raise ValueError(f'check "{own}" is not registered')
            add(f"check-{own}", check.message(name, parameter), ~empty & F.coalesce(check.fails(normal(c, trim, cased), parameter), F.lit(False)))
        if want.get("unique"):
            add("unique", f"{name} must be unique", ~empty, [name])
    identity = contract.get("identity")
    if identity and identity.get("unique", True):
        out.append(Rule("identity.unique", "identity must be unique", "error", all_of(F.col(f"`{c}`").isNotNull() for c in identity["columns"]), identity["columns"]))
    for rule in conditional_rules(contract):
        check_predicate(rule["expect"], rule["id"])
        when = predicate(rule["when"], contract) if rule.get("when") else F.lit(True)
        out.append(Rule(rule["id"], rule.get("name", rule["id"]), rule.get("severity", "error"), when & ~predicate(rule["expect"], contract)))
    if not out:
        raise ValueError("the contract has no rules to run")
    return out


def scoped(df: DataFrame, contract: dict, value: str | None) -> DataFrame:
    scope = (contract.get("sqlServer") or {}).get("scope")
    if not scope:
        return df
    if value is None:
        raise ValueError(f"a value for scope column {scope['column']} is required")
    return df.where(F.col(f"`{scope['column']}`").cast("string") == F.lit(str(value)))


def _key(rule: Rule, contract: dict) -> Column:
    trim, cased, _ = _options(contract)
    return F.when(rule.violation, F.array(*(normal(F.col(f"`{c}`"), trim, cased) for c in rule.keys)))


def rule_summary(df: DataFrame, contract: dict, scope: str | None = None) -> DataFrame:
    """(rule_id, rule_name, severity, failure_count). One scan counts all row rules; one shuffle on (rule, key) all unique rules."""
    rules, df = rules_of(contract), scoped(df, contract, scope)
    plain, unique = [r for r in rules if not r.keys], [r for r in rules if r.keys]
    named = lambda r: (F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"))
    parts = []
    if plain:
        sums = df.agg(*(F.count_if(r.violation).alias(f"r{k}") for k, r in enumerate(plain)))
        parts.append(sums.select(F.inline(F.array(*(F.struct(*named(r), F.col(f"r{k}").alias("failure_count")) for k, r in enumerate(plain))))))
    if unique:
        keys = F.array(*(F.struct(F.lit(k).alias("k"), _key(r, contract).alias("key")) for k, r in enumerate(unique)))
        groups = df.select(F.inline(keys)).where("key is not null").groupBy("k", "key").agg(F.count("*").alias("n"))
        sums = groups.agg(*(F.coalesce(F.sum(F.when((F.col("k") == k) & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias(f"r{k}") for k in range(len(unique))))
        parts.append(sums.select(F.inline(F.array(*(F.struct(*named(r), F.col(f"r{k}").alias("failure_count")) for k, r in enumerate(unique))))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rule_samples(df: DataFrame, contract: dict, locator: list[str], scope: str | None = None, limit: int | None = 100) -> DataFrame:
    """At most ``limit`` failing rows of each rule, the first by ``locator`` (which must tell rows apart), with all columns; all of them, unranked, if None.

    Row rules: a bounded top-n per rule and task precedes the shuffle (Spark's window group limit). Unique rules join with repeated keys.
    """
    rules, df = rules_of(contract), scoped(df, contract, scope)
    names = [f"`{c}`" for c in df.columns]
    plain, unique = [r for r in rules if not r.keys], [r for r in rules if r.keys]
    parts = []
    if plain:
        failed = F.array_compact(F.array(*(F.when(r.violation, F.lit(r.id)) for r in plain)))
        parts.append(df.where(any_of(r.violation for r in plain)).select(F.explode(failed).alias("rule_id"), *names))
    for r in unique:
        keyed = df.withColumn("_key", _key(r, contract)).where("_key is not null")
        twice = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"))
        parts.append(keyed.join(twice, F.col("_key") == F.col("_k"), "left_semi").select(F.lit(r.id).alias("rule_id"), *names))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    front = [f"`{c}`" for c in locator]
    if limit is None:
        return rows.select("rule_id", *front, *(n for n in names if n not in front))
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy(*(F.col(f"`{c}`") for c in locator)))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).select("rule_id", *front, *(n for n in names if n not in front))
