"""Staging rules as read-only T-SQL text. Patterns and row tests have no translation and leave warnings."""

from __future__ import annotations

import re

from veritab.functions.text import trim_text
from veritab.sources.contracts import conditional_rules, csv_options

SAFE_TYPE = re.compile(r"^(bigint|int|smallint|tinyint|bit|uniqueidentifier|date|datetime2(\([0-7]\))?|n?varchar\(([1-9]\d{0,3}|max)\))$", re.IGNORECASE)


def name(x: str) -> str:
    if not x.strip():
        raise ValueError("an identifier cannot be blank")
    return "[" + x.replace("]", "]]") + "]"


def text(x: str) -> str:
    return "N'" + str(x).replace("'", "''") + "'"


def script(contract: dict) -> dict:
    """{sql, rule_count, warnings}"""
    target, o, columns = contract.get("sqlServer"), csv_options(contract), contract["schema"]["columns"]
    if not target:
        raise ValueError("the contract has no sqlServer target")
    limit = target.get("detailLimit", 100)
    if not isinstance(limit, int) or not 1 <= limit <= 10_000:
        raise ValueError("sqlServer.detailLimit must be from 1 to 10000")
    scope = target.get("scope")
    for c in [*target.get("rowLocator", []), *([scope["column"]] if scope else [])]:
        if c not in columns:
            raise ValueError(f'sqlServer references undeclared column "{c}"')
    if scope and (not SAFE_TYPE.match(scope["sqlType"]) or not re.match(r"^[A-Za-z_][A-Za-z0-9_]*$", scope["parameter"])):
        raise ValueError("the scope needs a plain parameter name and one of the allowed types")

    def raw(c: str, alias: str = "t") -> str:
        return f"CONVERT(nvarchar(max), {alias}.{name(c)})"

    def normal(c: str, alias: str = "t") -> str:
        x = f"LTRIM(RTRIM({raw(c, alias)}))" if o["trimValues"] else raw(c, alias)
        return f"{x} COLLATE Latin1_General_100_BIN2" if o["caseSensitive"] else f"LOWER({x})"

    def value(v) -> str:
        v = trim_text(str(v)) if o["trimValues"] else str(v)
        return text(v if o["caseSensitive"] else v.lower())

    def several(values) -> str:
        return "(" + ", ".join(map(value, values)) + ")"

    def tree(node: dict) -> str:
        for many, word in (("all", " AND "), ("any", " OR ")):
            if many in node:
                return "(" + word.join(map(tree, node[many])) + ")"
        c, op = node["column"], node["operator"]
        for x in (c, node.get("otherColumn", c)):
            if x not in columns:
                raise ValueError(f'predicate references undeclared column "{x}"')
        if op in ("isNull", "notNull"):
            return f"t.{name(c)} IS {'' if op == 'isNull' else 'NOT '}NULL"
        blank = f"LTRIM(RTRIM({raw(c)}))"
        other = node.get("otherColumn", c)
        body = {
            "equals": lambda: f"{normal(c)} = {value(node['value'])}", "notEquals": lambda: f"{normal(c)} <> {value(node['value'])}", "in": lambda: f"{normal(c)} IN {several(node['values'])}",
            "notIn": lambda: f"{normal(c)} NOT IN {several(node['values'])}", "isBlank": lambda: f"{blank} = N''", "notBlank": lambda: f"{blank} <> N''",
            "equalsColumn": lambda: f"t.{name(other)} IS NOT NULL AND {normal(c)} = {normal(other)}", "notEqualsColumn": lambda: f"t.{name(other)} IS NOT NULL AND {normal(c)} <> {normal(other)}",
        }[op]()
        return f"(t.{name(c)} IS NOT NULL AND {body})"

    where = f"CONVERT(nvarchar(max), t.{name(scope['column'])}) = CONVERT(nvarchar(max), @{scope['parameter']})" if scope else "1 = 1"
    table = f"{name(target['schema'])}.{name(target['table'])}"

    def repeated(keys: list[str]) -> str:
        same = " AND ".join(f"{normal(k, 'd')} = {normal(k)}" for k in keys)
        within = f"CONVERT(nvarchar(max), d.{name(scope['column'])}) = CONVERT(nvarchar(max), @{scope['parameter']}) AND " if scope else ""
        return f"EXISTS (SELECT 1 FROM {table} AS d WHERE {within}{same} HAVING COUNT_BIG(*) > 1)"

    rules, warnings = [], []
    for c, definition in columns.items():
        want = definition.get("constraints") or {}
        empty = f"(t.{name(c)} IS NULL" + (f" OR {normal(c)} IN {several(o['nullValues'])})" if o["nullValues"] else ")")
        size = f"LEN({raw(c)} + N'#') - 1"
        for kind, key, violation in (
            ("not-null", "notNull", lambda n: empty), ("min-length", "minLength", lambda n: f"NOT {empty} AND {size} < {n}"), ("max-length", "maxLength", lambda n: f"NOT {empty} AND {size} > {n}"),
            ("allowed-values", "allowedValues", lambda v: f"NOT {empty} AND {normal(c)} NOT IN {several(v)}"), ("unique", "unique", lambda n: f"NOT {empty} AND {repeated([c])}"),
        ):
            n = want.get(key)
            if n is not None and n is not False and n != []:
                rules.append((f"{c}.{kind}", f"{c}: {kind}", "error", violation(n)))
        for own in want.get("checks") or {}:
            warnings.append(f"The check {own} of {c} has no translation.")
        if want.get("matches"):
            warnings.append(f"The pattern of {c} has no translation.")
    identity = contract.get("identity")
    if identity and identity.get("unique", True):
        rules.append(("identity.unique", "identity: unique", "error", repeated(identity["columns"])))
    for r in conditional_rules(contract):
        rules.append((r["id"], r.get("name", r["id"]), r.get("severity", "error"), f"{tree(r['when']) if r.get('when') else '1 = 1'} AND NOT {tree(r['expect'])}"))
    if contract.get("rowTests"):
        warnings.append("Row tests have no translation.")
    if not rules:
        raise ValueError("the contract has no rules to translate")
    lines = ["-- Read-only validation: SELECT statements alone.", "SET NOCOUNT ON;", ""]
    if scope:
        p = f"@{scope['parameter']}"
        lines += [f"DECLARE {p} {scope['sqlType']} = NULL; -- required", f"IF {p} IS NULL THROW 50001, 'Set {p} first.', 1;", ""]
    for k, (rule, said, severity, violation) in enumerate(rules):
        lines += ["UNION ALL SELECT" if k else "SELECT", f"  {text(rule)} AS RuleId, {text(said)} AS RuleName, {text(severity)} AS Severity,"]
        lines.append(f"  (SELECT COUNT_BIG(*) FROM {table} AS t WHERE ({where}) AND ({violation})) AS FailureCount")
    lines.append("ORDER BY Severity, RuleId;")
    locator = "".join(f"t.{name(c)}, " for c in target.get("rowLocator", []))
    for rule, _, _, violation in rules:
        lines += ["", f"SELECT TOP ({limit}) {text(rule)} AS RuleId, {locator}t.*", f"FROM {table} AS t", f"WHERE ({where}) AND ({violation});"]
    lines += [""] + [f"-- WARNING: {w}" for w in warnings] if warnings else []
    return {"sql": "\n".join(lines) + "\n", "rule_count": len(rules), "warnings": warnings}
