"""Contracts: YAML 1.2 text to checked dictionaries and back."""

from __future__ import annotations

import re

import yaml

OPERATORS = ("equals", "notEquals", "in", "notIn", "isNull", "notNull", "isBlank", "notBlank", "equalsColumn", "notEqualsColumn")
ID = re.compile(r"^[a-z0-9][a-z0-9._-]*$")


class ContractError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    """YAML 1.2 core: only true/false, null, decimal, 0o and 0x integers and floats are resolved; `yes` and dates stay texts."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
):
    _Loader.add_implicit_resolver(_tag, re.compile(_pattern), list(_first))


def _integer(loader, node):
    s = loader.construct_scalar(node)
    return int(s, 8 if s.startswith("0o") else 16 if s.startswith("0x") else 10) if not s.startswith("0o") else int(s[2:], 8)


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)

# The keys of a contract's parts.
_KEYS = {
    "contract": {"version", "name", "description", "targets", "csv", "identity", "schema", "rowTests", "sqlServer", "conditionalRules", "importedSchema"},
    "csv": {"delimiter", "quote", "encoding", "header", "nullValues", "trimValues", "caseSensitive", "allowBlankRows", "allowRaggedRows"},
    "schema": {"columns", "rowCount", "columnCount", "allowAdditionalColumns"},
    "column": {"presence", "description", "constraints"},
    "constraints": {"notNull", "unique", "minLength", "maxLength", "allowedValues", "matches", "checks"},
    "rowTest": {"id", "name", "description", "select", "expect"},
    "count": {"exact", "min", "max"},
    "rule": {"id", "name", "description", "severity", "when", "expect"},
    "identity": {"columns", "unique"},
}


def _known(node, kind: str, where: str) -> None:
    if not isinstance(node, dict):
        raise ContractError(f"{where} must be a mapping")
    if extra := set(node) - _KEYS[kind]:
        raise ContractError(f"{where} has unknown keys: {', '.join(sorted(map(str, extra)))}")


def _count(node, where: str) -> None:
    _known(node, "count", where)
    if not node or any(not isinstance(v, int) or isinstance(v, bool) or v < 0 for v in node.values()):
        raise ContractError(f"{where} needs exact, min or max as whole numbers from 0")


def check_predicate(node, where: str) -> None:
    if not isinstance(node, dict):
        raise ContractError(f"{where} must be a predicate")
    for many in ("all", "any"):
        if many in node:
            if not isinstance(node[many], list) or not node[many]:
                raise ContractError(f"{where}.{many} must not be empty")
            for k, x in enumerate(node[many]):
                check_predicate(x, f"{where}.{many}[{k}]")
            return
    if node.get("operator") not in OPERATORS or not node.get("column"):
        raise ContractError(f"{where} needs a column and one of the operators {', '.join(OPERATORS)}")
    needs = {"equals": "value", "notEquals": "value", "in": "values", "notIn": "values", "equalsColumn": "otherColumn", "notEqualsColumn": "otherColumn"}.get(node["operator"])
    if needs and (node.get(needs) is None or node[needs] == []):
        raise ContractError(f"{where}: {node['operator']} needs {needs}")


def checked(contract: dict) -> dict:
    """The contract, if its structure holds."""
    _known(contract, "contract", "contract")
    if contract.get("version") != 1 or not (contract.get("schema") or {}).get("columns"):
        raise ContractError("a contract needs version: 1 and schema.columns")
    _known(contract["schema"], "schema", "schema")
    if "csv" in contract:
        _known(contract["csv"], "csv", "csv")
        for key in ("delimiter", "quote"):
            if len(contract["csv"].get(key, ",")) != 1:
                raise ContractError(f"csv.{key} must be one character")
    for name, column in contract["schema"]["columns"].items():
        _known(column, "column", f"column {name}")
        if column.get("presence") not in ("required", "optional"):
            raise ContractError(f"column {name} needs presence: required or optional")
        _known(column.get("constraints", {}), "constraints", f"column {name}")
        if not isinstance((column.get("constraints") or {}).get("checks", {}), dict):
            raise ContractError(f"column {name}: checks must map names of registered checks to their parameters")
    for key in ("rowCount", "columnCount"):
        if key in contract["schema"]:
            _count(contract["schema"][key], key)
    if "identity" in contract:
        _known(contract["identity"], "identity", "identity")
        names = contract["identity"].get("columns") or []
        if not names or len(set(names)) != len(names):
            raise ContractError("identity.columns must be distinct and not empty")
    for test in contract.get("rowTests", []):
        _known(test, "rowTest", "row test")
        if not ID.match(str(test.get("id", ""))) or "expect" not in test or "select" not in test:
            raise ContractError("a row test needs an id, select and expect")
        if "count" in test["expect"]:
            _count(test["expect"]["count"], f"test {test['id']}")
    for rule in conditional_rules(contract):
        _known(rule, "rule", "conditional rule")
        if not ID.match(str(rule.get("id", ""))) or rule.get("severity", "error") not in ("error", "warning"):
            raise ContractError("a conditional rule needs an id, and severity error or warning")
        check_predicate(rule.get("expect"), f"rule {rule['id']}.expect")
        if rule.get("when") is not None:
            check_predicate(rule["when"], f"rule {rule['id']}.when")
    for target in contract.get("targets", []):
        if ("path" in target) == ("url" in target):
            raise ContractError("a target needs exactly one of path and url")
    return contract


def conditional_rules(contract: dict) -> list[dict]:
    """Rules stand under sqlServer, or at the top."""
    return [*contract.get("conditionalRules", []), *(contract.get("sqlServer") or {}).get("conditionalRules", [])]


def parse(text: str) -> dict:
    return checked(yaml.load(text, _Loader))


def dump(contract: dict, schema_path: str | None = None) -> str:
    head = f"# yaml-language-server: $schema={schema_path}\n" if schema_path else ""
    return head + yaml.safe_dump(contract, sort_keys=False, allow_unicode=True, width=110)


def csv_options(contract: dict) -> dict:
    """The csv section with its defaults."""
    defaults = {"delimiter": ",", "quote": '"', "nullValues": [""], "trimValues": False, "caseSensitive": True, "allowBlankRows": False, "allowRaggedRows": False}
    return defaults | contract.get("csv", {})
