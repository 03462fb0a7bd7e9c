"""Table definitions from catalogue exports or Spark schemas, and their merge into contracts, which never overwrites reviewed rules."""

from __future__ import annotations

import copy
import json

from pyspark.sql import types as T

_CHARS = {"varchar", "char", "nvarchar", "nchar"}


def from_struct(schema: T.StructType, table: str, namespace: str = "dbo", keys: tuple = ()) -> dict:
    """A Spark schema as a table definition."""
    columns = []
    for k, f in enumerate(schema.fields):
        size = getattr(f.dataType, "length", None)
        columns.append({"name": f.name, "ordinal": k + 1, "sqlType": f.dataType.simpleString(), "family": "varchar" if size else f.dataType.typeName(), "maxLength": size, "nullable": f.nullable, "identity": False, "computed": False, "generated": False})
    return {"schema": namespace, "table": table, "columns": columns, "keys": list(keys)}


def _sized(family: str, c: dict, length) -> tuple[str, int | None]:
    """The type with its arguments, and the length in characters: exports give bytes, two for each character of the national types."""
    size = int(length or 0)
    chars = size // 2 if family in ("nvarchar", "nchar") and size > 0 else size or None
    if family in _CHARS or family in ("binary", "varbinary"):
        return f"{family}({'max' if size < 0 else chars})", chars
    if family in ("decimal", "numeric"):
        return f"{family}({c.get('precision')},{c.get('scale')})", chars
    return (f"{family}({c.get('scale')})" if family in ("datetime2", "datetimeoffset", "time") else family), chars


def _column(c: dict, type_key: str, length_key: str, identity: bool, computed: bool) -> dict:
    family = str(c.get(type_key)).lower()
    sized, chars = _sized(family, c, c.get(length_key))
    space = c.get("typeSchema")
    return {
        "name": str(c["name"]), "ordinal": int(c["ordinal"]), "sqlType": sized if space in (None, "", "sys") else f"{space}.{sized}", "family": family, "maxLength": chars, "precision": c.get("precision"),
        "scale": c.get("scale"), "nullable": bool(c.get("nullable")), "identity": identity, "computed": computed, "generated": identity or computed,
    }


def _tracked(x: dict) -> dict:
    """A table model: type names with byte lengths, identity seeds and computed expressions, indexes of which one may be the primary key."""
    if not isinstance(x, dict) or not isinstance(x.get("schema"), str) or not isinstance(x.get("name"), str) or not isinstance(x.get("columns"), list):
        raise ValueError("the table model needs schema, name and columns")
    columns = [_column(c, "typeName", "maxLength", c.get("identitySeed") is not None, c.get("computedExpression") is not None) for c in x["columns"]]
    keys = next((i.get("columns") or [] for i in x.get("indexes") or [] if i.get("primaryKey") is True), [])
    keys = sorted((c for c in keys if not c.get("included")), key=lambda c: c.get("keyOrdinal", 0))
    return {"schema": x["schema"], "table": x["name"], "source": "database-tracking", "columns": columns, "keys": [str(c["name"]) for c in keys]}


def _known(x: dict) -> dict:
    """A table of a snapshot: data types with byte lengths, flags, and primary keys as lists of columns."""
    columns = [_column(c, "dataType", "length", bool(c.get("identity")), bool(c.get("computed"))) for c in x["columns"]]
    keys = (x.get("primaryKeys") or [{}])[0].get("columns") or []
    return {"schema": str(x["schema"]), "table": str(x["name"]), "source": "database-knowledge", "columns": columns, "keys": [str(c["name"]) for c in keys]}


def from_json(text: str) -> list[dict]:
    """Both catalogue exports: one table model, or a snapshot {objects: [...]} of tables and others, which are left out."""
    try:
        data = json.loads(text)
    except ValueError:
        raise ValueError("a schema source must be one of the supported JSON exports") from None
    if not isinstance(data, dict) or not isinstance(data.get("objects"), list):
        return [_tracked(data)]
    tables = [_known(x) for x in data["objects"] if str(x.get("type")).lower() == "table" and isinstance(x.get("columns"), list)]
    if not tables:
        raise ValueError("the snapshot contains no table objects")
    return tables


def merge(contract: dict, table: dict) -> tuple[dict, dict]:
    """(contract, preview): missing columns and constraints are filled in; what the contract already says stays, and is listed where the source says otherwise. The target is the table's."""
    out, target = copy.deepcopy(contract), contract.get("sqlServer") or {}
    declared, ordered = out["schema"]["columns"], sorted(table["columns"], key=lambda c: c["ordinal"])
    named = {c["name"]: c for c in ordered}
    preview = {
        "added": [c for c in named if c not in declared], "existing": [c for c in named if c in declared], "contract_only": [c for c in declared if c not in named], "filled": [], "preserved_conflicts": [],
        "target_changed": (target.get("schema"), target.get("table")) != (table["schema"], table["table"]), "identity_initialized": False,
    }
    columns = {}
    for name, c in named.items():
        own = declared.get(name) or {"presence": "optional" if c["generated"] else "required"}
        have = own.setdefault("constraints", {})
        facts = [] if c["generated"] else [("notNull", not c["nullable"])]
        if c["family"] in _CHARS and c["maxLength"] is not None and c["maxLength"] >= 0:
            facts.append(("maxLength", c["maxLength"]))
        for key, fact in facts:
            if have.get(key) is None:
                if fact is not False:
                    have[key] = fact
                    preview["filled"].append(f"{name}.{key}")
            elif have[key] != fact:
                preview["preserved_conflicts"].append(f"{name}.{key}")
        if not have:
            del own["constraints"]
        columns[name] = own
    out["schema"]["columns"] = columns | {c: declared[c] for c in preview["contract_only"]}
    kept = [{k: v for k, v in c.items() if k not in ("family", "generated") and v not in (None, False) or k == "nullable"} for c in ordered]
    out["sqlServer"] = target | {"schema": table["schema"], "table": table["table"], "importedSchema": {"formatVersion": 1, "sourceKind": table.get("source", "spark"), "columns": kept}}
    if "identity" not in out and table["keys"] and all(k in named and not named[k]["generated"] for k in table["keys"]):
        out["identity"] = {"columns": list(table["keys"]), "unique": True}
        preview["identity_initialized"] = True
    return out, preview
