"""Specification adapters: older spellings, missing columns, and step descriptions."""

from __future__ import annotations

import re
from copy import deepcopy

# The operations a step may name, under the spellings in use.
OPERATIONS = {
    "add_column": "add_column",
    "merge_files": "merge_files",
    "group_pivot": "group_pivot",
    "sort_filter": "sort_filter",
    "apply_formatting": "apply_formatting",
    "format": "apply_formatting",
    "formatting": "apply_formatting",
    "replace_rename_reorder": "replace_rename_reorder",
    "reconcile": "reconcile_files",
    "reconcile_files": "reconcile_files",
    "edit_file": "edit_file",
}


def operation_name(name: str) -> str:
    key = re.sub(r"[^a-z]+", "_", name.strip().lower()).strip("_")
    if key not in OPERATIONS:
        raise ValueError(f"unknown operation: {name!r}")
    return OPERATIONS[key]


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def step_parameters(name: str, parameters: dict) -> dict:
    """Parameters under one spelling: ``sort_config`` and ``sortConfig`` are the same."""
    p = {(_camel(k) if "_" in k and not k.startswith("__") else k): deepcopy(v) for k, v in parameters.items()}
    if name == "reconcile_files":
        p = reconcile_payload(p, parameters)
    if isinstance(p.get("outputTableName"), str):
        p["outputTableName"] = p["outputTableName"].strip()
    return p


def reconcile_payload(p: dict, raw: dict | None = None) -> dict:
    """Bring older field names of a reconciliation into the current ones."""
    raw = raw or {}
    out = dict(p)
    old = raw.get("reconciliation_settings")
    settings = dict(p.get("settings") or {})
    if old:
        based = old.get("based_on_columns") if isinstance(old.get("based_on_columns"), dict) else {}
        settings = {
            "method": old.get("method", "one-to-one"),
            "duplicate": old.get("handling_duplicate_matches"),
            "basis_column": {"left": based.get("file1"), "right": based.get("file2")},
        } | settings
    settings.setdefault("duplicate", settings.pop("duplicateHandling", None))
    if "basis_column" not in settings:
        settings["basis_column"] = {"left": settings.pop("baseColumn1", None), "right": settings.pop("baseColumn2", None)}
    settings["basis_column"] = _sided(settings["basis_column"] or {})
    settings["duplicate"] = settings.get("duplicate") or "first_occurrence"
    cross = p.get("crossReference") or {}
    if isinstance(cross, dict) and isinstance(cross.get("settings"), dict):
        settings = {**cross["settings"], **{k: v for k, v in (p.get("settings") or {}).items() if v}}
        settings["basis_column"] = _sided(settings.get("basis_column") or {})
    sources = p.get("sourceTableNames") or p.get("files") or []
    if settings.get("basis_table") in sources:
        settings["basis_table"] = "left" if settings["basis_table"] == sources[0] else "right"
    keys = raw.get("matching_keys") or p.get("keys") or []
    out["keys"] = [_key(k) for k in keys]
    out["values"] = [_value(v) for v in p.get("values") or []]
    out["settings"] = settings
    out["crossReference"] = _cross(cross)
    out["sourceTableNames"] = list(sources)
    return out


def _sided(d: dict) -> dict:
    return {
        "left": d.get("left") or d.get("file1") or d.get("file1_column"),
        "right": d.get("right") or d.get("file2") or d.get("file2_column"),
    }


def _yes(value: object) -> str:
    return "yes" if value in (True, "yes") else "no"


def _key(k: dict) -> dict:
    return {
        **_sided(k),
        "criteria": k.get("criteria") or k.get("method") or "exact",
        "case_sensitive": _yes(k.get("case_sensitive", "yes")),
        "ignore_special": _yes(k.get("ignore_special", k.get("ignore_special_characters", "no"))),
        "fuzzy_ranking_basis": bool(k.get("fuzzy_ranking_basis")),
    }


def _value(v: dict) -> dict:
    kind = v.get("threshold_type")
    return {**_sided(v), "threshold_type": kind.lower() if kind else None, "threshold_value": v.get("threshold_value") or 0}


def _cross(cross: object) -> dict:
    if isinstance(cross, dict) and ("left" in cross or "right" in cross):
        return {"left": list(cross.get("left") or []), "right": list(cross.get("right") or [])}
    entries = [cross] if isinstance(cross, dict) and cross else cross or []
    sides = {"left": [], "right": []}
    for entry in entries:
        for side, names in (("left", ("file1", "file1_column")), ("right", ("file2", "file2_column"))):
            ref = next((entry[n] for n in names if n in entry), None)
            if ref is not None and ref != "":
                sides[side].append("__Custom__" if ref == 0 else ref)
    return sides


def missing_columns(operation: str, parameters: dict, columns: list[str], columns2: list[str] | None = None) -> list[str]:
    """Columns a step names that its table(s) lack. Adding a column ignores case, other steps do not."""
    name = operation_name(operation)
    p = step_parameters(name, parameters or {})
    first: list[str] = []
    second: list[str] = []
    if name == "add_column":
        first.append(p.get("sourceColumn"))
        for step in p.get("operations") or []:
            first += [step.get("column"), step.get("column1"), step.get("column2")]
        first += [c.get("column") for c in p.get("conditions") or []]
        known = {c.lower() for c in columns}
        return _unique(c for c in first if isinstance(c, str) and c and c.lower() not in known)
    if name == "sort_filter":
        first += [c.get("column") for c in (p.get("sortConfig") or []) + (p.get("filterConfig") or [])]
    elif name == "group_pivot":
        heads = p.get("columnIndex")
        rows = p.get("rowIndex") or []
        first += [rows] if isinstance(rows, str) else list(rows)
        first += list(heads) if isinstance(heads, (list, tuple)) else [None if heads == "None" else heads]
        first += [v.get("column") for v in p.get("pivotValues") or []]
    elif name == "merge_files":
        first += [k.get("left") for k in p.get("keyPairs") or []]
        second += [k.get("right") for k in p.get("keyPairs") or []]
    elif name == "reconcile_files":
        for entry in p["keys"] + p["values"]:
            first.append(entry["left"])
            second.append(entry["right"])
        first += [r for r in p["crossReference"]["left"] if r != "__Custom__"]
        second += [r for r in p["crossReference"]["right"] if r != "__Custom__"]
    elif name == "replace_rename_reorder":
        for op in p.get("operations") or []:
            first += list(op.get("mapping") or {}) if op.get("type") == "rename_columns" else []
            first += op.get("order") or [] if op.get("type") == "reorder_columns" else []
            first += [r.get("column") for r in op.get("replacements") or []] if op.get("type") == "replace_values" else []
    elif name == "apply_formatting":
        for config in p.get("formattingConfigs") or []:
            for token in ((config.get("location") or {}).get("range") or "").split(","):
                token = token.strip()
                if token and not re.fullmatch(r"[A-Z]*\d*(:[A-Z]*\d*)?", token):
                    first.append(token)
    elif name == "edit_file":
        for table in p.get("tables") or []:
            first += list(table.get("columnTypes") or {})
    known, known2 = set(columns), set(columns2 or [])
    return _unique(
        [c for c in first if isinstance(c, str) and c and c not in known]
        + [c for c in second if isinstance(c, str) and c and c not in known2]
    )


def _unique(names) -> list[str]:
    return list(dict.fromkeys(names))


def source_tables(name: str, p: dict) -> list[str]:
    """Names of the tables a step reads."""
    if name == "merge_files":
        return [p.get("table1Name"), p.get("table2Name")]
    if name == "reconcile_files":
        return list(p.get("sourceTableNames") or [])
    if name == "edit_file":
        return [t["tableName"] for t in p.get("tables") or []]
    return [p.get("tableName")]


def _listed(*items: str) -> str:
    return ", ".join(_unique(i for i in items if i))


def describe(operation: str, parameters: dict) -> str:
    """One line about a step: its tables, then what happens to them. Columns have the names that the step is given."""
    name = operation_name(operation)
    p = step_parameters(name, parameters)
    of = lambda key, field="column": [rule.get(field) for rule in p.get(key) or []]
    rows = p.get("rowIndex") or []
    says = {
        "sort_filter": lambda: [("ordered by", of("sortConfig")), ("rows chosen by", of("filterConfig"))],
        "add_column": lambda: [("new column", [p.get("newColumnName")]), ("by", [p.get("operationType")])],
        "merge_files": lambda: [("joined", [p.get("mergeMethod") or "inner"]) if p.get("mergeType") == "horizontal" else ("stacked", ["all rows"])],
        "group_pivot": lambda: [("one row per", [rows] if isinstance(rows, str) else rows)],
        "reconcile_files": lambda: [("reconciled", [p["settings"].get("method", "one-to-one")])],
        "edit_file": lambda: [("columns and types", ["set"])],
        "apply_formatting": lambda: [("formats", ["set"])],
    }.get(name, lambda: [_edit_line(op) for op in p.get("operations") or []])
    parts = [f"{what} {_listed(*found)}" for what, found in says() if _listed(*found)]
    return f"{_listed(*source_tables(name, p))}: {'; '.join(parts) or 'unchanged'}"


def _edit_line(op: dict) -> tuple[str, list[str]]:
    what, key = {"rename_columns": ("new names for", "mapping"), "reorder_columns": ("column order", "order"),
                 "delete_columns": ("without", "columns"), "replace_values": ("new values in", "replacements")}.get(op.get("type"), ("", ""))
    return what, [c["column"] if isinstance(c, dict) else c for c in op.get(key) or []]
