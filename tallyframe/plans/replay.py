"""Replay of recorded steps: each step reads named tables and names its result.

Steps only build plans. Nothing is written between them, so Catalyst sees a chain of steps as one
query; a step whose plan does not resolve is reported when it is added, before any data is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyframe.functions.names import require
from tallyframe.operators import charts, columns, edits, formatting, grouping, joins, sorting, typing, unions
from tallyframe.operators.conformance import problems
from tallyframe.operators.reconcile import reconcile, statistics
from tallyframe.plans.specs import describe, missing_columns, operation_name, source_tables, step_parameters

ERROR, OVERWRITE = "error", "overwrite"


class Tables:
    """Named tables of one run. A permanent name is taken once; a temporary one may be replaced."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self._tables = dict(tables or {})
        self._temporary: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ValueError(f"table not found: {name}")
        return self._tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def names(self) -> list[str]:
        return list(self._tables)

    def as_dict(self) -> dict[str, DataFrame]:
        return dict(self._tables)

    def put(self, name: str, df: DataFrame, policy: str = ERROR, temporary: bool = False) -> None:
        if not name:
            raise ValueError("output table name is required")
        if name in self._tables and name not in self._temporary and policy == ERROR:
            raise ValueError(f"table with name {name} already exists")
        self._tables[name] = df
        (self._temporary.add if temporary else self._temporary.discard)(name)

    def keep(self, name: str) -> None:
        """Make the latest temporary table permanent and drop the other temporary ones."""
        self._temporary.discard(name)
        for other in list(self._temporary):
            del self._tables[other]
        self._temporary.clear()

    def view(self, name: str) -> None:
        self[name].createOrReplaceTempView(name)


@dataclass
class Run:
    tables: Tables
    results: list[dict] = field(default_factory=list)

    def summary(self) -> dict:
        total = len(self.results)
        count = {s: sum(r["status"] == s for r in self.results) for s in ("completed", "error", "skipped")}
        rate = f"{count['completed'] / total * 100:.2f}%" if total else "0%"
        return {
            "total_operations": total, "completed": count["completed"], "errors": count["error"],
            "skipped": count["skipped"], "success_rate": rate,
        }

    def status_table(self, spark: SparkSession) -> DataFrame:
        rows = [(float(r["sequence"]), r["operation"], r["status"], r["output"], r["error"], r["description"]) for r in self.results]
        return spark.createDataFrame(rows, "sequence double, operation string, status string, output string, error string, description string")


def _add_column(tables: Tables, p: dict) -> dict[str, DataFrame]:
    spec = {k: v for k, v in p.items() if k not in ("tableName", "newColumnName", "operationType", "outputTableName")}
    df = columns.add_column(tables[p["tableName"]], p["newColumnName"], p["operationType"], **spec)
    return {p.get("outputTableName") or p["tableName"]: df}


def _merge_files(tables: Tables, p: dict) -> dict[str, DataFrame]:
    a, b = tables[p["table1Name"]], tables[p["table2Name"]]
    kind = p.get("mergeType", "horizontal")
    if kind == "vertical":
        return {p["outputTableName"]: unions.union_common(a, b)}
    if kind != "horizontal":
        raise ValueError(f"invalid merge type: {kind!r}")
    method, pairs = p.get("mergeMethod") or "inner", p.get("keyPairs") or []
    out = {p["outputTableName"]: joins.merge(a, b, pairs, method)}
    if p.get("showCountSummary"):
        out[p["outputTableName"] + "_summary"] = joins.match_summary(a, b, pairs, method)
    return out


def _group_pivot(tables: Tables, p: dict) -> dict[str, DataFrame]:
    df = grouping.pivot(tables[p["tableName"]], p["rowIndex"], p.get("columnIndex"), p["pivotValues"], p.get("orderBy"))
    return {p["outputTableName"]: df}


def _sort_filter(tables: Tables, p: dict) -> dict[str, DataFrame]:
    df = sorting.sort_filter(tables[p["tableName"]], p.get("sortConfig") or [], p.get("filterConfig") or [])
    return {p["outputTableName"]: df}


def _edit(tables: Tables, p: dict) -> dict[str, DataFrame]:
    return {p["outputTableName"]: edits.edit_batch(tables[p["tableName"]], p.get("operations") or [])}


def _format(tables: Tables, p: dict) -> dict[str, DataFrame]:
    name = p.get("outputTableName") or f"formatted_{p['tableName']}"
    return {name: formatting.apply_formatting(tables[p["tableName"]], p.get("formattingConfigs") or [])}


def _reconcile(tables: Tables, p: dict) -> dict[str, DataFrame]:
    sources = p["sourceTableNames"]
    if len(sources) != 2:
        raise ValueError("exactly two source tables are required")
    a, b = reconcile(
        tables[sources[0]], tables[sources[1]], p["keys"], p["values"], p["settings"], p["crossReference"],
        (sources[0], sources[1]), p.get("orderBy"),
    )
    stem = p.get("outputTableName") or ""
    names = (p.get("outputTableName1") or f"{stem}_left", p.get("outputTableName2") or f"{stem}_right")
    return {names[0]: a, names[1]: b, (stem or names[0]) + "_statistics": statistics(a, b)}


def _edit_file(tables: Tables, p: dict) -> dict[str, DataFrame]:
    done, report = typing.type_tables(tables.as_dict(), p.get("tables") or [])
    if not done:
        raise ValueError("; ".join(r["error"] for r in report) or "no tables given")
    return done


STEPS: dict[str, Callable[[Tables, dict], dict[str, DataFrame]]] = {
    "add_column": _add_column,
    "merge_files": _merge_files,
    "group_pivot": _group_pivot,
    "sort_filter": _sort_filter,
    "replace_rename_reorder": _edit,
    "apply_formatting": _format,
    "reconcile_files": _reconcile,
    "edit_file": _edit_file,
}
_IN_PLACE = ("add_column", "edit_file")  # their output may carry the source's name


def active_steps(steps: list[dict]) -> list[dict]:
    return sorted((s for s in steps if s.get("is_active", True)), key=lambda s: float(s.get("sequence", 0)))


def replay(
    steps: list[dict],
    tables: dict[str, DataFrame],
    mapping: dict[str, str] | None = None,
    on_error: str = "continue",
) -> Run:
    """Run the active steps in sequence order over the tables.

    ``mapping`` gives, for a table name used in the steps, the table to take instead. A step that
    fails is reported; with ``on_error="stop"`` the steps after it are skipped, otherwise only the
    steps that need its output fail.
    """
    mapping = mapping or {}
    env = dict(tables)
    for recorded, actual in mapping.items():
        if actual not in tables:
            raise ValueError(f"table not found: {actual}")
        env[recorded] = tables[actual]
    run, stopped = Run(Tables(env)), False
    for step in active_steps(steps):
        raw = step.get("operation") or step.get("operation_name") or step.get("function")
        parameters = step.get("parameters") or step.get("args") or {}
        result = {"sequence": step.get("sequence", 0), "operation": raw, "status": "skipped", "output": None,
                  "error": None, "description": None}
        run.results.append(result)
        if stopped:
            continue
        try:
            name = operation_name(raw)
            p = step_parameters(name, parameters)
            result["description"] = describe(name, parameters)
            _check_columns(name, p, run.tables)
            outputs = STEPS[name](run.tables, p)
            own = set(source_tables(name, p)) if name in _IN_PLACE else set()
            for output, df in outputs.items():
                # A step may replace the table it works on, no other one.
                run.tables.put(output, df, OVERWRITE if output in own else step.get("policy", ERROR), step.get("temporary", False))
            result.update(status="completed", output=", ".join(outputs))
            if name == "edit_file":
                lost = [t["tableName"] for t in p.get("tables") or [] if t["tableName"] not in outputs]
                run.results += [result | {"status": "error", "output": None, "error": f"the columns and types of {t} could not be set"} for t in lost]
        except Exception as error:  # noqa: BLE001 - every failure is a status row
            result.update(status="error", error=str(error))
            stopped = on_error == "stop"
    return run


def _check_columns(name: str, p: dict, tables: Tables) -> None:
    if name == "edit_file":
        return
    sources = source_tables(name, p)
    held = [tables[s].columns for s in sources if s]
    lost = missing_columns(name, p, *held[:2])
    if lost:
        raise ValueError(f"the specified column(s) could not be found: {', '.join(lost)}")


def check_inputs(expected: dict[str, dict[str, str]], tables: dict[str, DataFrame], mapping: dict[str, str],
                 allow_extra: bool = False) -> dict[str, list[dict]]:
    """Schema problems per mapped input; empty lists mean that the run may start."""
    report = {}
    for recorded, schema in expected.items():
        actual = mapping.get(recorded, recorded)
        if actual not in tables:
            report[recorded] = [{"column": None, "status": "table missing", "expected": None, "actual": None}]
        else:
            report[recorded] = problems(schema, tables[actual], allow_extra)
    return report


def reorder_steps(steps: list[dict], order: list[dict]) -> list[dict]:
    """Apply new sequences, ``[{id, sequence}]``, and sort by them."""
    sequences = {o["id"]: o["sequence"] for o in order}
    unknown = set(sequences) - {s["id"] for s in steps}
    if unknown:
        raise ValueError(f"unknown step(s): {', '.join(map(str, sorted(unknown)))}")
    moved = [{**s, "sequence": sequences.get(s["id"], s.get("sequence", 0))} for s in steps]
    return sorted(moved, key=lambda s: float(s["sequence"]))


def delete_step(steps: list[dict], step_id: object) -> list[dict]:
    """Drop a step and renumber the rest 1..n."""
    kept = sorted((s for s in steps if s["id"] != step_id), key=lambda s: float(s.get("sequence", 0)))
    return [{**s, "sequence": float(i)} for i, s in enumerate(kept, 1)]


def copy_steps(steps: list[dict]) -> list[dict]:
    """A copy of the steps under fresh ids 1..n."""
    ordered = sorted(steps, key=lambda s: float(s.get("sequence", 0)))
    return [{**s, "id": i, "parameters": dict(s.get("parameters") or {})} for i, s in enumerate(ordered, 1)]


def chart_dataset(df: DataFrame, config: dict) -> DataFrame:
    """Dataset of a chart specification: line/bar, horizontal bar, or pie/donut."""
    kind = str(config.get("type", "bar")).lower()
    if "pie" in kind or "donut" in kind:
        require(df, [config["labels"], config["values"]])
        return charts.pie(df, config["labels"], config["values"], config.get("largestItems"))
    if "horizontal" in kind:
        return charts.horizontal_bars(df, config["xAxis"], config["series"])
    return charts.series_long(df, config["xAxis"], config["series"])
