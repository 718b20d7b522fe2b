"""Reports of a comparison: a folder with JSON, Markdown and evidence.

Evidence is written by tasks, so the folder must be one that all machines share.  analysis.json comes last and names only files of
tasks that were done: a report without it is not finished, and what a lost task left is no part of it.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources import files

MARKER = ".kindred-report"


def metric_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, left, right) of the metrics whose values differ, or that one side lacks; tables: metric, value."""
    a, b = left.select("metric", F.col("value").alias("left")), right.select("metric", F.col("value").alias("right"))
    return a.join(b, "metric", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


#: What sets two builds apart besides the scores: a metric, and its value on a side, from the profile's header and its notes.
METRICS = {
    "AGP": lambda header, notes: header["agp"],
    "signatures": lambda header, notes: ", ".join(notes["signing"]),
    "hardening": lambda header, notes: "present" if notes["hardening"] else None,
    "bytes of DEX files": lambda header, notes: header["counts"].get("dex_bytes"),
    "DEX files": lambda header, notes: header["counts"].get("dex"),
    "methods": lambda header, notes: header["counts"].get("methods"),
}
ORIGINAL = "hardening:originalaabsha256:"


def build_metrics(result: dict) -> list[tuple[str, str, str | None]]:
    """(side, metric, value) of a comparison; a hardened right side names the bundle it was made from, which may be the left one."""
    rows = []
    for side in ("left", "right"):
        notes = {k: v[side] for k, v in result["diagnostics"].items() if side in v}
        rows += [(side, name, None if (x := value(result[side], notes)) in (None, "") else str(x)) for name, value in METRICS.items()]
    made_from = [v[len(ORIGINAL) :] for v in result["diagnostics"]["hardening"]["right"] if v.lower().startswith(ORIGINAL)]
    if made_from:
        rows += [("left", "bundle before hardening", result["left"]["sha256"]), ("right", "bundle before hardening", made_from[0])]
    renamed = result["dimensions"].get("resources", {}).get("renamed_matches") or 0
    return rows + [("left", "resources with another path", "0"), ("right", "resources with another path", str(renamed))]


def difference_rows(spark: SparkSession, result: dict) -> list[list]:
    """metric_differences() of a comparison's build_metrics(), in their order."""
    rows = build_metrics(result)
    table = spark.createDataFrame(rows, "side string, metric string, value string")
    of = lambda side: table.where(F.col("side") == side).select("metric", "value")
    order = list(dict.fromkeys(name for _, name, _ in rows))
    return sorted(([r.metric, r.left, r.right] for r in metric_differences(of("left"), of("right")).collect()), key=lambda r: order.index(r[0]))


def differences(result: dict) -> list[str]:
    return [f"{metric}: {left or 'none'} -> {right or 'none'}" for metric, left, right in result.get("differences", ())] or ["none"]


def cell(text) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def number(x) -> str:
    return "N/A" if x is None else f"{x:.2f}"


def table(head: list[str], rows) -> list[str]:
    return ["", f"| {' | '.join(head)} |", "|" + "-|" * len(head), *[f"| {' | '.join(cell(x) for x in r)} |" for r in rows]]


#: What a report is called, which origins make up its dimensions, and how far it can be trusted.
KINDS = {
    "legacy": ("Comparison", (), "Whose the code is was judged by names; a dimension without data keeps its weight, so the total is a range."),
    "heuristic": ("Comparison of what seems own", ("HEURISTIC_OWNED",), "Ownership was judged by names and paths. It proves nothing, and some dependencies may be taken for own content."),
    "strict": ("Comparison of what is proven own", ("OWNED_SOURCE", "OWNED_GENERATED"), "Every scored row was traced to a source or generated file of the project. The manifest is that of the sources."),
}


def evidence_name(dimension: str, rank: int) -> str:
    return f"evidence/{dimension}-{rank:03d}.txt"


def _head(result: dict) -> list[str]:
    both = [result["left"], result["right"]]
    plain = [("file", *[h["path"] for h in both]), ("SHA-256", *[h["sha256"] for h in both]), ("modules", *[", ".join(h["modules"]) for h in both])]
    counts = [(k, *[h["counts"].get(k, 0) for h in both]) for k in both[0]["counts"]]
    return ["", "## Inputs", *table(["", "left", "right"], plain + counts)]


def _scores(result: dict, made_of: tuple) -> list[str]:
    """A row a dimension: with its weight, or of which origins either side's rows are."""
    weights, own = result.get("weights", {}), lambda d, side: " / ".join(str(d.get("origins", {}).get(side, {}).get(o, 0)) for o in made_of)
    more = ["left, of " + " / ".join(made_of).lower(), "right, of the same"] if made_of else ["weight"]
    rows = []
    for key, d in result["dimensions"].items():
        shown = sum(1 for f in result["findings"] if f[0] == key)
        last = [own(d, "left"), own(d, "right")] if made_of else [f"{weights.get(key, 0)} %"]
        rows.append([key, number(d["score"]), *[number(100 * d[c]) + " %" if d[c] is not None else "N/A" for c in ("left_coverage", "right_coverage", "confidence")], *last, shown])
    return ["", "## Dimensions", *table(["dimension", "score", "left covered", "right covered", "confidence", *more, "findings"], rows)]


def attribution(result: dict) -> list[str]:
    """Whose the rows of either side are, and the source files with most of them; nothing where no mode asked."""
    sides = {s: result["attribution"].get(s) for s in ("left", "right")}
    if not all(sides.values()):
        return []
    lines = ["", "## Attribution", *table(["origin", "left", "right"], [(k, sides["left"][k], sides["right"].get(k, 0)) for k in sides["left"]])]
    for side, found in result.get("origins", {}).items():
        if found["by_source"]:
            lines += ["", f"### Sources, {side}", *table(["source", "rows"], found["by_source"].items())]
    return lines


def _findings(result: dict) -> list[str]:
    lines = []
    for key in result["dimensions"]:
        rows = [(number(100 * s), a, b, f"[{k:03d}]({evidence_name(d, k)})") for d, k, a, b, s in result["findings"] if d == key]
        lines += ["", f"## Findings: {key}", *(table(["similarity", "left", "right", "evidence"], rows) if rows else ["", "none"])]
    return lines


def markdown(result: dict) -> str:
    title, made_of, note = KINDS[result.get("strategy") or "legacy"]
    total = result["aggregate"]
    lines = [f"# {title}"]
    if total:
        shown = f"{number(total['score'])} ({total['level']})" if total["score"] is not None else f"between {number(total['minimum'])} and {number(total['maximum'])}"
        lines += ["", f"Total: {shown}, of {total['analyzed_weight']} % of the weight"]
    lines += _head(result) + ["", "## Differences", "", *[f"- {cell(x)}" for x in differences(result)]]
    lines += _scores(result, made_of) + attribution(result)
    if made_of:
        lines += ["", "## Diagnostics", "", "```json", json.dumps(result.get("diagnostics", {}), ensure_ascii=False, indent=2, sort_keys=True), "```"]
    lines += _findings(result)
    lines += ["", "## Warnings", "", *([f"- {cell(w)}" for w in sorted(set(result["warnings"]))] or ["none"]), "", note]
    return "\n".join(lines) + "\n"


def require_folder(folder: str | Path, *, overwrite: bool = False) -> Path:
    """A new or empty folder, or one that an earlier report left if overwrite; never a link."""
    out = Path(folder)
    if out.is_symlink() or (out.exists() and not out.is_dir()):
        raise ValueError("the report needs a folder, not a link or a file")
    if out.exists() and any(out.iterdir()):
        if not (out / MARKER).is_file() or (out / MARKER).is_symlink():
            raise ValueError("the folder is in use")
        if not overwrite:
            raise ValueError("a report is there; ask to overwrite it")
    return out


#: What analysis.json holds, as JSON Schema.
_NUMBER, _TEXT, _COUNTS = {"type": ["number", "null"]}, {"type": "string"}, {"type": "object", "additionalProperties": {"type": "integer"}}
_HEADER = {"type": "object", "required": ["path", "sha256", "modules", "counts"], "properties": {"path": _TEXT, "sha256": _TEXT, "modules": {"type": "array", "items": _TEXT}, "agp": {"type": ["string", "null"]}, "counts": _COUNTS}}
_DIMENSION = {"type": "object", "required": ["key", "score", "left_coverage", "right_coverage", "confidence"], "properties": {"key": _TEXT} | {k: _NUMBER for k in ("score", "left_coverage", "right_coverage", "confidence")}}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["mode", "left", "right", "dimensions", "findings", "warnings", "attribution", "aggregate"],
    "properties": {
        "mode": {"enum": ["legacy", "owned"]},
        "left": _HEADER,
        "right": _HEADER,
        "dimensions": {"type": "object", "additionalProperties": _DIMENSION},
        "findings": {"type": "array", "items": {"type": "array", "prefixItems": [_TEXT, {"type": "integer"}, _TEXT, _TEXT, _NUMBER], "minItems": 5}},
        "warnings": {"type": "array", "items": _TEXT},
        "attribution": {"type": "object", "properties": {side: {"anyOf": [_COUNTS, {"type": "null"}]} for side in ("left", "right")}},
        "aggregate": {"anyOf": [{"type": "object", "properties": {k: _NUMBER for k in ("score", "minimum", "maximum", "analyzed_weight")}}, {"type": "null"}]},
        "selection": {"type": "object", "additionalProperties": _TEXT},
    },
}


def serialised(result: dict) -> dict:
    """What analysis.json holds: without the log and the sources; of an owned comparison without what only the build says."""
    out = {k: v for k, v in result.items() if k not in ("run", "snippets")}
    if result["mode"] == "owned":
        for side in ("left", "right"):
            head = {k: v for k, v in result[side].items() if k != "agp"}
            out[side] = head | {"counts": {k: v for k, v in head["counts"].items() if k != "native"}}
    return out


def read(folder: str | Path) -> dict:
    """A result that write() left; findings are tuples again."""
    found = json.loads((Path(folder) / "analysis.json").read_text())
    return found | {"findings": [tuple(x) for x in found["findings"]]}


def evidence(result: dict) -> DataFrame:
    """(name, text): a row a finding, with the source around it where result has snippets (dimension, rank, side, shown)."""
    spark = SparkSession.active()
    rows = [(evidence_name(d, k), d, k, f"{d}\nsimilarity {100 * s:.2f}\nleft  {a}\nright {b}\n") for d, k, a, b, s in result["findings"]]  # top rows only
    found = spark.createDataFrame(rows, "name string, dimension string, rank int, text string")
    shown = result.get("snippets")
    if shown is None:
        return found.select("name", "text")
    shown = shown.groupBy("dimension", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "shown"))), lambda x: x.shown), "\n\n").alias("shown"))
    return found.join(shown, ["dimension", "rank"], "left").select("name", F.concat("text", F.coalesce(F.concat(F.lit("\n"), "shown", F.lit("\n")), F.lit(""))).alias("text"))


def write_texts(texts: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Writes the texts (name, text) in tasks and gives (name, bytes) of all.  A file appears under its name only when it is whole;
    a task that runs twice writes the same again."""

    def run(batches):
        system, root = files.located(folder)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist(), strict=True):
                place, data = f"{root}/{name}", text.encode("utf-8", "replace")
                system.create_dir(place.rpartition("/")[0], recursive=True)
                beside = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(data)
                system.move(beside, place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    done = sorted((r.name, r.size) for r in texts.select("name", "text").mapInArrow(run, "name string, size long").collect())  # of top rows
    system, root = files.located(folder)
    for name, size in done:
        if system.get_file_info(f"{root}/{name}").size != size:
            raise ValueError(f"{folder} is no folder that all machines share: {name} is not there")
    return done


def write(result: dict, folder: str | Path, *, overwrite: bool = False) -> Path:
    """Writes the folder: JSON and its schema, Markdown, a log of the run, and a text for each finding, which the JSON names."""
    out = require_folder(folder, overwrite=overwrite)
    for name in ("evidence", "logs"):
        (out / name).mkdir(parents=True, exist_ok=True)
    (out / MARKER).touch()
    (out / "analysis.json").unlink(missing_ok=True)  # of an earlier report: from here on it is not finished
    dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
    listed = [name for name, _ in write_texts(evidence(result), str(out.resolve()))] if result["findings"] else []
    (out / "analysis.schema.json").write_text(dump(SCHEMA))
    (out / "logs" / "run.json").write_text(dump(result.get("run", {}) | {"mode": result["mode"], "strategy": result.get("strategy"), "selection": result.get("selection")}))
    (out / "report.md").write_text(markdown(result))
    (out / ".analysis.json").write_text(dump(serialised(result) | {"evidence": listed}))
    os.replace(out / ".analysis.json", out / "analysis.json")
    return out
