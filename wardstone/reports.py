"""Renderings of an evaluation: JSON, Markdown and JUnit, from its few fold rows."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.operators.evaluate import HEADLINE, pooled_by_layer

FIELDS = ("fold", "missed", "attacks", "bypass", "low", "high", "false_positives", "benign", "boundary", "auc")


def fold_rows(results: DataFrame) -> list[dict]:
    """Folds by bypass, highest first, then by name; the control last."""
    rows = [{k: r[k] for k in FIELDS} for r in results.where(F.col("layer") == HEADLINE).collect()]  # a row per family
    return sorted(rows, key=lambda r: (r["fold"] == "none", -r["bypass"], r["fold"]))


def pooled(rows: list[dict]) -> dict:
    """Pooled bypass over the held-out folds, the worst of them, and the gap to the control."""
    held = [r for r in rows if r["fold"] != "none"]
    control = next((r["bypass"] for r in rows if r["fold"] == "none"), None)
    share = sum(r["missed"] for r in held) / max(1, sum(r["attacks"] for r in held))
    return {"bypass": share, "worst": held[0]["fold"] if held else None, "control": control, "gap": None if control is None else share - control}


def layer_rows(results: DataFrame) -> list[dict]:
    """Each layer's pooled bypass, control and false positives, in order of name."""
    return [r.asDict() for r in pooled_by_layer(results).orderBy("layer").collect()]  # five rows


def as_json(rows: list[dict], layers: list[dict] = ()) -> str:
    return json.dumps({"pooled": pooled(rows), "folds": rows, "layers": list(layers)}, sort_keys=True, indent=2) + "\n"


def as_markdown(rows: list[dict], layers: list[dict] = ()) -> str:
    lines = ["| fold | bypass | interval | false positives | AUC |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        lines.append(f"| {r['fold']} | {r['bypass']:.2%} | {r['low']:.2%} to {r['high']:.2%} | {r['false_positives']}/{r['benign']} | {r['auc']:.3f} |")
    if layers:
        lines += ["", "| layer | bypass, held out | bypass, control | false positives |", "| --- | --- | --- | --- |"]
        lines += [f"| {r['layer']} | {r['bypass']:.2%} | {'-' if r['control'] is None else format(r['control'], '.2%')} | {r['false_positive_rate']:.2%} |" for r in layers]
    return "\n".join([f"Pooled bypass: {pooled(rows)['bypass']:.2%}", "", *lines]) + "\n"


def as_junit(rows: list[dict], most: float) -> str:
    """A test case per fold; it fails when the fold's bypass is above most."""
    cases = []
    for r in rows:
        message = quoteattr(f"bypass {r['bypass']:.4f} is above {most:.4f}")
        cases.append(f"  <testcase name={quoteattr(r['fold'])}>" + (f"<failure message={message}/>" if r["bypass"] > most else "") + "</testcase>")
    failures = sum(r["bypass"] > most for r in rows)
    return f'<testsuite name="held-out" tests="{len(rows)}" failures="{failures}">\n' + "\n".join(cases) + "\n</testsuite>\n"


def write(results: DataFrame, json_out: str | None = None, markdown_out: str | None = None, junit_out: str | None = None, most: float = 1.0) -> list[dict]:
    """Write the renderings asked for; the fold rows."""
    rows = fold_rows(results)
    layers = layer_rows(results) if json_out or markdown_out else []
    for path, text in ((json_out, as_json(rows, layers)), (markdown_out, as_markdown(rows, layers)), (junit_out, as_junit(rows, most))):
        if path:
            Path(path).write_text(text)
    return rows
