"""Markdown reports from result documents: no clock and no state, so that a report can be checked for drift."""

from __future__ import annotations

import difflib
import json
import textwrap
from pathlib import Path

from spanframe.model import LABELS, SCORED_TIERS

#: Names of the published systems, in the order of the report.
NAMES = {"regex": "Patterns and lexicon", "presidio": "Presidio", "gliner2_en": "GLiNER2 (English labels)", "gliner2_zh": "GLiNER2 (Chinese labels)", "llm": "Language model (few-shot)"}
BEGIN, END = "<!-- benchmark:begin -->", "<!-- benchmark:end -->"
COLUMNS = ("System", *[f"{x} F1" for x in LABELS], "Micro F1 (exact)", "Micro F1 (overlap)", "FPR (negatives)", "Latency p50/p95 (ms)", "Size", "Data leaves device?")
DIFF_LINES = 60


def load_results(folder: Path, order: tuple[str, ...] = tuple(NAMES)) -> dict[str, dict]:
    """Result documents that exist, in the order of the names."""
    return {k: json.loads((folder / f"{k}.json").read_text(encoding="utf-8")) for k in order if (folder / f"{k}.json").exists()}


def number(value, digits: int = 4) -> str:
    return "N/A" if value is None else f"{value:.{digits}f}"


def yes_no(value) -> str:
    return {None: "N/A", True: "yes", False: "no"}[value]


def size(value) -> str:
    return "N/A" if value is None else f"{value:.2f} MB"


def row(cells) -> str:
    return f"| {' | '.join(cells)} |"


def main_table(results: dict[str, dict], names: dict[str, str]) -> str:
    """One row a system. A system that was not evaluated says so, over one cell less than the columns."""
    lines = [row(COLUMNS), "|" + "---|" * len(COLUMNS)]
    for key, r in results.items():
        if r["status"] != "evaluated":
            lines.append(row([names.get(key, key), *["unevaluated"] * 6, "N/A", "N/A"]))
            continue
        m, late = r["metrics"], r.get("latency_ms") or {}
        scores = [m["exact"][x]["f1"] for x in (*LABELS, "micro")] + [m["overlap"]["micro"]["f1"], m["negatives"]["fpr"]]
        pace = f"{number(late.get('p50'), 3)} / {number(late.get('p95'), 3)}"
        lines.append(row([names.get(key, key), *map(number, scores), pace, size(r["metadata"]["size_mb"]), yes_no(r["metadata"]["data_leaves_machine"])]))
    return "\n".join(lines)


def tier_table(results: dict[str, dict], names: dict[str, str]) -> str:
    done = {k: r for k, r in results.items() if r["status"] == "evaluated"}
    if not done:
        return "Nothing was evaluated."
    lines = [row(["System", *[f"{t} (exact / overlap)" for t in SCORED_TIERS]]), "|" + "---|" * (1 + len(SCORED_TIERS))]
    for key, r in done.items():
        tiers = [r["metrics"]["by_tier"][t] for t in SCORED_TIERS]
        lines.append(row([names.get(key, key), *[f"{number(t['exact_micro_f1'])} / {number(t['overlap_micro_f1'])}" for t in tiers]]))
    return "\n".join(lines)


def unevaluated_list(results: dict[str, dict], names: dict[str, str]) -> str:
    found = [f"- **{names.get(k, k)}**: {' '.join(str(r['reason']).split())}" for k, r in results.items() if r["status"] != "evaluated"]
    return "\n".join(found) or "All systems were evaluated."


def first_field(results: dict[str, dict], *path: str) -> str:
    """The first value at a path, in the order of the results, else 'unknown'."""
    for r in results.values():
        for step in path:
            r = r.get(step) if isinstance(r, dict) else None
        if r is not None:
            return str(r)
    return "unknown"


def bullet(text: str) -> str:
    return textwrap.fill(f"- {text}", 79, subsequent_indent="  ", break_long_words=False, break_on_hyphens=False)


def limitations(results: dict[str, dict], names: dict[str, str]) -> str:
    """Caveats, with the counts they rest on where a system was evaluated."""
    notes = ["All rows are synthetic: scores say how systems do on these sentence frames, not on real text."]
    for key, r in results.items():
        if r["status"] != "evaluated":
            notes.append(f"{names.get(key, key)} was not evaluated, so nothing here says how it compares.")
            continue
        exact, overlap = r["metrics"]["exact"], r["metrics"]["overlap"]
        address = exact["ADDRESS"]
        if address["fp"] == 0 and address["fn"] == 0:
            notes.append(f"{names.get(key, key)} finds all {address['tp']} addresses without error, as the frames hold few forms of them.")
        if overlap["micro"]["f1"] - exact["micro"]["f1"] > 0.3:
            notes.append(f"{names.get(key, key)} is much better by overlap ({number(overlap['micro']['f1'])}) than exactly ({number(exact['micro']['f1'])}): it finds entities, but not their boundaries.")
    return "\n".join(map(bullet, notes))


def benchmark_document(results: dict[str, dict], names: dict[str, str]) -> str:
    about = [("testset_path", "Test set"), ("n_examples", "rows"), ("testset_sha256", "SHA-256"), ("hardware", "hardware"), ("python", "Python")]
    facts = "\n".join(f"- {label}: {first_field(results, 'metadata', key)}" for key, label in about)
    parts = ["# Benchmark", facts, "## Results", main_table(results, names), "## Not evaluated", unevaluated_list(results, names)]
    parts += ["## Micro F1 by tier", tier_table(results, names), "## Limitations", limitations(results, names)]
    return "\n\n".join(parts) + "\n"


def readme_section(results: dict[str, dict], names: dict[str, str], document: str) -> str:
    """What lies between the markers of a README: the main table and where the rest is."""
    return f"<!-- Made from the result documents; do not edit. -->\n\n{main_table(results, names)}\n\nMethod, reasons and scores by tier are in [{document}]({document})."


def replace_section(text: str, body: str) -> str:
    """text with what lies between the two markers replaced; ValueError where they are missing."""
    if BEGIN not in text or END not in text.split(BEGIN, 1)[1]:
        raise ValueError(f"no {BEGIN} ... {END} in the text")
    head, rest = text.split(BEGIN, 1)
    return f"{head}{BEGIN}\n{body}\n{END}{rest.split(END, 1)[1]}"


def drift(path: Path, expected: str) -> list[str]:
    """The first lines of a diff from the file to what it should be; none where they agree."""
    have = path.read_text(encoding="utf-8") if path.exists() else ""
    diff = difflib.unified_diff(have.splitlines(), expected.splitlines(), str(path), f"{path} (rendered)", lineterm="")
    return list(diff)[:DIFF_LINES]
