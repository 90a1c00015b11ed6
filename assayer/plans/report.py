"""Reports over stages: one envelope per operator run, consolidated, as plain dictionaries that JSON can hold."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators.issues import gravest, issue_summary

#: Rows of issues that a report shows; summaries count all.
SHOWN = 1000
#: Seconds up to which a run counts as excellent and as good.
EXCELLENT, GOOD = 30, 60


@dataclass
class StageResult:
    """What one operator reports. output: the table it hands on, if it changes one; it never goes into the JSON."""

    agent: str
    status: str = "success"
    seconds: float = 0.0
    metrics: dict = field(default_factory=dict)
    alerts: list[dict] = field(default_factory=list)
    row_issues: list[dict] = field(default_factory=list)
    issue_summary: list[dict] = field(default_factory=list)
    recommendations: list[dict] = field(default_factory=list)
    output: DataFrame | None = None


def run_stage(agent: str, work, df: DataFrame) -> StageResult:
    """Runs work(df) -> (output or None, metrics, issues or None); a failure becomes a result of status error, as one operator
    must not stop a report. The summary counts all issues, of which SHOWN are shown, the gravest first."""
    at = time.time()
    try:
        output, metrics, found = work(df)
        shown = [r.asDict() for r in gravest(found, SHOWN).collect()] if found is not None else []
        summary = [r.asDict() for r in issue_summary(found).collect()] if found is not None else []
        return StageResult(agent, "success", time.time() - at, metrics, [], shown, summary, [], output)
    except Exception as e:  # noqa: BLE001
        return StageResult(agent, "error", time.time() - at, alerts=[{"severity": "high", "message": str(e)[:500]}])


def run_chain(df: DataFrame, stages: dict) -> tuple[DataFrame, list[StageResult]]:
    """Stages one after another, each on what the one before handed on; failed stages are passed over. The final table is the
    last stage's."""
    results = []
    for agent, work in stages.items():
        results.append(run_stage(agent, work, df))
        df = results[-1].output if results[-1].output is not None else df
    return df, results


def consolidate(tool: str, results: list[StageResult]) -> dict:
    """One report: cards, totals, all alerts and issues with the agent they come from, and a narrative from a template."""
    seconds = sum(r.seconds for r in results)
    done = [r for r in results if r.status == "success"]
    total = sum(s["issues"] for r in results for s in r.issue_summary)
    grade = "excellent" if seconds < EXCELLENT else "good" if seconds < GOOD else "slow"
    by_severity: dict[str, int] = {}
    for r in results:
        for s in r.issue_summary:
            by_severity[s["severity"]] = by_severity.get(s["severity"], 0) + s["issues"]
    cards = [
        {"title": "agents", "value": f"{len(done)}/{len(results)}", "status": "good" if len(done) == len(results) else "warning"},
        {"title": "time", "value": round(seconds, 2), "status": grade},
        {"title": "alerts", "value": sum(len(r.alerts) for r in results), "status": "good" if not any(r.alerts for r in results) else "warning"},
        {"title": "issues", "value": total, "status": "good" if not total else "warning"},
        {"title": "recommendations", "value": sum(len(r.recommendations) for r in results), "status": "good"},
    ]
    worst = max(done, key=lambda r: sum(s["issues"] for s in r.issue_summary), default=None)
    said = f"{tool}: {len(done)} of {len(results)} operators ended well and found {total} issues."
    if worst and worst.issue_summary:
        said += f" Most come from {worst.agent}."
    return {
        "tool": tool,
        "status": "success" if len(done) == len(results) else "partial" if done else "error",
        "cards": cards,
        "issue_summary": {"total": total, "by_severity": by_severity, "by_agent": {r.agent: sum(s["issues"] for s in r.issue_summary) for r in results}},
        "alerts": [{"agent": r.agent, **a} for r in results for a in r.alerts],
        "row_issues": [{"agent": r.agent, **i} for r in results for i in r.row_issues][:SHOWN],
        "recommendations": [{"agent": r.agent, **x} for r in results for x in r.recommendations],
        "narrative": said,
        "agents": [{k: v for k, v in asdict_without_output(r).items() if k != "row_issues"} for r in results],
    }


def asdict_without_output(result: StageResult) -> dict:
    return asdict(StageResult(**{**result.__dict__, "output": None}))


def to_json(report: dict) -> str:
    """The report's text; dates and decimals as text."""
    return json.dumps(report, default=str, ensure_ascii=False, indent=1)
