"""Small results as Markdown and LaTeX. Only rows of a report come to the driver: clusters, methods or pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import agreement_label
from lexigrove.operators import agreement, audits, evaluation
from lexigrove.operators.taxonomy import Taxonomy, labelled


def _text(x: object, digits: int) -> str:
    return "--" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def markdown_table(df: DataFrame, digits: int = 2) -> str:
    """Rows in their order; missing values are dashes."""
    rows = [df.columns, ["-"] * len(df.columns), *([_text(x, digits) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in rows) + "\n"


def latex_results(cells: DataFrame, datasets: list[str], metrics: list[str], digits: int = 3) -> str:
    """``best_cells`` as a tabular: a line a method, panels apart, the best of each column underlined."""
    names = [f"{d}_{m}" for d in datasets for m in metrics]
    lines, panel = [f"\\begin{{tabular}}{{l{'r' * len(names)}}}", " & ".join(["method", *names]).replace("_", r"\_") + r" \\"], None
    for r in evaluation.results_table(cells, datasets, metrics).orderBy("panel", "method").collect():
        if r["panel"] != panel:
            panel = r["panel"]
            lines += [r"\hline", rf"\multicolumn{{{len(names) + 1}}}{{l}}{{{panel}}} \\"]
        shown = [rf"\underline{{{_text(r[n], digits)}}}" if r[f"{n}_best"] else _text(r[n], digits) for n in names]
        lines.append(" & ".join([r["method"].replace("_", r"\_"), *shown]) + r" \\")
    return "\n".join([*lines, r"\end{tabular}"]) + "\n"


def audit_report(rows: DataFrame, clusters: DataFrame, version: int) -> str:
    """Coverage, mean confidence, confidence counts, a line a cluster and the weak clusters, of the current version."""
    now = audits.current_version(rows, version)
    s = audits.assignment_stats(now, []).first()
    report = audits.metrics_report(now, clusters).orderBy("cluster_id")
    weak = [r.cluster_id for r in audits.weak_clusters(report).collect()]
    head = f"# Audits of version {version}\n\nCoverage {s.coverage:.0%} ({s.assigned} of {s.total}, {s.unclustered} unclustered), mean confidence {_text(s.mean_confidence, 2)}\n\n"
    parts = [markdown_table(audits.confidence_histogram(now).orderBy("confidence")), markdown_table(report)]
    return head + "\n".join(parts) + (f"\nWeak clusters: {', '.join(weak)}\n" if weak else "")


def agreement_report(pairs: DataFrame, entropic: int = 5) -> str:
    """Scores of each pair of proposals, their mean and its label, and the clusters that agree least."""
    cells = agreement.contingency(pairs, ["a", "b"])
    scores = agreement.partition_scores(cells, ["a", "b"])
    total = agreement.agreement_summary(scores).withColumn("label", agreement_label(F.col("mean_ari")))
    unsure = agreement.top_entropy(agreement.cluster_entropy(cells, ["a", "b"]), ["a", "b"], entropic)
    return "# Agreement\n\n" + "\n".join(markdown_table(t, 4) for t in (total, scores.orderBy("a", "b"), unsure.orderBy("a", "b", "rank")))


def taxonomy_summary(state: Taxonomy) -> str:
    """A taxonomy with its metrics, a line a cluster, and the changes that were rejected."""
    rows = labelled(state.clusters).select("cluster_id", "name", "description", F.size("evidence").alias("n_evidence"), "audit_assignments", "audit_mean_confidence", "confidence", "status")
    out = f"# Taxonomy, version {state.version}\n\nCoverage {_text(state.coverage, 2)}, mean confidence {_text(state.mean_confidence, 2)}\n\n" + markdown_table(rows.orderBy("cluster_id"))
    return out + ("\nRejected:\n" + "".join(f"- {x}\n" for x in state.rejected) if state.rejected else "")
