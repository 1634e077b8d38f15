"""Results as HTML tables and, where plotly is installed, as figures."""

from __future__ import annotations

import html
import math
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame


def format_value(value: Any, digits: int = 6) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "-" if math.isnan(value) else f"{value:.{digits}g}"
    return str(value)


def html_table(title: str, rows: Iterable[tuple[str, Any]]) -> str:
    """An escaped two-column table."""
    body = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(format_value(v))}</td></tr>" for k, v in rows)
    return f"<table><caption>{html.escape(title)}</caption><tbody>{body}</tbody></table>"


def row_table(title: str, df: DataFrame) -> str:
    """The first row of a result as a table."""
    row = df.first()
    return html_table(title, row.asDict().items() if row else [])


def _plotly():
    try:
        import plotly.graph_objects as go
    except ImportError as e:
        raise ImportError("figures need plotly") from e
    return go


def pbo_distribution(cscv: DataFrame, title: str | None = None):
    """Histogram of the splits' logits; a row per split is collected."""
    go = _plotly()
    return go.Figure(go.Histogram(x=[r["logit"] for r in cscv.select("logit").collect()]), layout={"title": title or "Logits of the best trial's rank"})


def deflated_sharpe_comparison(results: Mapping[str, Mapping[str, float]], title: str | None = None):
    go = _plotly()
    return go.Figure([go.Bar(name=k, x=list(results), y=[r[k] for r in results.values()]) for k in ("sr_hat", "sr_star", "dsr")], layout={"barmode": "group", "title": title or "Deflated Sharpe ratios"})


def monte_carlo_histogram(trials: DataFrame, columns: Sequence[str] = ("std_u", "seq_u"), title: str | None = None):
    go = _plotly()
    rows = trials.select(*columns).collect()
    return go.Figure([go.Histogram(name=c, x=[r[c] for r in rows], opacity=0.6) for c in columns], layout={"barmode": "overlay", "title": title or "Trials"})
