"""A session's dashboard: one payload, and a self-contained page around it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_POINTS = 2_000
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:right}}</style></head><body>
<h1>{title}</h1><svg id="curve" width="800" height="200"></svg><table id="rows"></table>
<script id="data" type="application/json">{data}</script><script>
const d = JSON.parse(document.getElementById("data").textContent), ys = d.equity.map(p => p.equity);
const lo = Math.min(...ys), hi = Math.max(...ys), span = hi - lo || 1;
const at = (y, i) => (800 * i / Math.max(ys.length - 1, 1)) + "," + (195 - 190 * (y - lo) / span);
const line = document.createElementNS("http://www.w3.org/2000/svg", "polyline");
line.setAttribute("points", ys.map(at).join(" ")); line.setAttribute("fill", "none"); line.setAttribute("stroke", "black");
document.getElementById("curve").append(line);
for (const a of d.actions) {{ const r = document.getElementById("rows").insertRow();
  for (const v of [a.action, a.reason, a.n]) r.insertCell().textContent = v ?? ""; }}
</script></body></html>"""


def payload(curve: DataFrame, decisions: DataFrame, points: int = MOST_POINTS) -> dict:
    """Equity at `points` equal steps of time at most, and counts of actions and reasons; both are small whatever the session."""
    bounds = curve.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    if bounds.a is None:
        return {"equity": [], "actions": []}
    width = max((bounds.b - bounds.a).total_seconds() / points, 1e-6)
    start = F.unix_micros(F.lit(bounds.a).cast("timestamp"))
    step = F.least(F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - start) / (width * 1e6)), F.lit(points - 1))
    sampled = curve.groupBy(step.alias("step")).agg(F.max("timestamp").alias("t"), F.max_by("equity", "timestamp").alias("equity")).orderBy("step")
    actions = decisions.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("action", "reason")
    return {
        "equity": [{"t": r.t.isoformat(), "equity": r.equity} for r in sampled.collect()],
        "actions": [r.asDict() for r in actions.collect()],
    }


def page(data: dict, title: str = "Session") -> str:
    """HTML with the payload embedded; a closing script tag in a value cannot end it."""
    text = json.dumps(data).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return PAGE.format(title=safe, data=text)


def write_dashboard(path: str, data: dict, title: str = "Session") -> None:
    Path(path).write_text(page(data, title), encoding="utf-8")
