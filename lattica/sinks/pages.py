"""Drawn graphs that need no server: SVG, a page of its own, a notebook view, a static site.

A drawing shows at most ``most`` nodes, the best connected ones; the limit is the
feature, as no screen shows more.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import layout
from lattica.operators.merge import drop_dangling, with_degree
from lattica.schema import Graph


def drawn(graph: Graph, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes with px, py and degree, edges among them) of the ``most`` best connected nodes, on a circle."""
    best = with_degree(graph.nodes, graph.edges).orderBy(F.desc("degree"), "id").limit(most)
    placed = layout.circle(best)
    return placed.select("id", F.coalesce("label", "id").alias("label"), "type", "degree", "px", "py"), drop_dangling(graph.edges, best).select("src", "rel", "dst")


def svg_lines(nodes: DataFrame, edges: DataFrame, size: float = 1200.0) -> DataFrame:
    """Lines (value) of an SVG drawing of placed nodes: edges first, then circles with their labels."""
    at = lambda c, end: F.round(size / 2 + F.col(c), 2).alias(end)
    ends = nodes.select("id", at("px", "x"), at("py", "y"))
    joined = edges.join(ends.withColumnsRenamed({"id": "src", "x": "x1", "y": "y1"}), "src").join(ends.withColumnsRenamed({"id": "dst", "x": "x2", "y": "y2"}), "dst")
    lines = joined.select(F.lit(1).alias("k"), F.concat_ws(" ", "src", "rel", "dst").alias("by"), F.format_string('<line x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f" stroke="#bbb"/>', "x1", "y1", "x2", "y2").alias("value"))
    radius = 3 + F.log1p("degree") * 2
    dots = nodes.select(F.lit(2).alias("k"), F.col("id").alias("by"), F.concat(F.format_string('<circle cx="%.2f" cy="%.2f" r="%.2f" fill="#456"/>', size / 2 + F.col("px"), size / 2 + F.col("py"), radius), F.format_string('<text x="%.2f" y="%.2f" font-size="10">', size / 2 + F.col("px") + 6, size / 2 + F.col("py")), T.xml_escape(F.col("label")), F.lit("</text>")).alias("value"))
    frame = nodes.sparkSession.createDataFrame([(0, "", f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size:g} {size:g}">'), (3, "", "</svg>")], "k int, by string, value string")
    return frame.unionByName(lines).unionByName(dots).orderBy("k", "by").select("value")


SCRIPT = """
const g = JSON.parse(document.getElementById("graph").textContent), by = {};
const c = document.querySelector("canvas"), x = c.getContext("2d"), q = document.querySelector("input");
g.nodes.forEach(n => by[n.id] = n);
function draw() {
  const w = c.width = c.clientWidth, h = c.height = c.clientHeight, s = Math.min(w, h) / 1150, word = q.value.toLowerCase();
  const at = n => [w / 2 + n.px * s, h / 2 + n.py * s];
  x.strokeStyle = "#ccc";
  g.edges.forEach(e => { x.beginPath(); x.moveTo(...at(by[e.src])); x.lineTo(...at(by[e.dst])); x.stroke(); });
  g.nodes.forEach(n => {
    const hit = word && n.label.toLowerCase().includes(word), [a, b] = at(n);
    x.fillStyle = hit ? "#c30" : "#456"; x.beginPath(); x.arc(a, b, 3 + Math.log1p(n.degree), 0, 7); x.fill();
    if (hit || g.nodes.length < 60) x.fillText(n.label, a + 6, b + 3);
  });
}
addEventListener("resize", draw); q.addEventListener("input", draw); draw();
"""


def payload(graph: Graph, most: int = 300) -> dict:
    """The drawn part of a graph as plain values."""
    nodes, edges = drawn(graph, most)
    return {"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}


def standalone_html(graph: Graph, title: str = "Graph", most: int = 300) -> str:
    """A page with the graph and its viewer in one file."""
    data = json.dumps(payload(graph, most), ensure_ascii=False).replace("</", "<\\/")
    name = html.escape(title)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{name}</title><style>body{{margin:0;font:14px sans-serif}}canvas{{width:100vw;height:90vh}}</style></head><body><h1>{name}</h1><input placeholder="find" aria-label="find"><canvas></canvas><script type="application/json" id="graph">{data}</script><script>{SCRIPT}</script></body></html>\n'


def embed_html(graph: Graph, title: str = "Graph", height: int = 500, most: int = 300) -> str:
    """The page within a frame, for a notebook cell or another page."""
    return f'<iframe srcdoc="{html.escape(standalone_html(graph, title, most), quote=True)}" style="width:100%;height:{height}px;border:0"></iframe>'


class NotebookView:
    """Shows itself in a notebook."""

    def __init__(self, graph: Graph, title: str = "Graph", height: int = 500, most: int = 300):
        self.graph, self.title, self.height, self.most = graph, title, height, most

    def _repr_html_(self) -> str:
        return embed_html(self.graph, self.title, self.height, self.most)


def publish(graph: Graph, path: str, title: str = "Graph", most: int = 300, head: dict | None = None) -> None:
    """A static site in a local folder: the page, the drawn part, and the whole graph file beside it."""
    from lattica.sinks.files import graph_json

    at = Path(path)
    at.mkdir(parents=True, exist_ok=True)
    (at / "index.html").write_text(standalone_html(graph, title, most), encoding="utf-8")
    (at / "embed.html").write_text(embed_html(graph, title, most=most), encoding="utf-8")
    graph_json(graph, str(at / "graph.json"), head)


def web_component(name: str = "lattica-graph") -> str:
    """A script that defines an element which loads ``src`` and draws it."""
    return f"""customElements.define({json.dumps(name)}, class extends HTMLElement {{
  async connectedCallback() {{
    const data = await (await fetch(this.getAttribute("src"))).text();
    const page = `<body style="margin:0"><input><canvas style="width:100%;height:90vh"></canvas><script type="application/json" id="graph">${{data.replaceAll("</", "<\\\\/")}}<\\/script><script>{{SCRIPT}}<\\/script></body>`;
    const frame = document.createElement("iframe");
    frame.style = "width:100%;height:100%;border:0";
    frame.srcdoc = page;
    this.append(frame);
  }}
}});
""".replace("{SCRIPT}", SCRIPT.replace("\\", "\\\\").replace("`", "\\`").replace("$", "\\$"))
