"""Where results go. Row formats are written in parallel; a document (JSON, Markdown, HTML, GraphML, text) is a table of its lines,
sorted and written as parts that put together in their order are the document: no report has a limit, and none is built on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from html import escape
from typing import Any
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import report

CSV_COLUMNS = ["method", "url", "type", "confidence", "source", "source_url", "status_code", "content_type", "params", "tags"]
ENDPOINT = ["url", "method", "type", "source", "source_url", "confidence", "status_code", "content_type", "params", "tags", "evidence"]
BOM = "\ufeff"


def flat(endpoints: DataFrame) -> DataFrame:
    """CSV columns: arrays joined by spaces, null as empty."""
    arrays = {c for c, t in endpoints.dtypes if t.startswith("array")}
    return endpoints.select(*[F.coalesce(F.array_join(c, " ") if c in arrays else F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(endpoints: DataFrame, path: str) -> None:
    """Rows as CSV; each part begins with a header and the mark by which spreadsheets know UTF-8."""
    rows = flat(endpoints)
    marked = rows.toDF(BOM + rows.columns[0], *rows.columns[1:])
    marked.write.mode("overwrite").option("header", True).csv(path)


def write_json_rows(endpoints: DataFrame, path: str) -> None:
    endpoints.write.mode("overwrite").json(path)


def append_history(endpoints: DataFrame, path: str, scan_id: int) -> None:
    """One more scan in the history table; scans are partitions."""
    endpoints.withColumn("scan_id", F.lit(scan_id)).write.mode("append").partitionBy("scan_id").parquet(path)


@dataclass
class Scan:
    """What a report is about: tables, any of which may be missing, and a few values."""

    endpoints: DataFrame
    target: str = ""
    assets: DataFrame | None = None
    errors: DataFrame | None = None
    routes: DataFrame | None = None
    technologies: DataFrame | None = None
    values: dict[str, Any] = field(default_factory=dict)


def _at(section: int, *keys) -> Column:
    """The place of a line: section, a number, and up to four strings."""
    number = next((k for k in keys if not isinstance(k, str)), F.lit(0))
    texts = [F.col(k) for k in keys if isinstance(k, str)]
    texts += [F.lit("")] * (4 - len(texts))
    return F.struct(F.lit(section).alias("s"), number.cast("long").alias("n"), *[F.coalesce(t, F.lit("")).alias(f"t{k}") for k, t in enumerate(texts)]).alias("at")


def _fixed(df: DataFrame, lines: dict[int, str]) -> DataFrame:
    """Lines that are there once, by section."""
    each = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("line")) for s, t in lines.items()])).alias("l")).select("l.*")
    return each.select(F.struct("s", F.lit(0).cast("long").alias("n"), *[F.lit("").alias(f"t{k}") for k in range(4)]).alias("at"), "line")


def write_document(lines: DataFrame, path: str) -> None:
    """Parts in the order of their names are the document."""
    lines.orderBy("at").select("line").write.mode("overwrite").text(path)


def endpoint_json(endpoints: DataFrame) -> Column:
    columns = [c for c in (*ENDPOINT, "discovered_at") if c in endpoints.columns]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_report(endpoints: DataFrame, target: str) -> DataFrame:
    """section and line: the endpoints, the counts by type and the summary, a JSON object each."""
    counts = report.type_counts(endpoints).select(F.lit("type_counts").alias("section"), F.to_json(F.struct("type", "n")).alias("line"))
    whole = report.summarize(endpoints).select(F.lit("summary").alias("section"), F.to_json(F.struct("*", F.lit(target).alias("target"))).alias("line"))
    return endpoints.select(F.lit("endpoints").alias("section"), endpoint_json(endpoints).alias("line")).unionByName(counts).unionByName(whole)


def json_document(scan: Scan) -> DataFrame:
    """One JSON document of fifteen keys, as lines."""
    e = scan.endpoints
    given = lambda k, missing=None: json.dumps(scan.values.get(k, missing), default=str)
    plain = {"target": json.dumps(scan.target)} | {k: given(k, m) for k, m in (("scan_time", None), ("page_title", None), ("scripts", 0), ("requests", 0), ("stats", {}), ("protection", None), ("challenges", 0))}
    out = _fixed(e, {0: "{" + ", ".join(f'"{k}": {v}' for k, v in plain.items())})
    out = out.unionByName(report.summarize(e).select(_at(1), F.concat(F.lit(', "summary": '), F.to_json(F.struct("*"))).alias("line")))
    lists: list[tuple[str, DataFrame | None, Any, list[str]]] = [
        ("type_counts", report.type_counts(e), F.to_json(F.struct("type", "n")), ["type"]),
        ("technologies", scan.technologies, F.to_json(F.struct("name")), ["name"]),
        ("routes", scan.routes, F.to_json(F.struct("url")), ["url"]),
        ("endpoints", e, endpoint_json(e), ["type", "url", "method"]),
        ("assets", scan.assets, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), ["url"]),
        ("errors", scan.errors, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), ["url"]),
    ]
    for k, (name, rows, line, order) in enumerate(lists):
        out = out.unionByName(_fixed(e, {10 * k + 2: f', "{name}": [', 10 * k + 4: "]"}))
        if rows is not None:
            own = rows.select(_at(10 * k + 3, *order), line.alias("line"))
            first = own.agg(F.min(F.struct("at", "line")).alias("_first"))  # the one that no comma precedes
            own = own.crossJoin(F.broadcast(first)).select("at", F.when(F.struct("at", "line") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(", "), "line")).alias("line"))
            out = out.unionByName(own.dropDuplicates())
    return out.unionByName(_fixed(e, {99: "}"}))


def _cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _by_type(endpoints: DataFrame) -> DataFrame:
    """Endpoints with the number of their type."""
    return endpoints.join(F.broadcast(report.type_counts(endpoints)), "type")  # a row a type, of which there are thirteen


def markdown(scan: Scan) -> DataFrame:
    """A report by type, the most frequent first; cells escape bars."""
    counts, rows = report.type_counts(scan.endpoints), _by_type(scan.endpoints)
    out = _fixed(scan.endpoints, {0: f"# Endpoints of {scan.target}\n\n| Type | Count |\n| --- | --- |"})
    out = out.unionByName(counts.select(_at(1, -F.col("n"), "type"), F.concat(F.lit("| "), _cell(F.col("type")), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line")))
    titles = counts.select(_at(2, -F.col("n"), "type"), F.concat(F.lit("\n## "), F.col("type"), F.lit("\n\n| Method | URL | Confidence |\n| --- | --- | --- |")).alias("line"))
    lines = rows.select(_at(2, -F.col("n"), "type", "url", "method"), F.concat(F.lit("| "), F.col("method"), F.lit(" | "), _cell(F.col("url")), F.lit(" | "), F.col("confidence"), F.lit(" |")).alias("line"))
    return out.unionByName(titles).unionByName(lines)


_SCRIPT = "const q=document.getElementById('q'),b=document.getElementById('b');function f(){const s=q.value.toLowerCase();b.textContent='';for(const r of D)if(JSON.stringify(r).toLowerCase().includes(s)){const t=b.insertRow();for(const k of ['method','url','type','confidence'])t.insertCell().textContent=r[k]}}q.oninput=f;f()"


def html(scan: Scan) -> DataFrame:
    """A page of its own with the rows as data; `</` can't end the script."""
    row = F.replace(F.to_json(F.struct("method", "url", "type", "confidence")), F.lit("</"), F.lit("<\\/"))
    lines = scan.endpoints.select(_at(1, "type", "url", "method"), F.concat(row, F.lit(",")).alias("line"))
    top = f"<!doctype html><meta charset=utf-8><title>{escape(scan.target)}</title><input id=q><table><tbody id=b></tbody></table><script>const D=["
    return _fixed(scan.endpoints, {0: top, 2: f"];{_SCRIPT}</script>"}).unionByName(lines)


def _quoted(value: Column) -> Column:
    v = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), v, F.lit('"'))


def graphml(scan: Scan) -> DataFrame:
    """Sources and endpoints as a directed graph: nodes with kind and type, edges with their relation."""
    pairs = report.edges(scan.endpoints)
    ends = scan.endpoints.groupBy("url").agg(F.min("type").alias("type"))
    sources = pairs.select(F.col("src").alias("url")).distinct().join(ends, "url", "left_anti")
    nodes = ends.select("url", F.lit("endpoint").alias("kind"), "type").unionByName(sources.select("url", F.lit("source").alias("kind"), F.lit("").alias("type")))
    data = lambda k, v: F.concat(F.lit(f"<data key={quoteattr(k)}>"), F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</data>"))
    keys = "".join(f'<key id={quoteattr(k)} for={quoteattr(of)} attr.name={quoteattr(k)} attr.type="string"/>' for k, of in (("kind", "node"), ("type", "node"), ("relation", "edge")))
    out = _fixed(scan.endpoints, {0: f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">', 3: "</graph></graphml>"})
    out = out.unionByName(nodes.select(_at(1, "url"), F.concat(F.lit("<node id="), _quoted(F.col("url")), F.lit(">"), data("kind", F.col("kind")), data("type", F.col("type")), F.lit("</node>")).alias("line")))
    edges = pairs.select(_at(2, "src", "dst"), F.concat(F.lit("<edge source="), _quoted(F.col("src")), F.lit(" target="), _quoted(F.col("dst")), F.lit(">"), data("relation", F.coalesce("relation", F.lit(""))), F.lit("</edge>")).alias("line"))
    return out.unionByName(edges)


def terminal(scan: Scan, limit: int = 0) -> DataFrame:
    """Tables by type, the most frequent first: method, URL, source and the first letter of the confidence; `limit` rows a type, 0 for all."""
    from ..operators.select import top_of_each_type

    rows, counts = _by_type(scan.endpoints), report.type_counts(scan.endpoints)
    shown = top_of_each_type(rows, limit).drop("position") if limit else rows
    title = counts.select(_at(1, -F.col("n"), "type"), F.concat(F.lit("["), F.col("type"), F.lit("]  ("), F.col("n").cast("string"), F.lit(")\n"), F.lit("METHOD  URL  SOURCE  C")).alias("line"))
    line = F.concat(F.rpad("method", 7, " "), F.lit(" "), F.col("url"), F.lit("  "), F.coalesce("source", F.lit("")), F.lit("  "), F.upper(F.left("confidence", F.lit(1))))
    out = title.unionByName(shown.select(_at(1, -F.col("n"), "type", "url", "method"), line.alias("line")))
    if limit:
        more = counts.where(F.col("n") > limit).withColumn("_last", F.lit("\uffff"))
        out = out.unionByName(more.select(_at(1, -F.col("n"), "type", "_last"), F.concat(F.lit("  … "), (F.col("n") - limit).cast("string"), F.lit(" more")).alias("line")))
    return out


def text_summary(endpoints: DataFrame) -> str:
    s = report.summarize(endpoints).first()
    return "\n".join(f"{k}: {s[k]}" for k in s.asDict())


DOCUMENTS = {"json": json_document, "markdown": markdown, "html": html, "graphml": graphml, "text": terminal}


def write_reports(scan: Scan, formats: list[str], folder: str) -> tuple[dict[str, str], dict[str, str]]:
    """(paths by format, errors by format): a format that fails doesn't take the others with it."""
    done, failed = {}, {}
    for f in formats:
        path = f"{folder}/{f}"
        try:
            if f == "csv":
                write_csv(scan.endpoints, path)
            else:
                write_document(DOCUMENTS[f](scan), path)
            done[f] = path
        except Exception as e:  # reported to the caller, by format
            failed[f] = f"{type(e).__name__}: {e}"
    return done, failed
