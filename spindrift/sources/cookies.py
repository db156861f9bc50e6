"""Cookie files as tables: a JSON list, a flat JSON object, or the tab-separated format of browsers."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAMES = ["file", "ord", "name", "value", "domain", "path", "secure"]
COOKIES = "file string, ord int, name string, value string, domain string, path string, secure boolean"
# fixed value: what marks a cookie that scripts can't read, on a line that is none of a comment
HTTP_ONLY = "#HttpOnly_"


def parse(text: str) -> list[tuple[str, str, str, str, bool]]:
    """(name, value, domain, path, secure) of a cookie file; none of one that can't be read."""
    text = text.strip()
    if text[:1] in ("[", "{"):
        try:
            tree = json.loads(text)
        except ValueError:
            return []
        if isinstance(tree, dict):
            return [(k, str(v), "", "/", False) for k, v in tree.items() if isinstance(v, (str, int, float))]
        rows = [c for c in tree if isinstance(c, dict) and isinstance(c.get("name"), str) and c.get("value") is not None]
        return [(c["name"], str(c["value"]), str(c.get("domain") or "").lstrip("."), str(c.get("path") or "/"), bool(c.get("secure", False))) for c in rows]
    out = []
    for line in map(str.strip, text.splitlines()):
        cells = line.removeprefix(HTTP_ONLY).split("\t")
        if (line.startswith("#") and not line.startswith(HTTP_ONLY)) or len(cells) < 7 or not cells[5]:
            continue
        out.append((cells[5], cells[6], cells[0].lstrip("."), cells[2] or "/", cells[3].strip().upper() == "TRUE"))
    return out


def read_cookies(files: DataFrame) -> DataFrame:
    """A row to each cookie of files (file, body), in their order."""

    def run(batches):
        for batch in batches:
            rows = [(f, k, *c) for f, text in zip(*(c.to_pylist() for c in batch.columns)) for k, c in enumerate(parse(text or ""))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=_NAMES)

    return files.select(F.col("file").cast("string"), F.col("body").cast("string")).mapInArrow(run, COOKIES)


def merged(cookies: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One cookie for each name and domain of a file: the last wins, and those given by hand (file, name, value), without a domain, win over all."""
    rows = cookies.withColumn("hand", F.lit(0))
    if given is not None:
        by_hand = given.select("file", F.lit(0).alias("ord"), "name", "value", F.lit("").alias("domain"), F.lit("/").alias("path"), F.lit(False).alias("secure"), F.lit(1).alias("hand"))
        rows = rows.unionByName(by_hand)
    last = F.max_by(F.struct("value", "path", "secure"), F.struct("hand", "ord"))
    return rows.groupBy("file", "name", "domain").agg(last.alias("l")).select("file", "name", "domain", "l.*")
