"""Sections of container definition files.

A file has a header of `Key: value` lines and sections that begin with %name (and, for sections of an
app, the app's name).  Readers get one row per section; labels are read from their sections.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = re.compile(r"^%(\w+)(?:[ \t]+(\S+))?[ \t]*$")


def sections(text: str) -> list[tuple[str, str, str]]:
    """(section, app, body) in order; what precedes the first section is the section `header`."""
    out, name, app, body = [], "header", "", []
    for line in text.splitlines():
        if found := HEAD.match(line):
            out.append((name, app, "\n".join(body).strip("\n")))
            name, app, body = found[1], found[2] or "", []
        elif not line.lstrip().startswith("#"):
            body.append(line)
    return [*out, (name, app, "\n".join(body).strip("\n"))]


def parse(files: DataFrame) -> DataFrame:
    """path, ordinal, section, app and body of files (path, text)."""

    def run(frames):
        for pdf in frames:
            rows = [(p, i, *s) for p, t in zip(pdf["path"], pdf["text"], strict=True) for i, s in enumerate(sections(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "section", "app", "body"])

    return files.select("path", "text").mapInPandas(run, "path string, ordinal int, section string, app string, body string")


def labels(parsed: DataFrame) -> DataFrame:
    """path, app, label, value and error (no value, given twice) of the label sections."""
    lines = parsed.where("section in ('labels', 'applabels')").select("path", "app", F.explode(F.split("body", "\n")).alias("line")).where("trim(line) <> ''")
    named = lines.select("path", "app", F.regexp_extract(F.trim("line"), r"^(\S+)", 1).alias("label"), F.trim(F.regexp_extract(F.trim("line"), r"^\S+\s*(.*)$", 1)).alias("value"))
    many = named.groupBy("path", "app", "label").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return many.select("path", "app", "label", "value", F.when(F.col("n") > 1, "given twice").when(F.col("value") == "", "no value").alias("error"))
