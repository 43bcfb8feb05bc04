"""Topic documents: markdown files with front matter, and JSON logs."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "type string, title string, description string, status string, tags array<string>, triggers array<string>, depends array<string>, generated_at string, generated_by string, scope string, confidence string, extras map<string,string>, body string, parse_error string"
STATUSES = ("draft", "stable", "deprecated")
KNOWN = ("type", "title", "description", "status", "tags", "triggers", "depends", "generated", "scope", "confidence")


KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s:#][^:]*):(?:\s+(.*))?$""")


class Malformed(ValueError):
    pass


def scalar(text: str):
    """A scalar of the front matter's YAML subset. Dates stay text."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] == '"':
        try:
            return json.loads(t)
        except ValueError:
            return t[1:-1]
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if t in ("", "~", "null", "Null", "NULL"):
        return None
    if t.lower() in ("true", "false") and t in (t.lower(), t.upper(), t.title()):
        return t.lower() == "true"
    if re.fullmatch(r"-?\d+(\.\d+)?", t):
        return float(t) if "." in t else int(t)
    if t[0] == "[" and t[-1] == "]":
        return [scalar(x) for x in split_flow(t[1:-1])]
    if t[0] == "{" and t[-1] == "}":
        return {str(scalar(k)): scalar(v) for k, _, v in (x.partition(":") for x in split_flow(t[1:-1]))}
    return t


def split_flow(text: str) -> list[str]:
    """Items between commas that stand in no quotes and no brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x for x in [*out, text[start:]] if x.strip()]


def front_matter(text: str) -> dict:
    """Nested maps and lists by indentation, from lines of "key: value", "key:" and "- item"."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            items = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                rest = lines[i][1][2:].strip()
                if (m := KEY.match(rest)) and rest[0] not in "\"'[{":
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                    items.append(value)
                else:
                    items.append(scalar(rest))
                    i += 1
            return items, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            if not (m := KEY.match(lines[i][1])):
                raise Malformed(f"no key: {lines[i][1][:40]}")
            key, value = m[1].strip("\"'"), (m[2] or "").strip()
            i += 1
            if value:
                found[key] = scalar(value)
            elif i < len(lines) and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("- "))):
                found[key], i = block(i, lines[i][0])
            else:
                found[key] = None
        return found, i

    out, end = block(0, lines[0][0]) if lines else ({}, 0)
    if end < len(lines):
        raise Malformed(f"bad indentation: {lines[end][1][:40]}")
    return out


def strings(value, name: str) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise Malformed(f"{name} is no list of strings")
    return value


def parse_topic(raw: str) -> dict:
    """A document's fields. Structural errors give parse_error only; slips fall back to defaults."""
    try:
        m = re.match(r"^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$", raw or "", re.S)
        if not m:
            raise Malformed("no front matter")
        fm = front_matter(m[1].replace("\r\n", "\n"))
        if not isinstance(fm, dict) or not isinstance(fm.get("type"), str) or not fm["type"]:
            raise Malformed("no type")
        status = fm.get("status") or "draft"
        if status not in STATUSES:
            raise Malformed("unknown status")
        triggers = fm.get("triggers")
        triggers = [x for x in triggers if isinstance(x, str)] if isinstance(triggers, list) else [triggers] if isinstance(triggers, str) else []
        made = fm.get("generated") if isinstance(fm.get("generated"), dict) else {}
        text = lambda k: None if fm.get(k) is None else str(fm[k])
        lesson = fm["type"].lower() == "lesson"
        return {
            "type": fm["type"], "title": text("title") or fm["type"], "description": text("description"), "status": status, "tags": strings(fm.get("tags"), "tags"), "triggers": triggers, "depends": strings(fm.get("depends"), "depends"),
            "generated_at": str(made.get("at") or "1970-01-01T00:00:00.000Z"), "generated_by": str(made.get("by") or "unknown"),
            "scope": (fm.get("scope") if fm.get("scope") in ("workspace", "global") else "workspace") if lesson else None,
            "confidence": (fm.get("confidence") if fm.get("confidence") in ("hint", "established") else "hint") if lesson else None,
            "extras": {k: json.dumps(v, ensure_ascii=False) for k, v in fm.items() if k not in KNOWN}, "body": m[2] or "", "parse_error": None,
        }
    except Malformed as e:
        return {"parse_error": str(e)}


def quoted(value) -> str:
    if isinstance(value, str):
        plain = re.fullmatch(r"[\w./][\w ./-]*", value) and scalar(value) == value and value == value.strip()
        return value if plain else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False)


def render_topic(doc: dict) -> str:
    """A document's text, keys in fixed order; parse_topic reads it back."""
    lines = [f"{k}: {quoted(doc[k])}" for k in ("type", "title", "description", "status", "scope", "confidence") if doc.get(k) is not None]
    for k in ("tags", "triggers", "depends"):
        if doc.get(k):
            lines += [f"{k}:", *(f"  - {quoted(x)}" for x in doc[k])]
    lines += ["generated:", f"  by: {quoted(doc.get('generated_by') or 'unknown')}", f"  at: {json.dumps(doc.get('generated_at') or '')}"]
    lines += [f"{k}: {v}" for k, v in sorted((doc.get("extras") or {}).items())]
    return "---\n" + "\n".join(lines) + "\n---\n" + (doc.get("body") or "")


def parse_documents(raw: DataFrame, text_col: str = "text") -> DataFrame:
    """raw with the columns of its parsed documents. The grammar nests, so an Arrow UDF parses; a batch at a time."""

    @F.pandas_udf(DOCUMENT)
    def parse(texts):
        import pandas as pd

        names = [x.split()[0] for x in DOCUMENT.split(", ")]
        return pd.DataFrame([{**dict.fromkeys(names), **parse_topic(t)} for t in texts], columns=names)

    return raw.withColumn("_doc", parse(F.col(text_col))).select(*raw.columns, "_doc.*")


def scan_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of a folder of markdown files, the index left out: slug and parsed fields; broken files have parse_error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    raw = files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"), F.decode("content", "UTF-8").alias("text")).where("slug <> 'index'")
    return parse_documents(raw).drop("text")


def nfkc(c):
    """A column's text in NFKC; ASCII text is so already and skips Python."""

    @F.pandas_udf("string")
    def norm(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(norm(c))


def json_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines log; torn lines are skipped."""
    from pyspark.sql.types import StringType, StructField, _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where("r is not null and r._corrupt is null").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def embedding_index(spark: SparkSession, path: str) -> DataFrame:
    """slug, model, dim, vec of an index kept as one JSON object."""
    raw = spark.read.text(path, wholetext=True)
    entry = "map<string,struct<model:string,dim:int,vec:array<double>>>"
    return raw.select(F.explode(F.from_json("value", entry)).alias("slug", "e")).select("slug", "e.*")


def literal_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Literals of a list: a line each, comments, blank and short ones (under 8 characters) left out."""
    return spark.read.text(path).select(F.trim("value").alias("secret")).where("secret <> '' and not startswith(secret, '#') and length(secret) >= 8")


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a JSON-lines log."""
    df.write.mode("append").json(path)
