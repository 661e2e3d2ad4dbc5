"""File sources and sinks: strict CSV, text records, JSON maps, usage logs, vectors, graphs and manifests."""

from __future__ import annotations

import csv
import decimal
import hashlib
import io
import json
import os
import re
import tempfile
import xml.sax.saxutils as sax
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fingerprint


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, in the order given; quotes may hold line ends; a byte order mark is dropped; empty cells are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    return frame.withColumn(columns[0], F.regexp_replace(columns[0], "^﻿", ""))


def read_typed(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, read by a DDL schema; only `columns` are parsed.  A cell that does not fit its type is null."""
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return frame.select(*columns) if columns else frame


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose types come from a pass over the whole file."""
    return spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", 1.0).option("multiLine", True).option("escape", '"').csv(path)


def load_all(spark: SparkSession, root: str, tables: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The named CSV files of a folder, each with its required columns; all that is missing is told at once."""
    out, missing = {}, []
    for name, columns in tables.items():
        path = f"{root.rstrip('/')}/{name}.csv"
        if not _fs(spark, path)[0].exists(_fs(spark, path)[1]):
            missing.append(name)
            continue
        head = spark.read.option("header", True).csv(path).columns
        lacks = [c for c in columns if c not in [h.lstrip("\ufeff") for h in head]]
        missing += [f"{name}.{c}" for c in lacks]
        if not lacks:
            out[name] = read_csv(spark, path, [h.lstrip("\ufeff") for h in head]).select(*columns)
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return out


def contract(frame: DataFrame, columns: Sequence[str], unique: Sequence[str] = (), filled: Sequence[str] = ()) -> dict[str, int]:
    """Failures of a schema contract, in one pass and one aggregate a key: rows with an empty required cell, and keys that come again."""
    require(frame, [*columns, *unique, *filled])
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    counts = frame.agg(*[F.count_if(blank(c)).alias(c) for c in filled]).first().asDict() if filled else {}
    out = {f"{c}_empty": n for c, n in counts.items()}
    if unique:
        out["key_repeated"] = frame.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").count()
    return out


def years(frame: DataFrame, column: str, low: int, high: int, freeze: int | None = None) -> DataFrame:
    """Rows whose year is a whole number within bounds (and by the freeze); the column becomes an int, anything else goes."""
    y = F.trim(F.col(column).cast("string")).try_cast("double").cast("int")
    out = frame.withColumn(column, y).where(F.col(column).between(low, high))
    return out.where(F.col(column) <= freeze) if freeze is not None else out


def union_sources(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """All sources in one table, each row with its source and an id of source and key; columns that a source lacks are null."""
    out = None
    for name, frame in frames.items():
        one = frame.withColumn("source", F.lit(name)).withColumn("row_id", F.concat_ws(":", F.lit(name), F.col(key).cast("string")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small text file in any store, published whole: it is written aside and renamed, so no reader sees a part of it."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        if not overwrite:
            raise ValueError(f"{path} exists")
    aside = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if overwrite:
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path} could not be published")


def get_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def scalar(value: object) -> str | int | float | bool:
    """A cell as an exporter takes it: null becomes the empty text, numpy and decimal numbers plain ones, text is cleaned."""
    if value is None or value != value:
        return ""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (bool, int, float)):
        return value
    return " ".join(str(value).split())


def write_json(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("ignoreNullFields", False).json(path)


def publish_json(spark: SparkSession, path: str, value: object, overwrite: bool = True) -> None:
    """A small object as canonical JSON (sorted keys, no spaces), published whole."""
    put_text(spark, path, canonical_json(value), overwrite)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def csv_sha256(frame: DataFrame, order: Sequence[str]) -> str:
    """SHA-256 of the table as one CSV in a total order, rows streamed: equal tables give equal hashes wherever they were written."""
    digest = hashlib.sha256()
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(frame.columns)
    for row in frame.orderBy(*order).toLocalIterator():
        w.writerow([scalar(x) for x in row])
        digest.update(out.getvalue().encode())
        out.seek(0)
        out.truncate()
    digest.update(out.getvalue().encode())
    return digest.hexdigest()


def write_one_csv(frame: DataFrame, path: str, order: Sequence[str]) -> int:
    """One CSV file with a byte order mark and fixed line ends, rows streamed in order; refuses an empty table.  Returns the rows written."""
    n = 0
    with open(path, "x", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(frame.columns)
        for row in frame.orderBy(*order).toLocalIterator():
            w.writerow([scalar(x) for x in row])
            n += 1
    if not n:
        os.unlink(path)
        raise ValueError("nothing to write")
    return n


def markdown(frame: DataFrame, order: Sequence[str], most: int = 200) -> str:
    """A Markdown table of the first `most` rows; bars are escaped."""
    cell = lambda x: str(scalar(x)).replace("|", "\\|")
    rows = frame.orderBy(*order).limit(most).collect()
    return "\n".join(["| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]) + "\n"


def write_xlsx(path: str, sheets: dict[str, DataFrame], orders: dict[str, Sequence[str]], widest: int = 60) -> None:
    """A workbook: a sheet a table, a frozen bold header, columns as wide as their cells, rows streamed in order.

    A sheet holds 1,048,575 rows; a larger table is an error.
    """
    esc = lambda x: sax.escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(x)))

    def cell(x: object, style: str = "") -> str:
        x = scalar(x)
        if isinstance(x, bool):
            return f'<c t="b"{style}><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c{style}><v>{x}</v></c>"
        return f'<c t="inlineStr"{style}><is><t xml:space="preserve">{esc(x)}</t></is></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    names = list(sheets)
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        for i, name in enumerate(names, 1):
            frame = sheets[name]
            wide = [len(c) for c in frame.columns]
            n = 1
            with tempfile.TemporaryFile("w+", encoding="utf-8") as body:
                body.write("<row>" + "".join(cell(c, ' s="1"') for c in frame.columns) + "</row>")
                for r in frame.orderBy(*orders[name]).toLocalIterator():
                    n += 1
                    if n > 1_048_576:
                        raise ValueError(f"{name} is too long for a sheet")
                    wide = [max(w, min(len(str(scalar(x))), widest)) for w, x in zip(wide, r, strict=True)]
                    body.write("<row>" + "".join(map(cell, r)) + "</row>")
                body.seek(0)
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    columns = "".join(f'<col min="{k}" max="{k}" width="{w + 2}" customWidth="1"/>' for k, w in enumerate(wide, 1))
                    out.write(f'{head}<worksheet {main}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>'.encode())
                    while piece := body.read(1 << 20):
                        out.write(piece.encode())
                    out.write(b"</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'{head}<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={sax.quoteattr(re.sub(r"[\[\]:*?/\\]", "_", n)[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        kinds = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{kinds}<Relationship Id="rIdS" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{part}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")


def write_report(spark: SparkSession, root: str, name: str, frame: DataFrame, order: Sequence[str], facts: dict[str, object]) -> dict[str, str]:
    """A table as Parquet, its first rows as Markdown and its figures as JSON under one name; none of them may exist."""
    paths = {kind: f"{root.rstrip('/')}/{name}{end}" for kind, end in (("table", ""), ("page", ".md"), ("figures", ".json"))}
    frame.write.mode("errorifexists").parquet(paths["table"])
    put_text(spark, paths["page"], markdown(frame, order))
    publish_json(spark, paths["figures"], facts, overwrite=False)
    return paths


def require(frame: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """Fails before anything runs if a column is missing."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return frame


def write_csv(frame: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Refuses an empty table; with an order the rows of the files follow it, so equal tables give equal bytes."""
    if frame.isEmpty():
        raise ValueError("nothing to write")
    (frame.orderBy(*order) if order else frame).write.mode(mode).option("header", True).option("lineSep", "\n").csv(path)


def guarded_overwrite(frame: DataFrame, path: str, human: Sequence[str]) -> None:
    """Overwrites a Parquet table unless a human has filled one of the given columns in it."""
    spark = frame.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path)
        filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in human if c in old.columns]
        if filled and not old.where(F.exists(F.array(*filled), lambda x: x)).isEmpty():
            raise ValueError("the table holds human decisions")
    frame.write.mode("overwrite").parquet(path)


def text_records(spark: SparkSession, path: str, separator: str = r"(?m)^={20,}\s*\n") -> DataFrame:
    """(path, record, body): files cut at separator lines; empty records go."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", separator)).alias("record", "body")).where(F.trim("body") != "")


def record_fields(body: Column, fields: dict[str, str]) -> list[Column]:
    """`name: value` lines of a record, by pattern of the name."""
    return [F.nullif(F.regexp_extract(body, rf"(?m)^{pattern}\s*:\s*(.*)$", 1), F.lit("")).alias(name) for name, pattern in fields.items()]


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(path, key, value) of files that hold one object keyed by id; `value` is a DDL type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """Sums of every numeric usage key of `turn.completed` events in a JSON-lines log."""
    log = spark.read.schema("type string, usage map<string,double>").json(path)
    return log.where("type = 'turn.completed'").select(F.explode("usage").alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def save_vectors(frame: DataFrame, root: str, stamp: str, key: str, vector: str) -> str:
    """A vector cache under its stamp (a hash of model and inputs); what is there already stays."""
    path = f"{root.rstrip('/')}/stamp={stamp}"
    frame.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("ignore").parquet(path)
    return path


def input_stamp(frame: DataFrame, order: Sequence[str], *parts: str) -> str:
    """Hash of a table's rows, whatever their order, and of names such as a model's."""
    rows = frame.select(fingerprint(*order).alias("h")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    return rows.select(F.sha2(F.concat_ws("|", *[F.lit(p) for p in parts], "n", "s"), 256)).first()[0]


def load_vectors(spark: SparkSession, root: str, stamp: str) -> DataFrame:
    """The vector cache of this very stamp; a cache of other inputs or another model is stale, which is an error."""
    path = f"{root.rstrip('/')}/stamp={stamp}"
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return spark.read.parquet(path)
    found = [x.getPath().getName() for x in fs.listStatus(p.getParent())] if fs.exists(p.getParent()) else []
    raise ValueError(f"stale cache: {found or 'none'}, not stamp={stamp}")


def contract_hash(frame: DataFrame, columns: Sequence[str]) -> str:
    """Hash of the allowed columns alone, whatever the rows' order; other columns may change freely."""
    return input_stamp(require(frame, columns).select(*columns), columns, *columns)


def load_state(spark: SparkSession, plan: str, decided: str, key: str, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(plan, decisions) of a run: decisions must be of the plan's items, and both of the same stamp."""
    p, d = spark.read.parquet(plan), spark.read.parquet(decided)
    unknown = d.join(p, key, "left_anti").count()
    old = p.where(~F.col("stamp").eqNullSafe(F.lit(stamp))).count() + d.where(~F.col("stamp").eqNullSafe(F.lit(stamp))).count()
    if unknown or old:
        raise ValueError(f"{unknown} decisions of unknown items, {old} rows of another stamp")
    return p, d


def next_attempt(spark: SparkSession, root: str) -> str:
    """The folder of the next attempt, attempt-001 up; earlier ones are never written to."""
    fs, p = _fs(spark, root)
    fs.mkdirs(p)
    taken = [re.fullmatch(r"attempt-(\d+)", x.getPath().getName()) for x in fs.listStatus(p)]
    name = f"{root.rstrip('/')}/attempt-{1 + max((int(m[1]) for m in taken if m), default=0):03d}"
    if not fs.mkdirs(_fs(spark, name)[1]):
        raise OSError(f"{name} could not be made")
    return name


#: What a structured decision must be, as JSON schema.
DECISION_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["item", "relation", "reason", "evidence"],
    "properties": {"item": {"type": "string"}, "relation": {"enum": ["equivalent_to", "broader_than", "narrower_than", "related_to", "distinct_from"]}, "reason": {"type": "string", "minLength": 1}, "evidence": {"type": "array", "items": {"type": "string"}}},
}


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
