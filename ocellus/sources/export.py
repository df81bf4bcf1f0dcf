"""Citation formats, plain text, CSV and JSON."""

from __future__ import annotations

import csv
import io
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.text import clean_author, clean_journal, collapse
from ocellus.operators.usage import shown


def line(tag: str, value: Column | str) -> Column:
    """tag and value; null where there is no value."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.nullif(v.cast("string"), F.lit(""))
    return F.concat(F.lit(tag), v)


def lines(*parts: Column) -> Column:
    """Arrays of lines one after another, without nulls, joined by CR LF."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull()), "\r\n")


def authors(tag: str) -> Column:
    return F.transform(F.filter(F.transform("authors", clean_author), lambda a: a != ""), lambda a: F.concat(F.lit(tag), a))


def year() -> Column:
    return F.nullif("year", F.lit(0))


def ris(papers: DataFrame) -> DataFrame:
    """(id, ris)."""
    journal = clean_journal("journal")
    pages = F.when(F.coalesce("page_end", F.lit("")) != "", line("EP  - ", "page_end")).otherwise(line("SP  - ", "pages"))
    head = F.array(F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), F.col("title")))
    rest = F.array(line("JO  - ", journal), line("T2  - ", journal), line("PY  - ", year()), line("VL  - ", "volume"), line("IS  - ", "issue"), line("SP  - ", "page_start"), pages, line("DO  - ", "doi"), line("UR  - ", "url"), line("AB  - ", "abstract"), line("N1  - ", "citation"), F.lit("ER  -"))
    return papers.select("id", F.concat(lines(head, authors("AU  - "), rest), F.lit("\r\n")).alias("ris"))


def enw(papers: DataFrame) -> DataFrame:
    """(id, enw); authors come last, and the text begins with a byte order mark."""
    start, end = F.nullif("page_start", F.lit("")), F.nullif("page_end", F.lit(""))
    pages = F.coalesce(F.nullif("pages", F.lit("")), F.concat(start, F.lit("-"), end), start)
    body = F.array(F.lit("%0 Journal Article"), F.concat(F.lit("%T "), F.col("title")), line("%B ", clean_journal("journal")), line("%D ", year()), line("%V ", "volume"), line("%N ", "issue"), line("%P ", pages), line("%R ", "doi"), line("%U ", "url"), line("%X ", "abstract"), line("%Z ", collapse("citation")))
    return papers.select("id", F.concat(F.lit("﻿"), lines(body, authors("%A ")), F.lit("\r\n\r\n")).alias("enw"))


def plain_text(papers: DataFrame) -> DataFrame:
    """(id, text): the record as labelled lines."""
    either = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    rows = [
        F.concat(F.lit("标题: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("作者: "), F.array_join("authors", ", ")),
        F.concat(F.lit("年份: "), either("year", "-")),
        F.concat(F.lit("关键词: "), F.array_join("keywords", ", ")),
        F.concat(F.lit("DOI: "), either("doi", "-")),
        F.concat(F.lit("网址: "), either("url", "-")),
        F.lit(""),
        F.lit("摘要:"),
        F.coalesce("abstract", F.lit("")),
        F.lit(""),
        F.lit("引用:"),
        either("citation", "（暂无）"),
    ]
    return papers.select("id", F.array_join(F.array(*rows), "\n").alias("text"))


def csv_bytes(df: DataFrame, headers: tuple[str, ...]) -> bytes:
    """A file for download: byte order mark, CR LF, as little quoting as needed. Rows come to the driver one partition at a time."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(headers)
    for row in shown(df).select(*headers).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return ("﻿" + out.getvalue()).encode()


def json_bytes(df: DataFrame, dataset: str, filters: dict, now: datetime | None = None) -> bytes:
    items = [r.asDict(recursive=True) for r in shown(df).toLocalIterator()]
    at = (now or datetime.now(UTC)).replace(microsecond=0, tzinfo=None).isoformat() + "Z"
    return json.dumps({"dataset": dataset, "generated_at": at, "filters": filters, "items": items}, ensure_ascii=False, indent=2).encode()


def write_csv(df: DataFrame, path: str) -> None:
    """Large exports: one file per partition, written by the executors."""
    shown(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    shown(df).write.mode("overwrite").json(path)
