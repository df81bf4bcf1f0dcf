"""Where the tables are: a folder of Parquet files, a JDBC address, or parts of one in the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ocellus.sources.tables import table

MYSQL_PORT = "3306"


def locate(given: str | None = None, environment: Mapping[str, str] | None = None, folder: str = ".") -> str:
    """The first of: the argument, PAPER_DB_URL, DATABASE_URL, the parts PAPER_DB_HOST, _PORT, _NAME or _DATABASE, _USER, _PASSWORD, _CHARSET, and the first *.sqlite file
    of the folder by name."""
    e = os.environ if environment is None else environment
    for place in (given, e.get("PAPER_DB_URL"), e.get("DATABASE_URL")):
        if place:
            return place
    if host := e.get("PAPER_DB_HOST"):
        name = e.get("PAPER_DB_NAME") or e.get("PAPER_DB_DATABASE")
        if not name:
            raise ValueError("PAPER_DB_HOST needs PAPER_DB_NAME")
        user, password = quote(e.get("PAPER_DB_USER", "root"), safe=""), quote(e.get("PAPER_DB_PASSWORD", ""), safe="")
        return f"mysql://{user}:{password}@{host}:{e.get('PAPER_DB_PORT', MYSQL_PORT)}/{name}?charset={e.get('PAPER_DB_CHARSET', 'utf8mb4')}"
    for path in sorted(Path(folder).glob("*.sqlite")):
        return str(path)
    raise FileNotFoundError("name a folder of tables or a database, or set PAPER_DB_URL or PAPER_DB_HOST and PAPER_DB_NAME")


def backend(place: str) -> str:
    """parquet, sqlite or the database of the address."""
    if m := re.match(r"(?:jdbc:)?([a-z0-9]+)(?:\+\w+)?:(?://)?", place):
        return m.group(1) if m.group(1) != "file" else "parquet"
    return "sqlite" if place.endswith((".sqlite", ".db")) else "parquet"


def shown(place: str) -> str:
    """The place without its password."""
    return re.sub(r"(://[^:/@]+:)[^@]*@", r"\1***@", place)


def jdbc_address(place: str) -> tuple[str, dict[str, str]]:
    """The JDBC URL and options of a database address or SQLite file."""
    if place.startswith("jdbc:"):
        return place, {}
    kind = backend(place)
    if kind == "sqlite":
        return "jdbc:sqlite:" + re.sub("^sqlite:/*(?=/)|^sqlite:", "", place), {}
    m = re.match(r"[a-z0-9]+(?:\+\w+)?://(?:([^:@/]*)(?::([^@]*))?@)?([^/?]+)/([^?]*)", place)
    if not m:
        raise ValueError(f"no database address: {shown(place)}")
    from urllib.parse import unquote

    user, password, host, name = m.groups()
    return f"jdbc:{kind}://{host}/{name}", {k: unquote(v) for k, v in (("user", user), ("password", password)) if v}


# the numeric column by whose ranges a table of a database is read
RANGES = {"papers": "paper_id", "paper_keywords": "paper_id", "paper_embeddings": "paper_id", "analytics_events": "id", "search_paper_unique_clicks": "id"}


def read_table(spark: SparkSession, name: str, place: str, columns: list[str] | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int | None = None) -> DataFrame:
    """A table, only the named columns of it. A database is read by `partitions` tasks, else as many as there are cores, over ranges of a numeric column: the one given, or the
    table's of RANGES where it has that. Its bounds are asked of the database unless given; they only shape the ranges, no row is left out."""
    if backend(place) == "parquet":
        df = table(spark, place, name)
    else:
        url, options = jdbc_address(place)
        reader = lambda: spark.read.format("jdbc").option("url", url).options(**options)
        whole = reader().option("dbtable", name).load()
        at = {c.lower(): c for c in whole.columns}
        by = at.get((partition_column or RANGES.get(name, "")).lower())
        if by and bounds is None:
            quoted = f"`{by}`" if "mysql" in url or "mariadb" in url else f'"{by}"'
            found = reader().option("query", f"select min({quoted}) as a, max({quoted}) as b from {name}").load().first()
            bounds = None if found[0] is None else (int(found[0]), int(found[1]))
        tasks = partitions or spark.sparkContext.defaultParallelism
        df = whole
        if by and bounds and bounds[0] < bounds[1] and tasks > 1:
            df = reader().option("dbtable", name).option("partitionColumn", by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", tasks).load()
    return df.select(*columns) if columns else df
