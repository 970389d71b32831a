"""The vector clauses of SQL, rewritten to DataFrame plans; all other statements go to Spark unchanged.

SELECT ... FROM c NEAREST TO [v] | SIMILAR TO [v] [USING name] [WHERE ...] [ORDER BY ...] [LIMIT n] [OFFSET n], WHERE before
or after LIMIT; SEARCH c FOR [v] [USING name] [WHERE ...] [LIMIT n]; CREATE TABLE c (k = v, ...) or WITH k = v; DROP TABLE
[IF EXISTS] c; DESCRIBE c; SHOW TABLES; INSERT INTO c (...) VALUES ...; UPDATE c SET ... [WHERE ...]; DELETE FROM c [WHERE ...].
``_score`` is the score of a search. Conditions are Spark's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import search
from nearfield.plans.catalog import Catalog, CatalogError

KEYWORDS = ("NEAREST TO", "SIMILAR TO", "USING", "WHERE", "ORDER BY", "LIMIT", "OFFSET")
DEFAULT_SEARCH_LIMIT, DEFAULT_LIMIT = 10, 100


class SqlError(ValueError):
    """A statement that can't be read."""


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: str = "*"
    vector: list[float] | None = None
    using: str | None = None
    where: str | None = None
    order_by: str | None = None
    limit: int | None = None
    offset: int = 0
    options: dict[str, str] = field(default_factory=dict)
    body: str = ""


def split_clauses(text: str, keywords: tuple[str, ...]) -> list[tuple[str, str]]:
    """(keyword, what follows), keywords within quotes and brackets left alone; the first has keyword ""."""
    pattern = re.compile(r"\b(" + "|".join(k.replace(" ", r"\s+") for k in keywords) + r")\b", re.I)
    out, depth, quote, start, name, i = [], 0, "", 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and (i == 0 or not text[i - 1].isalnum() and text[i - 1] not in "_.") and (found := pattern.match(text, i)):
            out.append((name, text[start:i].strip()))
            name, start = " ".join(found.group().upper().split()), found.end()
            i = found.end()
            continue
        i += 1
    if quote:
        raise SqlError("a quotation that isn't closed")
    out.append((name, text[start:].strip()))
    return out


def parse_vector(text: str) -> list[float]:
    match = re.fullmatch(r"\[(.*)\]", text.strip(), re.S)
    if not match:
        raise SqlError("a vector is written [x, y, ...]")
    try:
        values = [float(x) for x in match.group(1).split(",")]
    except ValueError as e:
        raise SqlError(f"not a vector: {text}") from e
    return values


def _number(name: str, text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise SqlError(f"{name} takes a number")
    return int(text)


def _clauses(statement: Statement, parts: list[tuple[str, str]]) -> Statement:
    seen = set()
    for name, text in parts:
        if name in seen or not text:
            raise SqlError(f"{name} twice or empty")
        seen.add(name)
        if name in ("NEAREST TO", "SIMILAR TO", "FOR"):
            if statement.vector is not None:
                raise SqlError("two vectors")
            statement.vector = parse_vector(text)
        elif name == "USING":
            statement.using = text
        elif name == "WHERE":
            statement.where = text
        elif name == "ORDER BY":
            statement.order_by = text
        elif name == "LIMIT":
            statement.limit = _number(name, text)
        elif name == "OFFSET":
            statement.offset = _number(name, text)
    return statement


def _table(text: str) -> str:
    text = text.strip().strip("`")
    if not re.fullmatch(r"[A-Za-z_][\w-]*", text):
        raise SqlError(f"not a table: {text!r}")
    return text


def _options(text: str) -> dict[str, str]:
    out = {}
    for part in filter(None, (p.strip() for p in text.strip().removeprefix("(").removesuffix(")").split(","))):
        key, equals, value = part.partition("=")
        if not equals:
            raise SqlError(f"not key = value: {part}")
        out[key.strip().lower()] = value.strip().strip("'\"")
    return out


def parse(text: str) -> Statement:
    """The statement; raises ``SqlError`` and nothing else."""
    text = text.strip().rstrip(";").strip()
    word = text.split(None, 1)[0].upper() if text else ""
    if word == "SELECT":
        parts = split_clauses(text[6:], ("FROM", *KEYWORDS))
        if len(parts) < 2 or parts[1][0] != "FROM" or not parts[0][1]:
            return Statement("spark", body=text)
        if re.search(r"\b(JOIN|GROUP\s+BY|UNION|HAVING)\b|,|\(", parts[1][1], re.I) or not re.fullmatch(r"[`\w-]+", parts[1][1]):
            return Statement("spark", body=text)
        return _clauses(Statement("select", _table(parts[1][1]), parts[0][1], body=text), parts[2:])
    if word == "SEARCH":
        parts = split_clauses(text[6:], ("FOR", "USING", "WHERE", "LIMIT", "OFFSET"))
        found = _clauses(Statement("select", _table(parts[0][1]), body=text), parts[1:])
        if found.vector is None:
            raise SqlError("SEARCH needs FOR [vector]")
        return found
    patterns = {
        "CREATE": r"CREATE\s+(?:TABLE|COLLECTION)\s+([\w`-]+)\s*(?:WITH\s+)?(.*)",
        "DROP": r"DROP\s+(?:TABLE|COLLECTION)\s+(IF\s+EXISTS\s+)?([\w`-]+)",
        "DESCRIBE": r"DESCRIBE\s+([\w`-]+)",
        "DESC": r"DESC\s+([\w`-]+)",
        "SHOW": r"SHOW\s+(?:TABLES|COLLECTIONS)",
        "INSERT": r"INSERT\s+INTO\s+([\w`-]+)\s*(\([^)]*\))?\s*VALUES\s*(.+)",
        "UPDATE": r"UPDATE\s+([\w`-]+)\s+SET\s+(.+)",
        "DELETE": r"DELETE\s+FROM\s+([\w`-]+)(?:\s+WHERE\s+(.+))?",
    }
    if word not in patterns:
        if word in ("WITH", "VALUES", "EXPLAIN", "FROM"):
            return Statement("spark", body=text)
        raise SqlError(f"unknown statement {word or 'of no words'}")
    found = re.fullmatch(patterns[word], text, re.I | re.S)
    if not found:
        raise SqlError(f"can't read {word}")
    if word == "CREATE":
        return Statement("create", _table(found[1]), options=_options(found[2]))
    if word == "DROP":
        return Statement("drop", _table(found[2]), options={"if_exists": "1"} if found[1] else {})
    if word in ("DESCRIBE", "DESC"):
        return Statement("describe", _table(found[1]))
    if word == "SHOW":
        return Statement("show")
    if word == "INSERT":
        return Statement("insert", _table(found[1]), (found[2] or "").strip("()"), body=found[3])
    if word == "UPDATE":
        parts = split_clauses(found[2], ("WHERE",))
        return Statement("update", _table(found[1]), parts[0][1], where=dict(parts[1:]).get("WHERE"))
    return Statement("delete", _table(found[1]), where=found[2])


def metric_of(name: str | None) -> str:
    name = (name or "cosine").lower()
    return {"euclidean": "euclidean", "l2": "euclidean", "dot": "dot_product", "dotproduct": "dot_product", "dot_product": "dot_product"}.get(name, "cosine")


def execute(catalog: Catalog, text: str) -> DataFrame:
    """Run a statement; writes change the catalog's collection and return a DataFrame (affected)."""
    spark, s = catalog.spark, parse(text)
    if s.kind == "spark":
        return spark.sql(s.body)
    if s.kind == "show":
        return catalog.listing()
    if s.kind == "create":
        dimension = _number("dimension", s.options.get("dimension", "128"))
        catalog.create(s.table, dimension=dimension, metric=metric_of(s.options.get("metric")))
        return spark.createDataFrame([(1,)], "affected bigint")
    if s.kind == "drop":
        done = catalog.drop(s.table, "if_exists" in s.options)
        return spark.createDataFrame([(int(done),)], "affected bigint")
    c = catalog.get(s.table)
    if s.kind == "describe":
        size = c.data.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("points").alias("field"), F.lit("bigint").alias("type"), "value")
        rows = [("name", "string", c.name), ("dimension", "int", str(c.dimension)), ("metric", "string", c.metric)]
        return spark.createDataFrame(rows, "field string, type string, value string").union(size)
    if s.kind == "select":
        return _select(c, s)
    data = c.data
    if s.kind == "insert":
        names = [n.strip() for n in s.columns.split(",")] if s.columns else data.columns
        new = spark.sql(f"SELECT * FROM VALUES {s.body}").toDF(*names)
        new = new.select(*[F.col(n).cast(data.schema[n].dataType) if n in names else F.lit(None).cast(data.schema[n].dataType).alias(n) for n in data.columns])
        catalog.replace(s.table, data.unionByName(new))
        return new.agg(F.count(F.lit(1)).alias("affected"))
    hit = F.expr(s.where) if s.where else F.lit(True)
    affected = data.filter(hit).agg(F.count(F.lit(1)).alias("affected"))
    if s.kind == "delete":
        catalog.replace(s.table, data.filter(~F.coalesce(hit, F.lit(False))))
        return affected
    changes = {}
    for part in re.split(r",(?![^(\[]*[)\]])", s.columns):
        name, equals, value = part.partition("=")
        if not equals or name.strip() not in data.columns:
            raise SqlError(f"not a column to set: {part.strip()}")
        changes[name.strip()] = F.when(F.coalesce(hit, F.lit(False)), F.expr(value).cast(data.schema[name.strip()].dataType)).otherwise(F.col(name.strip()))
    catalog.replace(s.table, data.withColumns(changes))
    return affected


def _select(c, s: Statement) -> DataFrame:
    df = c.typed()
    if s.where:
        df = df.filter(F.expr(s.where))
    if s.vector is not None:
        column = c.vector(s.using)
        search.check_query(s.vector, c.dimension if column == c.vector_col else None)
        df = search.nearest(df, s.vector, s.limit if s.limit is not None else DEFAULT_SEARCH_LIMIT, c.metric, None, c.id_col, column, offset=s.offset).withColumnRenamed("score", "_score")
        if s.order_by:
            df = df.orderBy(*[F.expr(x.strip()[:-5]).desc() if x.strip().upper().endswith(" DESC") else F.expr(re.sub(r"\s+ASC$", "", x.strip(), flags=re.I)) for x in s.order_by.split(",")])
    else:
        order = s.order_by or c.id_col
        df = df.orderBy(*[F.expr(x.strip()[:-5]).desc() if x.strip().upper().endswith(" DESC") else F.expr(re.sub(r"\s+ASC$", "", x.strip(), flags=re.I)) for x in order.split(",")])
        df = (df.offset(s.offset) if s.offset else df).limit(s.limit if s.limit is not None else DEFAULT_LIMIT)
    names = [x.strip() for x in s.columns.split(",")]
    if names == ["*"]:
        return df
    have = {n.lower() for n in df.columns}
    simple = [n for n in names if re.fullmatch(r"[\w.]+", n)]
    out = []
    for n in names:
        if n in simple and n.split(".")[0].lower() not in have:
            out.append(F.try_variant_get("payload", f"$.{n}", "string").alias(n) if "payload" in have else F.lit(None).cast("string").alias(n))
        else:
            out.append(F.expr(n))
    return df.select(*out)


__all__ = ["CatalogError", "SqlError", "Statement", "execute", "metric_of", "parse", "parse_vector", "split_clauses"]
