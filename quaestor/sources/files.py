"""Readers and writers of the dataset's files: strict CSV and JSON, file sets by digest, TSV."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


AS_IT_IS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class Malformed(ValueError):
    """A file isn't of the form that is asked for."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV file whose header has exactly these names in this order; a row of another form fails the read.

    Codes come as strings first, so that leading zeros stay, and are then cast by
    ``schema``. Blank lines are skipped; an empty cell is an empty string in a
    string column and null in any other.
    """
    head = spark.read.text(path, wholetext=False).limit(1).first()
    names = [c.strip('"') for c in (head[0] if head else "").lstrip("﻿").split(",")]
    if names != schema.names:
        raise Malformed(f"the header is {names}, not {schema.names}")
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(raw).csv(path, header=True, mode="FAILFAST", enforceSchema=True, multiLine=True, quote='"', escape='"', nullValue="\0", emptyValue="")
    cast = lambda f: F.coalesce(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.when(F.col(f.name) != "", F.col(f.name)).cast(f.dataType)
    return rows.select(*[cast(f).alias(f.name) for f in schema])


def departures(wanted: T.DataType, found: T.DataType, at: str = "$") -> list[str]:
    """What JSON of the type ``found`` has that ``wanted`` doesn't allow: keys it lacks and values of another kind, by path."""
    if isinstance(found, T.NullType):
        return []
    if isinstance(wanted, T.StructType) and isinstance(found, T.StructType):
        fields = {f.name: f.dataType for f in wanted}
        out = [f"unknown key {at}.{f.name}" for f in found if f.name not in fields]
        return out + [d for f in found if f.name in fields for d in departures(fields[f.name], f.dataType, f"{at}.{f.name}")]
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return departures(wanted.elementType, found.elementType, f"{at}[]")
    if isinstance(wanted, T.MapType) and isinstance(found, T.StructType):
        return [d for f in found for d in departures(wanted.valueType, f.dataType, f"{at}.{f.name}")]
    kinds = [(T.NumericType, T.NumericType), (T.BooleanType, T.BooleanType), ((T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType), T.StringType), (T.VariantType, T.DataType)]
    return [] if any(isinstance(wanted, w) and isinstance(found, f) for w, f in kinds) else [f"{at} isn't of type {wanted.simpleString()} everywhere"]


def _json_type(spark: SparkSession, text: str) -> T.DataType:
    """The type that ``schema_of_variant`` states."""
    return spark.sql(f"SELECT CAST(NULL AS {re.sub(r'(?<![`A-Za-z0-9_])OBJECT<', 'STRUCT<', text)}) AS v").schema["v"].dataType


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents of a JSON file or folder, one object or array of objects a file; keys that the schema lacks and values of other kinds, at any depth, fail the read.

    Strings don't stand for numbers, nor the other way round; nulls stand for anything.
    The files' types are combined before the shuffle, so that one type comes to the
    driver; only where that departs are single files looked at, to name one.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).where(F.length(F.trim("value")) > 0)
    # Every file as an array, so that both kinds of file have one type.
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    held = files.select(F.try_parse_json(listed).alias("v"), "file")
    broken, found = held.agg(F.min(F.when(F.col("v").isNull(), F.col("file"))), F.expr("schema_of_variant_agg(v)")).first()
    if broken is not None:
        raise Malformed(f"{broken} isn't JSON")
    of = lambda kind: departures(schema, _json_type(spark, kind).elementType)
    wrong = of(found) if found and found != "VOID" else []
    if wrong:
        kinds = held.groupBy(F.expr("schema_of_variant(v)").alias("kind")).agg(F.min("file").alias("file")).orderBy("file").limit(200).collect()
        each = [(k["file"], d) for k in kinds for d in of(k["kind"])]
        said = sorted({f"{d} in {f.rsplit('/', 1)[-1]}" for f, d in each}) or wrong
        raise Malformed("; ".join(said[:20]))
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_seed(spark: SparkSession, path: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """A seed CSV: empty cells are null, cells of ``arrays`` hold JSON arrays of strings."""
    rows = spark.read.csv(path, header=True, nullValue="", multiLine=True, quote='"', escape='"')
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in arrays}) if arrays else rows


def candidates(spark: SparkSession, folder: str, name: str, most_bytes: int = 32 << 20) -> DataFrame:
    """(path, length, sha256) of the files of a logical name, download suffixes like " (2)" included, up to a size."""
    stem, _, suffix = name.rpartition(".")
    quoted = "".join(c if c.isalnum() else "\\" + c for c in stem)
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") <= most_bytes)
    named = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "%20", " ")
    return files.where(named.rlike(rf"^{quoted}( ?\(\d+\))?\.{suffix}$")).select("path", "length", F.sha2("content", 256).alias("sha256"))


def resolve(spark: SparkSession, folder: str, name: str, sha256: str) -> str:
    """The path of the candidate with a digest."""
    found = candidates(spark, folder, name).where(F.col("sha256") == sha256).orderBy("path").first()
    if found is None:
        raise Malformed(f"no {name} has digest {sha256}")
    return found["path"]


def read_dataset(spark: SparkSession, folder: str, tables: dict[str, T.StructType], manifest: str = "manifest.json", most_bytes: int = 64 << 20) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that a manifest lists, by logical file name, and one row a file of what it says and what is there.

    Files are told by digest among those of their logical name, and their sizes
    together have a bound. ``tables`` gives each file's schema; the manifest has to list
    every one, once. The second result has name, path, sha256, expected and actual counts
    and ``result``, as ``checks.compared`` states it.
    """
    listed = spark.read.schema("publicFiles array<struct<fileName:string,sha256:string,rowCount:long,itemCount:long>>").json(f"{folder}/{manifest}", multiLine=True, mode="FAILFAST")
    files = listed.select(F.inline("publicFiles")).where(F.col("fileName").isin(*tables)).limit(2 * len(tables) + 1).collect()
    names = [f["fileName"] for f in files]
    if sorted(names) != sorted(tables):
        raise Malformed(f"the manifest lists {sorted(names)}, not {sorted(tables)}")
    found, rows, total = {}, [], 0
    for f in files:
        name = f["fileName"]
        held = candidates(spark, folder, name).where(F.col("sha256") == f["sha256"]).orderBy("path").first()
        if held is None:
            raise Malformed(f"no {name} has digest {f['sha256']}")
        total += held["length"]
        read = read_json if name.endswith(".json") else read_csv
        found[name] = read(spark, held["path"].replace("%20", " "), tables[name])
        expected = f["rowCount"] if f["rowCount"] is not None else f["itemCount"]
        rows.append(found[name].agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), F.lit(held["path"]).alias("path"), F.lit(f["sha256"]).alias("sha256"), F.lit(expected).cast("long").alias("expected"), "actual"))
    if total > most_bytes:
        raise Malformed(f"the files have {total} bytes, more than {most_bytes}")
    same = F.col("actual").eqNullSafe(F.col("expected"))
    return found, reduce(DataFrame.unionByName, rows).withColumn("result", F.when(same, "PASS").otherwise("FAIL"))


def read_review(spark: SparkSession, path: str, names: list[str], arrays: tuple[str, ...] = ()) -> DataFrame:
    """A review sheet with exactly these columns, all strings; cells of ``arrays`` hold JSON arrays of strings."""
    rows = read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in arrays}) if arrays else rows


def write_review(df: DataFrame, path: str, *order: str) -> None:
    """A review sheet: every cell quoted, arrays as JSON, rows in order over the files' names, so that reruns agree."""
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema]
    df.orderBy(*order).select(*cells).write.mode("overwrite").csv(path, header=True, quoteAll=True, **AS_IT_IS)


def write_seed(df: DataFrame, path: str, *order: str) -> None:
    """A seed CSV, which ``read_seed`` reads back: quoted where it has to be, null and empty cells empty, arrays as JSON."""
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema]
    df.orderBy(*order).select(*cells).write.mode("overwrite").csv(path, header=True, emptyValue="", **AS_IT_IS)


def markdown(title: str, sections: dict[str, DataFrame], most: int = 10_000) -> str:
    """A report: each section's rows as a table in their own order; "none" where there are none.

    It is for people to read, so a section of more than ``most`` rows is refused.
    """
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.select(*[F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ").alias(c) for c in df.columns]).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        line = lambda cells: f"| {' | '.join(cells)} |"
        body = [line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)] if rows else ["none"]
        out += [f"## {name}", "", *body, ""]
    return "\n".join(out)


def exploded(parents: DataFrame, key: str, nested: str) -> DataFrame:
    """A child table from an array of structs, with its parent's key."""
    return parents.select(key, F.explode(nested).alias("_c")).select(key, "_c.*")


def imported(payload: DataFrame, column: str, tables: dict[str, str], dataset: Column) -> dict[str, DataFrame]:
    """The tables that one JSON payload holds, each by the schema of its array's rows, with ``dataset_id``."""
    parsed = {name: payload.select(F.from_json(F.get_json_object(column, f"$.{name}"), f"array<{schema}>").alias("rows"), dataset.alias("dataset_id")) for name, schema in tables.items()}
    return {name: p.select("dataset_id", F.inline("rows")) for name, p in parsed.items()}


def storage_prefix(year: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws("/", year.cast("string"), kind, digest)


def guarded(cell: Column) -> Column:
    """Text for a sheet: tabs and line breaks to blanks, and no formula at its beginning."""
    flat = F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\t\r\n]+", " ")
    return F.when(flat.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def transcript(sessions: DataFrame, messages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row a message, in order; a session without messages keeps one row."""
    from pyspark.sql import Window as W

    numbered = messages.withColumn("message_order", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return sessions.join(numbered, key, "left").withColumn(text, guarded(F.col(text)))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def source_documents(*tables: DataFrame) -> DataFrame:
    """Distinct (source_type, source_file), the later table's row first."""
    from pyspark.sql import Window as W

    ranked = reduce(DataFrame.unionByName, [t.withColumn("_n", F.lit(i)) for i, t in enumerate(tables)])
    w = W.partitionBy("source_type", "source_file").orderBy(F.col("_n").desc())
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r").orderBy("source_type", "source_file")
