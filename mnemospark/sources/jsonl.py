"""JSON-lines sources: tolerant, counted, versioned and strict reads; incremental tails; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the newest schema version that readers know.
KNOWN_VERSION = 1


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files; lines are split by Spark, so large files are read in parallel."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def parse(lines: DataFrame, schema: T.StructType | str, line: str = "line") -> DataFrame:
    """``lines`` with ``record`` and ``status``: ok, blank or malformed. Lines that hold no object are malformed."""
    text = F.trim(F.coalesce(F.col(line), F.lit("")))
    known = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    # try_parse_json is null for broken text; only objects are records.
    kind = F.schema_of_variant(F.try_parse_json(text))
    status = F.when(text == "", "blank").when(kind.startswith("OBJECT"), "ok").otherwise("malformed")
    return lines.withColumn("status", status).withColumn("record", F.when(status == "ok", known))


def read(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The records of well-formed lines."""
    return parse(lines, schema).where("status = 'ok'").select("record.*")


def counted(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """How many lines are records, blank and malformed."""
    return parse(lines, schema).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "blank", "malformed")])


def known_version(version: Column) -> Column:
    """Missing versions are 1; numbers above the known one are of the future; what is no number passes."""
    return F.coalesce(version.try_cast("int") <= KNOWN_VERSION, F.lit(True))


def strict(lines: DataFrame, schema: T.StructType, required: list[str], version: str, prefix: str = "x_", limit: int = 1024) -> DataFrame:
    """Records with ``problem``, null if a record keeps the contract: version, required fields, no unknown
    field but those with ``prefix``, whose values are of limited size. Bad rows are kept aside, not raised."""
    rows = parse(lines, schema)
    fields = F.from_json(F.col("line"), "map<string,string>")
    names = F.map_keys(fields)
    allowed = F.array(*[F.lit(f.name) for f in schema])
    unknown = F.filter(names, lambda n: ~F.array_contains(allowed, n) & ~n.startswith(prefix))
    missing = F.filter(F.array(*map(F.lit, required)), lambda n: ~F.array_contains(names, n))
    large = F.map_keys(F.map_filter(fields, lambda k, v: k.startswith(prefix) & (F.octet_length(v) > limit)))
    found = F.try_element_at(fields, F.lit("schema_version"))
    problem = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce(found, F.lit("")) != version, F.concat(F.lit("version:"), F.coalesce(found, F.lit("none"))))
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(missing), ","))).when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(unknown), ",")))
        .when(F.size(large) > 0, F.concat(F.lit("large:"), F.array_join(F.array_sort(large), ",")))
    )
    return rows.withColumn("problem", problem)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; Spark's commit takes the place of file locks."""
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """Puts rows in place of all of a folder, whole or not at all."""
    rows.write.mode("overwrite").json(path)
