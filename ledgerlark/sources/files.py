"""Readers for delimited text, JSON and parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators tried, and names of the array a JSON file may be wrapped in.
DELIMITERS = [",", ";", "\t", "|"]
ENVELOPES = ["data", "records", "rows", "items", "results"]


#: What the upper bytes of a text are read as byte for byte, and what they are in windows-1256 (which Spark's readers do not offer).
LATIN, ARABIC = (bytes(range(128, 256)).decode(name) for name in ("latin-1", "cp1256"))
_ARABIC_NAMES = str.maketrans(LATIN, ARABIC)


def from_latin(text: Column) -> Column:
    """Text read as ISO-8859-1 that is windows-1256."""
    return F.translate(text, LATIN, ARABIC)


def encodings(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files by encoding: UTF-8 where every line is valid, else windows-1256 (which
    reads any byte).  Lines are tested where they are split, not whole files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    rows = lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).collect()  # one row per file
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault("UTF-8" if r["ok"] else "windows-1256", []).append(r["file"])
    return out


def sniff_delimiter(spark: SparkSession, path: str | list[str], lines: int = 1000) -> str:
    """The separator that occurs equally often, at least once, in the first lines."""
    sample = spark.read.text(path).where(F.length("value") > 0).limit(lines)
    row = sample.agg(*[
        F.struct(F.stddev_pop(n).alias("spread"), F.avg(n).alias("mean")).alias(f"d{i}")
        for i, d in enumerate(DELIMITERS) for n in [F.regexp_count("value", F.lit(d if d not in "|" else r"\|"))]
    ]).first()
    steady = [(row[f"d{i}"]["mean"], -i) for i in range(len(DELIMITERS)) if row[f"d{i}"]["mean"] and row[f"d{i}"]["spread"] == 0]
    return DELIMITERS[-max(steady)[1]] if steady else ","


def read_delimited(spark: SparkSession, path: str | list[str], *, sep: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Text with a header row; columns stay text until a cleaning step types them."""
    out = None
    for name, files in sorted(encodings(spark, path).items()):
        reader = spark.read.option("header", True).option("encoding", "UTF-8" if name == "UTF-8" else "ISO-8859-1").option("sep", sep or sniff_delimiter(spark, files))
        one = (reader.schema(schema) if schema else reader).csv(files)
        if name != "UTF-8":
            one = one.select(*[(from_latin(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name.translate(_ARABIC_NAMES)) for f in one.schema])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(str(path))
    return out


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumn("_source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_json(spark: SparkSession, path: str | list[str], *, multi_line: bool | None = None, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines or documents; an enveloped array is unwrapped, nested objects become dotted columns.

    Every file's first line tells its form, unless *multi_line* says it for all.
    """
    groups = {multi_line: path} if multi_line is not None else _json_forms(spark, path) or {False: path}
    parts = []
    for form, files in sorted(groups.items()):
        reader = spark.read.option("multiLine", form)
        parts.append(flatten(unwrap((reader.schema(schema) if schema else reader).json(files))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _json_forms(spark: SparkSession, path: str | list[str]) -> dict[bool, list[str]]:
    """Files by whether a document covers several lines (or is an array)."""
    text = F.trim("value")
    where = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.left(text, F.lit(1)).alias("first"), F.right(text, F.lit(1)).alias("last"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), text.alias("text"), where.alias("line")).where("text <> ''")
    out: dict[bool, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min("line").alias("line")).collect():  # one row per file
        out.setdefault(r["line"]["first"] == "[" or (r["line"]["first"] == "{" and r["line"]["last"] != "}"), []).append(r["file"])
    return out


def unwrap(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if f.name in ENVELOPES and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return df.select(F.explode(f.name).alias("r")).select("r.*")
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Structs to columns named ``a.b``; arrays stay arrays."""
    def leaves(c, kind: T.DataType, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from leaves(c[f.name], f.dataType, f"{name}.{f.name}")
        else:
            yield c.alias(name)

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


def describe(df: DataFrame) -> DataFrame:
    """Columns with type, nullability and place, how many values each has, and the number of rows."""
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    return counts.select("rows", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.lit(i + 1).alias("position"), F.col(f"c{i}").alias("filled"))
        for i, f in enumerate(fields)])))
