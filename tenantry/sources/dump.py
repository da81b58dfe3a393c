"""Tables from an SQL dump, read in parallel.

A dump writes line feeds inside texts as escapes, so ``;`` and a line feed end a statement and nothing else. The text
source cuts the file by bytes and deals out whole statements, wherever a cut falls; a statement is one INSERT of the
dump's buffer size, not a table. Rows and values are then taken apart by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import TABLES

# The forms of the dump. A text is quoted, with backslash escapes or doubled quotes inside.
TEXT = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
ROW = rf"(?s)\((?:{TEXT}|[^'()])*+\)"
VALUE = rf"(?s)(?:_binary\s+)?{TEXT}|[^,()\s']+"
#: What a backslash makes of these letters; before any other it only quotes.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(value): the statements of a dump, without comment lines."""
    lines = spark.read.option("lineSep", ";\n").text(path)
    return lines.select(F.regexp_replace("value", r"(?m)\A(?:\s*(?:--[^\n]*|/\*.*?\*/;?)?\n)+", "").alias("value"))


def _head(words: str, table: str) -> str:
    return rf"\A\s*{words}\s+`?\Q{table}\E`?[\s(]"


def columns_of(spark: SparkSession, path: str, table: str) -> list[str]:
    """The columns that the dump declares for a table, in its order."""
    created = statements(spark, path).filter(F.col("value").rlike(_head("CREATE TABLE(?: IF NOT EXISTS)?", table)))
    found = created.select(F.regexp_extract_all("value", F.lit(r"\n\s*`([^`]+)`\s"), F.lit(1)).alias("c")).first()
    if found is None:
        raise LookupError(f"the dump has no table {table}")
    return found["c"]


def unquoted(value: Column) -> Column:
    """The text of a value as written: null for NULL, the inside of quotes without escapes, else the value itself."""
    inside = F.regexp_replace(value, r"(?s)\A(?:_binary\s+)?'(.*)'\z", "$1")
    inside = F.replace(inside, F.lit("''"), F.lit("'"))

    def piece(p: Column) -> Column:
        for letter, char in ESCAPES.items():
            p = F.replace(p, F.lit("\\" + letter), F.lit(char))
        return F.replace(p, F.lit("\\"), F.lit(""))

    # a doubled backslash stands for one and quotes nothing: what lies between such pairs is treated by itself
    text = F.array_join(F.transform(F.split(inside, r"\\\\"), piece), "\\")
    return F.when(F.upper(value) == "NULL", None).when(value.contains("'"), text).otherwise(value)


def read_dump(spark: SparkSession, path: str, table: str, struct: StructType | None = None) -> DataFrame:
    """The rows of a table of the dump, under its declared schema or the given one.

    Columns are matched by name: by those of the INSERT if it names them, else of CREATE TABLE. Columns that the dump
    lacks are null, others are left out. A value that its type cannot hold is null. A table that the dump does not
    create is an error, one without rows is empty.
    """
    struct = struct or TABLES[table].struct
    names = columns_of(spark, path, table)
    inserts = statements(spark, path).filter(F.col("value").rlike(_head("INSERT INTO", table)))
    head = F.regexp_extract("value", r"(?is)\A\s*INSERT INTO\s+`?[^`\s(]+`?\s*(\([^)]*\))?\s*VALUES", 1)
    named = F.regexp_extract_all(head, F.lit(r"`?([^`,()\s]+)`?"), F.lit(1))
    order = F.when(head == "", F.array(*[F.lit(n) for n in names])).otherwise(named)
    body = F.regexp_replace("value", r"(?is)\A\s*INSERT INTO\s+`?[^`\s(]+`?\s*(?:\([^)]*\))?\s*VALUES", "")
    rows = inserts.select(order.alias("names"), F.explode(F.regexp_extract_all(body, F.lit(ROW), F.lit(0))).alias("row"))
    values = rows.select("names", F.regexp_extract_all("row", F.lit(VALUE), F.lit(0)).alias("v"))

    def column(name: str) -> Column:
        at = F.array_position("names", name)
        return unquoted(F.when(at > 0, F.try_element_at("v", at.cast("int"))))

    return values.select(*[column(f.name).try_cast("int").try_cast("boolean").alias(f.name) if f.dataType.typeName() == "boolean" else column(f.name).try_cast(f.dataType).alias(f.name) for f in struct])


def quoted(value: Column) -> Column:
    """A value as a dump writes it."""
    text = value.cast("string")
    for char, code in {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\0": "\\0", "\x1a": "\\Z"}.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return F.concat(F.lit("'"), text, F.lit("'"))


def write_dump(df: DataFrame, path: str, table: str, rows: int = 500) -> None:
    """A table as INSERT statements of up to ``rows`` rows, after its CREATE TABLE, as text files of a folder."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double")
    value = lambda f: F.coalesce(F.col(f.name).cast("int").cast("string") if f.dataType.typeName() == "boolean" else F.col(f.name).cast("string") if f.dataType.simpleString() in number or f.dataType.typeName() == "decimal" else quoted(F.col(f.name)), F.lit("NULL"))
    made = F.concat(F.lit("("), F.concat_ws(",", *[value(f) for f in df.schema]), F.lit(")"))
    block = F.floor(F.monotonically_increasing_id() / rows)
    inserts = df.select(made.alias("r"), block.alias("b")).groupBy("b").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit(";")).alias("value")).select("value")
    create = f"DROP TABLE IF EXISTS `{table}`;\nCREATE TABLE `{table}` (\n" + ",\n".join(f"  `{f.name}` text" for f in df.schema) + "\n);"
    df.sparkSession.createDataFrame([(create,)], "value string").unionByName(inserts).write.mode("append").text(path)
