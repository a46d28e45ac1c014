"""Files of items, parameters, constants and saved outputs, and bundles of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaloom import schemas
from thetaloom.functions.irt import points
from thetaloom.functions.keys import item_key


class DataError(ValueError):
    """Input rows that break a rule; the message shows the first of them."""


def require_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise ``DataError`` with the first rows of ``violations`` if there are any."""
    rows = violations.limit(show).collect()
    if rows:
        raise DataError(f"{message}: {[tuple(row) for row in rows]}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").drop("count")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSONL file or folder, with their unique ``item_key``."""
    items = spark.read.schema(schemas.ITEM).json(path)
    items = items.withColumn("item_key", item_key("assessment", "grade", "subject", "item_id"))
    require_empty(repeated(items, "item_key"), f"Item keys repeat in {path}")
    return items


def with_points(parameters: DataFrame) -> DataFrame:
    """The rows with a model, with their points in the scaling."""
    steps = [F.col(name) for name in ("step1", "step2", "step3") if name in parameters.columns]
    return parameters.filter("irt_model is not null").withColumn("scaled_points", points(F.col("irt_model"), steps))


def read_parameters(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Calibrated parameters of the items in ``keys`` from CSV. Every key needs a row; rows without a model are left out."""
    table = spark.read.schema(schemas.PARAMETERS).option("header", True).csv(path)
    table = table.withColumn("item_key", item_key("assessment", "grade", "subject", "item_id"))
    require_empty(repeated(table, "item_key"), f"Item keys repeat in {path}")
    require_empty(keys.select("item_key").join(table, "item_key", "left_anti"), f"No row in {path} for")
    return with_points(table.join(keys.select("item_key"), "item_key", "left_semi"))


def read_constants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONSTANTS).option("header", True).csv(path)


def read_saved_outputs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per saved output, with the name of its file: JSON files of one record each, or of one record a line."""
    frame = spark.read.schema(schemas.SAVED_OUTPUT).option("multiLine", one_per_file).json(path)
    return frame.select("*", F.col("_metadata.file_name").alias("file_name"))


def write_items(items: DataFrame, path: str) -> None:
    """Item records as JSON lines with exactly the declared fields in their order, each item ID once."""
    fields = schemas.ITEM.fieldNames()
    if items.columns != fields:
        raise DataError(f"Fields differ from the item record: {[n for n in items.columns if n not in fields]}, {[n for n in fields if n not in items.columns]}")
    require_empty(repeated(items, "item_id"), "Item IDs repeat")
    items.write.option("ignoreNullFields", False).json(path)


def missing_embeddings(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct texts (by hash) that have no stored vector yet."""
    hashed = texts.select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])
    return hashed.join(stored.select("text_sha256"), "text_sha256", "left_anti")


COLUMN = "position int, name string, type string, levels array<string>"
TEXT_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Bundle:
    """Named result tables as text: JSON lines under a root, and beside each table its columns with their types and the levels
    of its ordered categories. JSON lines keep NULL apart from an empty text and name infinite numbers; the types come back
    from the columns, so reading a table gives the rows written. Values beyond a category's levels raise."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, tables: dict[str, DataFrame], levels: dict[str, dict[str, list[str]]] | None = None) -> None:
        for name, table in tables.items():
            ordered = (levels or {}).get(name, {})
            for column, known in ordered.items():
                other = table.filter(~F.col(column).isin(known)).select(column).distinct()
                require_empty(other, f"Values of {name}.{column} beyond its levels")
            columns = [(at, field.name, field.dataType.simpleString(), ordered.get(field.name)) for at, field in enumerate(table.schema)]
            self.spark.createDataFrame(columns, COLUMN).coalesce(1).write.mode("overwrite").json(f"{self.root}/columns/{name}")
            table.write.mode("overwrite").options(**TEXT_FORMAT).json(f"{self.root}/tables/{name}")

    def _columns(self, name: str) -> list:
        return self.spark.read.schema(COLUMN).json(f"{self.root}/columns/{name}").orderBy("position").collect()

    def read(self, name: str) -> DataFrame:
        schema = ", ".join(f"`{column['name']}` {column['type']}" for column in self._columns(name))
        return self.spark.read.schema(schema).options(mode="FAILFAST", **TEXT_FORMAT).json(f"{self.root}/tables/{name}")

    def levels(self, name: str) -> dict[str, list[str]]:
        """The ordered categories of a table, each with its levels from the lowest."""
        return {column["name"]: list(column["levels"]) for column in self._columns(name) if column["levels"] is not None}


def level_place(category: Column, levels: list[str]) -> Column:
    """The place of a category among its levels, from 1: what to sort and compare it by; NULL stays NULL."""
    return F.array_position(F.array(*[F.lit(level) for level in levels]), category)
