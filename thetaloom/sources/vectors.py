"""A store of text vectors that grows by parts: one model identity, each text once, by its hash."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaloom.sources.files import DataError, require_empty

VERSION = "version int, identity string, parts array<string>"
VECTOR = "text_sha256 string, embedding array<float>, version int"


def hashed(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``text_sha256``; rows without a text go."""
    return texts.filter(F.col(text).isNotNull()).withColumn("text_sha256", F.sha2(text, 256))


class VectorStore:
    """Vectors under ``root``, all made by the model of ``identity``, whose ``dimensions`` is their length.

    A write makes a part, a Parquet folder of its own, and then a version: one small record that lists the parts in use. A
    write that fails leaves no version, so readers see the last whole one, and of two writers at once the second fails. A
    text in several parts has the vector of the latest. ``compact`` leaves one part, which is read without a shuffle.
    Nothing is deleted: earlier parts stay for readers that began before."""

    def __init__(self, spark: SparkSession, root: str, identity: dict[str, object]):
        self.spark, self.root, self.identity = spark, root.rstrip("/"), identity
        self._latest()

    def _latest(self) -> tuple[int, list[str]]:
        """The last version and its parts; raises where the store is another model's."""
        try:
            versions = self.spark.read.schema(VERSION).json(f"{self.root}/versions/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        row = versions.orderBy(F.desc("version")).first()
        if row is None:
            return 0, []
        stored = json.loads(row["identity"])
        differing = sorted(key for key in {*stored, *self.identity} if stored.get(key) != self.identity.get(key))
        if differing:
            raise DataError(f"{self.root} holds vectors of another model: {[(key, stored.get(key), self.identity.get(key)) for key in differing]}")
        return row["version"], list(row["parts"])

    def _parts(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], VECTOR)
        return self.spark.read.schema(VECTOR).parquet(*[f"{self.root}/parts/{part}" for part in parts])

    def _current(self, parts: list[str]) -> DataFrame:
        stored = self._parts(parts)
        if len(parts) < 2:
            return stored.select("text_sha256", "embedding")
        return stored.groupBy("text_sha256").agg(F.max_by("embedding", "version").alias("embedding"))

    def _commit(self, vectors: DataFrame, version: int, kept: list[str]) -> None:
        part = f"{version:06d}-{uuid.uuid4().hex}"
        rows = vectors.select("text_sha256", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(version).alias("version"))
        rows.write.parquet(f"{self.root}/parts/{part}")
        record = [(version, json.dumps(self.identity, sort_keys=True), [*kept, part])]
        self.spark.createDataFrame(record, VERSION).coalesce(1).write.json(f"{self.root}/versions/{version:06d}")

    def read(self) -> DataFrame:
        """text_sha256 and embedding, each text once."""
        return self._current(self._latest()[1])

    def add(self, vectors: DataFrame, replace: bool = False) -> None:
        """Store text_sha256 and embedding. Texts that the store has keep their vector, or take the new one (``replace``)."""
        version, parts = self._latest()
        length = F.size("embedding")
        fits = F.col("text_sha256").isNotNull() & F.col("embedding").isNotNull() & (length == self.identity["dimensions"])
        require_empty(vectors.filter(~fits).select("text_sha256", length.alias("length")), "Vectors without a text or of another length")
        require_empty(vectors.groupBy("text_sha256").count().filter("count > 1"), "Texts repeat")
        if parts and not replace:
            vectors = vectors.join(self._parts(parts).select("text_sha256"), "text_sha256", "left_anti")
        self._commit(vectors, version + 1, parts)

    def missing(self, texts: DataFrame) -> DataFrame:
        """The distinct texts, with their hash, that have no vector yet."""
        wanted = hashed(texts).select("text_sha256", "text").dropDuplicates(["text_sha256"])
        return wanted.join(self._parts(self._latest()[1]).select("text_sha256"), "text_sha256", "left_anti")

    def compact(self, texts: DataFrame) -> None:
        """One part with the vectors of ``texts`` alone: vectors that no text uses any more are left out."""
        version, parts = self._latest()
        self._commit(self._current(parts).join(hashed(texts).select("text_sha256"), "text_sha256", "left_semi"), version + 1, [])
