"""The database of function-pointer types and function signatures."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.operators import relational as R

SCHEMA = "name string, return_type string, params array<string>"


@dataclass(frozen=True)
class TypeDatabase:
    """types and functions (name, return_type, params), one of each name.  Every change gives a new database."""

    types: DataFrame
    functions: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> TypeDatabase:
        return TypeDatabase(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA))

    def add_types(self, rows: DataFrame) -> TypeDatabase:
        """rows take the place of types of their name."""
        return replace(self, types=R.keep_left(rows.select("name", "return_type", "params").dropDuplicates(["name"]), self.types, "name"))

    def add_functions(self, rows: DataFrame) -> TypeDatabase:
        return replace(self, functions=R.keep_left(rows.select("name", "return_type", "params").dropDuplicates(["name"]), self.functions, "name"))

    def compatible(self) -> DataFrame:
        """(type_name, functions) of types that some function fits."""
        return R.compatible_functions(self.types, self.functions)

    def compatible_with(self, type_name: str) -> DataFrame:
        """(name) of the functions that fit one type."""
        return R.compatible_functions(self.types.where(F.col("name") == type_name), self.functions).select(F.explode("functions").alias("name"))

    def is_compatible(self, function: str, type_name: str) -> bool:
        return not R.compatible_functions(self.types.where(F.col("name") == type_name), self.functions.where(F.col("name") == function)).isEmpty()
