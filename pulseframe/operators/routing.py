"""Filter, transform, merge and route telemetry rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.model import LOG_CONTENT, STRING_CONTENTS, GatewayConfig

Predicate = Column | str
Transformation = Callable[[DataFrame], DataFrame]


def keep(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows the predicate holds for; false and undecided rows go."""
    return df.where(predicate)


def transform_record(df: DataFrame, change: Transformation) -> DataFrame:
    return df.transform(change)


def merge_enrichment(df: DataFrame, **found: Column) -> DataFrame:
    """Add fields to ``analytical_data``, keeping those already there unless named again.

    Structs are merged field by field at every depth, so the sibling fields of a nested struct stay.
    """
    patch = F.struct(*[c.alias(k) for k, c in found.items()])
    if "analytical_data" not in df.columns:
        return df.withColumn("analytical_data", patch)
    kinds = df.select("analytical_data", patch.alias("patch")).schema
    return df.withColumn(
        "analytical_data", merge_structs(F.col("analytical_data"), kinds["analytical_data"].dataType, patch, kinds["patch"].dataType)
    )


def merge_structs(base: Column, base_type: T.StructType, patch: Column, patch_type: T.StructType) -> Column:
    """One struct of both, in which the fields of the patch win; structs that are in both are merged in turn."""
    old, new = set(base_type.fieldNames()), set(patch_type.fieldNames())
    fields = []
    for f in base_type.fields:
        if f.name not in new:
            value = base[f.name]
        elif isinstance(f.dataType, T.StructType) and isinstance(patch_type[f.name].dataType, T.StructType):
            value = merge_structs(base[f.name], f.dataType, patch[f.name], patch_type[f.name].dataType)
        else:
            value = patch[f.name]
        fields.append(value.alias(f.name))
    return F.struct(*fields, *[patch[n].alias(n) for n in patch_type.fieldNames() if n not in old])


def merge_maps(base: Column, patch: Column) -> Column:
    """Union of two string maps in which the patch wins."""
    return F.map_zip_with(base, patch, lambda _, a, b: F.coalesce(b, a))


def route(df: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """Adds ``branch``, the stage a record goes to first."""
    branch = F.lit("out")
    if cfg.analysis:
        branch = F.lit("analysis")
    if cfg.logs_analysis:
        branch = F.when(F.col("content_type") == LOG_CONTENT, F.lit("logs_analysis")).otherwise(branch)
    if cfg.scripted:
        branch = F.lit("filter")
    if cfg.discard:
        branch = F.lit("none")
    return df.withColumn("branch", branch)


def typed_values(data: Column, content_type: Column) -> dict[str, Column]:
    """The value in the one typed column its content type calls for."""
    return {
        "data_int": F.when(content_type == 3, F.try_variant_get(data, "$", "bigint")),
        "data_float": F.when(content_type == 0, F.try_variant_get(data, "$", "double")),
        "data_str": F.when(content_type.isin(*STRING_CONTENTS), F.try_variant_get(data, "$", "string")),
    }


def is_typed(content_type: Column) -> Column:
    return content_type.isin(0, 3, *STRING_CONTENTS)
