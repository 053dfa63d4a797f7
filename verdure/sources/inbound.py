"""S27 to S30, Q-12: inbound farm payloads, nested or flat, to one row per field or sub-plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLOT = "struct<plot_id:string,name:string,crop:string>"
NESTED = f"farms array<struct<farm_id:string,name:string,fields:array<struct<field_id:string,name:string,crop:string,sub_plots:array<{PLOT}>>>>>"
FLAT = "farmId string, fields array<struct<fieldId:string,name:string,crop:string>>, subPlots array<struct<plotId:string,fieldId:string,name:string,crop:string>>"


def _dotted(field: Column, plot: Column) -> Column:
    return F.when(F.startswith(plot, F.concat(field, F.lit("."))), plot).otherwise(F.concat_ws(".", field, plot))


def farm_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """(farm_id, canonical_id, name, crop) of both formats, told apart by farmId; sub-plots of unknown fields are dropped."""
    n, f = F.from_json(column, NESTED), F.from_json(column, FLAT)
    flat_kind = F.get_json_object(column, "$.farmId").isNotNull()
    fields = raw.where(~flat_kind).select(F.explode(n["farms"]).alias("farm")).select("farm.farm_id", F.explode("farm.fields").alias("f"))
    plots = fields.select("farm_id", F.col("f.field_id").alias("field_id"), F.explode("f.sub_plots").alias("p"))
    own = fields.select("farm_id", F.col("f.field_id").alias("canonical_id"), "f.name", "f.crop")
    own = own.unionByName(plots.select("farm_id", _dotted(F.col("field_id"), F.col("p.plot_id")).alias("canonical_id"), "p.name", "p.crop"))
    parsed = raw.where(flat_kind).select(f.alias("x"))
    flat = parsed.select(F.col("x.farmId").alias("farm_id"), F.explode("x.fields").alias("f"))
    sub = parsed.select(F.col("x.farmId").alias("farm_id"), F.explode("x.subPlots").alias("p")).select("farm_id", F.col("p.fieldId").alias("fid"), "p")
    known = flat.select("farm_id", F.col("f.fieldId").alias("fid"))
    own = own.unionByName(flat.select("farm_id", F.col("f.fieldId").alias("canonical_id"), "f.name", "f.crop"))
    joined = sub.join(known, ["farm_id", "fid"])
    return own.unionByName(joined.select("farm_id", _dotted(F.col("fid"), F.col("p.plotId")).alias("canonical_id"), "p.name", "p.crop"))
