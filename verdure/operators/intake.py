"""What comes in: requests for series, farms with their fields, regions; and the keys that units of work go by.

(F4 to F6, F11, H1, H32, H55, H66, K25, K26, P47, P48, Q-13, Q-18.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions.constants import AREA_SPAN_DEGREES, BACKFILL_MONTHS, FORMULA_VERSION, REQUEST_DATES
from verdure.operators import overlay
from verdure.operators.geo import geometry_key
from verdure.operators.lineage import checkpointed


def refused(today: Column, known: list[str]) -> Column:
    """Why a request (mode, index, indices, dates, months, geometry) can't be served, null if it can; the first reason counts."""
    one, many, dates = F.col("index"), F.col("indices"), F.coalesce("dates", F.array().cast("array<date>"))
    names = F.coalesce(many, F.array(one))
    unknown = F.get(F.filter(names, lambda n: ~F.lower(F.trim(n)).isin(*known)), F.lit(0))
    box = overlay.box(F.col("geometry"))
    span = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    months = F.when(F.coalesce("months", F.lit(0)) == 0, BACKFILL_MONTHS).otherwise(F.col("months"))
    reasons = [
        (one.isNull() == many.isNull(), "provide exactly one of `index` or `indices`"),
        (F.size(F.coalesce(many, F.array(F.lit("")))) == 0, "`indices` must be non-empty"),
        (unknown.isNotNull(), F.concat(F.lit("unknown index '"), unknown, F.lit("'"))),
        ((F.col("mode") == "dates") & ~F.size(dates).between(1, REQUEST_DATES), f"provide between 1 and {REQUEST_DATES} dates"),
        ((F.col("mode") == "dates") & F.exists(dates, lambda d: d > today), "dates cannot be in the future"),
        ((F.col("mode") == "backfill") & ~months.between(1, BACKFILL_MONTHS), f"months must be between 1 and {BACKFILL_MONTHS}"),
        (~F.col("mode").isin("dates", "backfill"), F.concat(F.lit("unknown AOI series mode '"), F.col("mode"), F.lit("'"))),
        (span.isNull(), "geometry has no coordinates"),
        (span > AREA_SPAN_DEGREES, f"AOI is too large for a preview (over {AREA_SPAN_DEGREES} degrees across); draw a field-sized area."),
    ]
    out = F.lit(None).cast("string")
    for when, why in reversed(reasons):
        out = F.when(F.coalesce(when, F.lit(False)), why).otherwise(out)
    return out


def result_key(geometry: Column, index: Column, scene: Column) -> Column:
    """What a computed pass is found again by: the area's digest, the index, the formula's version and the scene."""
    return area_result_key(geometry_key(geometry), index, scene)


def area_result_key(area: Column, index: Column, scene: Column) -> Column:
    """result_key by the area's digest, which is dear: where an area has many passes, it is made once and joined to them."""
    return F.concat_ws(":", area, index, F.lit(FORMULA_VERSION), scene)


def scene_unit(field: Column, scene: Column, version: Column) -> Column:
    """The unit of work of one scene of a field at a geometry version."""
    return F.concat(F.lit("collect:"), field.cast("string"), F.lit(":"), scene.cast("string"), F.lit(":v"), version.cast("string"))


def field_unit(field: Column, version: Column) -> Column:
    """The unit of work of a whole field at a geometry version."""
    return F.concat(F.lit("collect:field:"), field.cast("string"), F.lit(":v"), version.cast("string"))


def uncomputed(asked: DataFrame, results: DataFrame) -> DataFrame:
    """H1: passes that are asked for (key, ...) and not among the results (key), each key once."""
    return asked.dropDuplicates(["key"]).join(results.select("key"), "key", "left_anti")


def ingest(farms: DataFrame, fields: DataFrame, stored: DataFrame) -> DataFrame:
    """Q-13, F11, H70, K25: what becomes of each incoming farm's fields: farm_id, id, field_id, action, repaired, reason.

    farms: farm_id, boundary (GeoJSON or null), epsg, own_id (the id of the field
    that a farm without fields becomes); fields: id, farm_id, canonical_id,
    boundary, epsg; stored: as match_fields takes it. A farm is refused whole, one
    row with a reason and no action, if a boundary can't be used (the first field's
    by id before the farm's), if it has neither boundary nor fields, or if a field
    is not nested in its declared boundary. Else its boundary is the declared one
    or the union of its fields, and the fields meet the stored ones one to one.
    """

    def checked(df: DataFrame) -> DataFrame:
        kind, g = overlay.from_geojson(F.col("boundary"))
        return df.withColumn("v", overlay.validated(kind, g, F.col("epsg")))

    f = checkpointed(checked(overlay.dealt(fields, "id")))
    own = checkpointed(checked(overlay.dealt(farms, "farm_id")))
    label = F.concat(F.lit("field"), F.when(F.col("canonical_id").isNotNull(), F.concat(F.lit(" ("), F.col("canonical_id"), F.lit(")"))).otherwise(""), F.lit(": "), F.col("v.reason"))
    broken = f.where(~F.col("v.ok")).groupBy("farm_id").agg(F.min_by(label, "id").alias("field_reason"))
    has = f.groupBy("farm_id").agg(F.count("*").alias("n_fields"))
    known = own.join(broken, "farm_id", "left").join(has, "farm_id", "left")
    why = F.coalesce("field_reason", F.when(F.col("boundary").isNotNull() & ~F.col("v.ok"), F.concat(F.lit("farm boundary: "), F.col("v.reason"))), F.when(F.col("boundary").isNull() & F.col("n_fields").isNull(), "farm has neither a boundary nor any fields - nothing to analyse"))
    known = checkpointed(known.select("farm_id", "own_id", F.col("v.geometry").alias("boundary"), "n_fields", why.alias("reason")))
    good = known.where("reason IS NULL")
    sound = f.join(good.select("farm_id"), "farm_id", "left_semi").select("id", "farm_id", "canonical_id", F.col("v.geometry").alias("geometry"), F.col("v.repaired").alias("repaired"))
    bounds = overlay.farm_boundaries(good.select("farm_id", "boundary"), sound)
    share = F.format_string("%.1f%%", F.col("outside") * 100)
    named = F.concat(F.lit("field '"), F.coalesce("canonical_id", F.lit("<unnamed>")), F.lit("' is not nested within the farm boundary ("), share, F.lit(" of its area lies outside the tolerance)"))
    loose = overlay.nesting(sound, bounds).where("NOT nested").join(sound.select("id", "canonical_id"), "id").groupBy("farm_id").agg(F.min_by(named, "id").alias("reason"))
    loose = checkpointed(loose)
    held = sound.join(loose.select("farm_id"), "farm_id", "left_anti").withColumn("derived", F.lit(False))
    alone = good.where("n_fields IS NULL").select(F.col("own_id").alias("id"), "farm_id", F.lit(None).cast("string").alias("canonical_id"), F.col("boundary").alias("geometry"), F.lit(False).alias("repaired"), F.lit(True).alias("derived"))
    incoming = checkpointed(held.select(*alone.columns).unionByName(alone))
    done = overlay.match_fields(incoming, stored).join(incoming.select("id", "repaired"), "id")
    no = known.where("reason IS NOT NULL").select("farm_id", "reason").unionByName(loose)
    return done.select("farm_id", "id", "field_id", "action", "repaired", F.lit(None).cast("string").alias("reason")).unionByName(no, allowMissingColumns=True)


def drawn_regions(drawn: DataFrame, zones: DataFrame, farms: DataFrame) -> DataFrame:
    """K26, Q-18: regions (region_id, name, boundary as GeoJSON) that analysts draw: reason if refused, else their composition (zone=share, the largest first), the dominant zone, and how many farms (id, lon, lat) they capture.

    A region is never clipped; it may span several zones, or none.
    """
    kind, g = overlay.from_geojson(F.col("boundary"))
    made = checkpointed(overlay.dealt(drawn, "region_id").select("region_id", "name", overlay.validated(kind, g, F.lit(4326)).alias("v")))
    good = made.where("v.ok").select("region_id", F.col("v.geometry").alias("geometry"))
    parts = overlay.composition(good.withColumnRenamed("region_id", "id"), zones)
    line = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "zone"))), lambda p: F.concat(p["zone"], F.lit("="), F.format_string("%.4f", -p["s"])))
    spread = parts.groupBy(F.col("id").alias("region_id")).agg(F.array_join(line, ",").alias("composition"), F.max(F.when(F.col("dominant"), F.col("zone"))).alias("dominant"))
    caught = overlay.assign(farms, good).where("region_id IS NOT NULL").groupBy("region_id").agg(F.count("*").alias("captured"))
    out = made.join(spread, "region_id", "left").join(caught, "region_id", "left")
    return out.select("region_id", "name", F.col("v.reason").alias("reason"), "composition", "dominant", F.when(F.col("v.ok"), F.coalesce("captured", F.lit(0))).alias("captured"))
