"""Readers of artifact trees and their long tables (SRC-1..9), and writers (SNK-1..12).

A tree is <root>/<slide>/<iteration>/… and <root>/_diagnostics/<slide>/<iteration>/…; paths become columns. Only Spark's readers touch the files. They pass over names that begin
with an underscore, so the diagnostics folder is a root of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import kinds as K

COUNTS = "map<string,bigint>"
MANIFEST = (
    "status string, gt_available boolean, ablation_flags map<string,boolean>, emit_accounting struct<native_object_count:bigint,raster_region_count:bigint,native_area_ratio:double,raster_area_ratio:double,"
    f"raster_native_overlap_area_ratio:double,dropped_hypothesis_count:bigint>, motif_accounting map<string,{COUNTS}>, fallback_accounting {COUNTS}, source_attribution map<string,map<string,string>>"
)
ORACLE = (
    f"status string, gt_available boolean, stages map<string,struct<recoverable_count:bigint,ground_truth_count:bigint,recoverable_ratio:double,ground_truth_count_by_kind:{COUNTS},"
    f"recoverable_by_kind:{COUNTS},recoverable_by_source_bucket:{COUNTS},recoverable_by_source_bucket_by_kind:map<string,{COUNTS}>>>"
)
ATTRITION = "ground_truth array<struct<gt_id:string,lost_at:string>>"
FAILURES = "ground_truth array<struct<gt_id:string,kind:string,tag:string>>, predictions array<struct<prediction_id:string,kind:string,tag:string>>"
AUDIT = f"ground_truth array<struct<gt_id:string,kind:string,status:string,snap_effect:string>>, status_counts {COUNTS}, snap_effect_counts {COUNTS}"
TRUTH = "version int, objects array<string>"


def _placed(df: DataFrame) -> DataFrame:
    """With slide and iteration from the path."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = F.array_position(F.transform(parts, lambda p: p.startswith("iter_")), True).cast("int")
    return df.withColumn("_parts", parts).withColumn("_at", at).withColumn("slide", F.element_at("_parts", F.col("_at") - 1)).withColumn("iteration", F.element_at("_parts", F.col("_at"))).drop("_parts", "_at")


def files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All files of one name below `root`, one row each; none there, no rows."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return _placed(reader.json(root))


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """(slide, iteration, root) of all files; root is the folder above the slide."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path")
    whole = F.regexp_extract_all("path", F.lit(r"^(.*)/([^/]+)/(iter_[^/]+)/"), 0)
    rows = found.where(F.size(whole) > 0)
    part = lambda i: F.regexp_extract("path", r"^(.*?)/([^/]+)/(iter_[^/]+)/", i)
    return rows.select(part(1).alias("root"), part(2).alias("slide"), part(3).alias("iteration")).distinct()


def slides(found: DataFrame) -> DataFrame:
    return found.where(~F.col("root").endswith("_diagnostics")).select("slide", "iteration").distinct()


def stage_rows(oracle: DataFrame) -> DataFrame:
    return oracle.select("slide", F.explode("stages").alias("stage", "p")).select("slide", "stage", "p.recoverable_count", "p.ground_truth_count")


def stage_kind_rows(oracle: DataFrame, field: str) -> DataFrame:
    return oracle.select("slide", F.explode("stages").alias("stage", "p")).select("slide", "stage", F.explode(f"p.{field}").alias("kind", "n"))


def lost_rows(attrition: DataFrame) -> DataFrame:
    return attrition.select("slide", F.posexplode("ground_truth").alias("ord", "g")).select("slide", "ord", "g.gt_id", "g.lost_at").where("lost_at is not null and lost_at <> ''")


def tagged_rows(failures: DataFrame, side: str) -> DataFrame:
    return failures.select("slide", F.explode(side).alias("g")).select("slide", "g.kind", "g.tag")


def status_rows(audit: DataFrame) -> DataFrame:
    return audit.select("slide", F.explode("ground_truth").alias("g")).select("slide", "g.kind", "g.status", "g.snap_effect")


def manifest_rows(manifest: DataFrame) -> DataFrame:
    e = F.col("emit_accounting")
    number = lambda c, zero: F.coalesce(e[c], F.lit(zero)).alias(c)
    return manifest.select(
        "slide", F.coalesce("gt_available", F.lit(False)).alias("gt_available"), F.col("ablation_flags.grow_fallback_enabled").alias("grow"), F.col("ablation_flags.motifs_enabled").alias("motifs"),
        *(number(c, 0) for c in ("native_object_count", "raster_region_count", "dropped_hypothesis_count")), *(number(c, 0.0) for c in ("native_area_ratio", "raster_area_ratio", "raster_native_overlap_area_ratio")),
        F.coalesce(F.col("fallback_accounting.grow_fallback_hypothesis_count"), F.lit(0)).alias("grow_fallback_count"),
    )


def motif_rows(manifest: DataFrame) -> DataFrame:
    return manifest.select("slide", F.explode("motif_accounting").alias("family", "m")).select("slide", "family", F.explode("m").alias("counter", "n"))


def attribution_rows(manifest: DataFrame) -> DataFrame:
    """(slide, stage, field, kind, bucket, n); kind is null for counters by bucket only."""
    fields = manifest.select("slide", F.explode("source_attribution").alias("stage", "f")).select("slide", "stage", F.explode("f").alias("field", "json"))
    flat = fields.where(~F.col("field").endswith("_by_kind")).select("slide", "stage", "field", F.lit(None).cast("string").alias("kind"), F.explode(F.from_json("json", COUNTS)).alias("bucket", "n"))
    deep = fields.where(F.col("field").endswith("_by_kind")).select("slide", "stage", "field", F.explode(F.from_json("json", f"map<string,{COUNTS}>")).alias("kind", "c"))
    return flat.union(deep.select("slide", "stage", "field", "kind", F.explode("c").alias("bucket", "n")))


def parse_item(json: Column) -> Column:
    """A ground-truth object as an item: a box as list or object, other key names and defaults are accepted."""
    get = lambda *paths: F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, f"$.{p}")), F.lit("")) for p in paths))
    number = lambda i, name: F.coalesce(F.get_json_object(json, f"$.bbox[{i}]"), F.get_json_object(json, f"$.bbox.{name}")).cast("double")
    x0, y0, x1, y1 = (number(i, n) for i, n in enumerate(("x0", "y0", "x1", "y1")))
    box = F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), G.box(x0, y0, x1, y1))
    strings = lambda *paths: F.coalesce(*(F.from_json(F.get_json_object(json, f"$.{p}"), "array<string>") for p in paths), F.array().cast("array<string>"))
    ids = strings("source_ids")
    return F.struct(
        get("id").alias("id"), get("object_type", "kind").alias("kind"), box.alias("box"), ids.alias("source_ids"), strings("attachment_ids", "attachments").alias("attachment_ids"), get("parent_id").alias("parent_id"),
        F.coalesce(get("score_total").cast("double"), F.lit(1.0)).alias("score"), F.coalesce(get("source_bucket"), K.bucket(ids)).alias("bucket"), F.coalesce(get("evaluable").cast("boolean"), F.lit(True)).alias("evaluable"),
    )


def ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """Items of all *.gt.json files below `root`, by file; `<stem>.gt.json` goes before `<name><suffix>.gt.json` of the same picture. A file without a list of objects raises."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.gt.json").text(root).select("value", F.col("_metadata.file_path").alias("path"))
    picture = F.regexp_replace(F.regexp_replace("path", r"\.gt\.json$", ""), r"\.(png|jpe?g|webp|bmp)$", "")
    first = raw.withColumn("picture", picture).groupBy("picture").agg(F.min_by(F.struct("path", "value"), F.length("path")).alias("f"))
    objects = F.from_json(F.get_json_object("f.value", "$.objects"), "array<string>")
    checked = F.when(objects.isNull(), F.raise_error(F.concat(F.lit("no list of objects in "), "f.path"))).otherwise(objects)
    version = F.coalesce(F.get_json_object("f.value", "$.version").cast("int"), F.lit(1))
    return first.select("picture", version.alias("version"), F.posexplode(checked).alias("ord", "json")).select("picture", "version", "ord", parse_item(F.col("json")).alias("i")).select("picture", "version", "ord", "i.*")


def images(spark: SparkSession, root: str) -> DataFrame:
    """path and content of picture files; decoding is left to a kernel (no codec is a dependency)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,webp}").load(root).select("path", "content")


def planes(spark: SparkSession, rows: list[tuple[int, int, int, int, bytes]]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([*(T.StructField(n, T.LongType()) for n in ("slide_id", "height", "width", "channels")), T.StructField("pixels", T.BinaryType())]))


def write_stage_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines by stage."""
    items.write.mode(mode).partitionBy("stage").json(path)


def write_tables(path: str, recorder: str = "files", **tables: DataFrame) -> dict[str, str]:
    """Each table as JSON lines below `path`; the recorder `none` writes nothing. Gives the paths."""
    if recorder == "none":
        return {}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def evaluation_or_reason(rows: DataFrame, truth: DataFrame, reason: str = "ground_truth_missing") -> DataFrame:
    """A payload row: ok with all rows, or unavailable with the reason when there is no ground truth."""
    found = rows.agg(F.collect_list(F.to_json(F.struct("*"))).alias("rows")).crossJoin(truth.agg(F.count("*").alias("n")))
    ok = F.col("n") > 0
    return found.select(F.when(ok, "ok").otherwise("unavailable").alias("status"), ok.alias("gt_available"), F.when(~ok, F.lit(reason)).alias("reason"), F.when(ok, F.col("rows")).alias("rows"))


def serialised(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, boxes and points as objects."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
