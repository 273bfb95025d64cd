"""Readers and writers of the file formats the jobs exchange."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIRECTORY = (
    "Pincode string, OfficeName string, OfficeType string, Delivery string, District string, StateName string, "
    "Latitude string, Longitude string"
)
PINCODES = "pincode string, locality string, district string, state string, lat double, lng double, office_count int"
LOCALITIES = "pincode string, locality string"
TRUTH = (
    "struct<building:string,street:string,sub_locality:string,locality:string,city:string,district:string,state:string,"
    "pincode:string,landmarks:array<struct<name:string,relation:string>>>"
)
SEEDS = (
    f"seed_id string, raw string, shape string, truth {TRUTH}, geo struct<lat:double,lng:double>, digipin string, "
    "landmark_truth array<struct<name:string,relation:string,true_lat:double,true_lng:double,distance_m:double>>, "
    "provenance struct<source:string,office_type:string,contains_personal_data:boolean>"
)
CORPUS = (
    f"address_id string, seed_id string, raw string, truth {TRUTH}, geo struct<lat:double,lng:double>, digipin string, "
    "perturbations array<string>, phones_expected array<string>"
)
GOLD = CORPUS + ", label_status string, label_source string"
LANDMARKS = (
    "landmark_id string, canonical_name string, aliases array<string>, type string, lat double, lng double, "
    "digipin_cell string, pincode string, observation_count int, confidence double, access_notes array<map<string,string>>, "
    "last_seen timestamp, embedding array<float>"
)
DELIVERIES = "order_id string, ts timestamp, location struct<lat:double,lng:double>, accuracy_m double, detail_type string"


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The raw directory: CSV with a header, columns by name, all strings.

    line_no counts the rows of all files from 0, files by path, so "first row" stays defined and
    a row has the same number however the files are split.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [f.name for f in T.StructType.fromDDL(DIRECTORY).fields]
    present = {c.lstrip("\ufeff"): c for c in raw.columns}
    chosen = [
        (F.col(f"`{present[n]}`") if n in present else F.lit(None)).cast("string").alias(n) for n in names
    ]
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    return numbered(raw.select(*chosen, *at, F.monotonically_increasing_id().alias("_row")))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds line_no from _file, _block and _row: the rows of earlier blocks, and the place within the block.

    A block is read from start to end by one task, so its rows follow one another in ``_row``; only
    one count per block is gathered and summed.
    """
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of a file
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = blocks.select("_file", "_block", (offset - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["_file", "_block"]).withColumn("line_no", F.col("_row") + F.col("_shift")).drop("_file", "_block", "_row", "_shift")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """The pincode table; empty coordinates are null."""
    return spark.read.schema(PINCODES).option("header", True).option("emptyValue", "").csv(path)


def read_localities(spark: SparkSession, path: str) -> DataFrame:
    """The locality index; a gzip file is one split, so rows are spread after reading."""
    rows = spark.read.schema(LOCALITIES).option("header", True).csv(path)
    return rows.select("pincode", F.lower("locality").alias("locality")).distinct().repartition("pincode")


def read_jsonl(spark: SparkSession, path: str, schema: str, allow_unknown: bool = False) -> DataFrame:
    """JSON lines with a given schema; a broken row or an unknown field fails the read.

    Spark ignores unknown fields, so each line's keys are compared in the same
    pass that parses it.
    """
    if allow_unknown:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(schema).fields])
    extra = F.array_except(F.json_object_keys("value"), known)
    row = F.when(
        F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))
    ).otherwise(F.from_json("value", schema, {"mode": "FAILFAST"}))
    return spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select("r.*")


def read_small_map(spark: SparkSession, path: str) -> dict:
    """One small JSON object; keys that start with an underscore are comments."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    return {k: v for k, v in json.loads(text).items() if not k.startswith("_")}


def read_abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    return read_small_map(spark, path)


def read_knots(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    return sorted((float(x), float(y)) for x, y in read_small_map(spark, path)["knots"])


def read_events(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """An event stream from a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def write_gazetteer(gazetteer: DataFrame, localities: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Both reference tables, sorted; the locality index compressed."""
    if fmt == "csv":
        gazetteer.sort("pincode").write.mode("overwrite").option("header", True).csv(f"{folder}/pincodes")
        localities.sort("pincode", "locality").write.mode("overwrite").option("header", True).option(
            "compression", "gzip"
        ).csv(f"{folder}/localities")
    else:
        gazetteer.sort("pincode").write.mode("overwrite").format(fmt).save(f"{folder}/pincodes")
        localities.sort("pincode", "locality").write.mode("overwrite").format(fmt).save(f"{folder}/localities")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_timeline(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append audit events, one folder per day."""
    events.withColumn("event_date", F.to_date(ts)).write.mode("append").partitionBy("event_date").parquet(path)


def read_timeline(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("event_date") == F.lit(day).cast("date")) if day else rows


def bulk_resolve(spark: SparkSession, csv_path: str, out_path: str, resolve, split=None) -> dict[str, int]:
    """Resolve a CSV of (order_id, raw) into JSON lines; returns counts per status.

    Counts are observed while the result is written, not by a second pass. ``split``
    parts the rows into accepted and quarantined ones; the latter are written beside
    the result, below ``<out_path>-quarantined``.
    """
    from pyspark.sql import Observation

    rows = spark.read.schema("order_id string, raw string").option("header", True).csv(csv_path)
    seen, refused = Observation("bulk_resolve"), Observation("bulk_quarantined")

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status.lower())

    resolve(rows).observe(
        seen, F.count(F.lit(1)).alias("done"), count("RESOLVED"), count("NEEDS_INFO"), count("AMBIGUOUS")
    ).write.mode("overwrite").json(out_path)
    if split is None:
        return seen.get
    split(rows)[1].observe(refused, F.count(F.lit(1)).alias("quarantined")).write.mode("overwrite").json(f"{out_path}-quarantined")
    return {**seen.get, **refused.get}
