"""One reader per source kind; each returns canonical columns."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plotline import constants as K, schema
from plotline.functions import address as A, dates as D
from plotline.functions.text import blank, strip
from plotline.functions.values import first_filled, to_double, to_int, to_long, to_price
from plotline.operators import filters as P
from plotline.operators.gazetteer import resolve_city
from plotline.operators.standardise import add_parts
from plotline.session import stage
from plotline.sources.order import ingest_sequence

_TYPES = {f.name: f.dataType for f in schema.TRANSACTION}


def canonical(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the canonical columns, in order, missing ones as NULL (``keep`` columns follow)."""
    cols = [
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()
    ]
    return df.select(*cols, *[k for k in keep if k in df.columns])


def _typed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    out = {}
    for n in names:
        t = _TYPES[n]
        if isinstance(t, T.DoubleType):
            out[n] = to_double(n)
        elif isinstance(t, T.IntegerType):
            out[n] = to_int(n)
        elif isinstance(t, T.LongType):
            out[n] = to_long(n)
        else:
            out[n] = F.coalesce(F.col(n), F.lit(""))
    return df.withColumns(out)


def from_registry(raw: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """33 text columns of the registry to canonical rows with parsed address and dedup key."""
    rows = _typed(raw, schema.REGISTRY_COLUMNS)
    rows = rows.withColumns(
        {"floor_level": A.floor_or_raw("floor_level"), "total_floors": A.floor_or_raw("total_floors")}
    )
    rows = resolve_city(add_parts(rows, "address", "raw_district"), gazetteer)
    rows = rows.withColumn("dedup_key", A.dedup_key("transaction_date", "address", "total_price", normal="normalized"))
    return canonical(rows, keep=("ingest_seq",))


def read_registry_csv(spark: SparkSession, path: str | list[str], gazetteer: DataFrame | None = None) -> DataFrame:
    """Registry files: BOM, a Chinese and an English header row, short rows filled with ''."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.REGISTRY_COLUMNS])
    raw = ingest_sequence(
        spark.read.schema(text).option("header", True).option("enforceSchema", True)
        .option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    )
    # The second header row names its date column; a data row has digits there.
    body = raw.where(~F.coalesce("transaction_date", F.lit("")).rlike("[A-Za-z]"))
    return from_registry(body, gazetteer)


def _header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value"),
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))


def read_generic_csv(spark: SparkSession, path: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Files that each start with a header row of known names, in any order of their own; unknown
    columns are dropped.

    Where several headers of a file mean one column, the last non-blank one counts.  Parts a file
    does not give come from the address.  Files are told apart by their header line: the driver
    sees the distinct header lines, of which there are as many as layouts, not as files.
    """
    heads = stage(_header_lines(spark, path), "headers")
    layouts = {r.header: next(csv.reader([r.header]), []) for r in heads.select("header").distinct().collect()}
    width = max((len(names) for names in layouts.values()), default=0) or 1
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    lines = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    raw = ingest_sequence(lines.withColumn("file", F.col("_metadata.file_path"))).join(heads, "file")
    cells: dict[str, list[Column]] = {}
    for header, names in sorted(layouts.items()):
        places: dict[str, list[int]] = {}
        for i, h in enumerate(names):
            if name := schema.HEADER_ALIASES.get(h.strip()):
                places.setdefault(name, []).append(i)
        for name, at in places.items():
            value = first_filled(*[F.col(f"c{i}") for i in reversed(at)])
            cells.setdefault(name, []).append(F.when(F.col("header") == header, value))
    rows = raw.select(*[F.coalesce(*cs).alias(n) for n, cs in cells.items()], "ingest_seq")
    return from_columns(rows, gazetteer)


def from_columns(rows: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Text columns under canonical names to canonical rows; blank parts come from the address."""
    given = [n for n in rows.columns if n in _TYPES]
    typed = _typed(rows, given)
    if "address" not in given:
        return canonical(typed, keep=("ingest_seq",))
    hint = first_filled(*[F.col(n) for n in ("raw_district", "district") if n in given], F.lit(""))
    own = {f"__{n}": F.col(n) if n in given else F.lit(None).cast("string") for n in schema.PART_COLUMNS}
    parsed = add_parts(typed.withColumns(own | {"__hint": F.coalesce(hint, F.lit(""))}), "address", "__hint")
    parsed = resolve_city(parsed, gazetteer)
    filled = {
        n: F.coalesce(F.nullif(F.col(f"__{n}"), F.lit("")), F.col(n)) for n in schema.PART_COLUMNS
    }
    out = parsed.withColumns(filled)
    price = "total_price" if "total_price" in given else None
    out = out.withColumn(
        "dedup_key",
        A.dedup_key(
            "transaction_date" if "transaction_date" in given else F.lit(""), "address",
            F.col(price) if price else F.lit(None),
            normal="normalized",
        ),
    )
    return canonical(out, keep=("ingest_seq",))


def from_api(api: DataFrame, gazetteer: DataFrame | None = None, per_ping_price: bool = False) -> DataFrame:
    """Raw API rows to canonical rows; rows whose clean address has no 號 are dropped.

    The true total is JSON ``tp``; the price in ``p``/``cp`` is per ping and is converted to per
    square metre unless ``per_ping_price`` asks for the stored figure.
    """
    have = set(api.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    j = api.withColumns({"__j": F.from_json(F.col("raw_json"), schema.API_JSON), "__address": A.after_hash("address")})
    j = j.where(F.col("__address").contains("號")).withColumn(
        "__floor", A.floor_info(first_filled(F.col("__j.f"), col("floor"), F.lit("")))
    )
    js = lambda n: F.col(f"__j.{n}")
    unit = F.coalesce(F.nullif(to_double(js("p")), F.lit(0.0)), to_double(js("cp")))
    area = F.coalesce(F.nullif(to_double(col("area")), F.lit(0.0)), to_double(js("s")))
    total = F.coalesce(F.nullif(to_price(js("tp")), F.lit(0)), to_price(col("total_price")))
    coord = lambda c, n: F.coalesce(F.nullif(col(c).cast("double"), F.lit(0.0)), F.nullif(js(n), F.lit(0.0)))
    text = lambda *cs: F.coalesce(first_filled(*cs), F.lit(""))
    rows = j.withColumns({"__town": col("town"), "__code": col("city"), "__sq": col("sq")}).select(
        *[c for c in ("ingest_seq",) if c in have],
        F.col("__address").alias("address"),
        "__town", "__code",
        D.compact(F.coalesce(col("date_str"), F.lit(""))).alias("transaction_date"),
        F.col("__floor.floor").alias("floor_level"),
        F.col("__floor.total").alias("total_floors"),
        text(js("t")).alias("transaction_type"),
        to_int(js("j")).alias("rooms"), to_int(js("k")).alias("halls"), to_int(js("l")).alias("bathrooms"),
        text(js("m")).alias("has_management"),
        text(js("pu"), js("AA11")).alias("main_use"),
        text(col("build_type"), js("b")).alias("building_type"),
        text(js("note")).alias("note"),
        total.alias("total_price"),
        (unit if per_ping_price else unit / K.PING_SQM).alias("unit_price"),
        F.when(area != 0, area * K.API_PING_SQM).alias("building_area"),
        F.when(~blank("__sq"), F.concat(F.lit("api_"), F.col("__sq"))).alias("serial_no"),
        F.coalesce(col("community"), F.lit("")).alias("community_name"),
        coord("lat", "lat").alias("lat"),
        coord("lon", "lon").alias("lng"),
    )
    rows = rows.withColumns({
        n: F.lit("") for n in (
            "urban_zone", "non_urban_zone", "non_urban_use", "transaction_count", "main_material",
            "build_date", "partitioned", "parking_type", "elevator", "transfer_no",
        )
    })
    rows = rows.withColumn("__hint", A.city_from_code("__code"))
    rows = resolve_city(add_parts(rows, "address"), gazetteer, hint=F.col("__hint"))
    whole_floor = F.when(F.col("floor_level").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.col("floor_level"))
    rows = rows.withColumns(
        {
            "floor": F.coalesce(F.nullif("floor", F.lit("")), whole_floor, F.lit("")),
            "raw_district": text(F.col("district"), F.col("__town")),
            "dedup_key": A.dedup_key("transaction_date", "address", "total_price", normal="normalized"),
        }
    )
    return canonical(rows, keep=("ingest_seq",))


def read_api(spark: SparkSession, path: str, fmt: str = "parquet", gazetteer: DataFrame | None = None) -> DataFrame:
    """API rows from Parquet, or from JSON lines under the fixed schema."""
    reader = spark.read if fmt == "parquet" else spark.read.schema(schema.API_ROW)
    raw = reader.format(fmt).load(path)
    return from_api(ingest_sequence(raw), gazetteer)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A stored canonical table; columns it lacks are NULL."""
    return canonical(ingest_sequence(spark.read.parquet(path)), keep=("ingest_seq",))


def read_points_csv(spark: SparkSession, path: str, city_key: str = "") -> DataFrame:
    """Address points (lat, lon, city, district, street, housenumber; one header row)."""
    from plotline.operators.geo import clean_points

    raw = spark.read.schema(schema.POINT_FILE).option("header", True).option("enforceSchema", True).csv(path)
    return with_point_id(clean_points(raw, city_key))


def with_point_id(points: DataFrame) -> DataFrame:
    """A stable id per point from its content."""
    return points.withColumn("point_id", F.xxhash64("city", "district", "street", "housenumber", "lat", "lng"))


def read_manual_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manual mapping: address, project, district, remark; rows without address or project are dropped."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*[
        (strip(f"`{h}`") if h in raw.columns else F.lit(None).cast("string")).alias(n)
        for h, n in schema.MANUAL_HEADER.items()
    ])
    return named.where(~blank("community_name") & ~blank("address"))


def read_json_cache(
    spark: SparkSession, path: str, level: str = "exact", source: str = "json_import", per_line: bool = False
) -> DataFrame:
    """JSON objects ``{address: [lat, lng]}``, one per file (or per line), to geocode-cache rows."""
    text = spark.read.option("wholetext", not per_line).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("address_key", "xy"))
    rows = pairs.select(
        "address_key", F.get("xy", F.lit(0)).alias("lat"), F.get("xy", F.lit(1)).alias("lng"),
        F.lit(level).alias("level"), F.lit(source).alias("source"), F.col("address_key").alias("raw_address"),
    )
    return rows.where(P.in_territory("lat", "lng"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """One address per line to a query table; the id comes from the text."""
    lines = spark.read.text(path).select(strip("value").alias("query_text")).where("query_text <> ''")
    return lines.select(F.xxhash64("query_text").alias("query_id"), "query_text").distinct()


READERS = {
    "registry_csv": read_registry_csv,
    "generic_csv": read_generic_csv,
    "api": read_api,
    "transactions": lambda spark, path, gazetteer=None: read_transactions(spark, path),
}


def read_many(spark: SparkSession, files: Sequence[tuple[str, str]], gazetteer: DataFrame | None = None) -> DataFrame:
    """(path, kind) pairs in order of precedence to one table with ``source_rank`` and ``ingest_seq``."""
    out = None
    for rank, (path, kind) in enumerate(files, start=1):
        rows = READERS[kind](spark, path, gazetteer=gazetteer).withColumn("source_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows)
    return out
