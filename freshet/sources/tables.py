"""Scans, sinks and descriptions of tables.

Readers take a path that Spark reads and an explicit schema; nothing is inferred except
where the source has no fixed schema. Writers take the folder; they never list or move
files themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.session import stored


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8", columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """Delimited text, plain or gzip, with a header; blank fields are NULL, a byte-order mark is dropped."""
    df = spark.read.schema(schema).options(header=True, encoding=encoding, sep=sep, nullValue="", mode="PERMISSIVE", enforceSchema=True).csv(path)
    return df.select(*columns) if columns else df


def read_features(spark: SparkSession, path: str, properties: str, by_line: bool = False) -> DataFrame:
    """A row for each GeoJSON feature: properties (by a schema), rings and geometry_ok.

    Polygons and multi-polygons become one array of rings of struct(x, y); a geometry that
    can't be read has NULL rings and geometry_ok false. With ``by_line`` the file has a feature
    a line, as writers of large collections do (a comma may follow, other lines are passed
    over), and Spark splits it; otherwise a file is one document, read by one task.
    """
    shape = "properties string, geometry string"
    if by_line:
        feature = spark.read.text(path).where(F.col("value").rlike(r'^\s*\{\s*"type"\s*:\s*"Feature"\s*,')).select(F.from_json(F.regexp_replace("value", r",\s*$", ""), shape).alias("f"))
    else:
        whole = F.from_json("value", f"features array<struct<{shape.replace(' string', ':string')}>>")
        feature = spark.read.text(path, wholetext=True).select(F.explode(whole["features"]).alias("f"))
    geometry = F.from_json("f.geometry", "type string, coordinates string")
    kind, coords = geometry["type"], geometry["coordinates"]
    poly = F.from_json(coords, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coords, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", poly).when(kind == "MultiPolygon", multi)
    as_xy = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    usable = F.coalesce(F.size(rings) > 0, F.lit(False)) & F.coalesce(F.forall(rings, lambda r: F.size(r) >= 4), F.lit(False))
    props = F.from_json("f.properties", properties)
    return feature.select(props.alias("p"), F.when(usable, as_xy).alias("rings"), usable.alias("geometry_ok")).select("p.*", "rings", "geometry_ok")


def ring_edges(features: DataFrame, ident: str, order: str) -> DataFrame:
    """Edge table (zone, ord, ring, i, x1, y1, x2, y2) of features with rings; repeated last vertices are dropped."""
    rings = features.where("rings is not null").select(F.col(ident).alias("zone"), F.col(order).alias("ord"), F.posexplode("rings").alias("ring", "_r"))
    following = F.concat(F.slice("_r", F.lit(2), F.size("_r")), F.slice("_r", 1, 1))
    pairs = F.arrays_zip(F.col("_r").alias("a"), following.alias("b"))
    edges = rings.select("zone", "ord", "ring", F.posexplode(pairs).alias("i", "_e"))
    out = edges.select("zone", "ord", "ring", "i", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))
    return out.where("x1 <> x2 or y1 <> y2")


def read_buildings(spark: SparkSession, path: str, name: str = "names.primary", sources: str = "sources", columns: Sequence[str] = ()) -> DataFrame:
    """Parquet buildings with the primary name and the first source, nested fields pruned."""
    first = F.try_element_at(F.col(sources), F.lit(1))
    return spark.read.parquet(path).select(*columns, F.col(name).alias("name"), first["dataset"].alias("source_dataset"), first["record_id"].alias("source_record"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of which the fields are discovered over all rows; unreadable lines are kept aside."""
    return spark.read.option("columnNameOfCorruptRecord", "_unreadable").json(path)


def read_glob(spark: SparkSession, pattern: str, schema: str | T.StructType, part: str, name: str) -> DataFrame:
    """Files of one shape, with a column taken from the file's name by a regular expression."""
    df = spark.read.schema(schema).options(header=True, nullValue="").csv(pattern)
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), part, 1))


def read_layers(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen layers of a wide cell table; a missing layer is an error."""
    missing = [n for n in names if n not in cells.columns]
    if missing:
        raise ValueError(f"no such layer: {missing}")
    return cells.select("row", "col", *names)


def read_frames(frames: DataFrame, default_span: int) -> DataFrame:
    """Frames that arrived (rate known), with their span or the default."""
    span = F.coalesce("span_min", F.lit(default_span)) if "span_min" in frames.columns else F.lit(default_span)
    return frames.withColumn("span_min", span).where(F.col("rate").isNotNull())


def write_by_event(df: DataFrame, path: str, key: str = "event", skip_done: bool = False) -> None:
    """A partition for each event; a rerun replaces its events only, or skips those already there."""
    spark = df.sparkSession
    if skip_done:
        try:
            done = spark.read.parquet(path).select(key).distinct()
            df = df.join(done, key, "left_anti")
        except Exception as e:  # the first write: nothing is there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    df.write.mode("append" if skip_done else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def gate_complete(df: DataFrame, requested: DataFrame, share: float = 0.9, key: str = "event", stamp: str = "stamp") -> tuple[DataFrame, DataFrame]:
    """(rows of the events with at least ``share`` of the requested stamps, the missing stamps)."""
    asked = requested.select(key, stamp).distinct()
    here = df.select(key, stamp).distinct()
    missing = asked.join(here, [key, stamp], "left_anti")
    counts = asked.groupBy(key).agg(F.count(F.lit(1)).alias("_asked")).join(here.join(asked, [key, stamp], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_got")), key, "left")
    good = counts.where(F.coalesce("_got", F.lit(0)) >= share * F.col("_asked")).select(key)
    return df.join(good, key, "left_semi"), missing


def publish(df: DataFrame, path: str, order: Sequence[str], sample: int, drop: Sequence[str] = ()) -> None:
    """Sorted zstd Parquet, a gzip CSV without nested columns, and a sample of the first rows."""
    ordered = stored(df).orderBy(*order)  # the input is computed once
    flat = ordered.drop(*drop)
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/table")
    flat.write.mode("overwrite").options(header=True, compression="gzip").csv(f"{path}/csv")
    flat.limit(sample).coalesce(1).write.mode("overwrite").options(header=True).csv(f"{path}/sample")


def manifest(df: DataFrame, positive: Column, event: str, columns: Sequence[str], status: str | None = None) -> DataFrame:
    """One row: rows, positives, rate, events, known values of columns, rows of each status."""
    pos = F.sum(F.when(positive, 1).otherwise(0))
    base = df.agg(F.count(F.lit(1)).alias("rows"), pos.alias("positives"), (pos / F.count(F.lit(1))).alias("rate"), F.count_distinct(event).alias("events"), *[F.count(c).alias(f"known_{c}") for c in columns])
    if not status:
        return base
    by = df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status).cast("string"), F.lit("-")), "n")))).alias("status"))
    return F.broadcast(base).crossJoin(F.broadcast(by))  # one row each


def manifest_by_event(df: DataFrame, positive: Column, event: str, columns: Sequence[str]) -> DataFrame:
    """A row for each event: rows, positives, rate, known values of columns and their means."""
    pos = F.sum(F.when(positive, 1).otherwise(0))
    each = [a for c in columns for a in (F.count(c).alias(f"known_{c}"), F.avg(c).alias(f"mean_{c}"))]
    return df.groupBy(event).agg(F.count(F.lit(1)).alias("rows"), pos.alias("positives"), (pos / F.count(F.lit(1))).alias("rate"), *each)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of all contents, independent of files and partitions."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content"))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, rows, columns, schema."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(f"{c}:{t}" for c, t in df.dtypes)).alias("schema"))
        out = one if out is None else out.unionByName(one)
    return out


def catalog(spark: SparkSession, assets: dict[str, tuple[str, str | None]]) -> DataFrame:
    """A row for each asset, name -> (path of a Parquet table, CRS or None): status, rows, columns, bytes, files, crs, schema.

    Status is OK, EMPTY (no rows) or MISSING (nothing at the path); a missing asset has NULLs.
    Bytes and files come from the store's own listing, on any store that Spark reads.
    """
    out = None
    for name, (path, crs) in sorted(assets.items()):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(place):
            df, held = spark.read.parquet(path), store.getContentSummary(place)
            schema = ", ".join(f"{c}:{t}" for c, t in df.dtypes)
            rows = F.count(F.lit(1)).alias("rows")
            known = [F.lit(len(df.columns)).alias("columns"), F.lit(held.getLength()).cast("long").alias("bytes"), F.lit(held.getFileCount()).cast("long").alias("files"), F.lit(crs).cast("string").alias("crs"), F.lit(schema).alias("schema")]
            one = df.agg(rows).select(F.lit(name).alias("name"), F.when(F.col("rows") > 0, "OK").otherwise("EMPTY").alias("status"), "rows", *known)
        else:
            none = "cast(null as bigint) as rows, cast(null as int) as columns, cast(null as bigint) as bytes, cast(null as bigint) as files"
            one = spark.range(1).select(F.lit(name).alias("name"), F.lit("MISSING").alias("status"), *[F.expr(e) for e in none.split(", ")], F.lit(crs).cast("string").alias("crs"), F.lit(None).cast("string").alias("schema"))
        out = one if out is None else out.unionByName(one)
    return out


def pack_grid(cells: DataFrame, surveyed_m: float) -> DataFrame:
    """Cells as small integers: score 1..255 (0 no data), decimetres, 20 m steps near surveys."""
    code = F.greatest(F.lit(1), F.least(F.lit(255), F.bround(F.col("score") * 254, 0) + 1))
    near = F.col("dist_m") <= surveyed_m
    return cells.select(
        "row", "col",
        F.when(F.col("score").isNull(), 0).otherwise(code).cast("int").alias("score_u8"),
        F.when(F.col("z").isNotNull(), F.bround(F.bround("z", 1) * 10, 0)).otherwise(-32768).cast("int").alias("z_dm"),
        F.when(near, F.bround(F.col("dist_m") / 20, 0)).otherwise(65535).cast("int").alias("dist_20m"),
    )


def unpack_grid(packed: DataFrame) -> DataFrame:
    """Packed cells as score, metres and distance; sentinels are NULL."""
    return packed.select(
        "row", "col",
        F.when(F.col("score_u8") != 0, (F.col("score_u8") - 1) / 254).alias("score"),
        F.when(F.col("z_dm") != -32768, F.col("z_dm") / 10).alias("z"),
        F.when(F.col("dist_20m") != 65535, F.col("dist_20m") * 20.0).alias("dist_m"),
    )


def tiles(pixels: DataFrame, value: str) -> DataFrame:
    """(level, z, tx, ty, band): a 256 x 256 array in row order for each tile with any value above 0; of several values of a pixel the largest."""
    kept = pixels.where(F.col(value) > 0).groupBy("level", "z", "tx", "ty", "px", "py").agg(F.max(value).alias(value))
    at = (F.col("py") * 256 + F.col("px")).cast("int")
    # at most 65,536 entries a tile; sorted, each is preceded by the zeros since the last one
    put = kept.groupBy("level", "z", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct(at.alias("k"), F.col(value).cast("int").alias("v")))).alias("_e"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_e", i - 1)["k"])
    runs = F.transform("_e", lambda e, i: F.concat(F.array_repeat(F.lit(0), e["k"] - before(i) - 1), F.array(e["v"])))
    rest = F.array_repeat(F.lit(0), F.lit(65535) - F.element_at("_e", -1)["k"])
    return put.select("level", "z", "tx", "ty", F.concat(F.flatten(runs), rest).alias("band"))


def conform(df: DataFrame, schema: T.StructType, ident: str, kinds: dict[str, Sequence[str]], ranges: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``problems``); a differing set of fields is an error."""
    expected, found = set(schema.fieldNames()), set(df.columns)
    if expected != found:
        raise ValueError(f"fields differ: missing {sorted(expected - found)}, unknown {sorted(found - expected)}")
    twice = df.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(ident).alias("_twice"))
    marked = df.join(twice, F.col(ident) == F.col("_twice"), "left")
    problems = [F.when(F.col(ident).isNull(), f"{ident} missing"), F.when(F.col("_twice").isNotNull(), f"{ident} not unique")]
    problems += [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), f"{c} not allowed") for c, allowed in kinds.items()]
    problems += [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), f"{c} out of range") for c, (lo, hi) in ranges.items()]
    marked = marked.withColumn("problems", F.array_compact(F.array(*problems))).drop("_twice")
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def expect(df: DataFrame, rules: dict[str, tuple[Column, object]]) -> DataFrame:
    """(rule, value, expected, ok): aggregate expressions against what they should give."""
    row = df.agg(*[value.cast("string").alias(name) for name, (value, _) in rules.items()])
    entries = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("value"), F.lit(str(want)).alias("expected")) for n, (_, want) in rules.items()]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*").withColumn("ok", F.col("value").eqNullSafe(F.col("expected")))


def no_leak(df: DataFrame, leaks: Sequence[str], group: str) -> DataFrame:
    """``df`` without columns that tell the label, and without rows that lack a group."""
    return df.drop(*leaks).where(F.col(group).isNotNull())
