"""Text, date, number and key cleaning as column expressions.

Missing is always NULL: never an empty string, a sentinel or NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cause words of drainage failures and of rivers leaving their bed.
INLAND_WORDS = ("내수", "배수", "하수", "역류", "저지대", "내부침수")
RIVER_WORDS = ("범람", "제방", "월류", "외수")

# Province codes after the reorganisations, and those that older surveys carry.
PROVINCE_FORMER = {"12": ("29", "46"), "51": ("42",), "52": ("45",)}

MAX_DEPTH_CM = 1500


def digits_padded(c: Column, width: int) -> Column:
    """Trimmed text; all-digit text of up to ``width`` characters is zero-padded to it."""
    t = F.trim(c)
    return F.when(F.rlike(t, F.lit(rf"^\d{{1,{width}}}$")), F.lpad(t, width, "0")).otherwise(t)


def norm_ymd(c: Column) -> Column:
    return digits_padded(c, 8)


def norm_hhmm(c: Column) -> Column:
    return digits_padded(c, 4)


def number(c: Column, default: float | None = None) -> Column:
    """A number from text with thousands commas; blank or unreadable gives ``default``."""
    value = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def null_if(c: Column, condition: Column) -> Column:
    return F.when(condition, None).otherwise(c)


def gauge_mm(c: Column, live: bool = False) -> Column:
    """Gauge rain: -90 and below are codes in the archive, any negative is one live."""
    return null_if(c, (c < 0) if live else (c <= -90))


def soil_class(c: Column) -> Column:
    """Soil layers use 0 and 999 or more for no data."""
    return null_if(c, (c == 0) | (c >= 999))


def year_of(c: Column, low: int = 1800, high: int = 2100) -> Column:
    """First four digits of a date written in any way, if a plausible year."""
    digits = F.regexp_replace(c, r"\D", "")
    year = F.when(F.length(digits) >= 4, F.substring(digits, 1, 4).cast("int"))
    return F.when(year.between(low, high), year)


def flood_year(start: Column, year: Column) -> Column:
    """Year of a flood: of its start date, else its year field, from 1900 to 2100."""
    return F.coalesce(year_of(start, 1900, 2100), F.when(year.between(1900, 2100), year.cast("int")))


def event_id(c: Column) -> Column:
    """YYYYMMDD of the first 20YY-MM-DD (also / or .) in a text."""
    pattern = r"(20\d\d)[-/.](\d\d)[-/.](\d\d)"
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat(*parts))


def dms(c: Column) -> Column:
    """Degrees of "126-57-24"; malformed text gives NULL."""
    pattern = r"^\s*(\d+)-(\d+)-(\d+(?:\.\d+)?)\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i).cast("double")
    return F.when(F.rlike(c, F.lit(pattern)), part(1) + part(2) / 60 + part(3) / 3600)


def mechanism(c: Column, inland: Sequence[str] = INLAND_WORDS, river: Sequence[str] = RIVER_WORDS) -> Column:
    """Cause of a flood by its description: inland, river, both or empty; never guessed."""
    has = lambda words: F.rlike(F.coalesce(c, F.lit("")), F.lit("|".join(words)))
    return F.when(has(inland) & has(river), "both").when(has(inland), "inland").when(has(river), "river").otherwise("")


def drop_river(df: DataFrame, cause: str, river: Sequence[str] = RIVER_WORDS) -> DataFrame:
    return df.where(~F.rlike(F.coalesce(F.col(cause), F.lit("")), F.lit("|".join(river))))


def depth_cm(c: Column) -> Column:
    """Whole centimetres; readings of 0 or less, or over 1500, are dropped, not clipped."""
    return F.when((c > 0) & (c <= MAX_DEPTH_CM), F.bround(c, 0).cast("int"))


def in_box(lon: Column, lat: Column, west: float = 124.0, south: float = 33.0, east: float = 132.0, north: float = 39.0) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def land_only(df: DataFrame, elevation: str, required: Sequence[str] = ()) -> DataFrame:
    """Rows with a finite elevation above 0 and finite required columns."""
    keep = df.where((F.col(elevation) > 0) & ~F.isnan(elevation) & (F.col(elevation) < float("inf")))
    for name in required:
        keep = keep.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    return keep


def former_codes(df: DataFrame, code: str, former: Mapping[str, Sequence[str]] = PROVINCE_FORMER) -> DataFrame:
    """A row for each code that older surveys use for ``code``, as flood_code."""
    table = F.create_map(*[x for k, v in former.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return df.withColumn("flood_code", F.explode(F.coalesce(F.try_element_at(table, F.col(code)), F.array(F.col(code)))))


def pnu(sigungu: Column, dong: Column, land: Column, bun: Column, ji: Column) -> Column:
    """Parcel key of 19 digits; land flag 0 is written 1, and 1 is written 2."""
    flag = F.when(land == "0", "1").when(land == "1", "2").otherwise(land)
    pad = lambda c, n: F.lpad(c, n, "0")
    return F.concat(pad(sigungu, 5), pad(dong, 5), flag, pad(bun, 4), pad(ji, 4))


def pnu_parts(c: Column) -> Column:
    cut = lambda at, n: F.substring(c, at, n)
    land = F.when(cut(11, 1) == "1", "0").when(cut(11, 1) == "2", "1").otherwise(cut(11, 1))
    return F.struct(
        cut(1, 5).alias("sigungu"), cut(6, 5).alias("dong"), land.alias("land"), cut(12, 4).alias("bun"), cut(16, 4).alias("ji")
    )


def entity_id(*cols: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the trimmed columns, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(c, F.lit(""))) for c in cols]), 256), 1, 20)


def region_from(address: Column, agency: Column, regions: Sequence[str]) -> Column:
    """First of ``regions`` found in the address, else in the agency's name; else NULL."""
    pattern = "(" + "|".join(regions) + ")"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))
    return F.coalesce(found(address), found(agency))


def parking_seed(df: DataFrame, regions: Sequence[str], province: str, address: str = "address", agency: str = "agency", key: Sequence[str] = ("name", "address")) -> DataFrame:
    """Rows of one province with region, stable id and a quality flag, in order of region and id."""
    region = region_from(F.col(address), F.col(agency), regions)
    return (
        df.where(F.contains(F.coalesce(F.col(address), F.lit("")), F.lit(province)) | F.contains(F.coalesce(F.col(agency), F.lit("")), F.lit(province)))
        .withColumn("region", region)
        .withColumn("seed_id", entity_id(*[F.col(k) for k in key]))
        .withColumn("quality", F.when(F.col("region").isNull(), "REGION_UNKNOWN").when(F.contains(F.coalesce(F.col(address), F.lit("")), F.col("region")), "ADDRESS").otherwise("AGENCY"))
        .orderBy(F.col("region").asc_nulls_last(), "seed_id")
    )


def translated(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``column`` looked up in a dimension ``table`` (key, value); unmapped values pass through."""
    return (
        df.join(table.select(F.col("key").alias("_key"), F.col("value").alias("_value")), F.col(column) == F.col("_key"), "left")
        .withColumn(column, F.coalesce("_value", column))
        .drop("_key", "_value")
    )


# Column letters of the 100 km reference squares, from the origin.
GID_LETTERS = "가나다라마바사아자차카타파하"


def gid_to_km(c: Column, letters: str = GID_LETTERS) -> Column:
    """Kilometre offsets (x, y) of a 1 km reference code: two letters and two digits for each axis."""
    letter = lambda at: F.instr(F.lit(letters), F.substring(c, at, 1)) - 1
    x = F.when(letter(1) >= 0, letter(1) * 100 + F.substring(c, 3, 2).try_cast("int"))
    y = F.when(letter(2) >= 0, letter(2) * 100 + F.substring(c, 5, 2).try_cast("int"))
    return F.struct(x.alias("x_km"), y.alias("y_km"))


def clock24(c: Column) -> Column:
    """Timestamp of a YYYYMMDDHH key with hours 01 to 24: midnight is the day before's hour 24."""
    day = F.to_timestamp(F.substring(c, 1, 8), "yyyyMMdd")
    return day + F.make_interval(hours=F.substring(c, 9, 2).cast("int"))


def first_source(sources: Column) -> Column:
    """First element of an array of source structs; NULL of an empty one."""
    return F.try_element_at(sources, F.lit(1))


def existed_at_flood(approved: Column, first: Column, last: Column) -> Column:
    """Did a building exist at its covering floods: NO, PARTIAL, YES, or UNKNOWN."""
    unknown = approved.isNull() | first.isNull() | last.isNull()
    return F.when(unknown, "UNKNOWN").when(approved > last, "NO").when(approved > first, "PARTIAL").otherwise("YES")


def parking_status(confirmed: Column, underground: Column, indoor: Column, floors_collected: Column) -> Column:
    """Evidence of basement parking, strongest first."""
    below, spaces = F.coalesce(underground, F.lit(0)) > 0, F.coalesce(indoor, F.lit(0)) > 0
    return (
        F.when(F.coalesce(confirmed, F.lit(False)), "CONFIRMED_BASEMENT_PARKING_USE")
        .when(below & spaces & F.coalesce(floors_collected, F.lit(False)), "PROBABLE_NOT_CONFIRMED_IN_FLOOR_ROWS")
        .when(below & spaces, "PROBABLE_FLOOR_DETAIL_NOT_COLLECTED")
        .when(below, "UNDERGROUND_FLOOR_ONLY")
        .otherwise("GIS_BASEMENT_CANDIDATE_NOT_CONFIRMED_BY_TITLE")
    )


def parking_flag(kind: Column, classes: Sequence[str]) -> Column:
    """1 if an open-map class is a parking class, 0 if another, NULL if unknown."""
    return F.when(kind.isNull(), None).when(kind.isin(*classes), 1).otherwise(0)


def has_terms(query: str, *cols: Column) -> Column:
    """Every term of a query is a substring of the lower-cased columns taken together."""
    text = F.lower(F.concat_ws(" ", *cols))
    hit = F.lit(True)
    for term in query.lower().split():
        hit = hit & F.contains(text, F.lit(term))
    return hit
