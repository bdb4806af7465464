"""Readers and writers: receiver logs, track CSV, tracker GPX, photo CSV, map-way JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions import clock, nmea

FIX = "utc string, lat double, lon double, sog_kn double, cog_deg double, quality int, sats int, hdop double"
#: What XML text has to escape, the ampersand first.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
WAYS = "elements array<struct<id:bigint,type:string,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"


def read_logs(spark: SparkSession, folder: str, pattern: str = "GPS_*.log") -> DataFrame:
    """(file, pos, line) of every line; pos orders the lines of a file. Large files are read in splits."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.log$", 1).alias("file"), at.alias("pos"), F.btrim(F.col("value"), F.lit(" \t\r\n\x0b\f")).alias("line"))


def write_tracks(fixes: DataFrame, path: str, folders: bool = False) -> None:
    """CSV with a header: 6, 6, 2, 1 and 1 decimals, an empty field for no course, the track's name (URL-encoded) last.

    Tracks share files, each sorted by track and time, so the number of files follows from the number of points; a track is in one file, or in
    a few where it is large. An empty name is read as null. With ``folders`` each track has a folder of its own instead, which suits some hundreds of tracks.
    """
    text = {"lat": 6, "lon": 6, "sog_kn": 2, "cog_deg": 1, "hdop": 1}
    cols = [nmea.fixed(F.col(c), text[c]).alias(c) if c in text else F.col(c) for c in ("lat", "lon", "sog_kn", "cog_deg", "quality", "sats", "hdop")]
    out = fixes.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), *cols, F.url_encode("track").alias("track"))
    # Rows of a track meet before writing.
    write = out.hint("rebalance", F.col("track")).sortWithinPartitions("track", "utc").write.mode("overwrite").option("header", True)
    (write.partitionBy("track") if folders else write).csv(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tracks`` wrote, in either layout."""
    rows = spark.read.schema(f"{FIX}, track string").option("header", True).csv(path)
    return rows.select(F.url_decode("track").alias("track"), clock.iso(F.col("utc")).alias("ts"), "lat", "lon", "sog_kn", "cog_deg", "quality", "sats", "hdop")


def write_gpx(fixes: DataFrame, path: str, piece: int = 10_000, per_file: int = 50_000) -> None:
    """GPX files of (track, t_s, ts, lat, lon): about ``per_file`` points each, a track as many trk of its name as hold ``piece`` points each.

    The number of files follows from the number of points, not of tracks.
    """
    point = F.format_string('<trkpt lat="%s" lon="%s"><ele>1</ele><time>%s</time></trkpt>', nmea.fixed(F.col("lat"), 6), nmea.fixed(F.col("lon"), 6), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    place = F.row_number().over(Window.partitionBy("track").orderBy("t_s"))
    rows = fixes.select("track", "t_s", point.alias("x"), F.floor((place - 1) / piece).alias("piece_n"))
    trk = rows.groupBy("track", "piece_n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_s", "x"))), lambda v: v["x"]), "").alias("x"))
    # Characters that XML gives a meaning are escaped, those that it has no place for replaced; a null track has no name.
    name = F.regexp_replace(F.col("track").cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "\ufffd")
    for plain, escaped in ENTITIES.items():
        name = F.replace(name, F.lit(plain), F.lit(escaped))
    name = F.coalesce(F.concat(F.lit("<name>"), name, F.lit("</name>")), F.lit(""))
    files = fixes.count() // per_file + 1
    body = trk.select(F.pmod(F.xxhash64("track", "piece_n"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("part"), F.concat(F.lit("<trk>"), name, F.lit("<trkseg>"), "x", F.lit("</trkseg></trk>")).alias("value"))
    ends = fixes.sparkSession.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("<gpx>").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("</gpx>").alias("value")))).alias("e"))
    both = body.unionByName(ends.select("file", "e.*"))
    both.repartitionById(files, "file").sortWithinPartitions("file", "part").select("value").write.text(path)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(session, ts, lat, lon, ele) of every track point that has a time, at any depth of its track; session is the track's name.

    A file is read in splits of bytes, whatever the length of its tracks: a record is what follows one ``<trkpt`` up to
    the next, so it holds one point and, behind its end, the names of tracks that begin before the next one. A point
    takes the last name before it: within its split by a window, and from earlier splits of its file by one row a split.
    A track without a name has a null session. Text inside comments is read like any other.
    """
    rows = spark.read.option("lineSep", "<trkpt").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    is_point = F.col("value").rlike(r"^\s+[^>]*\blat\s*=")
    inside = F.substring_index("value", "</trkpt>", 1)
    behind = F.when(is_point, F.substr("value", F.length(inside) + 1)).otherwise(F.col("value"))
    begun = F.when(behind.rlike(r"<trk[\s>]"), F.substring_index(F.regexp_replace(behind, r"(?s)^.*<trk(?=[\s>])", ""), "</trk>", 1))
    name = F.nullif(F.regexp_extract(begun, r"(?s)<name>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</name>", 1), F.lit(""))
    for plain, escaped in reversed(ENTITIES.items()):
        name = F.replace(name, F.lit(escaped), F.lit(plain))
    found = lambda pattern: F.regexp_extract(inside, pattern, 1)
    number = lambda text: F.btrim(text).try_cast("double")
    rows = rows.select(
        "file", "block", "row", is_point.alias("point"), F.when(begun.isNotNull(), F.struct(name.alias("name"))).alias("named"),
        number(found(r"""^\s[^>]*?\blat\s*=\s*["']([^"']*)""")).alias("lat"), number(found(r"""^\s[^>]*?\blon\s*=\s*["']([^"']*)""")).alias("lon"),
        number(found(r"<ele>([^<]*)</ele>")).alias("ele"), F.btrim(found(r"<time>([^<]*)</time>"), F.lit(" \t\r\n")).alias("time"),
    )
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.last("named", True).over(before))
    ends = rows.groupBy("file", "block").agg(F.max_by("named", F.when(F.col("named").isNotNull(), F.col("row"))).alias("last"))
    earlier = ends.select("file", "block", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    points = rows.filter("point and time != ''").join(earlier, ["file", "block"])
    return points.select(F.coalesce("own", "carried")["name"].alias("session"), clock.iso(F.col("time")).alias("ts"), "lat", "lon", "ele")


def read_photos(spark: SparkSession, path: str, below: float = 30.0) -> DataFrame:
    """(name, ts, lat, lon) of photos with a position south of ``below`` and a time."""
    rows = spark.read.schema("name string, when string, lat string, lon string").option("header", True).csv(path)
    rows = rows.select("name", F.col("when").alias("taken"), F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))
    return rows.filter((F.col("lat") < below) & (F.col("taken") != "")).select("name", "taken", clock.from_exif(F.col("taken")).alias("ts"), "lat", "lon")


def read_ways(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(way_id, tags, points array<struct<lat,lon>>) of the elements with two points or more.

    ``multi_line``: a file is one document; else each line is one, and files are read in splits.
    """
    e = spark.read.option("multiLine", multi_line).schema(WAYS).json(path).select(F.explode("elements").alias("e"))
    return e.filter(F.size("e.geometry") >= 2).select(F.col("e.id").alias("way_id"), F.col("e.tags").alias("tags"), F.col("e.geometry").alias("points"))
