"""Parameter files, alignment and matrix tables, study exports and the manifest log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys of an acquisition's parameter file and the fields they give.
FIELDS = {
    "Pixel size at object /um": "pixel", "Tilt angle": "angle", "Exposure time /ms": "exposure_ms", "Step size /um": "step", "um per galvo DU": "galvo",
    "Galvo DUs per step": "units", "Planes per volume": "planes", "Number of Time Points": "time_points", "Pixel size /um": "camera_pitch",
    "System magnification": "magnification", "Effective detection NA": "na", "Refractive index": "refractive_index", "Emission wavelength /nm": "wavelength_nm",
    "Frame period /ms": "period_ms",
}
MATRIX = "source string, reference boolean, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double"


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """``path, n, line`` of small text files, read whole so that lines keep their numbers (from 0)."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\r?\\n")).alias("n", "line"))


def parameters(lines: DataFrame) -> DataFrame:
    """One row per file (path, n, line; n numbers the lines) with a text column for each known key.

    The last line of a key counts, of a number's key the last one with a number.
    """
    key = F.trim(F.regexp_replace(F.split_part("line", F.lit(":"), F.lit(1)), "\ufeff", ""))
    split = lines.filter(F.instr("line", ":") > 0).select("path", "n", key.alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    last = lambda wanted: F.max_by("value", F.when(wanted, F.col("n")))
    numbers = [last((F.col("key") == k) & F.col("value").try_cast("double").isNotNull()).alias(f) for k, f in FIELDS.items()]
    texts = [last(F.col("key") == k).alias(f) for k, f in {"Interval": "interval", "Camera ROI X0, X1, Y0, Y1": "roi"}.items()]
    return split.groupBy("path").agg(*numbers, *texts)


def strict_geometry(params: DataFrame) -> DataFrame:
    """Sampling in nanometres, angle, seconds and ROI size; files without the needed keys, or with NaN for one, are left out."""
    number = lambda c: F.col(c).try_cast("double")
    roi = F.split("roi", " +")
    edge = lambda i: F.try_element_at(roi, F.lit(i)).try_cast("double")
    from lamella.functions.names import interval_seconds

    out = params.select(
        "path", (number("pixel") * 1e3).alias("pixel_nm"), (number("galvo") * number("units") * 1e3).alias("step_nm"), number("angle").alias("angle"),
        interval_seconds(F.col("interval")).alias("interval_s"), F.abs(edge(2) - edge(1)).alias("width"), F.abs(edge(4) - edge(3)).alias("height"),
    )
    return out.filter(" AND ".join(f"{k} IS NOT NULL AND NOT isnan({k})" for k in ("pixel_nm", "step_nm", "angle")))


def tolerant_geometry(params: DataFrame) -> DataFrame:
    """Finite positive fields only, with warnings; the galvo product overrides an explicit step."""

    def good(c):
        v = F.col(c).try_cast("double")
        limit = F.lit(89.9) if c == "angle" else F.lit(float("inf"))
        return F.when((v > 0) & ~F.isnan(v) & (v < limit), v)

    bad = lambda c, text: F.when(F.col(c).isNotNull() & good(c).isNull(), F.lit(text))
    product = good("galvo") * good("units")
    planes = good("planes")
    whole = F.when((planes == F.floor(planes)) & (planes >= 2), planes.cast("int"))
    warnings = F.array_compact(F.array(
        bad("pixel", "Invalid Pixel size at object /um"), bad("angle", "Invalid Tilt angle"), bad("step", "Invalid Step size /um"), bad("exposure_ms", "Invalid Exposure time /ms"),
        bad("na", "Invalid Effective detection NA"), bad("refractive_index", "Invalid Refractive index"), bad("wavelength_nm", "Invalid Emission wavelength /nm"), bad("period_ms", "Invalid Frame period /ms"),
        F.when(good("step").isNotNull() & product.isNotNull() & (F.abs(good("step") - product) > 1e-6), "Galvo product overrides the conflicting explicit step"),
        F.when(F.col("planes").isNotNull() & whole.isNull(), "Invalid plane count"),
    ))
    return params.select(
        "path", F.coalesce(good("pixel"), good("camera_pitch") / good("magnification")).alias("pixel"), good("angle").alias("angle"),
        F.coalesce(product, good("step")).alias("step"), whole.alias("planes"), good("time_points").cast("int").alias("time_points"),
        *[good(k).alias(k) for k in ("exposure_ms", "na", "refractive_index", "wavelength_nm", "period_ms")], warnings.alias("warnings"),
    )


def with_parameters(files: DataFrame, params: DataFrame) -> DataFrame:
    """Files with the parameters of their own folder, else of the folder above."""
    up = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    fields = [c for c in params.columns if c != "path"]
    here = params.select(up("path").alias("_here"), *[F.col(c).alias(f"h_{c}") for c in fields])
    above = params.select(up("path").alias("_above"), *[F.col(c).alias(f"a_{c}") for c in fields])
    placed = files.withColumn("_here", up("path")).withColumn("_above", up("_here"))
    joined = placed.join(here, "_here", "left").join(above, "_above", "left")
    return joined.select(*files.columns, *[F.coalesce(f"h_{c}", f"a_{c}").alias(c) for c in fields])


def alignments(lines: DataFrame) -> DataFrame:
    """Alignment sets of lines (path, n, line; n numbers them): ``reference,<key>``, ``source,<key>,6 numbers``, or a bare 2x3 (two lines of three, in their order)."""
    parts = lines.withColumn("p", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    reference = parts.filter("p[0] = 'reference'").groupBy("path").agg(F.max_by("p", "n")[1].alias("ref"))
    numbers = [F.try_element_at("p", F.lit(i + 3)).try_cast("double").alias(k) for i, k in enumerate(("m00", "m01", "m02", "m10", "m11", "m12"))]
    tagged = parts.filter("p[0] = 'source'").select("path", F.col("p")[1].alias("source"), *numbers)
    bare = parts.filter("size(p) = 3 AND try_cast(p[0] AS double) IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", F.transform("p", lambda x: x.try_cast("double")).alias("row")))).alias("r"))
    bare = bare.withColumn("r", F.col("r.row"))
    plain = bare.filter("size(r) = 2").select("path", F.lit(None).cast("string").alias("source"), *[F.col("r")[i // 3][i % 3].alias(k) for i, k in enumerate(("m00", "m01", "m02", "m10", "m11", "m12"))])
    return tagged.unionByName(plain).join(reference, "path", "left").withColumn("is_reference", F.coalesce(F.col("source") == F.col("ref"), F.lit(False))).drop("ref")


def write_alignments(table: DataFrame, path: str) -> None:
    numbers = ["m00", "m01", "m02", "m10", "m11", "m12"]
    line = F.when(F.col("source").isNotNull(), F.concat_ws(",", F.lit("source"), "source", *[F.col(k).cast("string") for k in numbers]))
    table.select(line.alias("value")).filter("value IS NOT NULL").write.mode("overwrite").text(path)


def write_matrix(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", False).csv(path)


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    return spark.read.schema(", ".join(f"c{i} double" for i in range(columns))).csv(path)


def export_study(rows: DataFrame, folder: str) -> None:
    """Scores as CSV and as JSON in which undefined values are null."""
    clean = rows.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
    clean.write.mode("overwrite").option("header", True).csv(f"{folder}/rows.csv")
    clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{folder}/rows.json")


LOG = "path string, size long, modified long, status string, format string, seq long"


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").option("sep", "\t").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; corrupt lines are dropped."""
    return spark.read.schema(LOG).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)
