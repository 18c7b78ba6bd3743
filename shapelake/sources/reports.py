"""Specimen naming, banking, and the text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelake.sources.csv_blocks import EfdCsv


def name_specimens(images: DataFrame) -> DataFrame:
    """image_id and specimen_name: a trimmed name where there is one, else ``Specimen`` and the place by seq.

    Numbering is by range: each range's offset comes from counts, so that no
    task sees all images.
    """
    # A place is the number of rows before the range, and the place inside it.
    df = images.withColumn("_r", F.floor(F.col("seq") / 100_000))
    sizes = df.groupBy("_r").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(sizes.select("_r", before.alias("before")), "_r")
    place = F.col("before") + F.row_number().over(Window.partitionBy("_r").orderBy("seq", "image_id"))
    own = F.trim("name")
    return df.select("image_id", F.coalesce(F.when(own != "", own), F.concat(F.lit("Specimen "), place)).alias("specimen_name"))


def bank_specimens(efd: DataFrame, names: DataFrame) -> DataFrame:
    """Descriptors with their specimen's name, for specimens with at least one harmonic."""
    return efd.join(names, efd["outline_id"] == names["image_id"]).drop("image_id")


def quoted(text: Column) -> Column:
    """A CSV field, quoted where it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def efd_csv_lines(banked: DataFrame) -> DataFrame:
    """outline_id, line_no, line: name, header, one line a harmonic, and a blank line, block by block."""
    key = banked.groupBy("outline_id", "specimen_name").agg(F.max("harmonic").alias("h"))
    fixed = F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), quoted(F.col("specimen_name")).alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("harmonic,a,b,c,d").alias("line")),
        F.struct((F.col("h") + 2).alias("line_no"), F.lit("").alias("line")),
    ))
    detail = banked.select("outline_id", (F.col("harmonic") + 1).alias("line_no"), F.concat_ws(",", "harmonic", "a", "b", "c", "d").alias("line"))
    return key.select("outline_id", fixed.alias("f")).select("outline_id", "f.line_no", "f.line").unionByName(detail)


def write_efd_csv(lines: DataFrame, path: str, files: int | None = None) -> None:
    """The lines of ``efd_csv_lines`` as text files in order, with a blank line between blocks and none after the last.

    Blocks are dealt by ranges, into so many files at most, and stay whole, so
    that no task holds all lines.
    """
    lines.sparkSession.dataSource.register(EfdCsv)
    last = lines.agg(F.max("outline_id")).first()[0]
    keep = lines.where((F.col("outline_id") != F.lit(last)) | (F.col("line") != "")) if last is not None else lines
    dealt = keep.repartitionByRange(files, "outline_id") if files else keep.repartitionByRange("outline_id")
    ordered = dealt.sortWithinPartitions("outline_id", "line_no")
    ordered.select("line").write.format("efd_csv").mode("overwrite").save(path)


def read_efd_csv(spark: SparkSession, path: str) -> DataFrame:
    """specimen_name, harmonic, a, b, c, d of files that ``write_efd_csv`` wrote."""
    spark.dataSource.register(EfdCsv)
    return spark.read.format("efd_csv").load(path)


def metadata_summary(metrics: DataFrame, efd: DataFrame) -> DataFrame:
    """outline_id and report: labelled metrics, then a line for each harmonic."""
    rows = efd.groupBy("outline_id").agg(F.sort_array(F.collect_list(F.struct("harmonic", "a", "b", "c", "d"))).alias("e"))  # 100 harmonics at most
    line = lambda k: F.format_string("%d: %.4f %.4f %.4f %.4f", k["harmonic"], k["a"], k["b"], k["c"], k["d"])
    head = F.format_string(
        "Perimeter: %.2f\nArea: %.2f\nAspect ratio: %.2f\nPerimeter/area: %.4f\nCircularity: %.4f\nTurning: %.4f, mean %.4f, variance %.4f",
        "perimeter", "area", "aspect_ratio", "perimeter_area_ratio", "circularity", "sum_turning", "mean_turning", "var_turning",
    )
    df = metrics.join(rows, "outline_id")
    return df.select("outline_id", F.concat_ws("\n", head, F.array_join(F.transform("e", line), "\n")).alias("report"))
