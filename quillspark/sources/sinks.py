"""Writers of images and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import media


def image_rows(items: DataFrame) -> DataFrame:
    """items: doc, index, extension, data. ``doc``, ``file`` (BIN0001.png), ``mime``, ``data``."""
    return items.select("doc", media.item_name("index", "extension").alias("file"), media.mime_of_extension("extension").alias("mime"), "data")


def write_images(items: DataFrame, target: str) -> None:
    """Images as Parquet rows of doc, file, mime, data, by document: one table instead of millions of small files; the same call
    again replaces it. ``export_images`` makes files of it where they are needed."""
    image_rows(items).write.mode("overwrite").parquet(target)


def export_images(items: DataFrame, folder: str) -> int:
    """Writes each image as ``folder/<hash of doc>/<file>`` through the file system of the cluster's storage; the same names are
    overwritten, so a task that runs again changes nothing. Returns how many were written."""
    spark = items.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = image_rows(items).withColumn("folder", F.substring(F.md5("doc"), 1, 12))
    n = 0
    for row in rows.toLocalIterator(prefetchPartitions=True):  # one image at a time
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['folder']}/{row['file']}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row["data"] or b""))
        out.close()
        n += 1
    return n


def preview_rows(previews: DataFrame) -> DataFrame:
    """previews: streams.preview_images(). ``doc``, ``file`` (preview.bmp, .gif or .bin by format), ``data``."""
    ending = F.when(F.col("format") == "BMP", "bmp").when(F.col("format") == "GIF", "gif").otherwise("bin")
    return previews.select("doc", F.concat(F.lit("preview."), ending).alias("file"), F.unbase64("image").alias("data"))


def write_previews(previews: DataFrame, target: str) -> None:
    """Preview images as Parquet rows of doc, file, data, in the tasks that read them; the same call again replaces them."""
    preview_rows(previews).write.mode("overwrite").parquet(target)


def write_texts(texts: DataFrame, column: str, target: str) -> None:
    """One text a document, as a Parquet table of doc and text."""
    texts.select("doc", F.col(column).alias("text")).write.mode("overwrite").parquet(target)


def header_json(headers: DataFrame, pretty: bool = False) -> Column:
    """The file header as JSON."""
    from quillspark.functions import bits, numbers

    body = F.struct(
        F.lit("HWP Document File").alias("signature"), numbers.version("version").alias("version"), bits.flag_names("document_flags", bits.DOCUMENT_FLAGS).alias("document_flags"),
        bits.flag_names("license_flags", bits.LICENSE_FLAGS).alias("license_flags"), F.col("encrypt_version").alias("encrypt_version"), F.col("kogl_country").alias("kogl_country"),
    )
    return F.to_json(body, {"pretty": "true"} if pretty else {})
