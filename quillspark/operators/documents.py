"""Whole documents: from a folder of files to paragraphs, texts and Markdown, whatever their container."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import bits, media, numbers
from quillspark.functions import text as T
from quillspark.operators import render
from quillspark.plans import sequence
from quillspark.sources import compound, package, records, summary


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def formats(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("doc"), media.sniff("content").alias("format"))


def headers(files: DataFrame) -> DataFrame:
    """The file headers alone: of a compound file no other stream is put together. ``status`` says whether the rest can be read: ``plain``,
    ``encrypted`` or ``distribution``."""
    status = F.when(bits.has_bit("document_flags", 1), "encrypted").when(bits.has_bit("document_flags", 2), "distribution").otherwise("plain")
    return records.file_headers(compound.streams(files, "FileHeader")).withColumn("status", status)


def summaries(files: DataFrame) -> DataFrame:
    """The summaries alone, likewise."""
    return summary.summaries(compound.streams(files, ".*SummaryInformation"))


def errors(files: DataFrame) -> DataFrame:
    """doc, ``name`` (of a stream or an entry, else null), ``error`` of all that could not be read: files of unknown format, broken
    containers, sections that do not inflate, entries that are damaged."""
    unknown = files.where(media.sniff("content") == "unknown").select(F.col("path").alias("doc"), F.lit(None).cast("string").alias("name"), F.lit("unknown format").alias("error"))
    rows = compound.streams(files, "DocInfo|(Root Entry/)?BodyText/Section[0-9]+")
    bad = compound.inflated(rows).where("error is not null").select("doc", "name", "error")
    return unknown.union(bad).union(package.entries(files).where("error is not null").select("doc", "name", "error"))


def text_of_runs(runs: F.Column) -> F.Column:
    """Cleaned text of a paragraph: runs of text, and the characters that stand for controls, without breaks."""
    shown = F.transform(runs, lambda r: F.when(r["kind"] == "text", r["text"]).when(r["code"].isin(9, 24, 30, 31), T.control_text(r["code"])).otherwise(F.lit("")))
    return F.array_join(shown, "")


def binary_paragraphs(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc, section, seq, text, top of the paragraphs of compound documents, in record order; sections beyond the number that a document
    says it has don't count. Containers are read once for the texts and once for that number."""
    areas = records.area_counts(records.records(compound.inflated(compound.streams(files, "DocInfo"))))
    body = compound.streams(files, "(Root Entry/)?BodyText/Section[0-9]+")
    framed = records.tree(records.records(records.sections(body, areas)))
    # a text's own level says whether its paragraph is at the top: one below the header's
    top = framed.where("tag = 67").withColumn("top", F.col("level") <= 1)
    texts = records.typed(top.withColumn("section", F.regexp_extract("stream", "([0-9]+)$", 1).cast("int")), "para_text")
    return texts.where("error is null").select("doc", "section", "seq", text_of_runs(F.col("runs")).alias("text"), "top")


def package_paragraphs(files: DataFrame) -> DataFrame:
    nodes = package.nodes(package.sections(package.entries(files)))
    return nodes.where("kind in ('paragraph', 'caption')").select("doc", "section", F.col("ord").cast("long").alias("seq"), "text", F.lit(True).alias("top"))


def paragraphs(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Paragraphs of both containers; files of unknown format give none."""
    return binary_paragraphs(spark, files).unionByName(package_paragraphs(files))


def plain_texts(spark: SparkSession, files: DataFrame, deep: bool = False) -> DataFrame:
    """doc, ``text``: paragraphs of the body, one a line; with ``deep`` also those of cells, boxes and notes."""
    rows = paragraphs(spark, files)
    rows = (rows if deep else rows.where("top")).withColumn("o", F.struct("section", "seq"))
    return render.plain_text(rows, "doc", "o", "text")


def markdowns(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc, ``markdown`` of the body's paragraphs in the Markdown shell with the version."""
    versions = headers(files).select("doc", "version").union(package.header_version(package.entries(files)))
    rows = paragraphs(spark, files).where("top").where(T.meaningful("text"))
    rows = rows.select("doc", F.lit("body").alias("part"), F.struct("section", "seq").alias("ord"), T.trim("text").alias("line")).join(versions, "doc")
    return render.markdown(rows, "doc", version=numbers.version("version", padded=True))


def section_counts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc, ``sections``."""
    body = records.sections(compound.streams(files)).select("doc", "section")
    packed = package.sections(package.entries(files)).select("doc", "section")
    return body.union(packed).groupBy("doc").agg(F.count_distinct("section").alias("sections"))


def numbered_notes(controls: DataFrame, start: int = 1) -> DataFrame:
    """controls: doc, seq, kind. Adds the numbers of notes of each kind in document order."""
    return sequence.numbered(controls, ["doc", "kind"], "seq", "number", start)
