"""Verse texts in three JSON shapes: a map of books, lines, or an array of books. All give book, chapter, verse, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.refs import book_code
from tillage.functions.text import strip


def _kept(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", strip(F.col("text"))).filter((F.col("text") != "") & F.col("book").isNotNull() & F.col("chapter").isNotNull() & F.col("verse").isNotNull())


def from_map(documents: DataFrame, value: str = "value") -> DataFrame:
    """Rows of {book: {chapter: {verse: text}}}; what isn't a map, a number or a text is skipped."""
    books = documents.select(F.explode(F.from_json(value, "map<string,map<string,map<string,string>>>")).alias("book", "c"))
    chapters = books.select("book", F.explode("c").alias("chapter", "v"))
    verses = chapters.select("book", "chapter", F.explode("v").alias("verse", "text"))
    return _kept(verses.select(book_code(F.col("book")).alias("book"), F.expr("try_cast(chapter as int)").alias("chapter"), F.expr("try_cast(verse as int)").alias("verse"), "text"))


def from_array(documents: DataFrame, value: str = "value") -> DataFrame:
    """Rows of [{name|book|abbrev, chapters: [[text]]}], numbered from 1 by place."""
    shape = "array<struct<name:string,book:string,abbrev:string,chapters:array<array<string>>>>"
    books = documents.select(F.explode(F.from_json(value, shape)).alias("b"))
    chapters = books.select(F.coalesce("b.name", "b.book", "b.abbrev").alias("book"), F.posexplode("b.chapters").alias("chapter", "v"))
    verses = chapters.select("book", (F.col("chapter") + 1).alias("chapter"), F.posexplode("v").alias("verse", "text"))
    return _kept(verses.select(book_code(F.col("book")).alias("book"), "chapter", (F.col("verse") + 1).alias("verse"), "text"))


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines with book_id or book, chapter, verse, text and perhaps verse_end."""
    rows = spark.read.schema("book_id string, book string, chapter int, verse int, verse_end int, text string").json(path)
    return _kept(rows.select(F.coalesce("book_id", book_code(F.col("book"))).alias("book"), "chapter", "verse", "text", "verse_end"))


def find_source(spark: SparkSession, folder: str, configured: str | None = None) -> str | None:
    """The configured file if it is there, else the folder's first .json by name, else its first .jsonl, else None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if configured and path(configured).getFileSystem(conf).exists(path(configured)):
        return configured
    for ending in (".json", ".jsonl"):
        found = path(folder).getFileSystem(conf).globStatus(path(folder, "*" + ending)) or []
        names = sorted(f.getPath().toString() for f in found if f.isFile())
        if names:
            return names[0]
    return None


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """Whichever shape a file has: .jsonl holds lines; else a map or an array, told by its first character."""
    if path.endswith(".jsonl"):
        return from_lines(spark, path)
    whole = spark.read.option("wholetext", True).text(path)
    first = whole.select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first and first[0] == "{":
        return from_map(whole)
    if first and first[0] == "[":
        return from_array(whole)
    raise ValueError("neither a map nor an array of books")


def in_order(verses: DataFrame) -> DataFrame:
    from tillage.functions.refs import sort_key

    return verses.orderBy(sort_key(F.col("book")), "chapter", "verse")
