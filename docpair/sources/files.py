"""Files as tables: reading, checks, texts, rejects, dictionaries; and results as JSON."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import collapsed

TEXT_KINDS = ["txt", "md", "csv", ""]
#: How files of a kind begin.
SIGNATURES = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}


def read_files(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """name, length, content of the files under path; content is null beyond most_bytes. Spark leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def kind(name: Column) -> Column:
    """The lower-case extension; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def checked(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Adds kind and problem: empty, kind, size or signature, whichever comes first; null if there is none."""
    ext = kind(F.col("name"))
    begins = F.coalesce(*[F.when(ext == k, F.substring("content", 1, len(s)) == F.lit(s)) for k, s in SIGNATURES.items()], ~F.coalesce(*[F.substring("content", 1, len(s)) == F.lit(s) for s in SIGNATURES.values()]))
    problem = (
        F.when(F.coalesce("length", F.lit(0)) == 0, "empty").when(~ext.isin(*TEXT_KINDS, *SIGNATURES), "kind").when(F.col("length") > most_bytes, "size").when(~begins, "signature")
    )
    return files.withColumn("kind", ext).withColumn("problem", problem)


def clean_name(name: Column, most: int = 180) -> Column:
    """A file's name without folders, other characters than letters, digits, dots, signs of minus and underscores as one underscore; upload if nothing is left."""
    bare = F.regexp_replace(F.trim(F.element_at(F.split(name, r"[/\\\\]"), -1)), r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.coalesce(bare, F.lit("")).isin("", ".", ".."), "upload").otherwise(F.substring(bare, 1, most))


def pdf_problem(content: Column) -> Column:
    """structure for a PDF without an end mark or a page, encrypted for one with a dictionary of encryption; null if neither shows."""
    raw = F.decode(content, "ISO-8859-1")
    return F.when(~F.contains(F.substring(raw, -1024, 1024), F.lit("%%EOF")) | ~raw.rlike(r"/Type\s*/Pages?\b"), "structure").when(raw.rlike(r"/Encrypt\b"), "encrypted")


def decoded(content: Column) -> Column:
    """Text in UTF-8, else in Windows-1252, else, as five bytes have no meaning there, in ISO-8859-1."""
    latin = F.decode(content, "ISO-8859-1")
    own = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}  # what the two differ in
    unknown = latin.rlike("[" + "".join(f"\\x{b:02x}" for b, c in own.items() if not c) + "]")
    windows = F.translate(latin, "".join(chr(b) for b, c in own.items() if c), "".join(own.values()))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(~unknown, windows).otherwise(latin)


@F.pandas_udf(StringType())
def _document_xml(contents: pd.Series) -> pd.Series:
    """The XML of a DOCX file's body, header and footer; null for what is no such file."""

    def read(content: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                here = set(archive.namelist())
                return "\n".join(archive.read(p).decode("utf-8", "ignore") for p in ("word/document.xml", "word/header1.xml", "word/footer1.xml") if p in here)
        except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, OSError):
            return None

    return pd.Series([read(c) for c in contents], dtype=object)


def docx_text(content: Column) -> Column:
    """The text of a DOCX file: paragraphs, breaks and tabs are newlines, tags are blanks. Null for what is no such file."""
    lines = F.regexp_replace(_document_xml(content), r"<w:(?:br|cr|tab)\b[^>]*/?>|</w:p>", "\n")
    return F.regexp_replace(collapsed(F.regexp_replace(lines, r"<[^>]+>", " ")), r"^\s+|\s+$", "")


def texts(files: DataFrame, with_problems: bool = False) -> DataFrame:
    """name, text, method, n_pages of the files without a problem, by their kind; PDF files have no text here.

    Text files that are PDF inside go with those. n_pages of a DOCX file is estimated from its length. With problems, files
    that have one are kept, with a null text and the problem; so are DOCX files that can't be read (corrupt).
    """
    rows = checked(files)
    is_docx = F.col("kind") == "docx"
    # Python reads DOCX files only: they are told apart before
    plain = rows.where(~is_docx).select("name", F.when(F.col("problem").isNull() & F.col("kind").isin(TEXT_KINDS), decoded(F.col("content"))).alias("text"), F.when(F.col("kind").isin(TEXT_KINDS), "plain_text").otherwise(F.col("kind")).alias("method"), F.lit(1).alias("n_pages"), "problem")
    word = rows.where(is_docx).withColumn("text", F.when(F.col("problem").isNull(), docx_text(F.col("content"))))
    pages = F.greatest(F.lit(1), (F.char_length("text") / 3000).cast("int") + 1)
    corrupt = F.coalesce("problem", F.when(F.coalesce("text", F.lit("")) == "", "corrupt"))
    word = word.select("name", F.when(corrupt.isNull(), F.col("text")).alias("text"), F.lit("docx").alias("method"), pages.alias("n_pages"), corrupt.alias("problem"))
    both = plain.unionByName(word)
    return both if with_problems else both.where("problem is null and text is not null").drop("problem")


def parted_by_length(rows: DataFrame, least_chars: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows with enough text, and the others."""
    enough = F.char_length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars
    return rows.where(enough), rows.where(~enough)


def dictionary(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """category, canonical, alias from a JSON object of categories, each an object of canonical names and their lists of aliases.

    Where there is no file at path, the default is returned, if one is given.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if default is not None and not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return default
    shape = "map<string, map<string, array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    names = whole.select(F.explode("d").alias("category", "names")).select("category", F.explode("names").alias("canonical", "aliases"))
    return names.select("category", "canonical", F.explode_outer("aliases").alias("alias"))


def surfaces(entries: DataFrame, drop: list[str] = (), exact: list[str] = ()) -> DataFrame:
    """surface, canonical, category, policy of a dictionary's entries, for the operators on spans: names and aliases of 2 characters and
    more. Surfaces listed in drop never match, those in exact only with a capital; of equal surfaces the first canonical name stays."""
    rows = entries.select(F.explode(F.array_compact(F.array("canonical", "alias"))).alias("surface"), "canonical", "category").where(F.char_length(F.trim("surface")) >= 2)
    low = F.lower(F.trim("surface"))
    policy = F.when(low.isin(list(drop)), "drop").when(low.isin(list(exact)), "exact").otherwise("any")
    once = rows.withColumn("policy", policy).groupBy(low.alias("__key")).agg(F.min(F.struct("canonical", "surface", "category", "policy")).alias("x"))
    return once.select("x.surface", "x.canonical", "x.category", "x.policy")


def save_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Appends results, as Parquet or JSON."""
    results.write.mode("append").format(form).save(path)
