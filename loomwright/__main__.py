"""python -m loomwright -i FOLDER [-o FOLDER]: a wiki from a book's extracted pages (toc, book_pages, spans, shapes and icons as
Parquet), or search documents of a folder's pages.parquet, as Parquet and JSON."""

from __future__ import annotations

import argparse
import os

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomwright import build as wiki
from loomwright.functions import text as T
from loomwright.operators import search
from loomwright.sources import tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomwright")
    parser.add_argument("-i", "--input", default=os.getcwd(), help="folder with a book's tables or pages.parquet")
    parser.add_argument("-o", "--output", help="folder for the index; INPUT/index if not given")
    out = parser.parse_args(argv)
    out.output = out.output or os.path.join(out.input, "index")
    return out


def build(spark, source: str, target: str) -> int:
    """Writes the search documents; the number of them."""
    pages = tables.table(spark, source, "pages").withColumn("title", T.title_of("html"))
    docs = search.search_documents(pages, "page_id", "title", "html")
    docs.write.mode("overwrite").parquet(f"{target}/search_docs")
    written = spark.read.parquet(f"{target}/search_docs")
    tables.write_search_index(written, f"{target}/search_index")
    return written.count()


def read_book(spark, source: str) -> wiki.Book | None:
    """The tables of a book; None if the folder has no spans."""
    try:
        spans = tables.table(spark, source, "spans")
    except AnalysisException:
        return None
    toc, pages = tables.toc(tables.table(spark, source, "toc")), tables.table(spark, source, "book_pages")
    return wiki.Book("book2", toc, pages, spans, tables.table(spark, source, "shapes"), tables.table(spark, source, "icons"), pages.agg(F.max("page")).first()[0])


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    given = arguments(argv)
    spark = SparkSession.builder.appName("loomwright").getOrCreate()
    book = read_book(spark, given.input)
    if book:
        print(wiki.write(wiki.build(book, os.path.join(given.output, "work")), given.output))
    else:
        print(f"{build(spark, given.input, given.output)} search documents in {given.output}")


if __name__ == "__main__":
    main()
