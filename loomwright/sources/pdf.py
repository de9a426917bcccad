"""A Spark data source that reads the positioned text of PDF files, a partition for each range of pages.

It needs PyMuPDF on the executors; without it spark.read.format("pdf_spans") fails with a plain message.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, ord long, x double, y double, x1 double, text string, font string, size double"


def _library():
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("the pdf_spans source needs PyMuPDF, which is not installed") from missing
    return fitz


class Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("pagesPerPartition", "16"))

    def partitions(self):
        with _library().open(self.path) as doc:
            n = doc.page_count
        return [Pages(self.path, i, min(n, i + self.step)) for i in range(0, n, self.step)]

    def read(self, partition: Pages):
        with _library().open(partition.path) as doc:
            for number in range(partition.first, partition.last):
                order = 0
                for block in doc[number].get_text("dict")["blocks"]:
                    for line in block.get("lines", []) if block.get("type") == 0 else []:
                        for span in line["spans"]:
                            text = span["text"].replace("\t", " ")
                            if text.strip():
                                x, y, x1, _ = span["bbox"]
                                yield number + 1, order, float(x), float(y), float(x1), text, span["font"], float(span["size"])
                                order += 1


class PdfSpans(DataSource):
    """spark.dataSource.register(PdfSpans); spark.read.format("pdf_spans").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)
