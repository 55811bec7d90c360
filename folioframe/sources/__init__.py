"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import document_name
from folioframe.operators.pages import explode_pages
from folioframe.schema import OCR_DOCUMENT

# The files that hold pages.
PAGE_FILES = "*.{pdf,png,jpg,jpeg,bmp,tif,tiff,PDF,PNG,JPG,JPEG,BMP,TIF,TIFF}"


def read_files(spark: SparkSession, path: str, pattern: str = PAGE_FILES) -> DataFrame:
    """Every file below path that matches: doc_id (its name), path, length, content. The content is read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(document_name(F.col("path")).alias("doc_id"), "path", "length", "content")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of nested OCR documents, one JSON file each; the schema is given, so nothing is inferred."""
    docs = spark.read.schema(OCR_DOCUMENT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return explode_pages(docs.withColumn("path", F.col("_metadata.file_path")), document_name(F.col("path")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, text: Column, path: str, key: str = "doc_id", mode: str = "overwrite") -> None:
    """Texts in a folder for each key, as markdown or plain text are kept."""
    df.select(F.col(key), text.alias("value")).write.mode(mode).partitionBy(key).text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below path, decoded by the JVM (JPEG, PNG, BMP, GIF): doc_id (the file's name), page 1 and image
    (height, width, nChannels, data in the order BGR); null for files that are no images."""
    files = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    image = F.when(F.col("image.height") > 0, F.struct(*(F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data"))))
    return files.select(document_name(F.col("image.origin")).alias("doc_id"), F.lit(1).alias("page"), image.alias("image"))


def tiff_files(pages: DataFrame, dpi: int = 300, packing: str = "deflate") -> DataFrame:
    """(doc_id, page, image) to one multi-page TIFF file a document (packing deflate or lzw): doc_id, n_pages, content. Null images are left out, as
    are documents without any. A document's pages meet in one task."""

    def run(pdf):
        import pandas as pd

        from folioframe import images

        kept = pdf[pdf["image"].notna()].sort_values("page", kind="stable")
        rows = [(pdf["doc_id"].iloc[0], len(kept), images.tiff([images.decode(i) for i in kept["image"]], dpi, packing))] if len(kept) else []
        return pd.DataFrame(rows, columns=["doc_id", "n_pages", "content"])

    return pages.select("doc_id", "page", "image").groupBy("doc_id").applyInPandas(run, "doc_id string, n_pages int, content binary")


def rasterize(files: DataFrame, dpi: int = 216) -> DataFrame:
    """One row per page of read_files(): doc_id, page, image (as read_images gives it) and error. A file that can't be
    read gives one row with its error and no page. Needs pdf2image and Pillow on the executors."""
    import pandas as pd

    def pages_of(content):
        from pdf2image import convert_from_bytes

        try:
            for n, page in enumerate(convert_from_bytes(content, dpi=dpi), 1):
                yield n, page, None
        except Exception as e:  # noqa: BLE001  a bad file concerns only its row
            yield None, None, f"{type(e).__name__}: {e}"

    def run(frames):
        import numpy as np

        for pdf in frames:
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                for n, page, error in pages_of(content):
                    image = None
                    if page is not None:
                        bgr = np.asarray(page.convert("RGB"))[:, :, ::-1]
                        image = {"height": bgr.shape[0], "width": bgr.shape[1], "nChannels": 3, "data": bgr.tobytes()}
                    yield pd.DataFrame({"doc_id": [doc], "page": pd.array([n], "Int32"), "image": [image], "error": [error]})

    schema = "doc_id string, page int, image struct<height:int,width:int,nChannels:int,data:binary>, error string"
    return files.select("doc_id", "content").mapInPandas(run, schema)
