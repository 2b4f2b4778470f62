"""Places where a renderer or a recognition model is plugged in; neither is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.quality import with_quality
from pagewright.operators.pages import STRATEGIES, pick_attempt

#: (path, page number, dpi) -> encoded image
Renderer = Callable[[str, int, int], bytes]
#: (encoded image, mode) -> text
Recognizer = Callable[[bytes, str], str]


def render_pages(pages: DataFrame, renderer: Renderer) -> DataFrame:
    """Add ``image`` to ``pages(path, page_num, dpi, …)``; the renderer runs where the rows are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(image=[renderer(p, int(n), int(d)) for p, n, d in zip(f["path"], f["page_num"], f["dpi"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "image")
    return pages.drop("image").mapInPandas(run, fields + ", image binary")


def image_text(image: Column) -> Column:
    """An encoded image as base64 on one line, the way recognition servers take it."""
    return F.regexp_replace(F.base64(image), r"\s+", "")


def pdf_facts(files: DataFrame, reader: Callable[[bytes], dict]) -> DataFrame:
    """Add ``total_pages, pdf_title, pdf_author, pdf_creation_date, pdf_producer`` to ``files(content, …)`` as an injected reader tells them.

    ``reader`` takes the bytes of one file and gives any of these under ``total_pages, title, author, creation_date, producer``; what it
    leaves out is null, and so is all of a file it raises an error on, whose message goes to ``pdf_error``.
    """
    names = ("total_pages", "title", "author", "creation_date", "producer")

    def one(content: bytes) -> tuple:
        try:
            told = reader(bytes(content))
            return *(told.get(k) for k in names), None
        except Exception as e:  # any fault of a foreign reader concerns its file only
            return *(None for _ in names), str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = list(zip(*map(one, f["content"]))) or [()] * 6
            made = {"total_pages": pd.Series(told[0], dtype="Int32"), **{f"pdf_{k}": pd.Series(v, dtype=object) for k, v in zip(("title", "author", "creation_date", "producer", "error"), told[1:])}}
            yield pd.concat([f.drop(columns="content").reset_index(drop=True), pd.DataFrame(made)], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    return files.mapInPandas(run, kept + ", total_pages int, pdf_title string, pdf_author string, pdf_creation_date string, pdf_producer string, pdf_error string")


def recognize_pages(pages: DataFrame, recognizer: Recognizer, clean: Callable, keys: list[str], retries: int = 2) -> DataFrame:
    """Read every page, again in the next mode while the result fails or is empty, at most ``retries`` times more.

    ``pages`` has ``keys``, ``page_num`` and ``image``. Each round reads only the pages still open; what a round read is written before
    the next one looks at it, so a lost executor calls the model no second time.
    """
    from pagewright.sources.tables import settle

    done = None
    left = pages
    for attempt, mode in enumerate(STRATEGIES[: retries + 1], 1):

        def run(frames: Iterator[pd.DataFrame], mode=mode) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(raw_text=[recognizer(i, mode) for i in f["image"]])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
        read = left.mapInPandas(run, fields + ", raw_text string").drop("image")
        read = read.withColumns({"attempt": F.lit(attempt), "mode": F.lit(mode), "clean_text": clean(F.col("raw_text"))})
        read = settle(with_quality(read, "clean_text", "page_num"), "attempt")
        done = read if done is None else done.unionByName(read)
        left = left.join(read.filter("quality.status not in ('pass', 'warn')").select(*keys), keys, "left_semi")
    return pick_attempt(done.withColumn("__s", F.col("quality.status")), keys, "attempt", "__s").drop("__s")
