"""Pages of PDFs and images: text layers where there are any, recognition elsewhere.

Opening a file and recognising an image are plug-ins; which pages need recognition, the order of what is recognised, its
confidence and the repair of amounts are decided here, the latter three in columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T

# A page whose text layer is shorter than this, and that has an image, is recognised; longer sides are enlarged to this.
LAYER_CHARS, LONG_SIDE = 25, 2300

Box = tuple[float, float, float, str, float]  # middle y, left x, height, text, score
BOXES = "array<struct<y:double,x:double,height:double,text:string,score:double>>"


class Page(NamedTuple):
    """What a file backend gives for a page or frame; the image is whatever the engine takes."""

    text: str
    image: object = None


#: (format, bytes) → pages in order.
Backend = Callable[[str, bytes], Iterable[Page]]


class Engine:
    """A recognition engine that is loaded when it is first needed, once a worker.

    Its state is off (there is none), waiting, loaded, or failed (it couldn't be loaded, and isn't tried again).
    """

    def __init__(self, load: Callable[[], Callable[[object], list[Box]]] | None):
        self.load, self.run = load, None
        self.state = "off" if load is None else "waiting"

    def boxes(self, image: object) -> list[Box] | None:
        """The boxes of an image, none if recognition fails on it, None without an engine."""
        if self.state == "waiting":
            try:
                self.run, self.state = self.load(), "loaded"
            except Exception:  # the reason is the engine's own; pages are reported as unread
                self.state = "failed"
        if self.state != "loaded":
            return None
        try:
            return self.run(image)
        except Exception:  # one image must not end the file
            return []


def enlargement(width: int, height: int, least: int = LONG_SIDE) -> float:
    """The factor by which an image is enlarged before recognition; it is never reduced."""
    return max(1.0, least / max(1, width, height))


def read_pages(files: DataFrame, backend: Backend, load: Callable[[], Callable[[object], list[Box]]] | None, mode: str = "safe") -> DataFrame:
    """(doc_id, page_no, text, is_ocr, unread, confidence, repairs, unresolved) of (doc_id, format, content).

    unread: the page needs recognition, but there is no engine. A file that can't be opened has no pages.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = Engine(load)
        for part in parts:
            rows = []
            for doc, kind, data in zip(part["doc_id"], part["format"], part["content"], strict=True):
                try:
                    pages = list(backend(kind, bytes(data)))
                except Exception:
                    continue
                for n, page in enumerate(pages, 1):
                    needs = len(page.text.strip()) < LAYER_CHARS and page.image is not None
                    boxes = engine.boxes(page.image) if needs else None
                    found = [dict(zip(("y", "x", "height", "text", "score"), b)) for b in boxes or []]
                    rows.append((doc, n, page.text, needs and boxes is not None, needs and boxes is None, found))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "layer", "is_ocr", "unread", "boxes"])

    kind = files.schema["doc_id"].dataType.simpleString()
    pages = files.select("doc_id", "format", "content").mapInPandas(run, f"doc_id {kind}, page_no int, layer string, is_ocr boolean, unread boolean, boxes {BOXES}")
    read = pages.withColumn("r", T.reading_order(F.col("boxes"))).withColumn("a", K.repair(mode)(F.col("r.text")))
    own = F.col("is_ocr")
    return read.select(
        "doc_id", "page_no", F.when(own, F.col("a.text")).otherwise(F.col("layer")).alias("text"), "is_ocr", "unread", F.when(own, F.col("r.confidence")).alias("confidence"),
        F.when(own, F.col("a.fixed")).otherwise(0).alias("repairs"), F.when(own, F.col("a.unresolved")).otherwise(0).alias("unresolved"),
    )
