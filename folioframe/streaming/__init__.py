"""Streaming extraction: pages arrive in any order, windows are extracted in page order and merged."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioframe.operators.merge import Fold, complete
from folioframe.schema import EXTRACTION

Extractor = Callable[[str], str]
RESULT = "n_pages int, skipped int, result string"
#: A document as land_documents() writes it and documents_stream() reads it.
DOCUMENT = "doc_id string, pages array<struct<page:int,text:string>>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_text(texts: list[str]) -> str:
    return "\n".join(t for t in texts if t and t.strip())


class Reading:
    """How far a document has been read: pages taken, windows skipped, the last `overlap` texts, and what has been merged."""

    def __init__(self, extract: Extractor, overlap: int, taken: int = 0, skipped: int = 0, recent: list[str] | None = None, merged: Callable[[], dict | None] = lambda: None):
        self.extract, self.overlap, self.taken, self.skipped, self.recent = extract, overlap, taken, skipped, recent or []
        self._merged, self._fold = merged, None

    @property
    def fold(self) -> Fold:
        """Read from the state when it is first needed."""
        if self._fold is None:
            self._fold = Fold(self._merged())
        return self._fold

    def take(self, text: str) -> None:
        """The next page's text: its window is extracted and merged. A blank window isn't; one that fails is skipped."""
        window = window_text([*self.recent, text])
        if window.strip():
            try:
                self.fold.add(complete(json.loads(self.extract(window)), EXTRACTION))
            except Exception:  # noqa: BLE001  whatever the extractor raised
                self.skipped += 1
        self.recent = [*self.recent, text][-self.overlap :] if self.overlap else []
        self.taken += 1

    def row(self) -> dict:
        return {"n_pages": self.taken, "skipped": self.skipped, "result": json.dumps(self.fold.result(), ensure_ascii=False)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for state and results; one of our own only where it names none, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="folioframe-")


class DocumentReader(StatefulProcessor):
    """One document's pages, in whatever order they come.

    State: where the reading is (a few numbers), the pages that came early (a map, one entry a page), the last texts, and
    the merged record. A page that isn't next touches its own map entry only, so a document costs time in proportion to
    its pages. The record is read and written when pages are taken, once a trigger."""

    def __init__(self, extract: Extractor, overlap: int = 1, patience: int | None = None):
        self._extract, self._overlap, self._patience = extract, overlap, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._place = handle.getValueState("place", "next int, last int, taken int, skipped int, early int")
        self._record = handle.getValueState("record", "merged string")
        self._recent = handle.getListState("recent", "text string")
        self._early = handle.getMapState("early", "page int", "text string")
        # ended documents are remembered for as long as their pages may be repeated
        self._ended = handle.getValueState("ended", "n_pages int", self._patience) if self._patience else None

    def _load(self) -> Reading:
        self._next, self._last, taken, skipped, self._n_early = self._place.get() if self._place.exists() else (1, None, 0, 0, 0)
        recent = [r[0] for r in self._recent.get()] if taken and self._overlap else []
        return Reading(self._extract, self._overlap, taken, skipped, recent, lambda: json.loads(self._record.get()[0]) if self._record.exists() else None)

    def _save(self, at: Reading, before: int) -> None:
        self._place.update((self._next, self._last, at.taken, at.skipped, self._n_early))
        if at.taken > before:
            if self._overlap:
                self._recent.put([(t,) for t in at.recent])
            if at.fold.merged is not None:
                self._record.update((json.dumps(at.fold.merged, ensure_ascii=False),))

    def _end(self, key: tuple, at: Reading) -> Iterator[pd.DataFrame]:
        for state in (self._place, self._record, self._recent, self._early):
            state.clear()
        self._reset_timer(None)
        if self._ended is not None:
            self._ended.update((at.taken,))
        yield pd.DataFrame([{"doc_id": key[0], **at.row()}])

    def _reset_timer(self, timers) -> None:
        if self._patience:
            for (at,) in [(t,) if isinstance(t, int) else tuple(t) for t in self._handle.listTimers()]:
                self._handle.deleteTimer(at)
            if timers is not None:
                self._handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self._patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self._ended is not None and self._ended.exists():
            for _ in rows:
                pass  # pages of a document that has been given out
            return
        at = self._load()
        before = at.taken
        for pdf in rows:
            came: dict[int, str] = {}
            for page, text, last in zip(pdf["page"], pdf["text"], pdf["is_last"], strict=True):
                if page >= self._next:
                    came.setdefault(int(page), text or "")
                if last:
                    self._last = int(page)
            for page in sorted(came):
                if page == self._next:
                    at.take(came[page])
                    self._next += 1
                    self._catch_up(at)
                elif page > self._next and not self._early.containsKey((page,)):
                    self._early.updateValue((page,), (came[page],))
                    self._n_early += 1
        if self._last is not None and self._next > self._last:
            yield from self._end(key, at)
        else:
            self._save(at, before)
            self._reset_timer(timerValues)

    def _catch_up(self, at: Reading) -> None:
        """Takes the early pages that follow now."""
        while self._n_early and self._early.containsKey((self._next,)):
            at.take(self._early.getValue((self._next,))[0])
            self._early.removeKey((self._next,))
            self._n_early -= 1
            self._next += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Pages that never came are given up: those that did are taken in their order."""
        if not self._place.exists():
            return
        at = self._load()
        for page in sorted(k[0] for k in self._early.keys()):
            at.take(self._early.getValue((page,))[0])
        yield from self._end(key, at)

    def close(self) -> None:
        pass


def extract_stream(pages: DataFrame, extract: Extractor, overlap: int = 1, patience: int | None = None) -> DataFrame:
    """(doc_id, n_pages, skipped, result JSON) of each document in a stream of (doc_id string, page int, text, is_last).

    A document is done when the page marked is_last and all before it have come; its state then goes. Repeated pages
    count once. A blank page still moves the window on. With patience (milliseconds), a document that no page reaches
    for so long is given out as extract_batch would do it, with the pages that came, and pages that are repeated
    within that time after the end are known and left out; without, it waits on, and a page repeated after the end opens it anew.
    Patience needs a trigger that goes on: Spark never ends an availableNow run whose states may time out.
    State lies in RocksDB, which the session is told to use for its streams."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "None" if patience is None else "ProcessingTime"
    return pages.groupBy("doc_id").transformWithStateInPandas(DocumentReader(extract, overlap, patience), f"doc_id string, {RESULT}", "append", mode)


def land_documents(pages: DataFrame, path: str) -> None:
    """Writes pages (doc_id, page, text) as whole documents, one a line: what a scanner puts down for the stream to find. Of a repeated page the least text stays."""
    own = pages.where("page is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(F.min("text").alias("text"))
    whole = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    whole.write.option("ignoreNullFields", "false").json(path)


def documents_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The documents that are put down in a folder, as they come: files of DOCUMENT lines, at most per_trigger files at once."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", per_trigger).json(path)


def pages_of(documents: DataFrame) -> DataFrame:
    """The pages of documents (doc_id, pages), batch or stream, in their order: doc_id, page, text, is_last. A document itself tells where it ends; one without pages has none."""
    pages = documents.select("doc_id", F.posexplode("pages").alias("at", "held"), F.size("pages").alias("n"))
    return pages.select("doc_id", (F.col("at") + 1).alias("page"), F.col("held.text").alias("text"), (F.col("at") + 1 == F.col("n")).alias("is_last"))


def extract_batch(pages: DataFrame, extract: Extractor, overlap: int = 1) -> DataFrame:
    """The same over a table of pages (doc_id, page, text); where page numbers run from 1 without gaps the result equals the stream's. Across a gap this goes on, while the stream waits."""
    kind = dict(pages.dtypes)["doc_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = Reading(extract, overlap)
        for text in pdf.sort_values("page").drop_duplicates("page")["text"]:
            at.take(text or "")
        return pd.DataFrame([{"doc_id": pdf["doc_id"].iloc[0], **at.row()}])

    return pages.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, {RESULT}")


def stub_extractor(window: str) -> str:
    """Deterministic: the first words as a person's name, the number of lines as an offence."""
    words = window.split()
    entity = {"thong_tin_ket_an": {"ten_toi_danh": [f"lines {window.count(chr(10)) + 1}"]}, "bi_cao_vn": {"ho_va_ten": " ".join(words[:2]) or None}}
    return json.dumps({"thong_tin_chung": {"ghi_chu": words[-1] if words else None}, "danh_sach_doi_tuong": [entity]}, ensure_ascii=False)
