"""Operator 5: language identification by compression.

For every learned language a zstandard raw-content dictionary is filled with
its training texts.  A text belongs to the language whose dictionary makes it
smallest; where the two smallest sizes are nearly equal the text is rejected.
Texts are compressed in pieces of ``PIECE_BYTES`` so that a long text cannot
become its own dictionary; every piece of the whole text counts.

Training data are bounded: of each language the rows with the smallest hash of
doc_id, whole texts of at most ``TEXT_BYTES``, until they have ``DICT_BYTES`` or
are ``TRAIN_ROWS``.  Longer texts are not learned from, so that what the driver
holds of a language is bounded too; they are told like all others.  A language
with fewer texts has a smaller dictionary and changes no other one.

Defined results: text that is null, empty or without a letter is ``und`` with
score 0 and rejected; ties go to the language first in the alphabet, with
score 0; rows come back one for one; with no training row everything is
``und``.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.llm.blocks import text_blocks
from episodeframe.llm.shared import bounded_batches, narrow

TRAIN_ROWS, DICT_BYTES, PIECE_BYTES = 150, 128 << 10, 2048
TEXT_BYTES = 64 << 10
#: rejected where (second - best) / second is below this
MARGIN = 0.004
#: at lower levels the matcher misses short matches, which carry the signal
LEVEL = 6


def learn_dictionaries(rows: DataFrame, train_rows: int = TRAIN_ROWS, dict_bytes: int = DICT_BYTES, text_bytes: int = TEXT_BYTES) -> dict[str, bytes]:
    """Language -> dictionary content from (doc_id, text, lang) training rows."""
    usable = rows.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, text_bytes))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = usable.select("lang", "doc_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= train_rows).select("lang", "doc_id").collect()
    if not picked:
        return {}
    # A bounded list: train_rows for each language.
    ids = sorted({r["doc_id"] for r in picked if r["doc_id"] is not None})
    texts = usable.where(F.col("doc_id").isin(ids)).select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect()
    out: dict[str, bytearray] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"])):
        held = out.setdefault(r["lang"], bytearray())
        # About the same amount for all: a larger dictionary would win for its size alone.
        if len(held) < dict_bytes:
            held.extend(r["text"].lower().encode("utf-8") + b"\n")
    return {lang: bytes(b) for lang, b in sorted(out.items())}


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.coders = [self._coder(dictionaries[x]) for x in self.langs]

    @staticmethod
    def _coder(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, raw: bytes) -> tuple[str, float, float]:
        """(language, score, margin)"""
        text = raw.decode("utf-8")
        if not self.langs or not _has_letter(text):
            return "und", 0.0, 0.0
        raw = text.lower().encode("utf-8")
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.langs[best], min(1.0, margin / (margin + 0.05) * 1.05) if margin > 0 else 0.0, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        judge = Classifier(dictionaries)
        for block in text_blocks(batches):
            found = [judge(raw) for raw in block.docs()]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[0] == "und" or x[2] < margin for x in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not rejected."""

    def run(batches):
        judge = Classifier(dictionaries)
        for block in text_blocks(batches, text_col):
            found = [judge(raw) for raw in block.docs()]
            keep = pa.array([x[0] != "und" and x[2] >= margin for x in found], pa.bool_())
            yield block.batch.slice(block.first, block.last - block.first).filter(keep)

    return bounded_batches(docs).mapInArrow(run, docs.schema)
