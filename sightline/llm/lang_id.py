"""Language of a text by compression (operator 1).

Each learned language has a raw-content Zstandard dictionary of up to DICTIONARY_BYTES, cut from a bounded
sample of labelled documents; all dictionaries together stay within ALL_BYTES, so many languages get
smaller ones. The sample takes pieces spread over a text, not its beginning. A text is lower-cased and reduced to letters and single spaces, cut into
pieces of PIECE_BYTES, and every piece is compressed with each dictionary; the language with the
smallest total wins. Pieces keep the dictionary decisive in long texts. A result whose margin over the
runner-up is at most NARROW (relative) is marked as rejected.

Defined results: null text, or text without a letter, is `und` with score 0, rejected. With one learned
language the score is 1 for every text with letters; with none all is `und`. Ties go to the language
first in alphabetical order and are rejected. Rows with null or repeated doc_id are each judged; rows
with null doc_id or null lang teach nothing. Other columns are not read, and the filter keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of

#: Bounds of the training sample: documents per language, pieces of a text, characters of a piece, letters of a text.
SAMPLE_DOCUMENTS, SAMPLE_PIECES, PIECE_CHARS, SAMPLE_CHARS = 400, 4, 400, 1000
DICTIONARY_BYTES, ALL_BYTES, PIECE_BYTES = 256 << 10, 8 << 20, 1024
NARROW = 0.001
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> str:
    """Lower-case words of letters with single spaces between."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Greedy matching from four bytes on, tuned to short pieces."""
    settings = zstandard.ZstdCompressionParameters.from_level(
        5,
        source_size=PIECE_BYTES,
        dict_size=DICTIONARY_BYTES,
        strategy=zstandard.STRATEGY_GREEDY,
        min_match=4,
        search_log=3,
        hash_log=18,
        chain_log=18,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


def sizes(text: bytes, compressors: dict[str, zstandard.ZstdCompressor]) -> list[tuple[int, str]]:
    """(compressed bytes, language), smallest first."""
    pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
    return sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in compressors.items())


def judge(text: str | None, compressors: dict[str, zstandard.ZstdCompressor], narrow: float) -> tuple[str, float, bool]:
    """(language, margin from 0 to 1, rejected)."""
    body = letters(text).encode() if text else b""
    if not body or not compressors:
        return UNKNOWN, 0.0, True
    order = sizes(body, compressors)
    if len(order) == 1:
        return order[0][1], 1.0, False
    margin = 1 - order[0][0] / order[1][0]
    return order[0][1], margin, margin <= narrow


def _pieces(text: Column) -> Column:
    """Pieces of a text at even distances, the first at its beginning, the last at its end."""
    room = F.greatest(F.length(text) - PIECE_CHARS, F.lit(0))
    starts = [(F.floor(room * i / (SAMPLE_PIECES - 1)) + 1).cast("int") for i in range(SAMPLE_PIECES)]
    spread = F.concat_ws(" ", *[F.substring(text, s, F.lit(PIECE_CHARS)) for s in starts])
    return F.when(room <= PIECE_CHARS * (SAMPLE_PIECES - 1), text).otherwise(spread)


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """labelled (doc_id, text, lang) → a dictionary for each language, from the documents with the smallest hashes."""
    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    names = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one short row a language
    size = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(names)))
    documents = min(SAMPLE_DOCUMENTS, max(1, SAMPLE_DOCUMENTS * size // DICTIONARY_BYTES))
    keyed = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    # about three times the documents needed pass by their hash, so few rows are ranked however many there are
    few = F.lit(False)
    for row in names:
        share = min(1.0, 3 * documents / row["count"] + 20 / row["count"])
        few = few | ((F.col("lang") == row.lang) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
    keyed = keyed.where(few)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = keyed.distinct().withColumn("place", place).where(F.col("place") <= documents).select("lang", "doc_id", "h")
    # One text of a repeated doc_id: at most SAMPLE_DOCUMENTS rows a language, ALL_BYTES in all but for short ones.
    rows = (
        known.join(F.broadcast(chosen), ["lang", "doc_id"])
        .groupBy("lang", "doc_id", "h")
        .agg(F.min(_pieces(F.col("text"))).alias("text"))
        .collect()
    )
    taken: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        taken.setdefault(row.lang, []).append(letters(row.text)[:SAMPLE_CHARS])
    joined = {name: " ".join(parts).encode()[:size] for name, parts in taken.items()}
    return {name: content for name, content in joined.items() if len(content) >= 8}


def classify(text: Column, dictionaries: dict[str, bytes], narrow: float = NARROW) -> Column:
    """A struct of lang, score and rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = {name: compressor(content) for name, content in dictionaries.items()}
        for batch in batches:
            rows = [judge(t, compressors, narrow) for t in batch]
            yield pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return judged(text)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) → doc_id, held_out, lang_pred, score, rejected; learns from rows that are not held out."""
    rest = F.pmod(crc32_of("doc_id"), F.lit(4))
    dictionaries = fit(docs.select("doc_id", "text", "lang").where(rest != 2))
    judged = docs.select(
        "doc_id",
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        classify(F.col("text"), dictionaries).alias("found"),
    )
    return judged.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is clear, with all their columns."""
    found = "__found_language"
    rest = F.pmod(crc32_of("doc_id"), F.lit(4))
    dictionaries = fit(docs.select("doc_id", "text", "lang").where(rest != 2))
    return docs.withColumn(found, classify(F.col("text"), dictionaries)).where(f"not {found}.rejected").drop(found)
