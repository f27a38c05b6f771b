"""Language by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content zstandard dictionary is filled with pieces of a bounded, hashed
sample of its labelled documents. A text, in lower case, is compressed in blocks with every
dictionary; the smallest total wins. The score is high if the runner-up is clearly larger, and a
narrow margin is marked as rejected.

A null text, and one without letters, is ``und`` with score 0. Without any labelled document all
are ``und``. Ties go to the first language in order of code points. Repeated rows get equal
results. Extra columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

PIECES = 64             # sampled documents of a language
PIECE = 2048            # code points that a sampled document gives, from a hashed place
LEVEL = 9
BLOCK = 8192            # bytes compressed at a time, so long texts don't outgrow the dictionary
SCALE = 25.0            # how fast the score rises with the margin
NARROW = 0.01           # margins below are rejected
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(key: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the id falls into the fold that nothing is learned from; a null id is not held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def dictionaries(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", pieces: int = PIECES, piece: int = PIECE) -> dict[str, bytes]:
    """Dictionary contents by language, from the first ``pieces`` documents of each in the order of their hashes.

    Ids are ranked first and only the chosen documents' pieces are read: the driver gets at most
    ``pieces * piece`` characters a language.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64(key, F.lit(7))
    ids = known.select(F.col(lang).alias("l"), F.col(key).alias("k"), place.alias("h")).withColumn(
        "r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))).filter(F.col("r") <= pieces)
    start = (F.pmod(place, F.greatest(F.lit(1), F.char_length("text") - piece + 1)) + 1).cast("int")
    rows = known.join(F.broadcast(ids), (F.col(lang) == F.col("l")) & (F.col(key) == F.col("k"))).select(
        "l", "h", F.lower(F.substring("text", start, F.lit(piece))).alias("text")).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["text"])):
        out.setdefault(r["l"], []).append(r["text"])
    return {k: "\n".join(v).encode() for k, v in out.items()}


@lru_cache(maxsize=4)
def _compressors(contents: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, data in contents:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(data), source_size=4096, write_content_size=False)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify(text: str | None, contents: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """``(language, score, rejected)``."""
    if not text or not contents or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = text.lower().encode()
    sizes = [(sum(len(c.compress(data[i:i + BLOCK])) for i in range(0, len(data), BLOCK)), name) for name, c in _compressors(contents)]
    best, *others = sorted(sizes)
    if not others:
        return best[1], 1.0, False
    margin = 1 - best[0] / others[0][0]
    return best[1], 1 - math.exp(-SCALE * margin), margin < NARROW


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def languages(text: str | Column, contents: dict[str, bytes]) -> Column:
    fixed = tuple(sorted(contents.items()))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(RESULT.names, classify(t, fixed))) for t in texts.to_pylist()], RESULT)

    return arrow_udf(run, "struct<lang_pred:string,score:double,rejected:boolean>")(text)


def identify(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; nothing but the text is an input, and nothing is shuffled."""
    kept = [c for c in docs.columns if c not in RESULT.names]
    return docs.select(*kept, languages("text", contents).alias("_lang")).select(*kept, "_lang.*")
