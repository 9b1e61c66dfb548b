"""What the text operators share: words, batches of bytes, held-out rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(key: Column) -> Column:
    """True for the fifth of all rows that no model may learn labels from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def byte_texts(texts: pa.Array):
    """The UTF-8 bytes of each text, null as empty, one at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    for value in texts.cast(kind):
        yield value.as_py() or b""


def code_points(text: str) -> np.ndarray:
    """Code points of a text; surrogates, which no valid text holds, become '?'."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
