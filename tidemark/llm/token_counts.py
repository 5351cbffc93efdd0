"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A chunk is encoded with the offsets of its tokens. Two chunks that overlap are spliced at a stable common boundary: a
character after an ASCII blank at which both encodings begin a token, with no token of either across the blank. The
splitter of the vocabulary never joins text across a blank and merges each word alone, so the tokens on either side
of such a place are those of the whole text. The last such place in the overlap is taken. Where the overlap has none,
it is doubled until a search finds a blank there. A chunk without a blank reaches to the next one, and a rest without
any is counted in one piece, without offsets: so the time is in proportion to the text, and the offsets held are those
of a chunk or of the longest stretch between two blanks.

A text of one chunk or less needs no splicing: its tokens are counted in one piece. That is most texts of a usual
corpus; what the chunks bound is the memory that the offsets of a huge text take.

Edge cases: null and empty texts have no bytes and no tokens; texts of any length are counted whole; rows that share a
doc_id, equal ones too, and rows with a null doc_id stay separate rows; an empty table gives no rows; other columns,
of whatever name, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import LETTERS, Encoder, encoder

CHUNK, OVERLAP = 32_768, 512
BLANK = re.compile(rf"(?<=[ \t\n\r])[0-9{LETTERS}]")
#: The longest special string is shorter than this; a cut inside one is then within the overlap.
Starts = tuple[np.ndarray, np.ndarray]


def chunk_tokens(enc: Encoder, text: str) -> Starts:
    """First and last character offsets of each token of text."""
    if enc.plain(text):
        low = text.lower() if enc.lower else text
        spans = [(m.start(), m.end(), len(enc.words[m.group()]) // 4) for m in enc.pattern.finditer(low)]
        a, b, n = np.array(spans, dtype=np.int64).reshape(-1, 3).T
        return np.repeat(a, n), np.repeat(b, n)
    offsets = np.array(enc.library.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
    return offsets[:, 0], offsets[:, 1]


def count_spliced(text: str, tokens: Callable[[str], Starts], count: Callable[[str], int], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text. `tokens` sees a chunk and its overlap at a time; `count` takes a text, or the rest
    of one behind a proven boundary, in which there is no blank to splice at."""

    def blank(low: int, high: int) -> bool:
        return BLANK.search(text, low, high) is not None

    def piece_end(begin: int, end: int) -> int:
        """A place from end on (the text's own at most) such that there is a blank between begin and it, if there is any."""
        if end >= len(text) or blank(begin + 1, end):
            return min(end, len(text))
        after = BLANK.search(text, end)
        return min(len(text), after.start() + overlap) if after else len(text)

    total, begin, end = 0, 0, piece_end(0, chunk)
    if end == len(text) > chunk:
        return count(text)
    first, last = tokens(text[begin:end])
    while end < len(text):
        # Behind the last blank there may be much: then only the boundary is proven with offsets.
        ends_plain = len(text) - end > chunk and not blank(end, len(text))
        stop = min(len(text), end + overlap) if ends_plain else piece_end(end, end + chunk)
        width, cut = overlap, None
        while cut is None and width < 2 * (end - begin):
            start = max(begin, end - width)
            if blank(start + 1, end):  # a search costs little, an encoding much
                next_first, next_last = tokens(text[start:stop])
                cut = common_boundary(text, begin, first, last, start, next_first, next_last, end)
            width *= 2
        if cut is None:  # no boundary in the whole piece: one of twice its length
            end = piece_end(end, end + max(chunk, end - begin))
            if end == len(text):
                return total + count(text[begin:])
            first, last = tokens(text[begin:end])
            continue
        total += int((first < cut - begin).sum())
        if ends_plain:
            return total + count(text[cut:])
        keep = next_first >= cut - start
        begin, end, first, last = cut, stop, next_first[keep] - (cut - start), next_last[keep] - (cut - start)
    return total + len(first)


def common_boundary(text: str, begin: int, first: np.ndarray, last: np.ndarray, start: int, next_first: np.ndarray, next_last: np.ndarray, end: int) -> int | None:
    """The last place before end, after a blank, where both encodings begin a token and none lies across."""
    a, b = first + begin, next_first + start
    both = np.intersect1d(a, b)
    for cut in both[::-1].tolist():
        if not start < cut < end:
            continue
        if BLANK.match(text, cut) and not ((a < cut) & (last + begin > cut)).any() and not ((b < cut) & (next_last + start > cut)).any():
            return cut
    return None


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        size = lambda t: len(enc.ids(t)) // 4
        for batch in batches:
            n = [size(t) if len(t or "") <= chunk else count_spliced(t, lambda x: chunk_tokens(enc, x), size, chunk, overlap) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
