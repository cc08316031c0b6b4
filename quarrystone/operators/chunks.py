"""Chunking as Column folds: a document's pieces are packed inside its row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..tables import let

CHUNK_SIZE, OVERLAP, MIN_SIZE = 700, 150, 80
_STATE = "struct<open:int,starts:array<int>>"


def _none() -> Column:
    return F.array().cast("array<string>")


def _filled(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def lines(text: Column) -> Column:
    return _filled(F.split(text, "\n"))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines and before headings marked with hash signs."""
    return _filled(F.split(text, r"(?m)\n{2,}|(?=^#{1,4}\s)"))


def clauses(text: Column) -> Column:
    """Pieces that begin at a clause mark such as (1) or (a)."""
    return _filled(F.split(text, r"(?=\(\d+\)\s|\([a-z]\)\s)"))


def strides(text: Column, size: int, step: int) -> Column:
    """Stretches of `size` characters, `step` apart."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), F.lit(step)), lambda i: F.substr(text, i, F.lit(size)))


def pack(pieces: Column, size: int = CHUNK_SIZE, min_size: int = MIN_SIZE, glue: str = "\n", oversize: Callable[[Column], Column] | None = None) -> Column:
    """Pieces joined in order as long as they fit; a chunk below min_size that cannot grow is dropped.

    A piece beyond `size` closes the open chunk and becomes oversize(piece), or an open chunk itself. One fold over
    the lengths finds where chunks start; the pieces are cut and joined once.
    """

    def step(state: Column, piece: Column) -> Column:
        grown = state["open"] + len(glue) + piece["n"]
        new = (state["open"] == 0) | (piece["n"] > size) | (grown > size)
        left = F.when(new, F.when(piece["n"] > size, 0).otherwise(piece["n"]) if oversize else piece["n"]).otherwise(grown)
        return F.struct(left.alias("open"), F.when(new, F.concat(state["starts"], F.array(piece["i"]))).otherwise(state["starts"]).alias("starts")).cast(_STATE)

    def cut(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p, i: F.struct(F.char_length(p).alias("n"), (i + 1).alias("i")))
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("starts")).cast(_STATE), step, lambda s: s["starts"])
        joined = let(starts, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(ps, a, F.coalesce(F.get(at, k + 1), F.size(ps) + 1) - a), glue)))
        if not oversize:
            return F.filter(joined, lambda c: F.char_length(c) >= min_size)
        long = F.filter(joined, lambda c: F.char_length(c) >= min(min_size, size + 1))
        return F.flatten(F.transform(long, lambda c: F.when(F.char_length(c) > size, oversize(c)).otherwise(F.array(c))))

    return let(pieces, cut)


def generic_split(text: Column, size: int = CHUNK_SIZE, min_size: int = MIN_SIZE) -> Column:
    """Paragraphs packed; long ones cut by length; the text's start if nothing is left."""
    packed = pack(paragraphs(text), size, min_size, "\n\n", lambda p: strides(p, size, size))
    return let(packed, lambda cs: F.when(F.size(cs) > 0, cs).when(strip(text) != "", F.array(F.substr(text, F.lit(1), F.lit(size)))).otherwise(_none()))


def hard_split(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences packed; what is still too long is cut into overlapping stretches."""
    packed = pack(F.split(text, r"(?<=[.!?])\s+"), size, 1, " ")
    return F.flatten(F.transform(packed, lambda c: F.when(F.char_length(c) <= size, F.array(c)).otherwise(strides(c, size, max(size - overlap, 1)))))


def overlapped(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Each chunk after the last characters of the one before it."""
    return let(chunks, lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, c).otherwise(strip(F.concat(F.right(F.get(cs, i - 1), F.lit(overlap)), F.lit(" "), c)))))


def chunk_text(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, min_size: int = MIN_SIZE) -> Column:
    """The generic chunker: paragraphs packed, long ones split by sentences, neighbours overlapping."""
    packed = pack(paragraphs(text), size, min_size, "\n\n", lambda p: hard_split(p, size, overlap))
    return overlapped(packed, overlap) if overlap > 0 else packed


def subchunk_article(text: Column, article: Column, size: int = CHUNK_SIZE, min_size: int = MIN_SIZE) -> Column:
    """A long article by clauses; from the second chunk on each says that it continues."""
    prefix = F.when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("[Article "), article, F.lit("] (continued) "))).otherwise("")
    whole = F.transform(generic_split(text, size, min_size), lambda c: F.concat(prefix, c))

    def by_clauses(pieces: Column) -> Column:
        packed = F.transform(pack(pieces, size, min_size), lambda c, i: F.when(i > 0, F.concat(prefix, c)).otherwise(c))
        cut = F.flatten(F.transform(packed, lambda c: F.when(F.char_length(c) <= size, F.array(c)).otherwise(F.transform(generic_split(c, size, min_size), lambda s: F.concat(prefix, s)))))
        return let(cut, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.substr(text, F.lit(1), F.lit(size)))))

    return let(clauses(text), lambda pieces: F.when(F.size(pieces) <= 1, whole).otherwise(by_clauses(pieces)))


def exploded(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_id, text): a row for each chunk, numbered from 0 within its document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("chunk_id", "text"))
