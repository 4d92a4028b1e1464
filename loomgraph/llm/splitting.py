"""Cutting oversized texts at natural boundaries with one bounded regular expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of a text are matched as Latin-1 characters, so what is not ASCII is written as its UTF-8 bytes.
#: Line ends: CR LF, LF, CR, U+2028, U+2029, U+0085.
_LINE = r"(?=[\n\r\xE2\xC2])(?:\r\n|\n|\r|\xE2\x80[\xA8\xA9]|\xC2\x85)"
#: What opens a claim, a numbered paragraph or a bracketed heading: "12. ", "[0012]", U+3010.
_OPENING = r"(?=\d{1,4}\s?[.)]|\[\d{4,5}\]|\xE3\x80\x90)"
#: No byte that continues a character.
_START = r"(?![\x80-\xBF])"

#: What ends a piece, strongest first, and its bytes at most: blank line, line before an opening, line, sentence, clause, word.
#: The full stops and commas of scripts that put no space after them: U+3002 U+FF01 U+FF1F U+FF1B, U+3001 U+FF0C U+FF1A.
BOUNDARIES = (
    (rf"{_LINE}{_LINE}", 6),
    (rf"{_LINE}{_OPENING}", 3),
    (_LINE, 3),
    (r"(?:[.!?;][\t ]|\xE3\x80\x82|\xEF\xBC[\x81\x9F\x9B])", 3),
    (r"(?:[,:)][\t ]|\xE3\x80\x81|\xEF\xBC[\x8C\x9A])", 3),
    (r"(?:[\t ]|\xE3\x80\x80)", 3),
)


def _alternatives(limit: int) -> str:
    """Alternatives for one piece; each but the last runs from the largest size down to half of the limit."""
    cuts = [rf"[\x00-\xFF]{{{limit // 2},{limit - n}}}{b}" for b, n in BOUNDARIES if limit - n >= max(1, limit // 2)]
    return "|".join([rf"[\x00-\xFF]{{1,{limit}}}+\z", *cuts, rf"[\x00-\xFF]{{1,{limit}}}{_START}", r"[\x00-\xFF]"])


def cut_pattern(limit: int, overlap: int) -> str:
    """Consecutive matches are the pieces without their overlap: the first takes up to ``limit``, the others leave room.

    Three bytes of that room are for the character in whose middle an overlap would start.
    """
    if overlap < 0 or limit - overlap - 3 < 4:
        raise ValueError("the limit must exceed the overlap by more than one character")
    return rf"\A(?:{_alternatives(limit)})|(?:{_alternatives(limit - overlap - 3 if overlap else limit)})"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Pieces whose ends are summed one by one; the sums of such stretches are added up before.
_STRETCH = 128


def _ends(lengths: Column) -> Column:
    """0 and the running sums of an array. Only one number a stretch is appended to an array, so long texts are not copied again and again."""
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda a, n: a + n)

    def of(n: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / _STRETCH).cast("int")), lambda b: total(F.slice(n, b * _STRETCH + 1, F.lit(_STRETCH))))
        before = F.aggregate(starts, F.array(zero), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        at = lambda i: F.floor(i / _STRETCH).cast("int")
        return _once(before, lambda b: F.transform(F.sequence(F.lit(0), F.size(n)), lambda i: F.get(b, at(i)) + total(F.slice(n, at(i) * _STRETCH + 1, (i % _STRETCH).cast("int")))))

    return _once(lengths, of)


def _continues(data: Column, i: Column) -> Column:
    """The byte at offset ``i`` continues a character."""
    byte = F.substring(data, (i + 1).cast("int"), F.lit(1))
    return (byte >= F.lit(b"\x80")) & (byte <= F.lit(b"\xbf"))


def split_texts(docs: DataFrame, limit: int, overlap: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, n_pieces, start, tokens, overlap, text)``: ordered pieces of at most ``limit`` byte-level tokens.

    A text above ``limit`` is cut where a boundary lies in the second half of the room a piece has: before a claim,
    numbered paragraph or heading, after a line, sentence, clause or word, else between two characters. Every
    piece but the first repeats the last ``overlap`` tokens before it; where that would start inside a character, up to three
    more. Dropping each piece's ``overlap`` tokens and joining the rest gives the text back. Texts within the limit,
    empty ones too, are one piece; null texts give none. Repeated ids are split each on their own, null ids stay null.

    The text is matched as one Latin-1 character per byte, so the quantifiers count tokens. All work is per row in the JVM,
    with no shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("binary").alias("_data")).where(F.col("_data").isNotNull())
    data, size, zero = F.col("_data"), F.octet_length("_data").cast("long"), F.lit(0).cast("long")
    cores = F.regexp_extract_all(F.decode("_data", "ISO-8859-1"), F.lit(cut_pattern(limit, overlap)), 0)
    lengths = F.when(size <= limit, F.array(size)).otherwise(F.transform(cores, lambda c: F.length(c).cast("long")))

    def spans(ends: Column) -> Column:
        def piece(i: Column) -> Column:
            core, end = F.get(ends, i), F.get(ends, i + 1)
            at = F.greatest(core - overlap, zero)
            back = F.lit(3)
            for k in (2, 1, 0):
                back = F.when(~_continues(data, at - k), k).otherwise(back)
            start = F.when((i == 0) | F.lit(not overlap), core).otherwise(at - back)
            return F.struct(i.alias("piece"), start.alias("start"), core.alias("core"), end.alias("end"))

        return F.transform(F.sequence(F.lit(0), F.size(ends) - 2), piece)

    ends = _ends(lengths)
    cut = lambda s: F.struct(
        s["piece"].alias("piece"), s["start"].alias("start"), (s["end"] - s["start"]).alias("tokens"), (s["core"] - s["start"]).alias("overlap"),
        F.decode(F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8").alias("text"),
    )
    pieces = _once(ends, lambda e: F.transform(spans(e), cut))
    rows = rows.select("_doc", F.inline(_once(pieces, lambda p: F.transform(p, lambda x: F.struct(F.size(p).alias("n_pieces"), x.alias("x"))))))
    return rows.select(F.col("_doc").alias(doc_id), "x.piece", "n_pieces", "x.start", "x.tokens", "x.overlap", "x.text")
