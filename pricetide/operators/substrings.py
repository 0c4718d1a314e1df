"""Which of very many short strings (needles) does a text contain?

Trying every needle on every text costs texts x needles. Here a needle is filed under its first
letters, at most ``REACH`` of them, and a text is cut at each place into pieces of just the lengths
that occur among those keys, so pieces and keys meet in an ordinary equality join: one lookup a place
and length, whatever the number of needles. Needles longer than their key are verified. Spark
broadcasts the needles where it measures them as small and shuffles both sides otherwise; equal texts are
searched once.

Searched by keys, a text meets only its own key's needles, and nearly all its pieces are in none of them. A
key's needles then mark bits of a bitmap of fixed size, and a piece whose bit is not set goes no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 16
MARK_WORDS = 64  # of 64 bits each; a bitmap full of marks lets every piece through and costs no more than that


def starts(text: Column, reach: int) -> Column:
    """From each place of a text that is not empty, the letters a key may have."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda at: F.substr(text, at, F.lit(reach)))


def _mark(piece: Column) -> tuple[Column, Column]:
    """The word of the bitmap that a piece falls on, and the bit in it."""
    place = F.pmod(F.xxhash64(piece), F.lit(64 * MARK_WORDS)).cast("int")
    return F.shiftright(place, 6), F.pmod(place, F.lit(64))


def marks(filed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, marks ARRAY<BIGINT>``: the bitmap of each key's pieces."""
    word, bit = _mark(F.col("piece"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = filed.groupBy(*keys, word.alias("word")).agg(F.bit_or(one).alias("bits"))
    by_word = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"))
    all_words = F.transform(F.sequence(F.lit(0), F.lit(MARK_WORDS - 1)), lambda w: F.coalesce(
        F.try_element_at("by_word", w), F.lit(0).cast("bigint")))
    return by_word.select(*keys, all_words.alias("marks"))


def marked_pieces(text: Column, sizes: Column, bitmap: Column) -> Column:
    """``ARRAY<STRUCT<place, piece>>``: pieces of a text, of the given lengths, whose bit is set. Places count from 1."""
    def of_size(size: Column) -> Column:
        places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
        pieces = F.transform(places, lambda at: F.struct(at.alias("place"), F.substr(text, at, size).alias("piece")))

        def is_marked(p: Column) -> Column:
            word, bit = _mark(p["piece"])
            return F.getbit(F.get(bitmap, word), bit) == 1

        return F.filter(pieces, is_marked)

    return F.flatten(F.array_compact(F.transform(sizes, of_size)))


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str, keys: list[str] | None = None,
               reach: int = REACH) -> DataFrame:
    """``keys, text`` and the columns of ``needles``: a row for each text and needle that it contains.

    With ``keys`` a text is searched for the needles of its own keys only. A null or empty text contains
    nothing, a null or empty needle is in nothing; repeated texts count once, repeated needles each. Names
    of the two tables must differ but for ``keys``.
    """
    keys = keys or []
    filed = needles.where(F.length(needle) > 0).withColumn("piece", F.left(needle, F.lit(reach)))
    searched = texts.where(F.length(text) > 0).select(*keys, text).distinct()
    if keys:
        # at most ``reach`` lengths and ``MARK_WORDS`` words a key
        sizes = filed.groupBy(*keys).agg(F.collect_set(F.length("piece")).alias("sizes"))
        cut = searched.join(sizes, keys).join(marks(filed, keys), keys).select(
            *keys, text, F.explode(marked_pieces(F.col(text), F.col("sizes"), F.col("marks"))).alias("p")).select(*keys, text, "p.*")
    else:
        sized = searched.withColumn("sizes", filed.agg(F.collect_set(F.length("piece"))).scalar())
        placed = sized.select(text, "sizes", F.posexplode(starts(F.col(text), reach)).alias("place", "start"))
        cut = placed.select(text, (F.col("place") + 1).alias("place"), "start", F.explode("sizes").alias("size")).where(
            F.length("start") >= F.col("size")).select(text, "place", F.left("start", F.col("size")).alias("piece"))
    # a needle counts at its first place, so each text gives it once
    first = F.instr(F.col(text), F.col(needle)) == F.col("place")
    return cut.join(filed, [*keys, "piece"]).where(first).drop("piece", "place")
