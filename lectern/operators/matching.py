"""Which texts hold which terms, for sets of terms of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, and bytes of terms that a plan may broadcast.
GRAM, BROADCAST_BYTES = 3, 32 << 20


def _grams(x: str):
    return F.expr(f"array_distinct(transform(sequence(1, length({x}) - {GRAM - 1}), i -> substring({x}, i, {GRAM})))")


def matches(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows (text, term) where the text holds the term; both frames have distinct values.

    A term of three characters and more is looked for only in texts that share its rarest gram, by an equi-join; shorter ones
    are held against every text, since there are at most as many of them as pairs of characters."""
    t, w = texts.select(F.col(text).alias("__t")), terms.select(F.col(term).alias("__w")).where(F.length(term) > 0)
    short = w.where(F.length("__w") < GRAM)
    size = short.agg(F.sum(F.octet_length("__w") + 16)).first()[0] or 0
    found = t.join(F.broadcast(short) if size <= BROADCAST_BYTES else short, F.col("__t").contains(F.col("__w"))) if size else None
    posts = t.where(F.length("__t") >= GRAM).select("__t", F.explode(_grams("__t")).alias("gram"))
    own = w.where(F.length("__w") >= GRAM).select("__w", F.explode(_grams("__w")).alias("gram"))
    many = posts.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text has comes first: such a term is in no text
    rarest = own.join(many, "gram", "left").groupBy("__w").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    long = posts.join(rarest, "gram").where(F.col("__t").contains(F.col("__w"))).select("__t", "__w")
    out = long if found is None else long.unionByName(found.select("__t", "__w"))
    return out.select(F.col("__t").alias(text), F.col("__w").alias(term))
