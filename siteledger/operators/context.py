"""Contexts of candidates for review, shortened to a limit of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_BYTES = 24 * 1024


def first_bytes(text: Column, limit: Column) -> Column:
    """The longest start of text of at most limit UTF-8 bytes."""
    raw = lambda n: F.substring(F.encode(text, "UTF-8"), F.lit(1), n.cast("int"))
    # a character cut in two has its first bytes at the end
    tries = [F.try_validate_utf8(raw(F.greatest(limit - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*tries))


def fitted(meta: Column, excerpt: Column, enclosing: Column, related: Column, most: int = CONTEXT_BYTES) -> Column:
    """struct of excerpt, enclosing, related (array of strings), truncated flags and fits, whose JSON with meta has most bytes or less.

    What is too much goes from the last related site that has text left, then the one before it, then the enclosing source, then the excerpt. fits
    is false where meta alone is too long. At each step a text loses as many bytes as are too much, so it ends empty or
    the whole fits, and there are no more steps than texts.
    """
    start = F.struct(excerpt.alias("excerpt"), F.lit(False).alias("excerpt_truncated"), enclosing.alias("enclosing"), F.lit(False).alias("enclosing_truncated"), F.transform(related, lambda r: F.struct(r.alias("text"), F.lit(False).alias("truncated"))).alias("related"))
    size = lambda s: F.octet_length(F.to_json(F.struct(meta.alias("meta"), s.alias("context"))))

    def step(s: Column, _: Column) -> Column:
        def with_excess(excess: Column) -> Column:
            sites = s["related"]
            last = F.array_max(F.transform(sites, lambda r, i: F.when(F.octet_length(r["text"]) > 0, i).otherwise(F.lit(-1))))
            short = lambda t: first_bytes(t, F.greatest(F.octet_length(t) - excess, F.lit(0)))
            some, inner, own = F.coalesce(last, F.lit(-1)) >= 0, F.coalesce(F.octet_length(s["enclosing"]), F.lit(0)) > 0, F.coalesce(F.octet_length(s["excerpt"]), F.lit(0)) > 0
            on_inner, on_own = ~some & inner, ~some & ~inner & own
            new = F.transform(sites, lambda r, i: F.when(some & (i == last), F.struct(short(r["text"]).alias("text"), F.lit(True).alias("truncated"))).otherwise(r))
            smaller = F.struct(
                F.when(on_own, short(s["excerpt"])).otherwise(s["excerpt"]).alias("excerpt"), (s["excerpt_truncated"] | on_own).alias("excerpt_truncated"),
                F.when(on_inner, short(s["enclosing"])).otherwise(s["enclosing"]).alias("enclosing"), (s["enclosing_truncated"] | on_inner).alias("enclosing_truncated"), new.alias("related"),
            )
            return F.when(excess > 0, smaller).otherwise(s)

        return F.transform(F.array(size(s) - most), with_excess)[0]

    done = F.aggregate(F.sequence(F.lit(1), F.size(related) + 2), start, step)
    return F.transform(F.array(done), lambda s: F.struct(s["excerpt"].alias("excerpt"), s["excerpt_truncated"].alias("excerpt_truncated"), s["enclosing"].alias("enclosing"), s["enclosing_truncated"].alias("enclosing_truncated"), s["related"].alias("related"), (size(s) <= most).alias("fits")))[0]
