"""Raw payload shapes built from plain text, for the bridge tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, words


def word_index(text: Column) -> Column:
    """word -> positions map of a text, the shape abstracts are served in."""

    def runs(placed: Column) -> Column:
        last = F.size(placed) - 1
        starts = F.filter(
            F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(placed, i)["w"] != F.get(placed, i - 1)["w"]))
        return bind(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            F.get(placed, at)["w"].alias("key"),
            F.transform(F.slice(placed, at + 1, F.coalesce(F.get(s, k + 1), F.size(placed)) - at),
                        lambda e: e["i"]).alias("value"))))

    placed = F.array_sort(F.transform(words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.map_from_entries(bind(placed, runs))
