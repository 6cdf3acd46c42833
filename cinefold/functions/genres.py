"""Expressions over the genre strings and genre profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the placeholder of a movie without genres.
NO_GENRES = "(no genres listed)"


def tokens(genres: Column | str) -> Column:
    """The genre string cut at each `|`; empty tokens and repeats stay."""
    return F.split(genres, r"\|")


def profile_map(profile: Column | str) -> Column:
    """An array of (genre, proportion) as a map; null becomes the empty map."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.map_from_entries(profile), empty)
