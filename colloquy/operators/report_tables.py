"""The six tables of a report from coded posts and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquy.config import Thresholds
from colloquy.operators import emergent, fuzzy, profile


def report_tables(posts: DataFrame, themes: DataFrame, key: str, community: str, tertile: str, body_length: str, communities: list[str], limits: Thresholds | None = None) -> dict[str, DataFrame]:
    """Tables by name. ``posts`` has deductive_codes; ``themes`` has label, community, post, seq and what a catalogue shows.

    The flags of posts are made once for the tables that count posts.
    """
    t = limits or Thresholds()
    flags = profile.post_flags(posts, key, community, extra=(tertile, body_length))
    canon = fuzzy.canonical_labels(themes, "label", "seq", t.label_score)
    return {
        "community_profile": profile.community_profile(flags, community),
        "tertile_sensitivity": profile.tertile_sensitivity(flags, community, tertile, body_length, t),
        "emergent_catalogue": emergent.theme_catalogue(themes, canon, "label", "community", "post", "seq", t.least_posts_of_theme),
        "cooccurrence": profile.cooccurrence(posts, community, communities),
        "subcode_frequency": profile.subcode_frequency(flags),
        "code_heatmap": profile.code_heatmap(flags, community, posts.select(community).distinct()),
    }
