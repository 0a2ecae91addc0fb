"""Job parameters.

The default limits are fixed values of the collection, enrichment and
clustering rules; ``None`` for a limit means "no limit".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from narrata.functions.stopwords import ENGLISH_STOP_WORDS


@dataclass(frozen=True)
class CollectSettings:
    communities: tuple[str, ...] = ("politics", "conspiracy", "worldnews", "Conservative")
    top_limit: int | None = 50
    hot_limit: int | None = 50
    min_comments: int = 10
    min_score: int = 10
    max_comments_per_post: int | None = 50
    top_comments: int = 10
    # Instant the one-month window of the top listing ends at. None: jobs take the collection date.
    as_of: str | None = None
    # False lists over all time.
    month_window: bool = True
    # True writes the literal 'None' for a missing author, pooling them as one user.
    literal_none_author: bool = False


@dataclass(frozen=True)
class ClusterSettings:
    vector_size: int = 768
    components: int = 50
    min_cluster_size: int = 10
    min_samples: int = 5


@dataclass(frozen=True)
class ReportSettings:
    keywords: int = 10
    sample_titles: int = 5
    top_authors: int = 3
    sample_seed: str = "0"
    burst_seconds: int = 3600
    author_posts: int = 4
    exclude_noise: bool = False
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS


@dataclass(frozen=True)
class Settings:
    collect: CollectSettings = field(default_factory=CollectSettings)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)
    report: ReportSettings = field(default_factory=ReportSettings)
