"""The analyses as callables: choose the settings once, call with utterances as often as wanted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from parley.functions import text as X
from parley.operators import centroid, keynet, lexrank, segment, stats


@dataclass(frozen=True)
class Keyphrases:
    """``lexrank.keyphrases``."""

    method: str = "naive"
    weighted: bool = False
    max_words: int | None = 50
    pattern: str = X.TOKEN

    def __call__(self, utterances: DataFrame, speakers: list[str] | None = None, use_main: bool = False, top: int = 5) -> DataFrame:
        return lexrank.keyphrases(utterances, speakers, use_main, top, self.max_words, self.method, self.weighted, pattern=self.pattern)


@dataclass(frozen=True)
class Summary:
    """``centroid.summarize``."""

    method: str = "first"
    n: int = centroid.CANDIDATES
    threshold: float = 10.0

    def __call__(self, utterances: DataFrame, length: int = 5) -> DataFrame:
        return centroid.summarize(utterances, self.method, self.n, length, self.threshold)


@dataclass(frozen=True)
class KeywordNetwork:
    """``keynet.build_keywords``: nodes and edges."""

    top: int = keynet.KEYWORDS
    focus_doc: int | None = None
    by_entities: bool = False

    def __call__(self, utterances: DataFrame, speakers: list[str] | None = None, use_main: bool = True, window: int = 10) -> tuple[DataFrame, DataFrame]:
        return keynet.build_keywords(utterances, speakers, use_main, window, self.top, self.focus_doc, self.by_entities)


@dataclass(frozen=True)
class Segmentation:
    """``segment.segments``, or with ``plot`` what a chart of it shows."""

    tiling: segment.Tiling = segment.Tiling()

    def __call__(self, utterances: DataFrame, plot: bool = False) -> DataFrame:
        return segment.plot_data(utterances, self.tiling) if plot else segment.segments(utterances, self.tiling)


@dataclass(frozen=True)
class Entities:
    """``stats.entity_counts``, ranked."""

    recogniser: stats.Recogniser | None = None
    top: int | None = None

    def __call__(self, utterances: DataFrame) -> DataFrame:
        return stats.entity_counts(utterances, recogniser=self.recogniser, ranked=True, top=self.top)
