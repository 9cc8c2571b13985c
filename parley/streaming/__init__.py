"""The analyses that need no statistics of the whole corpus, over streams of utterance lines."""

from parley.streaming.live import running_speakers, running_words, stream_lines, stream_search  # noqa: F401
