"""Where utterances come from."""
