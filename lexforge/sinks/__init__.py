"""sinks of the lexicon engine."""
