"""operators of the lexicon engine."""
