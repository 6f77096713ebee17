"""sources of the lexicon engine."""
