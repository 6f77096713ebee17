"""markup of the lexicon engine."""
