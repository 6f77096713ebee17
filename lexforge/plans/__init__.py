"""plans of the lexicon engine."""
