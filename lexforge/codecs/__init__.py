"""codecs of the lexicon engine."""
