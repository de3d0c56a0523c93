"""Column functions: text, stemming, codecs and scoring."""
