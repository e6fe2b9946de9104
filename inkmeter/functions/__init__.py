"""Column builders: pattern dialect, text normalisation, tokens, markers, cleaning, statistics."""
