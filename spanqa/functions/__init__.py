"""Column builders: byte arithmetic, spans, character classes, languages."""
