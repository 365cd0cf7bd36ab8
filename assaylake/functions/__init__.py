"""Column expressions: numbers, texts and chemistry notation."""
