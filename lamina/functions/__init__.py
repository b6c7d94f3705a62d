"""Column functions over strings, spans and boxes."""
