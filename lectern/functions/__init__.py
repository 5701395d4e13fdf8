"""Column functions: text, titles, SSML, chunks, audio."""
