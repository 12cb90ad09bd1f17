"""Readers and writers: plain text, Markdown chapters, e-book archives, HTML, JSON lines, WAV, paged services."""
