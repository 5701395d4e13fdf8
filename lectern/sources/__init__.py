"""Readers: HTML blocks, packaged books, stored tables, batch outputs."""
