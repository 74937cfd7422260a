"""Readers for tables, media listings, gazetteers and import sidecars."""
