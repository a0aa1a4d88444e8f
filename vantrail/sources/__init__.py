"""Readers: track files, season metadata, tables, and the track view over an event table."""
