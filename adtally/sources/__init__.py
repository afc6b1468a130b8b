"""Readers and writers: fact tables, landed report files and API replies."""
