"""Readers: tables of a folder, and trade-document views over them."""
