"""Registered queries: each module has QUERIES (name -> function of session and folder) and SQL (name -> the same in ANSI SQL)."""
