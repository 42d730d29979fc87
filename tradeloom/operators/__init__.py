"""Relational operators on trade-document tables. All take and return DataFrames."""
