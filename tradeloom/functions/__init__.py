"""Column functions: text, codes, money, documents."""
