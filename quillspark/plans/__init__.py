"""Relational building blocks: document-order windows, interval and as-of joins, tables of cells."""
