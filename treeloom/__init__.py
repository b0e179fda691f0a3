"""Tree-shaped documents as Spark columns, tables and text."""
