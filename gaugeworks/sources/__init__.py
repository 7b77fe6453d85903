"""From tables and files to series, and from series to JSON."""
