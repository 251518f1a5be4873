"""DataFrame operators: joins, patches, text overlap, statistics, splits."""
