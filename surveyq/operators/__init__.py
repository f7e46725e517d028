"""DataFrame-to-DataFrame operators: joins, aggregates, waterfalls, matching."""
