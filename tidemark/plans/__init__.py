"""Plan shapes shared by the operators: ordered scans, skew-safe lookups, bounded lists, SQL jobs."""
