"""Plan shapes shared by the operators: running scans, interval joins, reports."""
