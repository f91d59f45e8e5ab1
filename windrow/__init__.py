"""windrow: array-valued window tables, interval algebra, scoring and audits on Spark."""
