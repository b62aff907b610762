"""blockloom: stat-block extraction, publishing and browsing as Spark plans."""
