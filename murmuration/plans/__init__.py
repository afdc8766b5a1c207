"""Entry points that compose operators: network analysis, topic report,
verified dictionary; plus the query catalogue with its SQL oracles."""
