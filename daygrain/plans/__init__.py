"""Query plans: the named queries, their SQL oracles and the feature build."""
