"""DataFrame operators: daily roll-ups, nested lists, spine, windows, models."""
