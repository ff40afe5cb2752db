"""DataFrame -> DataFrame operators: scorers, edits, corpus dataflows, metrics."""
