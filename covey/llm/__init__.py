"""Training-data operators: each module is one operator with its query; nothing outside this package imports it."""
