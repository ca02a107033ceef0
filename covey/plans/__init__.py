"""Query plans: from a specification and series to results."""
