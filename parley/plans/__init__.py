"""Building blocks of plans that several operators share."""
