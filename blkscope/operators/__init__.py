"""Order, derivation, filters, statistics, samples and points over trace tables."""
