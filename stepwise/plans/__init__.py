"""Query plans over the driver's tables: fixtures, registry and oracles."""
