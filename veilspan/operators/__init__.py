"""DataFrame operators that SQL does not express."""
