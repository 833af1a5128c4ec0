"""Sources and sinks: readers, fixture adapters over the test tables, writers and bundles."""
