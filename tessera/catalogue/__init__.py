"""Named queries over the test tables, with SQL that another engine can run for the same result."""
