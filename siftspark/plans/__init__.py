"""Named plans over the test tables, each with the SQL that gives the same rows, and the composite pipelines."""
