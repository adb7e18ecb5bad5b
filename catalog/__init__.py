"""Named queries over the test tables, each with the SQL that should give the same rows."""
