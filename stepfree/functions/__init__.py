"""Part of stepfree; see README.md."""
