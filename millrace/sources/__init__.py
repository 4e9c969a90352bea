"""Reading delimited files, checking, numbering and publishing tables."""
