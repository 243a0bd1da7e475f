"""Set-based operators: matching, merging, folding, filtering and views."""
