"""Plans over change logs: validation, replay, links, compaction. Pure functions of DataFrames."""
