"""Named queries: every entry is a function (spark, sf_dir) -> DataFrame."""
