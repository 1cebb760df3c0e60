"""From statements to DataFrames: names, types, access paths, plan tags."""
