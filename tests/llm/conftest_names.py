#: Names that operators use themselves.
CLASHING = ["gone", "p_top", "expected_grade", "lines_dropped", "copy", "at", "__gone", "id", "class", "row", "mark", "tokens", "of", "block", "whole", "left", "digest", "pos", "cluster", "shard", "bin_id", "kept", "component_id", "n_tokens", "a.b", "c0"]
