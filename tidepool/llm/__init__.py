"""Training-data operators: near-dedup, search, substring dedup, language ID,
HTML extraction, mixing, chat formatting, secret scans, sharding and
benchmark decontamination. Nothing outside this folder imports it."""
