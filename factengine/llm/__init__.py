"""Training-data operators: near-duplicates, mixing, quality, extraction, sharding, licences, tokens, WARC, top-k, joins."""
