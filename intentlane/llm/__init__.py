"""Training-data operators (language id, near-duplicates, extraction, quality,
mixing, LM scoring, token counts, toxicity, decontamination) as Spark jobs.
Nothing outside this subpackage imports it."""
