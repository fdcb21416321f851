"""Training-data operators: decontamination, language, licences, dedup, secrets,
toxicity, tokenization and quality. Nothing outside this package imports it."""
