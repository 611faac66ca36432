"""Training-data operators: formatting, filters, deduplication, decontamination, tokenisation."""
