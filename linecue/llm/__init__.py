"""Corpus preparation operators (quality, dedup, tokens, archives, decontamination)."""
