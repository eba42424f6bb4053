"""Text preparation: personal data, near duplicates, garbled text, tokens, packing and truncation. Nothing else imports this."""
