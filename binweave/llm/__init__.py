"""Training-data operators: archives, extraction, classifiers, joins and tokenizers."""
