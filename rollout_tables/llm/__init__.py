"""Training-data operators: decontamination, substring and near-duplicate
removal, PII surrogates, quality and toxicity scores, tokenization, vector
search, chat formatting and language-model scores. Nothing outside this
subpackage imports it."""
