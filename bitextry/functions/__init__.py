"""Column functions: text clean-up, tokenizers, chat messages, token arrays and metric kernels."""
