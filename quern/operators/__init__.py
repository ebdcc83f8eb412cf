"""DataFrame operators: digest, retrieval, prompts, evaluation, reporting."""
