"""Reading corpora, predictions and lexicons; writing results and models."""
