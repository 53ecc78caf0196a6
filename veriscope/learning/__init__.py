"""Classifiers, vectors and remote scorers that produce the predictions to audit."""
