"""Spark-native curation and evaluation of question-answer and document data."""
