"""Evaluation that can be stopped and taken up again."""
