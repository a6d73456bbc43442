"""Readers of posts, and services of embeddings and answers."""
