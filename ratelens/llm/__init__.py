"""Operators that prepare text, chats, media and embeddings for language-model training."""
