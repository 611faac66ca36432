"""Conversation analytics on Spark: transcripts, speakers, embeddings and streams."""
