"""Operators over the model: lineage, artifacts, edges, similarity, cues, references."""
